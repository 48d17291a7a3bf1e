"""Operator 13: fill-in-middle transformation, cut by a sparse checkpoint index."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from ._runs import tidy
from ._store import fresh
from ._text import column_bytes

EVERY, SLICE = 512, 1 << 20
UNITS = ("code point", "word", "line")
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True


@dataclass(frozen=True)
class Form:
    """How documents are cut and put together; rates are per cent.

    ``seed`` and the document's id decide the two cuts and the form.  A unit is a code point, a word (with the blanks
    after it; blanks before the first word are a unit) or a line (with its line feed).
    """

    seed: int = 1
    fim_rate: int = 90
    spm_rate: int = 20
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    unit: str = "code point"
    every: int = EVERY

    def __post_init__(self):
        marks = self.marks
        if not all(marks) or len(set(marks)) < 3:
            raise ValueError("three different marks are needed")
        for a in marks:
            for b in marks:
                if a != b and a in b or any(a.startswith(b[k:]) for k in range(1, len(b))):
                    raise ValueError(f"marks overlap: {a!r}, {b!r}")  # else a cut text could show a mark across a border
        if self.unit not in UNITS or self.every < 1:
            raise ValueError(f"unit must be one of {UNITS}, every at least 1")

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def _unit_starts(data: np.ndarray, before: int, unit: str) -> np.ndarray:
    """Whether a unit starts at each byte; ``before`` is the byte in front, -1 at the start of a text."""
    if unit == "code point":
        return (data & 0xC0) != 0x80
    last = np.empty(len(data), np.uint8)
    last[1:], last[0] = data[:-1], max(before, 0)
    found = last == 10 if unit == "line" else ~_GAP[data] & _GAP[last]
    if before < 0:
        found[0] = True
    return found


class Checkpoints:
    """Byte and code-point offsets of every ``every``-th unit of a UTF-8 text, noted while its units are counted.

    The text is gone over in slices, so counting takes memory for a slice and the checkpoints alone.
    """

    def __init__(self, data: np.ndarray, unit: str = "code point", every: int = EVERY):
        self.data, self.unit = data, unit
        units, at_bytes, at_chars = [], [], []
        n = chars = 0
        for base in range(0, len(data), SLICE):
            part = data[base : base + SLICE]
            starts = np.flatnonzero(_unit_starts(part, int(data[base - 1]) if base else -1, unit))
            marked = starts[-n % every :: every]
            units.append(np.arange(n + (-n % every), n + len(starts), every))
            at_bytes.append(marked + base)
            if unit == "code point":
                at_chars.append(units[-1])
                n += len(starts)
                chars = n
            else:
                letters = np.flatnonzero((part & 0xC0) != 0x80)
                at_chars.append(chars + np.searchsorted(letters, marked))
                n, chars = n + len(starts), chars + len(letters)
        self.n, self.chars = n, chars  # of the whole text
        self.units = np.concatenate([*units, [n]]).astype(np.int64)
        self.bytes = np.concatenate([*at_bytes, [len(data)]]).astype(np.int64)
        self.at_chars = np.concatenate([*at_chars, [chars]]).astype(np.int64)

    def cut(self, unit: int) -> tuple[int, int]:
        """Byte and code-point offset where ``unit`` (0 to n) starts: a binary search for the last checkpoint at or before it,
        then a rescan from there, at most to the next checkpoint."""
        if unit >= self.n:
            return len(self.data), self.chars
        k = int(np.searchsorted(self.units, unit, "right")) - 1
        first, left = int(self.bytes[k]), unit - int(self.units[k])
        if not left:
            return first, int(self.at_chars[k])
        part = self.data[first : int(self.bytes[k + 1])]
        at = int(np.flatnonzero(_unit_starts(part, int(self.data[first - 1]) if first else -1, self.unit))[left])
        return first + at, int(self.at_chars[k]) + int(np.count_nonzero((part[:at] & 0xC0) != 0x80))


def _draws(form: Form, doc_id: Column) -> list[Column]:
    """Four numbers of 32 bits that the seed and the id decide; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{form.seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def fim_transform(docs: DataFrame, form: Form = Form()) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n (units), form, prefix_chars, middle_chars (code points), output.

    With h1 to h4 from the seed and the id, the prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1) units, the
    middle after the larger.  ``form`` is plain (the text as it is, null lengths) for a text that is empty or null or holds
    a mark, or where h3 % 100 >= fim_rate; else spm (suffix, prefix, middle) where h4 % 100 < spm_rate, else psm.  Parts may
    be empty.  Repeated rows give repeated results, other columns are left out.  Rows keep their partitions: nothing
    is shuffled, and a text is held as bytes, never as decoded characters.
    """
    ship(docs.sparkSession)
    prefix, suffix, middle = (m.encode() for m in form.marks)
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    taken = ["doc_id", "text"]
    names = [fresh(f"h{k}", taken) for k in range(4)]

    def run(batches):
        for batch in batches:
            texts = pc.fill_null(batch["text"], "")
            plain = pc.equal(pc.binary_length(texts), 0)
            for mark in form.marks:
                plain = pc.or_(plain, pc.match_substring(texts, mark))
            plain = pc.or_(plain, pc.greater_equal(batch[names[2]].to_numpy() % 100, form.fim_rate)).to_pylist()
            h1, h2, _, h4 = (batch[h].to_numpy() for h in names)
            data, offsets = column_bytes(texts)
            rows: list[tuple] = []
            for k in range(batch.num_rows):
                text = data[offsets[k] : offsets[k + 1]]
                index = Checkpoints(text, form.unit, form.every)
                if plain[k]:
                    rows.append((index.n, "plain", None, None, text.tobytes()))
                    continue
                first, last = sorted((int(h1[k]) % (index.n + 1), int(h2[k]) % (index.n + 1)))
                (a, chars_a), (b, chars_b) = index.cut(first), index.cut(last)
                p, m, s = text[:a].tobytes(), text[a:b].tobytes(), text[b:].tobytes()
                spm = int(h4[k]) % 100 < form.spm_rate
                out = [suffix, s, prefix, p, middle, m] if spm else [prefix, p, suffix, s, middle, m]
                rows.append((index.n, "spm" if spm else "psm", chars_a, chars_b - chars_a, b"".join(out)))
            n, kinds, prefixes, middles, outs = zip(*rows) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n, pa.int64()), pa.array(kinds, pa.string()), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()), pa.array(outs, pa.binary()).view(pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text"), *[h.alias(name) for h, name in zip(_draws(form, doc_id), names)]).mapInArrow(tidy(run), schema)


def restore(output: Column | str, kind: Column | str, form: Form = Form()) -> Column:
    """The text that fim_transform() made ``output`` from, by its form; a column of built-in functions.

    Cut texts hold no mark, so each mark is found where it was put.
    """
    output, kind = (F.col(c) if isinstance(c, str) else c for c in (output, kind))

    def between(left: str, right: str | None) -> Column:
        rest = F.substring(output, F.locate(left, output) + len(left), F.length(output))
        return rest if right is None else F.substring_index(rest, right, 1)

    psm = F.concat(between(form.prefix, form.suffix), between(form.middle, None), between(form.suffix, form.middle))
    spm = F.concat(between(form.prefix, form.middle), between(form.middle, None), between(form.suffix, form.prefix))
    return F.when(kind == "psm", psm).when(kind == "spm", spm).otherwise(output)


def op13_fim_checkpoints(spark, sf_dir: str) -> DataFrame:
    """All ``documents``, cut by code points and put together again."""
    made = fim_transform(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore("output", "form"), 256).alias("restored_sha256"))
