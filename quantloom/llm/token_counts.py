"""Operator 4: token counts by a compiled finite-state transducer."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from ._runs import tidy
from ._words import blocks, spaced_starts, tokenizer_path

_NEVER = 1 << 60


def _byte_alphabet() -> dict[str, int]:
    """The byte that each printable stand-in character of byte-level vocabularies means."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class BpeTransducer:
    """A deterministic transducer over bytes; a transition is annotated with the tokens that it emits.

    Along a pre-token, BPE of every prefix ends in one well-defined last token, and the encoding before that token is
    the encoding of the shorter prefix.  So a state needs, for every earlier position from which the bytes up to
    here begin some token (a trie node): the last token of the prefix that ended there and how many tokens
    it has, relative to the present prefix.  On a byte the trie nodes advance; of those that now are tokens
    exactly one may follow the last token where it starts, and it gives the new count.  A transition's annotation
    is the new count less the old one (0 or less when tokens merge), so annotations add up to the count of
    the whole.  States are numbered as they turn up; at ``most`` states the tables start anew.
    """

    START = 0

    def __init__(self, vocab: dict[str, int], merges: list, most: int = 250_000):
        alphabet = _byte_alphabet()
        self.most = most
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(merges):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            whole = vocab[left + right]
            self.rank[vocab[left], vocab[right]] = rank
            self.parts.setdefault(whole, (rank, vocab[left], vocab[right]))
        self.child: dict[int, int] = {}  # node * 256 + byte -> node
        self.token_at: dict[int, int] = {}
        nodes = 1
        for text, i in vocab.items():
            if i not in self.parts and len(text) > 1:
                continue  # not made by merges: BPE never gives it
            node = 0
            for c in text:
                key = node << 8 | alphabet[c]
                if key not in self.child:
                    self.child[key] = nodes
                    nodes += 1
                node = self.child[key]
            self.token_at[node] = i
        self.spines: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.follows: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple] = [((0, -1, 0),)]
        self.numbers = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, int]] = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The symbols at a token's right (side 2) or left (side 1) edge, smallest first, each with the merge rank that ends it."""
        key = token, side
        if key not in self.spines:
            out, ends = [], _NEVER
            while True:
                out.append((token, ends))
                if token not in self.parts:
                    break
                ends, token = self.parts[token][0], self.parts[token][side]
            self.spines[key] = out[::-1]
        return self.spines[key]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the bytes of ``a`` and ``b`` together are encoded as ``a, b``: no merge crosses at any time.

        The symbols at the border change as merges of rising rank make them larger; a crossing merge happens
        if its rank comes before both changes (at equal rank the left of two places merges first).
        """
        key = a, b
        if key not in self.follows:
            left, right, i, j, good = self._spine(a, 2), self._spine(b, 1), 0, 0, True
            while True:
                (x, x_ends), (y, y_ends) = left[i], right[j]
                r = self.rank.get((x, y))
                if r is not None and r < x_ends and r <= y_ends:
                    good = False
                    break
                if x_ends == y_ends == _NEVER:
                    break
                if x_ends <= y_ends:
                    i += 1
                else:
                    j += 1
            self.follows[key] = good
        return self.follows[key]

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """The next state and the emitted tokens."""
        key = state << 8 | byte
        move = self.moves.get(key)
        if move is None:
            move = self.moves[key] = self._compile(state, byte)
        return move

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        alive, last, emitted = [], -1, 0
        for node, before, count in self.states[state]:
            node = self.child.get(node << 8 | byte)
            if node is None:
                continue
            token = self.token_at.get(node)
            if token is not None and (before < 0 or self.may_follow(before, token)):
                last, emitted = token, count + 1
            alive.append((node, before, count))
        found = (*((n, t, c - emitted) for n, t, c in alive), (0, last, 0))
        number = self.numbers.get(found)
        if number is None:
            number = self.numbers[found] = len(self.states)
            self.states.append(found)
        return number, emitted

    def run(self, data: bytes, state: int = START) -> tuple[int, int]:
        emitted, moves = 0, self.moves
        for byte in data:
            move = moves.get(state << 8 | byte) or self.step(state, byte)
            state = move[0]
            emitted += move[1]
        return state, emitted


@dataclass
class ChunkMap:
    """What a chunk does to the transducer, for every state that it may be entered in.

    ``head`` are the bytes up to the first place where a pre-token starts; there any state gives way to the
    start state, so ``emitted`` tokens follow and ``state`` is left at the end whatever came in.  Without such
    a place (``state`` None) the chunk is all head.
    """

    head: bytes
    emitted: int = 0
    state: int | None = None

    def apply(self, machine: BpeTransducer, state: int) -> tuple[int, int]:
        state, n = machine.run(self.head, state)
        return (state, n) if self.state is None else (self.state, n + self.emitted)

    def then(self, after: ChunkMap, machine: BpeTransducer) -> ChunkMap:
        """The map of both chunks; the operation is associative."""
        if self.state is None:
            return ChunkMap(self.head + after.head, after.emitted, after.state)
        state, n = after.apply(machine, self.state)
        return ChunkMap(self.head, self.emitted + n, state)


def prefix_scan(maps: list[ChunkMap], machine: BpeTransducer) -> list[ChunkMap]:
    """Inclusive scan in log(n) rounds: in round r every element takes in the one 2**r before it."""
    maps, reach = list(maps), 1
    while reach < len(maps):
        maps = [m if k < reach else maps[k - reach].then(m, machine) for k, m in enumerate(maps)]
        reach *= 2
    return maps


_BLANKS = rb"[ \t\n\r\x0b\x0c]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
_RUN = re.compile(rb" (?=" + _BLANKS + rb"|\Z)")


class TokenCounter:
    """Token counts of whole texts, as the library's byte-level BPE gives them.

    A blank before a visible character always starts a pre-token, so texts without other runs of blanks
    are counted word by word from a cache; the transducer runs once over each distinct pre-token.  Other texts,
    and parts over ``chunk`` characters, go through chunk maps and their scan.
    """

    def __init__(self, file: str, chunk: int = 1 << 16, most_raw: int = 1_000_000):
        with open(tokenizer_path(file), encoding="utf-8") as f:
            spec = json.load(f)
        self.machine = BpeTransducer(spec["model"]["vocab"], spec["model"]["merges"])
        self.specials = [t["content"].encode() for t in spec["added_tokens"]]
        self.split = re.compile(b"|".join(map(re.escape, self.specials))) if self.specials else None
        self.chunk, self.most = chunk, most_raw
        self.raw: dict[bytes, int] = {}
        self.pre: dict[str, int] = {}

    def _pre_token(self, word: str) -> int:
        n = self.pre.get(word)
        if n is None:
            if len(self.machine.states) > self.machine.most:
                self.machine.reset()
            if len(self.pre) > self.most:
                self.pre = {}
            n = self.pre[word] = self.machine.run(word.encode("utf-8", "surrogatepass"))[1]
        return n

    def chunk_maps(self, text: str) -> list[ChunkMap]:
        """Maps of the text's slices of ``chunk`` characters, made without knowing what comes before a slice."""
        machine, starts, out = self.machine, spaced_starts(text).tolist(), []
        if len(machine.states) > machine.most:  # not while maps hold states
            machine.reset()
        encode, k = (lambda s: s.encode("utf-8", "surrogatepass")), 0
        for a in range(0, len(text), self.chunk):
            b = min(a + self.chunk, len(text))
            first, emitted = k, 0
            while k < len(starts) and starts[k] < b:
                k += 1
            own = starts[first:k]
            if not own:
                out.append(ChunkMap(encode(text[a:b])))
                continue
            for x, y in zip(own, own[1:]):
                word = text[x:y]
                n = self.pre.get(word)
                if n is None:
                    n = self.pre[word] = machine.run(encode(word))[1]
                emitted += n
            state, n = machine.run(encode(text[own[-1] : b]))
            out.append(ChunkMap(encode(text[a : own[0]]), emitted + n, state))
        return out

    def _mapped(self, text: str) -> int:
        total = 0
        for part in blocks(text):
            if part:
                total += prefix_scan(self.chunk_maps(part), self.machine)[-1].apply(self.machine, BpeTransducer.START)[1]
        return total

    def count(self, text: bytes) -> int:
        if self.split is not None and b"<|" in text:
            found = self.split.findall(text)
            if found:
                return len(found) + sum(map(self.count, self.split.split(text)))
        if not text:
            return 0
        if _RUN.search(text) or len(text) > 8 * self.chunk:
            return self._mapped(text.decode("utf-8", "surrogatepass"))
        first, *words = text.split(b" ")
        total = self._mapped(first.decode("utf-8", "surrogatepass")) if first else 0
        try:
            return total + sum(map(self.raw.__getitem__, words))
        except KeyError:
            self._learn(words)
            return total + sum(map(self.raw.__getitem__, words))

    def _learn(self, words: list[bytes]) -> None:
        if len(self.raw) > self.most:
            self.raw = {}
        new = [w for w in dict.fromkeys(words) if w not in self.raw]
        text = b"".join(b" " + w for w in new).decode("utf-8", "surrogatepass")
        ends, at = [], 0
        for w in new:
            at += 1 + (len(w) if w.isascii() else len(w.decode("utf-8", "surrogatepass")))
            ends.append(at)
        starts, counts, owner = spaced_starts(text).tolist(), [0] * len(new), 0
        for a, b in zip(starts, [*starts[1:], at]):
            while a >= ends[owner]:
                owner += 1
            counts[owner] += self._pre_token(text[a:b])
        self.raw.update(zip(new, counts))


@lru_cache(2)
def token_counter(file: str) -> TokenCounter:
    """One a Python worker; its tables serve all tasks that the worker runs."""
    return TokenCounter(file)


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_tokens, over_limit.

    A null text is empty: 0 bytes and tokens.  Rows keep their partitions: nothing is shuffled, and a long
    text is cut into chunks inside its task.
    """

    ship(docs.sparkSession)

    def run(batches):
        counter = token_counter(tokenizer)
        for batch in batches:
            texts = [t or b"" for t in batch["text"].cast(pa.binary()).to_pylist()]
            n = [counter.count(t) for t in texts]
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "n_bytes": pa.array(map(len, texts), pa.int64()), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([x > limit for x in n], pa.bool_())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op4_fst_token_counts(spark, sf_dir: str) -> DataFrame:
    """All ``documents``, counted."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
