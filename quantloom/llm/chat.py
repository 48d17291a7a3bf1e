"""Operator 9: chat formatting, every assistant turn an example of its own."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._store import Scratch

# fixed values: the control strings of the template
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]"]
_ESCAPED = re.compile(r"\\(?:(\\)|\.)")
ROLES = ("assistant",)


def escape(text: Column) -> Column:
    """Double backslashes, then part each control string after its first character by a backslash and a dot."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), r"([<\[])(?=/?s>|/?INST\])", r"$1\\.")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1] or "", text)


def format_turns(conversations: DataFrame, scratch: Scratch, roles=ROLES) -> tuple[DataFrame, DataFrame]:
    """Write the formatted turns and the examples of ``conversations`` (conv_id, turn, role, text); return both tables.

    A turn is formatted as ``<s>role[INST]text[/INST]</s>``, role and text escaped (a null is an empty string).
    A conversation's text is its segments in order of turn (equal turns: by role, then text; null first).

    Every turn of a role in ``roles`` is an example: all turns before it as context, only its own text trainable.
    Contexts repeat every earlier turn in every later example, so they are kept by reference: an example says
    how many turns and characters of the conversation's text come before its own segment and which
    characters ([target_start, target_end)) are under the loss mask.  Size stays linear in the input for any length of
    conversation; expand() gives the full texts.

    Rows are range-partitioned on (conv_id, turn), so a conversation may lie in many partitions; characters before a
    turn are running sums inside a partition plus the sums of a conversation's earlier partitions.
    """
    text = lambda name: escape(F.coalesce(F.col(name).cast("string"), F.lit("")))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text("role").alias("shown"), text("text").alias("body"), F.col("text").cast("string").alias("text"))
    made = rows.select("conv_id", "turn", "role", "text", F.length("shown").alias("role_chars"), F.concat(F.lit("<s>"), "shown", F.lit("[INST]"), "body", F.lit("[/INST]</s>")).alias("segment"), F.col("role").isin(*roles).alias("target"))
    ordered = made.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text").drop("role", "text")

    def number(batches):
        part, conv, seq, chars, first = TaskContext.get().partitionId(), None, 0, 0, True
        for batch in batches:
            seqs, before, sizes = [], [], pc.utf8_length(batch["segment"]).to_pylist()
            for c, n in zip(batch["conv_id"].to_pylist(), sizes):
                if first or c != conv:
                    conv, seq, chars, first = c, 0, 0, False
                seqs.append(seq)
                before.append(chars)
                seq, chars = seq + 1, chars + n
            n = batch.num_rows
            yield pa.RecordBatch.from_pydict({"conv_id": batch["conv_id"], "part": pa.array([part] * n, pa.int32()), "seq": pa.array(seqs, pa.int64()), "turn": batch["turn"], "role_chars": batch["role_chars"], "segment": batch["segment"], "target": batch["target"], "chars": pa.array(sizes, pa.int64()), "before": pa.array(before, pa.int64())})

    numbered = scratch.write(ordered.mapInArrow(number, "conv_id long, part int, seq long, turn long, role_chars int, segment string, target boolean, chars long, before long"), "segments")
    parts = numbered.groupBy("conv_id", "part").agg(F.count("*").alias("turns"), F.sum("chars").alias("chars"))
    earlier = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    shifts = parts.select("conv_id", "part", F.sum("turns").over(earlier).alias("add_turns"), F.sum("chars").over(earlier).alias("add_chars")).where("add_turns > 0")
    joined = numbered.join(shifts.withColumnsRenamed({"conv_id": "c", "part": "p"}), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left")
    turns = joined.select("conv_id", (F.col("seq") + F.coalesce("add_turns", F.lit(0))).alias("seq"), "turn", "role_chars", "segment", "target", "chars", (F.col("before") + F.coalesce("add_chars", F.lit(0))).alias("context_chars"))
    turns = scratch.write(turns, "turns")
    start = F.col("context_chars") + len("<s>") + F.col("role_chars") + len("[INST]")
    examples = turns.where("target").select("conv_id", F.col("seq").alias("context_turns"), "context_chars", start.alias("target_start"), (F.col("context_chars") + F.col("chars") - len("[/INST]</s>")).alias("target_end"), (F.col("context_chars") + F.col("chars")).alias("example_chars"))
    return turns, scratch.write(examples, "examples")


def expand(turns: DataFrame) -> DataFrame:
    """The examples as full texts: conv_id, context_turns, text, loss_start, loss_end.

    Grows with the square of a conversation's turns; meant for the conversations that a trainer takes up next.
    """

    def run(batches):
        conv, text, first = None, "", True
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if first or r["conv_id"] != conv:
                    conv, text, first = r["conv_id"], "", False
                start = len(text) + len("<s>") + r["role_chars"] + len("[INST]")
                text += r["segment"]
                if r["target"]:
                    out.append({"conv_id": conv, "context_turns": r["seq"], "text": text, "loss_start": start, "loss_end": len(text) - len("[/INST]</s>")})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("conv_id", pa.int64()), ("context_turns", pa.int64()), ("text", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())]))

    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "seq").mapInArrow(run, "conv_id long, context_turns long, text string, loss_start long, loss_end long")


def read_back(turns: DataFrame, examples: DataFrame) -> DataFrame:
    """Per conversation of the written tables its digests.

    Digests run over a conversation's turns in order, row by row: a task holds one batch at a time, however long
    a conversation is.
    """
    spans = examples.select(F.col("conv_id").alias("c"), F.col("context_turns").alias("s"), "target_start", "target_end")
    rows = turns.join(spans, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("seq") == F.col("s")), "left").select("conv_id", "seq", "segment", "context_chars", "target_start", "target_end")

    def run(batches):
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_examples", pa.int64())])
        now, done = None, []

        def close():
            if now is not None:
                done.append({"conv_id": now[0], "n_turns": now[1], "turns_sha256": now[2].hexdigest(), "loss_chars": now[3], "loss_sha256": now[4].hexdigest(), "formatted_chars": now[5], "n_examples": now[6]})

        for batch in batches:
            for r in batch.to_pylist():
                if now is None or now[0] != r["conv_id"]:
                    close()
                    now = [r["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                segment = r["segment"]
                role, _, body = segment[len("<s>") : -len("[/INST]</s>")].partition("[INST]")
                now[1] += 1
                now[2].update(f"{unescape(role)}\n{unescape(body)}\n".encode())
                if r["target_start"] is not None:
                    text = unescape(segment[r["target_start"] - r["context_chars"] : r["target_end"] - r["context_chars"]])
                    now[3] += len(text)
                    now[4].update(text.encode())
                    now[6] += 1
                now[5] += len(segment)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
                done = []
        close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=schema)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "seq").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long")


def op9_chat_prefix(spark, sf_dir: str) -> DataFrame:
    """All ``conversations`` and a conversation of control strings, formatted and read back."""
    trap = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(trap).alias("text"))
    found = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return read_back(*format_turns(found.union(extra), Scratch(spark, "op9")))
