"""Intermediate tables, as the rest of the library keeps them, and names for helper columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.scratch import Scratch, shared_dir

__all__ = ["Scratch", "fresh", "shared_dir", "with_string_text"]


def with_string_text(docs):
    """``docs`` with its text as a string, and the name of that column: its own ``text`` where it is one already."""
    if docs.schema["text"].dataType.simpleString() == "string":
        return docs, "text"
    name = fresh("__text", docs.columns)
    return docs.withColumn(name, F.col("text").cast("string")), name


def fresh(name: str, taken: list[str]) -> str:
    """A column name like ``name`` that isn't ``taken`` (in any case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name
