"""Exact order statistics of groups of any size, by distributed selection.

No group is sorted or gathered.  A value's bits make a whole number that orders as the values do.  Of every group and wanted rank
a bracket of values is known that holds it, at first from the least to the greatest; counts of the bracket's rows over up to
4096 equal ranges of keys, added up before the shuffle, tell in which range the rank lies, and the least and greatest
value in it are the next bracket.  A bracket of one value is the answer.  Keys have 64 bits, so six rounds are enough for any
data; from the second on only rows inside open brackets are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from .dealt import SENT, attach_rows

BITS = 12
_HUGE = 2047 << 52  # key of infinity; NaN, the largest of all, is one more


def order_key(x: Column) -> Column:
    """A whole number that orders as doubles do (both zeros alike, NaN last): sign, exponent and fraction, as floating point keeps them.

    NULL for NULL.  Built from exact operations: scaling by powers of two.
    """
    a = F.abs(x)
    power = lambda e: F.pow(F.lit(2.0), e)
    guess = F.floor(F.log2(a)).cast("double")  # off by one at most, next to a power of two
    scaled = a * power(-guess)
    exponent = F.when(scaled >= 2.0, guess + 1).when(scaled < 1.0, guess - 1).otherwise(guess)
    fraction = F.when(scaled >= 2.0, scaled / 2.0).when(scaled < 1.0, scaled * 2.0).otherwise(scaled) - 1.0
    normal = F.shiftleft((exponent + 1023).cast("long"), 52) + (fraction * float(1 << 52)).cast("long")
    small = (a * float(2**537) * float(2**537)).cast("long")  # below the least normal number: whole steps of 2**-1074
    size = F.when(a < float(2.0**-1022), small).when(a == float("inf"), F.lit(_HUGE)).otherwise(normal)
    return F.when(F.isnan(x), F.lit(_HUGE + 1)).when(x < 0, -size).otherwise(size)


def select_ranks(df: DataFrame, over: tuple[str, ...], values: dict[str, Column], places: dict[str, Callable[[Column], Column]], scratch: Scratch, sent: int = SENT) -> DataFrame:
    """Per group of ``over`` (NULL is a group too): for every value and place a struct ``{value}_{place}`` of ``value``, ``below`` and ``equal``.

    ``values`` are columns of doubles, whose NULLs are left out; a place gives a rank, from 0, as a function of the column that
    counts the group's values.  ``below`` and ``equal`` count the values smaller than and equal to the one at that rank.  A
    group without values has NULLs; ``{value}_n`` counts values.  Brackets are joined to rows by attach_rows(), so one
    group may hold most of the rows; rows are counted by different values from the second round on, so ties are few.
    """
    groups, names = [f"g{k}" for k in range(len(over))], list(values)
    keys = [*groups, "c"]
    source = df.select(*[F.col(g).alias(a) for g, a in zip(over, groups)], F.array(*[values[c].cast("double") + 0.0 for c in names]).alias("xs"))
    rows = source.select(*groups, F.posexplode("xs").alias("c", "x")).withColumn("m", F.lit(1).cast("long"))
    ends = scratch.write(rows.groupBy(*keys).agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")), "select-ends")
    many = ends.count()
    wanted = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), f(F.col("n")).cast("long").alias("at")) for p, f in places.items()]))
    state = ends.where("n > 0").select("*", wanted.alias("w")).select(*keys, "w.*", F.lit(0).cast("long").alias("below"), F.col("n").alias("equal"), "lo", "hi")
    rows, step = rows.where("x is not null"), 0
    while (still := state.where("lo < hi")).limit(1).count():
        step += 1
        if step > 64 // BITS + 2:
            raise RuntimeError("selection doesn't end")
        low, high = order_key(F.col("lo")), order_key(F.col("hi"))
        span = F.shiftright(high, 1) - F.shiftright(low, 1)  # of halves, which doesn't overflow
        shift = F.when(span < 1 << (BITS - 1), -1).otherwise(F.length(F.bin(span)) - BITS)
        bracket = F.struct("lo", "hi", low.alias("key"), shift.cast("int").alias("shift"))
        brackets = scratch.write(still.select(*keys, "lo", "hi").distinct().groupBy(*keys).agg(F.collect_list(bracket).alias("b")), f"select-brackets-{step}")  # one for each place at most
        met = attach_rows(rows, brackets, keys, many, sent).select(*keys, "x", "m", F.filter("b", lambda b: (F.col("x") >= b["lo"]) & (F.col("x") <= b["hi"])).alias("b"))
        if step > 1:
            inside = met.where(F.size("b") > 0).groupBy(*keys, "x", "b").agg(F.sum("m").alias("m"))
            met = scratch.write(inside, f"select-rows-{step}")
            rows = met.drop("b")
        placed = met.select(*keys, "x", "m", F.explode("b").alias("b")).select(*keys, "x", "m", "b.*", order_key(F.col("x")).alias("own"))
        part = F.when(F.col("shift") < 0, F.col("own") - F.col("key")).otherwise(F.expr("shiftright(shiftright(own, 1) - shiftright(key, 1), shift)"))
        bracket_keys = [*keys, "lo", "hi"]
        counts = placed.groupBy(*bracket_keys, part.alias("part")).agg(F.sum("m").alias("n"), F.min("x").alias("next_lo"), F.max("x").alias("next_hi"))
        before = F.coalesce(F.sum("n").over(W.partitionBy(*bracket_keys).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        ranges = counts.withColumn("before", before)
        right = ranges.select(*[F.col(k).alias(f"r_{k}") for k in bracket_keys], "n", "next_lo", "next_hi", "before")
        same = F.lit(True)
        for k in bracket_keys:
            same = same & F.col(k).eqNullSafe(F.col(f"r_{k}"))
        found = still.join(right, same & (F.col("at") >= F.col("before")) & (F.col("at") < F.col("before") + F.col("n")))
        moved = found.select(*keys, "p", (F.col("at") - F.col("before")).alias("at"), (F.col("below") + F.col("before")).alias("below"), F.col("n").alias("equal"), F.col("next_lo").alias("lo"), F.col("next_hi").alias("hi"))
        state = scratch.write(state.where("not lo < hi").unionByName(moved), f"select-{step}")
    both = state.select(*keys, "p", F.struct(F.col("lo").alias("value"), "below", "equal").alias("v"), F.lit(None).cast("long").alias("n")).unionByName(ends.select(*keys, F.lit(None).cast("string").alias("p"), F.lit(None).cast("struct<value: double, below: bigint, equal: bigint>").alias("v"), "n"))
    columns = []
    for c, name in enumerate(names):
        columns.append(F.max(F.when(F.col("c") == c, F.col("n"))).alias(f"{name}_n"))
        columns += [F.max(F.when((F.col("c") == c) & (F.col("p") == p), F.col("v"))).alias(f"{name}_{p}") for p in places]
    wide = both.groupBy(*groups).agg(*columns)
    return scratch.write(wide.select(*[F.col(a).alias(g) for g, a in zip(over, groups)], *[c for c in wide.columns if c not in groups]), "select-found")
