"""The k best rows of every group by radix selection, so that no group is sorted or gathered anywhere.

Passes over the bits of the value, highest first: grouped histograms of one digit (at most 2^BITS counts for each group)
tell the digit in which a group's kth value lies; rows above it are in, rows below it go, and the next pass reads what
is left. Rows that tie at the kth value are refined in the same way by the UTF-8 bytes of their item, from the first byte
in which a group's tied items differ. Histograms are combined before their shuffle, so a group may hold any share of the rows.

Defined results: values are longs of at least 0; a null value or item takes no part; groups with fewer than k rows give all; null group keys are
groups of their own; rows that agree in group, value and item (repeated rows) are ranked one after another; an empty
table has no ranks. Only the named columns are returned.
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from cindersift.storage import dropped, written

BITS = 10
#: Tied rows of a group that may be sorted at once; more are first refined by bytes.
TIE_ROWS = 4096


def _same(a: DataFrame, b: DataFrame, keys: list[str]):
    return reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[k]) for k in keys))


def _with(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with their group's state; adaptive execution broadcasts a state of few groups and splits a hot group's rows."""
    named = state.select(*(F.col(k).alias(f"__{k}") for k in keys), *(c for c in state.columns if c not in keys))
    on = reduce(lambda x, y: x & y, (rows[k].eqNullSafe(named[f"__{k}"]) for k in keys))
    return rows.join(named, on).drop(*(f"__{k}" for k in keys))


def _pivot(hist: DataFrame, keys: list[str], order) -> DataFrame:
    """Per group the digit that holds the needed row, or the last, and how many rows are needed from inside it."""
    w = Window.partitionBy(*keys).orderBy(order)
    run = hist.withColumn("__upto", F.sum("n").over(w)).withColumn("__last", F.lead("digit").over(w).isNull())
    hit = run.where((F.col("__upto") - F.col("n") < F.col("need")) & ((F.col("__upto") >= F.col("need")) | F.col("__last")))
    return hit.withColumn("inside", F.least(F.col("need") - F.col("__upto") + F.col("n"), F.col("n")))


def _prefix(batches):
    """Adds ``at``: the bytes that two items share at their beginning."""
    import pyarrow as pa

    for b in batches:
        lo, hi = (b.column(b.schema.get_field_index(n)).cast(pa.binary()).to_pylist() for n in ("lo", "hi"))
        yield b.append_column("at", pa.array([len(os.path.commonprefix([x, y])) for x, y in zip(lo, hi)], pa.int32()))


def best(rows: DataFrame, keys: list[str], value: str, item: str, k: int, *, tie_rows: int = TIE_ROWS) -> DataFrame:
    """(keys, item, value, rank): per group the k rows of largest value, ties to the smaller item by UTF-8 bytes."""
    live = written(rows.where(F.col(value).isNotNull() & F.col(item).isNotNull()).select(*keys, F.col(item).alias("item"), F.col(value).alias("value")), "ranked")
    top = live.agg(F.max("value")).first()[0] or 0
    made, chosen = [live], []
    state = live.select(*keys).distinct().select(*keys, F.lit(0).cast("long").alias("head"), F.lit(k).cast("long").alias("need"))
    for shift in reversed(range(0, max(top.bit_length(), 1), BITS)):
        # Of the rows left, all share their higher bits with the group's kth value.
        digit = F.shiftright("value", shift).bitwiseAND((1 << BITS) - 1)
        hist = _with(live.select(*keys, digit.alias("digit")).groupBy(*keys, "digit").agg(F.count("*").alias("n")), state, keys)
        state = written(_pivot(hist, keys, F.desc("digit")).select(*keys, (F.col("head") * (1 << BITS) + F.col("digit")).alias("head"), F.col("inside").alias("need")), "thresholds")
        near = written(_with(live, state, keys).where(F.shiftright("value", shift) >= F.col("head")).withColumn("above", F.shiftright("value", shift) > F.col("head")), "near")
        made += [state, near]
        chosen.append(near.where("above").select(*keys, "item", "value"))
        live = near.where("not above").select(*keys, "item", "value")
    tied = live
    while True:
        counts = _with(tied.groupBy(*keys).agg(F.count("*").alias("n"), F.min("item").alias("lo"), F.max("item").alias("hi")), state, keys)
        counts = written(counts.select(*keys, "n", "lo", "hi", "need"), "ties")
        made.append(counts)
        many = (F.col("n") > F.col("need")) & (F.col("n") > tie_rows) & (F.col("lo") < F.col("hi"))
        if counts.where(many).isEmpty():
            break
        few = _with(tied, counts.where(~many).select(*keys, "need"), keys)
        at = written(counts.where(many).select(*keys, "lo", "hi", "need").mapInArrow(_prefix, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in counts.schema if f.name in keys), "lo string", "hi string", "need long", "at int"])).drop("lo", "hi"), "bytes")
        byte = F.expr("coalesce(nullif(hex(substring(cast(item as binary), at + 1, 1)), ''), '')")
        split = _with(tied, at, keys).withColumn("digit", byte)
        hist = _with(split.groupBy(*keys, "digit").agg(F.count("*").alias("n")), at.select(*keys, "need"), keys)
        pivot = written(_pivot(hist, keys, F.asc("digit")).select(*keys, F.col("digit").alias("pivot"), F.col("inside").alias("need")), "thresholds")
        near = written(_with(split.drop("need"), pivot, keys).where("digit <= pivot").select(*keys, "item", "value", (F.col("digit") < F.col("pivot")).alias("above")), "near")
        rest = written(few.select(*keys, "item", "value"), "tied")
        made += [at, pivot, near, rest]
        chosen.append(near.where("above").drop("above"))
        tied = rest.unionByName(near.where("not above").drop("above"))
        state = counts.where(~many).select(*keys, "need").unionByName(pivot.select(*keys, "need"))
    # Of each group at most tie_rows are left, or just as many as are needed, or equal ones.
    last = _with(tied, counts.select(*keys, "need"), keys).withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy("item")))
    chosen.append(last.where("__r <= need").select(*keys, "item", "value"))
    w = Window.partitionBy(*keys).orderBy(F.desc("value"), F.asc("item"))
    out = written(reduce(DataFrame.unionByName, chosen).withColumn("rank", F.row_number().over(w)), "best")
    dropped(*made)
    return out
