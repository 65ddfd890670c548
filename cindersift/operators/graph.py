"""Call-graph taint walk (T7, T8): a bounded breadth-first search from handlers over an edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cindersift.storage import dropped, written


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that is not broadcast: what grows with the files goes from task to task, never over the driver."""
    return df.hint("merge")


def reached(starts: DataFrame, edges: DataFrame, depth: int = 5) -> DataFrame:
    """(start, node, depth): every node within ``depth`` edges of a start, once for each start, at its least depth.

    starts: (start, node); edges: (caller, callee), of any type. Every round is a join of the newest nodes on the caller,
    less those already seen, and is written out, so cycles end and no plan grows with the depth.
    """
    edges = edges.select("caller", "callee").distinct()
    fronts = [written(starts.select("start", "node").distinct().withColumn("depth", F.lit(0)), "walk")]
    for d in range(1, depth + 1):
        seen = fronts[0]
        for f in fronts[1:]:
            seen = seen.union(f)
        new = fronts[-1].join(shuffled(edges), F.col("node") == F.col("caller")).select("start", F.col("callee").alias("node")).distinct()
        front = written(new.join(shuffled(seen.select("start", "node")), ["start", "node"], "left_anti").withColumn("depth", F.lit(d)), "walk")
        if front.isEmpty():
            dropped(front)
            break
        fronts.append(front)
    out = fronts[0]
    for f in fronts[1:]:
        out = out.union(f)
    return out


def confidence(depth: Column) -> Column:
    return F.round(F.greatest(F.lit(0.40), 0.75 - 0.10 * depth), 4)


def exploitability(depth: Column) -> Column:
    return F.round(0.65 - 0.08 * depth, 4)


def taint_walk(edges: DataFrame, handlers: DataFrame, sinks: DataFrame, depth: int = 5) -> DataFrame:
    """(handler, node, sink, depth): functions that call a sink, reached from a handler in at most ``depth`` calls.

    edges: (caller, callee); handlers: (node); sinks: (node). A function that calls a sink is not walked past, and each
    is visited once for each handler, at its least depth.
    """
    edges = edges.select("caller", "callee").distinct()
    hits = edges.join(sinks.select(F.col("node").alias("callee")).distinct(), "callee").groupBy(F.col("caller").alias("node")).agg(F.min("callee").alias("sink"))
    hits = written(hits, "sinks")
    going = edges.join(hits.select(F.col("node").alias("caller")), "caller", "left_anti")
    seen = reached(handlers.select(F.col("node").alias("start"), "node"), going, depth).withColumnRenamed("start", "handler")
    out = seen.join(hits, "node").select("handler", "node", "sink", "depth")
    return out.withColumns({"confidence": confidence(F.col("depth")), "exploitability": exploitability(F.col("depth"))})
