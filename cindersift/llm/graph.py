"""Connected components of an edge table by distributed union-find.

A round deals the edges evenly to tasks of about TASK_EDGES edges. Each task runs union-find over its edges and tells
the root of each of its nodes; a node known to several tasks joins its roots by new edges. So each round contracts the
graph to its roots, whose order is a hash that changes every round (a long path shrinks by a constant factor), until one
task holds what is left. A node comes at most once from each task, so no node's edges are gathered in one place.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cindersift.llm.hashing import mixed
from cindersift.storage import dropped, written

TASK_EDGES = 250_000
MAX_ROUNDS = 200


def _forest(batches: Iterable[pa.RecordBatch], salt: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct nodes of a task's edges and the root of each: the smallest node, or with a salt the first by hash."""
    parts = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate(x) for x in zip(*parts))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    order = np.arange(len(nodes)) if salt is None else np.argsort(mixed(nodes.view(np.uint64) + np.uint64(salt)), kind="stable")
    rank = np.empty(len(nodes), np.int64)
    rank[order] = np.arange(len(nodes))
    up = list(range(len(nodes)))
    for x, y in zip(rank[at[: len(a)]].tolist(), rank[at[len(a) :]].tolist()):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x < y:
            up[y] = x
        elif y < x:
            up[x] = y
    for i in range(len(up)):  # a parent always comes first
        up[i] = up[up[i]]
    return nodes, nodes[order[np.array(up)[rank]]]


def _roots(salt: int | None):
    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, roots = _forest(batches, salt)
        for lo in range(0, len(nodes), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[lo : lo + 65536]), pa.array(roots[lo : lo + 65536])], ["node", "root"])

    return find


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, root) sorted by node: the first root of each node, and edges from it to the node's other roots (as rows with an edge)."""
    node0, root0 = None, None
    for b in batches:
        if not b.num_rows:
            continue
        node, root = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        new = np.ones(len(node), bool)
        new[1:] = node[1:] != node[:-1]
        if node0 is not None and node[0] == node0:
            new[0] = False
            starts = np.flatnonzero(new)
            first = np.concatenate([[root0], root[starts]])[np.cumsum(new)]
        else:
            first = root[np.flatnonzero(new)][np.cumsum(new) - 1]
        node0, root0 = node[-1], first[-1]
        keep = new | (root != first)
        yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(first[keep]), pa.array(root[keep], mask=new[keep])], ["node", "root", "other"])


def components(edges: DataFrame) -> DataFrame:
    """Undirected edges (a, b) of longs to rows (node, component): the smallest node reachable. Nodes without an edge are absent.

    Null ends and loops are ignored, repeated edges count once, and no edges give no rows.
    """
    left = written(edges.where("a is not null and b is not null and a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")), "edges")
    rounds: list[DataFrame] = []
    made = [left]
    for salt in range(1, MAX_ROUNDS):
        tasks = -(-left.count() // TASK_EDGES)
        if tasks <= 1:
            label = left.coalesce(1).mapInArrow(_roots(None), "node long, root long")
            break
        found = left.repartition(tasks).mapInArrow(_roots(salt), "node long, root long")
        found = written(found.repartition("node").sortWithinPartitions("node").mapInArrow(_joined, "node long, root long, other long"), "roots")
        made.append(found)
        rounds.append(found.where("other is null").select("node", "root"))
        left = written(found.where("other is not null").select(F.least("root", "other").alias("a"), F.greatest("root", "other").alias("b")).distinct(), "edges")
        made.append(left)
    else:
        raise RuntimeError(f"edges are left after {MAX_ROUNDS} rounds")
    if not rounds:
        out = written(label.select("node", F.col("root").alias("component")), "components")
        dropped(*made)
        return out
    for earlier in reversed(rounds):
        label = earlier.join(label.select(F.col("node").alias("root"), F.col("root").alias("higher")), "root", "left").select("node", F.coalesce("higher", "root").alias("root"))
    label = written(label, "labels")
    least = label.groupBy("root").agg(F.min("node").alias("component"))
    out = written(label.join(least, "root").select("node", "component"), "components")
    dropped(label, *made)
    return out
