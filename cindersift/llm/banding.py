"""From band keys to true links, without all pairs of a bucket and without gathering a bucket in one task.

1. Places (band key, node, 128-bit sketch) are dealt by key, packed in one row for each batch and part. A task sorts
   what it has; in a bucket of up to SMALL nodes it compares the sketches and passes on the groups of nodes that may be
   alike, under a key of their own. Nodes of a larger bucket all go on: the bucket leaves the task's memory as soon as
   it is known to be large, so a task holds about LIMIT places however many share a key.
2. First round: each small group is met once with full sketches, and only its best spanning forest of likely pairs is
   confirmed (a family of n near copies costs n - 1 pairs, not n * n); in a large bucket, each node with one hub.
   True links give components.
3. What still holds several components is met again, and every likely pair across components is confirmed: in small
   groups at once; in large buckets in tiles of TILE by TILE nodes, spread over tasks, first by a spanning forest over
   the components and then in full. So a bucket of any size is compared exactly; what differs is only where.

A likely pair is one that the sketches can't rule out: the 128-bit one by a bound on differing bits, the full one by
the caller's function.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cindersift.llm.graph import components
from cindersift.llm.hashing import mixed, returning
from cindersift.storage import dropped, written

#: Places of one batch that go to one part, as one value, or (NEAR, FAR, HOT) its FAR places and the keys known to be hot.
PLACES = "part int, kind int, places binary"
NEAR, FAR, HOT = 0, 1, 2
#: A part holds so few places that 32 bits of a key tell its buckets apart (two that meet are told apart by sketches).
PLACE = np.dtype([("key", "<u4"), ("node", "<i8"), ("low", "<u8"), ("high", "<u8")])
FAR_PLACE = np.dtype([("key", "<i8"), ("node", "<i8")])
BITS = 128
#: From so many nodes of a key in one batch, they are dealt by node instead of by key, and the key's part is told.
LOCAL = 64
#: Nodes up to which a bucket is met in the task that holds it.
SMALL = 512
#: Places that a task holds before buckets known to be large leave it.
LIMIT = 2_000_000
#: Places of a part on average.
PART = 750_000
#: Nodes of a large bucket on one side of a tile.
TILE = 512
#: Hash classes whose occupation bounds what two sets have in common.
CLASSES = 2048
#: Bits of the filter that spares nodes nobody asks for (1 MB).
FILTER = 1 << 23
#: Pairs compared at once.
PAIRS = 1 << 15


def differing(percent: int) -> int:
    """Bits in which the sketches of a pair at the threshold differ at most, six standard errors above the mean."""
    p = (100 - percent) / 200
    return int(BITS * p + 6 * (BITS * p * (1 - p)) ** 0.5)


def sketched(minima: np.ndarray) -> np.ndarray:
    """Two longs for each row of minima, which give a bit in turn."""
    bits = minima[:, np.arange(BITS) % minima.shape[1]].astype(np.uint64)
    bits = mixed(bits + mixed(np.arange(BITS, dtype=np.uint64) + np.uint64(1))) & np.uint64(1)
    return np.packbits(np.ascontiguousarray(bits.astype(np.uint8)), axis=1).copy(order="C").view(np.uint64)


def occupied(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A map of CLASSES bits for each set: the hash classes that its values occupy."""
    n, out = len(at) - 1, []
    for lo in range(0, n, 1024):
        hi = min(lo + 1024, n)
        bits = np.zeros((hi - lo, CLASSES), np.uint8)
        bits[np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1])), (s[at[lo] : at[hi]] & np.uint64(CLASSES - 1)).astype(np.int64)] = 1
        out.append(np.packbits(bits, axis=1))
    return np.concatenate(out) if out else np.zeros((0, CLASSES // 8), np.uint8)


def bounded(na: np.ndarray, nb: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The most that the similarity of pairs of sets can be, from sizes and maps; -1 where that is below the threshold.

    A value in a class that the other set doesn't occupy is not in common.
    """
    a, b = (np.ascontiguousarray(x).view(np.uint64) for x in (a, b))
    common = np.minimum(na - np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64), nb - np.bitwise_count(b & ~a).sum(axis=1, dtype=np.int64))
    either = na + nb - common
    return np.where(100 * common >= percent * either, common / np.maximum(either, 1), -1.0)


def wanted(nodes: DataFrame) -> np.ndarray:
    """A map of FILTER bits, whatever the number of nodes: those set at a node's hash. It only saves work before an exact join."""

    def bits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = mixed(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)) % np.uint64(FILTER)
            yield pa.RecordBatch.from_arrays([pa.array((h >> np.uint64(6)).view(np.int64)), pa.array((np.uint64(1) << (h & np.uint64(63))).view(np.int64))], ["word", "bit"])

    found = nodes.mapInArrow(bits, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(FILTER >> 6, np.uint64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy().view(np.uint64)
    return out


def holds(filter_: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Which nodes may be among those of :func:`wanted`."""
    h = mixed(nodes.view(np.uint64)) % np.uint64(FILTER)
    return (filter_[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63)) & np.uint64(1)).astype(bool)


def parts(places: int) -> int:
    """Into how many parts to deal so many places."""
    return max(16, -(-places // PART))


def packed(key: np.ndarray, node: np.ndarray, sketch: np.ndarray, n: int) -> pa.RecordBatch:
    """Places of one batch (each once) in rows of :data:`PLACES`, for n parts. sketch: of :func:`sketched`."""
    whole = (mixed(key.view(np.uint64)) % np.uint64(n)) << np.uint64(32) | (key.view(np.uint64) & np.uint64(0xFFFFFFFF))
    order = np.argsort(whole)
    whole, node = whole[order], node[order]
    at, size = _runs(whole)
    far = np.repeat(size >= LOCAL, size)
    near = order[~far]
    rows = np.empty(len(near), PLACE)
    rows["key"], rows["node"], rows["low"], rows["high"] = (whole[~far] & np.uint64(0xFFFFFFFF)).astype(np.uint32), node[~far], sketch[near, 0], sketch[near, 1]
    away = np.empty(int(far.sum()), FAR_PLACE)
    away["key"], away["node"] = whole[far].view(np.int64), node[far]
    hot = whole[at[:-1][size >= LOCAL]]
    out: list[tuple[int, int, bytes]] = []
    for kind, of, what in ((NEAR, whole[~far] >> np.uint64(32), rows), (FAR, mixed(node[far].view(np.uint64)) % np.uint64(n), away), (HOT, hot >> np.uint64(32), hot.astype(np.uint32))):
        if kind == FAR:
            order = np.argsort(of, kind="stable")
            of, what = of[order], what[order]
        at = np.searchsorted(of, np.arange(n + 1, dtype=np.uint64))
        out += [(p, kind, what[at[p] : at[p + 1]].tobytes()) for p in np.flatnonzero(np.diff(at)).tolist()]
    columns = list(zip(*out)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], ["part", "kind", "places"])


def _distinct(rows: np.ndarray) -> np.ndarray:
    """Sorted by key and node, each once."""
    rows = rows[np.lexsort((rows["node"], rows["key"]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["key"][1:] != rows["key"][:-1]) | (rows["node"][1:] != rows["node"][:-1])
    return rows[new]


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts (and the end) of the runs of equal values, and each one's length."""
    at = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key)) if len(key) else np.zeros(1, np.int64)
    return at, np.diff(at)


def _pairs(at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows (the earlier first) within runs that begin at ``at``, PAIRS or one row's at a time."""
    left = np.repeat(at[1:], np.diff(at)) - np.arange(at[0], at[-1]) - 1  # partners that come after each row
    total = np.concatenate([[0], np.cumsum(left)])
    lo = 0
    while lo < len(left):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + PAIRS, "right")) - 1)
        n = left[lo:hi]
        i = np.repeat(np.arange(lo, hi), n)
        yield i + at[0], i + 1 + np.arange(len(i)) - np.repeat(total[lo:hi] - total[lo], n) + at[0]
        lo = hi


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least row reachable from each of n rows."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if (label == before).all():
            return label


def _whole(part: int, key: np.ndarray) -> np.ndarray:
    """The 64-bit keys of a part's 32-bit ones."""
    return (np.uint64(part) << np.uint64(32) | key.astype(np.uint64)).view(np.int64)


def _groups(part: int, rows: np.ndarray, differ: int) -> Iterator[pa.RecordBatch]:
    """Members (key, node, large) of a part's places: large buckets whole, of small ones the groups that may be alike."""
    rows = rows[np.argsort(rows["key"])]
    _, size = _runs(rows["key"])
    rows = _distinct(rows[np.repeat(size > 1, size)])
    at, size = _runs(rows["key"])
    large = np.repeat(size > SMALL, size)
    if large.any():
        yield _members(_whole(part, rows["key"][large]), rows["node"][large], True)
        rows = rows[~large]
        at, _ = _runs(rows["key"])
    if not len(rows):
        return
    found = []
    for i, j in _pairs(at):
        near = np.bitwise_count(rows["low"][i] ^ rows["low"][j]).astype(np.int16) + np.bitwise_count(rows["high"][i] ^ rows["high"][j]) <= differ
        found.append((i[near], j[near]))
    i, j = (np.concatenate(x) for x in zip(*found))
    label = _labels(len(rows), i, j)
    some = np.zeros(len(rows), bool)
    some[i] = some[j] = True
    if some.any():
        key = mixed(_whole(part, rows["key"]).view(np.uint64) ^ mixed(rows["node"][label].view(np.uint64))).view(np.int64)
        yield _members(key[some], rows["node"][some], False)


def _members(key: np.ndarray, node: np.ndarray, large: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.ascontiguousarray(node)), pa.array(np.full(len(key), large))], ["key", "node", "large"])


class _Part:
    """What a task holds of one part."""

    def __init__(self, part: int, differ: int):
        self.part, self.differ, self.held, self.n, self.limit = part, differ, [], 0, LIMIT
        self.hot = np.zeros(0, np.uint32)

    def add(self, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Keeps the rows, but for those of hot keys, which go on."""
        known = np.isin(rows["key"], self.hot) if len(self.hot) else np.zeros(len(rows), bool)
        if known.any():
            yield _members(_whole(self.part, rows["key"][known]), rows["node"][known], True)
            rows = rows[~known]
        self.held.append(rows)
        self.n += len(rows)
        if self.n > self.limit:
            rows = _distinct(np.concatenate(self.held))
            at, size = _runs(rows["key"])
            self.hot = np.union1d(self.hot, rows["key"][at[:-1][size > SMALL]])
            self.held, self.n, self.limit = [], 0, len(rows) + LIMIT
            yield from self.add(rows)
            self.limit = max(LIMIT, 2 * self.n)

    def end(self) -> Iterator[pa.RecordBatch]:
        rows, self.held, self.n = np.concatenate(self.held or [np.zeros(0, PLACE)]), [], 0
        self.limit = len(rows)
        yield from self.add(rows)
        yield from _groups(self.part, self.held[0], self.differ)


def _meet(differ: int):
    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, _Part] = {}
        for b in batches:
            for part, kind, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if kind == FAR:
                    rows = np.frombuffer(blob.as_buffer(), FAR_PLACE)
                    yield _members(np.ascontiguousarray(rows["key"]), rows["node"], True)
                    continue
                own = parts.setdefault(part, _Part(part, differ))
                if kind == HOT:
                    own.hot = np.union1d(own.hot, np.frombuffer(blob.as_buffer(), np.uint32))
                else:
                    yield from own.add(np.frombuffer(blob.as_buffer(), PLACE).copy())
        for own in parts.values():
            yield from own.end()

    return returning(meet)


def _forest(n: int, i: np.ndarray, j: np.ndarray, good: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) of n rows make a spanning forest over ``label``, the best ones first."""
    order = np.argsort(-good, kind="stable")
    i, j, chosen = i[order], j[order], np.zeros(len(i), bool)
    while True:
        a, b = label[i], label[j]
        alive = np.flatnonzero(a != b)
        if not len(alive):
            break
        _, first = np.unique(np.concatenate([a[alive], b[alive]]), return_index=True)  # the best pair of each component
        best = np.unique(alive[first % len(alive)])
        chosen[best] = True
        label = _labels(n, a[best], b[best])[label]
    return order[chosen]


def _likely_pairs(likely: Callable, forest: bool, sided: bool):
    """Rows (key, node, label, side, n, sketch) sorted by key to likely pairs (a, b) across labels. sided: only of different sides, if there are two."""

    def told(key: np.ndarray, node: np.ndarray, label: np.ndarray, side: np.ndarray, n: np.ndarray, sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
        at, _ = _runs(key)
        _, label = np.unique(label, return_inverse=True)
        found = []
        for i, j in _pairs(at):
            keep = label[i] != label[j]
            if sided:
                keep &= (side[i] != side[j]) | (side[i] < 0)
            i, j = i[keep], j[keep]
            if len(i):
                good = likely(n[i], n[j], sketch[i], sketch[j])
                keep = good >= 0
                found.append((i[keep], j[keep], good[keep]))
        if not found:
            return
        i, j, good = (np.concatenate(x) for x in zip(*found))
        if forest and len(i):
            # Labels of different buckets stay apart: the forest is over (bucket, label).
            _, own = np.unique(np.repeat(np.arange(len(at) - 1), np.diff(at)) * (label.max() + 1) + label, return_inverse=True)
            best = _forest(len(key), i, j, good, own)
            i, j = i[best], j[best]
        a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
        once = np.unique(np.rec.fromarrays([a, b]))
        if len(once):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(once["f0"])), pa.array(np.ascontiguousarray(once["f1"]))], ["a", "b"])

    def columns(b: pa.RecordBatch) -> list[np.ndarray]:
        width = len(b.column(5)[0].as_buffer())
        sketch = np.frombuffer(b.column(5).buffers()[2], np.uint8)[b.column(5).offset * width :][: b.num_rows * width].reshape(b.num_rows, width)
        return [*(b.column(i).to_numpy(zero_copy_only=False) for i in range(5)), sketch]

    def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            now = columns(b)
            now = now if rest is None else [np.concatenate(x) for x in zip(rest, now)]
            cut = int(np.searchsorted(now[0], now[0][-1])) if now[0][0] != now[0][-1] else 0
            if cut:
                yield from told(*(x[:cut] for x in now))
            rest = [x[cut:].copy() for x in now]
        if rest is not None:
            yield from told(*rest)

    return returning(pairs)


def linked(places: DataFrame, n_parts: int, differ: int, payload: Callable, likely: Callable, confirmed: Callable) -> DataFrame:
    """All links needed for the components of the graph whose edges are the true links that share a band.

    places: rows of :func:`packed`; pairs whose 128-bit sketches differ in more than ``differ`` bits are not links.
    payload: (node) to (node, n, sketch, ...), a full sketch of constant width and what confirming a link needs of each node.
    likely: arrays (n, n, sketch, sketch) of pairs to how good each is, below 0 where the sketches rule a link out.
    confirmed: (a, b) and payload rows to the true links.
    """
    made: list[DataFrame] = []  # what nothing needs once the links are known

    def saved(df: DataFrame, name: str) -> DataFrame:
        made.append(written(df, name))
        return made[-1]

    met = places.repartitionById(n_parts, F.col("part")).mapInArrow(_meet(differ), "key long, node long, large boolean")
    members = saved(met, "members")
    own = saved(payload(members.select("node").distinct()), "payload")
    sketches = own.select("node", "n", "sketch")

    def pairs(rows: DataFrame, forest: bool, sided: bool) -> DataFrame:
        rows = rows.join(sketches, "node").select("key", "node", "label", "side", "n", "sketch")
        return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_likely_pairs(likely, forest, sided), "a long, b long")

    small = members.where("not large").select("key", "node")
    large = saved(members.where("large").select("key", "node").distinct(), "large")
    hubs = large.groupBy("key").agg(F.min("node").alias("hub"))
    stars = large.join(hubs, "key").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    alone = small.select("key", "node", F.col("node").alias("label"), F.lit(-1).alias("side"))
    tested = saved(pairs(alone, True, False).union(stars).distinct(), "pairs")
    links = saved(confirmed(tested, own), "links")

    def opened(rows: DataFrame, label: DataFrame) -> DataFrame:
        """The rows of buckets that hold several components, with these, and each bucket's number of nodes."""
        named = rows.join(label, "node", "left").select("key", "node", F.coalesce("component", "node").alias("label"))
        several = named.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.count("*").alias("size")).where("l0 < l1")
        return saved(named.join(several.select("key", "size"), "key"), "open")

    def tiles(rows: DataFrame) -> DataFrame:
        """Each pair of blocks of a bucket under a key of its own, the nodes of the first block as side 0. A block with itself is one tile (side -1)."""
        blocks = rows.withColumn("blocks", F.ceil(F.col("size") / TILE)).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
        both = blocks.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        low, high = F.least("own", "other"), F.greatest("own", "other")
        side = F.when(low == high, -1).when(F.col("own") == low, 0).otherwise(1)
        return both.select(F.xxhash64("key", low, high).alias("key"), "node", "label", side.cast("int").alias("side"))

    def more(found: DataFrame) -> bool:
        nonlocal links, tested
        found = saved(found.distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        if found.isEmpty():
            return False
        tested, links = tested.union(found), saved(links.union(confirmed(found, own)), "links")
        return True

    label = components(links)
    made.append(label)
    again = opened(small, label).select("key", "node", "label", F.lit(-1).alias("side"))
    wide = opened(large, label)
    if wide.isEmpty():
        more(pairs(again, False, False))
    elif more(pairs(again, False, False).union(pairs(tiles(wide), True, True))):
        made.append(components(links))
        more(pairs(tiles(opened(large, made[-1])), False, True))
    dropped(*(t for t in made if t is not links))
    return links
