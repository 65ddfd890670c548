"""Approximate nearest neighbours: multi-probe p-stable hashing.

A table hashes a vector by HASHES random projections, floor((a . x + b) / w). A query visits, in each table, its own
bucket and then buckets whose hashes are moved by one at some projections, in the order of their estimated success
(the summed squared distances to the boundaries crossed). The candidates of all buckets and tables are merged and
reranked by the exact measure on the original vectors.

Inner products become distances by one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm (0 for queries), so
the largest inner product is the smallest distance also where norms differ. Rows are split by norm into bands of one
doubling, each with an M and hashes of its own, so a few long rows do not push the others away from the queries, which
are scaled to M. Every band of over 4 k rows is hashed; smaller ones are one bucket, as a query that has fewer than k
rows to find gets them all. How many buckets are visited, and the width w, are chosen for each band on a bounded sample: PILOT queries against FITTED rows of the band; cells widen and are measured again until
the share of true neighbours in visited buckets reaches TARGET (the sample misses fewer of few rows, so the target lies
above the 0.9 wanted), at last to one bucket that holds all rows.

Rows and queries meet by table and place: the buckets that share all but their last FINE cells. As the number of
projections grows with the table, so do the cells that tell places apart: a place holds a bounded number of rows on
average at any size of the table, and a query is sent to no more places than it makes visits, once to each. A place of
more rows is dealt to shards of SHARD, one that more queries visit to blocks of ASKED; both are part of the key, so no
place is gathered in one task, however many rows or queries share it. Equal vectors of a batch go on as their k + 1
smallest ids, which is all that can be in a result. Rows go once to each table, with their vectors, so the reranking
needs no join.

Defined results: vectors that are null, zero, of another length than most sampled ones, or that hold null or
non-finite components take no part, nor do rows of a null id; equal scores go to the smaller id; rows with the same id
are one candidate (its best score) and one query; with fewer than k rows to find a query gets them all, and with none no
row. Only the id and vector columns are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cindersift.llm.hashing import mixed
from cindersift.storage import written

TABLES = 2
PILOT, FITTED = 200, 20_000
TARGET = 0.97
#: Rows wanted in a bucket on average; more rows mean more projections, not larger buckets.
BUCKET_ROWS = 2000
SHARD = 16384
#: Queries compared at once with a shard.
BLOCK = 512
MAX_HASHES = 24
#: Classes of length to a doubling, and the class of rows that have none; a band spans one doubling.
CELLS, NO_CELL = 8, -(1 << 40)
WIDENINGS = 24
#: Queries of a block on average.
ASKED = 8192
#: Projections whose cells tell the buckets of a place apart; all others tell places apart.
FINE = 3


def matrix(col: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The usable vectors as doubles, and which rows they are."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    size = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    if dim is None:
        known = size[size > 0]
        dim = int(np.bincount(known).argmax()) if len(known) else 0
    rows = np.flatnonzero((size == dim) & (dim > 0))
    if not len(rows):
        return np.zeros((0, dim)), rows
    flat = col.take(pa.array(rows)).flatten().cast(pa.float64())
    x = flat.to_numpy(zero_copy_only=False).reshape(-1, dim)
    ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return x[ok], rows[ok]


class Hashes:
    """TABLES times ``n`` projections of vectors with one more coordinate."""

    def __init__(self, dim: int, n: int, width: float, largest: float, probes: int, center: np.ndarray):
        rng = np.random.default_rng(20)
        self.coarse = max(1, n - FINE)
        self.dim, self.n, self.width, self.largest, self.probes, self.center = dim, n, width, largest, probes, center
        self.a = rng.normal(size=(dim + 1, TABLES * n))
        self.b = rng.uniform(0, 1, TABLES * n)

    def place(self, x: np.ndarray, query: bool) -> np.ndarray:
        if query:  # of the length of the largest row: the order of the products stays, and the nearest are near
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x, rest = x * (self.largest / np.sqrt((x * x).sum(axis=1, keepdims=True))), np.zeros(len(x))
        else:
            rest = np.sqrt(np.maximum(self.largest**2 - (x * x).sum(axis=1), 0))
        return ((np.column_stack([x, rest]) - self.center) @ self.a / self.width + self.b).reshape(len(x), TABLES, self.n)

    def keys(self, cell: np.ndarray) -> np.ndarray:
        """One long for each row of cells (..., n)."""
        h = np.zeros(cell.shape[:-1], np.uint64)
        for i in range(cell.shape[-1]):
            h = (h ^ cell[..., i].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h.view(np.int64)

    def places(self, cell: np.ndarray) -> np.ndarray:
        return self.keys(cell[..., : self.coarse])

    def probed(self, x: np.ndarray) -> np.ndarray:
        """Cells (row, table, probe, hash) of the buckets to visit, likeliest first."""
        at = self.place(x, True)
        cell = np.floor(at)
        within = at - cell
        # Squared distance to the lower and the upper boundary of each hash; sets of moves in the order of their sum.
        cost = np.concatenate([within**2, (1 - within) ** 2], axis=2)
        order = np.argsort(cost, axis=2)
        ranked = np.take_along_axis(cost, order, axis=2)
        moves = self.sets()
        total = np.stack([ranked[:, :, list(s)].sum(axis=2) if s else np.zeros(ranked.shape[:2]) for s in moves], axis=2)
        clash = np.stack([self._clash(order, s) for s in moves], axis=2)
        total[clash] = np.inf
        best = np.argsort(total, axis=2, kind="stable")[:, :, : self.probes]
        moved = np.repeat(cell[:, :, None, :], best.shape[2], axis=2)
        for i, s in enumerate(moves):
            if s:
                r, t, p = np.nonzero(best == i)
                for j in s:
                    which = order[r, t, j]
                    moved[r, t, p, which % self.n] += np.where(which < self.n, -1, 1)
        return moved

    def sets(self) -> list[tuple[int, ...]]:
        """Candidate sets of moves, as ranks in a query's own order of boundaries: all of up to ``n`` moves, cheapest ranks first."""
        from itertools import combinations

        n = 2 * self.n
        if self.n <= 5:
            return [s for k in range(self.n + 1) for s in combinations(range(n), k)]
        out = [s for k in (0, 1, 2) for s in combinations(range(n), k)]
        return out + [s for k in (3, 4) for s in combinations(range(min(n, 12)), k)]

    def _clash(self, order: np.ndarray, s: tuple[int, ...]) -> np.ndarray:
        out = np.zeros(order.shape[:2], bool)
        for i, x in enumerate(s):
            for y in s[:i]:
                out |= order[:, :, x] % self.n == order[:, :, y] % self.n
        return out


def _top(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k best of each row, ties to the smaller id."""
    if score.shape[1] > k:
        edge = -np.partition(-score, k - 1, axis=1)[:, k - 1]
        r, c = np.nonzero(score >= edge[:, None])
        order = np.lexsort((ids[c], -score[r, c], r))
        r, c = r[order], c[order]
        first = np.searchsorted(r, np.arange(len(score)))
        keep = np.arange(len(r)) - first[r] < k
        return r[keep], c[keep]
    r, c = np.divmod(np.arange(score.size), max(score.shape[1], 1))
    return r, c


def norm_cells(x: np.ndarray) -> np.ndarray:
    """Fine classes of length, CELLS to a doubling; NO_CELL where the square of a length is beyond doubles."""
    with np.errstate(over="ignore", under="ignore", divide="ignore"):
        at = np.floor(np.log2(np.einsum("ij,ij->i", x, x)) * (CELLS / 2))
    return np.where(np.isfinite(at), at, NO_CELL).astype(np.int64)


def _norms(dim: int):
    def norms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, _ = matrix(b.column(0), dim)
            cell, back = np.unique(norm_cells(x), return_inverse=True)
            q = np.zeros(len(cell))
            with np.errstate(over="ignore"):
                np.maximum.at(q, back, np.einsum("ij,ij->i", x, x))
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.bincount(back, minlength=len(cell)).astype(np.int64)), pa.array(q)], ["cell", "n", "q"])

    return norms


class Bands:
    """Rows in bands of like length, each with hashes of its own; rows of the other bands (``exact``) are all compared."""

    def __init__(self, dim: int, edges: list[tuple[int, int]], hashes: list[Hashes]):
        self.dim, self.edges, self.hashes = dim, edges, hashes

    def of(self, x: np.ndarray) -> np.ndarray:
        """The band of each row, -1 for the exact one."""
        cell, out = norm_cells(x), np.full(len(x), -1)
        for i, (lo, hi) in enumerate(self.edges):
            out[(cell >= lo) & (cell <= hi)] = i
        return out


def bands(cells: list[tuple[int, int, float]], least: int) -> list[tuple[int, int, int, float]]:
    """(lowest cell, highest cell, rows, largest length) of the bands of over ``least`` rows, from (cell, rows, largest square)."""
    out, left = [], sorted((c for c in cells if c[0] != NO_CELL), reverse=True)
    while left:
        top = left[0][0]
        part = [c for c in left if c[0] > top - CELLS]
        left = left[len(part) :]
        n = sum(c[1] for c in part)
        if n > least:
            out.append((part[-1][0], top, n, float(np.sqrt(max(c[2] for c in part))) * (1 + 1e-9)))
    return out


def fitted(x: np.ndarray, ids: np.ndarray, pilot: np.ndarray, pilot_ids: np.ndarray, n_rows: int, largest: float, k: int) -> Hashes:
    """Projections, width and visits that find TARGET of the pilot's neighbours among the sampled rows of a band.

    Cells are widened until they do, at last to one bucket that holds all rows.
    """
    dim = x.shape[1]
    whole = np.column_stack([x, np.sqrt(np.maximum(largest**2 - (x * x).sum(axis=1), 0))])
    center = whole.mean(axis=0)
    score = pilot @ x.T
    score[pilot_ids[:, None] == ids[None, :]] = -np.inf
    truth = np.argsort(-score, axis=1)[:, : min(k, len(x) - 1)]
    n = int(min(MAX_HASHES, max(2, np.ceil(np.log2(max(n_rows / BUCKET_ROWS, 4))))))
    spread = float(np.sqrt(((whole - center) ** 2).sum(axis=1).mean()))
    best = Hashes(dim, n, 2.0 * spread or 1.0, largest, 1, center)
    limit = len(best.sets())
    for _ in range(WIDENINGS):
        best.probes = limit
        keys = best.keys(best.probed(pilot))
        own = best.keys(np.floor(best.place(x, False)))
        first = np.full(truth.shape, limit)  # how many visits come before the one that finds it
        for t in range(TABLES):
            for i in range(len(pilot)):
                same = own[truth[i], t][:, None] == keys[i, t][None, :]
                first[i] = np.minimum(first[i], np.where(same.any(axis=1), same.argmax(axis=1), limit))
        probes = 1
        while probes < limit and first.size and (first < probes).mean() < TARGET:
            probes = min(probes + max(1, probes // 3), limit)
        best.probes = probes
        if not first.size or (first < probes).mean() >= TARGET:
            return best
        best.width *= 2
    best.width, best.probes = np.inf, 1
    return best


def tuned(vectors: DataFrame, k: int) -> Bands | None:
    """Bands and their hashes, from bounded samples of the rows and the lengths of all."""

    def sampled(rows: DataFrame, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        sample = rows.orderBy(F.xxhash64("id"), "id").limit(FITTED).toArrow()
        x, at = matrix(sample.column("v"), dim)
        return x, sample.column("id").to_numpy()[at]

    x, ids = sampled(vectors)
    if not len(x):
        return None
    dim = x.shape[1]
    cells = vectors.select("v").mapInArrow(_norms(dim), "cell long, n long, q double").groupBy("cell").agg(F.sum("n").alias("n"), F.max("q").alias("q")).collect()
    cells = [(r.cell, r.n, r.q) for r in cells]
    dense = bands(cells, 4 * k)
    hashes = []
    for lo, hi, n, largest in dense:
        own, own_ids = x, ids
        if n < sum(c[1] for c in cells):
            alone = Bands(dim, [(lo, hi)], [])

            def inside(batches: Iterable[pa.RecordBatch], alone: Bands = alone) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    y, at = matrix(b.column(1), alone.dim)
                    yield b.take(pa.array(at[alone.of(y) == 0]))

            own, own_ids = sampled(vectors.mapInArrow(inside, vectors.schema), dim)
        hashes.append(fitted(own, own_ids, x[:PILOT], ids[:PILOT], n, largest, k))
    return Bands(dim, [d[:2] for d in dense], hashes)


def _few(x: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which rows stay of a batch: of equal vectors those with the k + 1 smallest ids."""
    word = np.ascontiguousarray(x).view(np.uint64)
    h = mixed(word + mixed(np.arange(1, word.shape[1] + 1, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)
    order = np.lexsort((ids, h))
    new = np.append(True, h[order][1:] != h[order][:-1])
    run, starts = np.cumsum(new) - 1, np.flatnonzero(new)
    other = ids[order] != np.append(ids[order][:1], ids[order][:-1])  # than the row before
    number = np.cumsum(other | new)
    late = (number - number[starts][run] > k) | ~(other | new)
    if not late.any():
        return np.arange(len(x))
    some = np.flatnonzero(np.isin(run, run[late]))
    differs = (x[order[some]] != x[order[starts[run[some]]]]).any(axis=1)
    late &= ~np.isin(run, run[some[differs]])  # a run that holds another vector by chance stays whole
    return np.sort(order[~late])


def _indexed(h: Bands, kind: np.dtype, k: int):
    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, rows = matrix(b.column(1), h.dim)
            if not len(x):
                continue
            few = _few(x, b.column(0).take(pa.array(rows)).to_numpy(zero_copy_only=False), k)
            x, rows = x[few], rows[few]
            band = h.of(x)
            for i in np.unique(band):
                part = np.flatnonzero(band == i)
                y = x[part]
                ids = b.column(0).take(pa.array(rows[part]))
                blob = pa.array([r.tobytes() for r in y.astype(kind)], pa.binary())
                if i < 0:
                    place = bucket = np.zeros((len(y), 1), np.int64)
                else:
                    cells = np.floor(h.hashes[i].place(y, False))
                    place, bucket = h.hashes[i].places(cells), h.hashes[i].keys(cells)
                for t in range(bucket.shape[1]):
                    number = -1 if i < 0 else i * TABLES + t
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(place[:, t])), pa.array(np.full(len(y), number, np.int32)), pa.array(np.ascontiguousarray(bucket[:, t])), ids, blob], ["place", "t", "bucket", "id", "v"])

    return index


def _probes(h: Bands, kind: np.dtype):
    """One row for each query, table and place, with all buckets that the query visits there."""

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["place", "t", "buckets", "id", "v"]
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                x, rows = matrix(part.column(1), h.dim)
                if not len(x):
                    continue
                ids = part.column(0).take(pa.array(rows))
                blob = pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())
                zeros = np.zeros(len(x), np.int64)
                every = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32)), pa.array(zeros))
                yield pa.RecordBatch.from_arrays([pa.array(zeros), pa.array(np.full(len(x), -1, np.int32)), every, ids, blob], names)
                for i, own in enumerate(h.hashes):
                    cells = own.probed(x)
                    place, bucket = own.places(cells), own.keys(cells)
                    for t in range(TABLES):
                        who = np.repeat(np.arange(len(x)), place.shape[2])
                        p, k = place[:, t].ravel(), bucket[:, t].ravel()
                        order = np.lexsort((k, p, who))
                        who, p, k = who[order], p[order], k[order]
                        new = np.append(True, (p[1:] != p[:-1]) | (who[1:] != who[:-1]))
                        once = new | np.append(True, k[1:] != k[:-1])  # a bucket reached by two sets of moves is visited once
                        who, p, k, new = who[once], p[once], k[once], new[once]
                        starts = np.flatnonzero(new)
                        buckets = pa.ListArray.from_arrays(pa.array(np.append(starts, len(p)).astype(np.int32)), pa.array(k))
                        which = pa.array(who[starts])
                        yield pa.RecordBatch.from_arrays([pa.array(p[starts]), pa.array(np.full(len(starts), i * TABLES + t, np.int32)), buckets, ids.take(which), blob.take(which)], names)

    return probe


def _answered(k: int, kind: np.dtype):
    none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    def answer(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or queries.empty:
            return none
        rows = rows.sort_values("bucket", kind="stable")
        x = np.frombuffer(b"".join(rows["v"]), kind).reshape(len(rows), -1).astype(np.float64)
        ids, bucket, out = rows["id"].to_numpy(), rows["bucket"].to_numpy(), []
        for lo in range(0, len(queries), BLOCK):
            own = queries.iloc[lo : lo + BLOCK]
            q = np.frombuffer(b"".join(own["v"]), kind).reshape(len(own), -1).astype(np.float64)
            asked = own["id"].to_numpy()
            who = np.repeat(np.arange(len(own)), own["buckets"].map(len))
            visited = np.concatenate(own["buckets"].to_list())
            found = []
            for one in np.unique(visited):
                i, j = np.searchsorted(bucket, one), np.searchsorted(bucket, one, "right")
                if i == j:
                    continue
                w = who[visited == one]
                score = q[w] @ x[i:j].T
                score[asked[w][:, None] == ids[None, i:j]] = -np.inf
                r, c = _top(score, ids[i:j], k)
                keep = score[r, c] > -np.inf
                found.append((w[r[keep]], c[keep] + i, score[r[keep], c[keep]]))
            if found:
                r, c, score = (np.concatenate(f) for f in zip(*found))
                order = np.lexsort((ids[c], -score, r))
                r, c, score = r[order], c[order], score[order]
                keep = np.arange(len(r)) - np.searchsorted(r, r) < k
                out.append(pd.DataFrame({"query_id": asked[r[keep]], "vec_id": ids[c[keep]], "score": score[keep]}))
        return pd.concat(out) if out else none

    return answer


def met(rows: DataFrame, asked: DataFrame, h: Bands, kind: np.dtype, k: int) -> tuple[DataFrame, DataFrame]:
    """Rows and queries by (t, place, shard, block), only of places that have both."""
    index = rows.mapInArrow(_indexed(h, kind, k), "place long, t int, bucket long, id long, v binary")
    probes = asked.mapInArrow(_probes(h, kind), "place long, t int, buckets array<long>, id long, v binary")
    counts = index.groupBy("place", "t").agg(F.count("*").alias("n")).join(probes.groupBy("place", "t").agg(F.count("*").alias("q")), ["place", "t"])
    counts = written(counts.select("place", "t", F.ceil(F.col("n") / SHARD).alias("shards"), F.ceil(F.col("q") / ASKED).alias("blocks")), "places")

    def dealt(df: DataFrame, own: str, number: str, other: str, every: str) -> DataFrame:
        kept = df.columns
        df = df.join(counts, ["place", "t"]).withColumn(own, F.pmod(F.xxhash64("id"), F.col(number)))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(every) - 1))).select(*kept, "shard", "block")

    return dealt(index, "shard", "shards", "block", "blocks"), dealt(probes, "block", "blocks", "shard", "shards")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k rows of largest inner product that were found, itself excluded by id."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null")
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null")
    none = "query_id long, rank int, vec_id long, score double"
    h = tuned(rows, k)
    if h is None:
        return vectors.sparkSession.createDataFrame([], none)
    single = all(dict(df.dtypes)["v"] == "array<float>" for df in (rows, asked))
    kind = np.dtype(np.float32 if single else np.float64)  # of the original components, so products are of these
    index, probes = met(rows, asked, h, kind, k)
    keys = ["place", "t", "shard", "block"]
    found = index.groupBy(*keys).cogroup(probes.groupBy(*keys)).applyInPandas(_answered(k, kind), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("b"))
    best = best.select("query_id", F.posexplode(F.slice("b", 1, k)).alias("pos", "x"))
    return best.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))
