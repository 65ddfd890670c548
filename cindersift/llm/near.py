"""Near-duplicate documents by HyperMinHash over word shingles.

Each document's distinct five-word shingles are hashed into 256 registers that keep the leading-zero count and
ten mantissa bits of their least hash. Six registers make one of 42 bands; for the bands (only), an empty register
borrows from the others, in an order of its own, until it has one, so that short texts do not meet by one shingle. Pairs
that share a band pass a collision-corrected Jaccard estimate (five standard errors below the threshold) and are then
confirmed on their full shingle sets. A pair at the threshold of 0.8 shares no band with probability 3e-6, at 0.85 with 2e-9.

Defined results: null or blank texts have no shingles and link with nothing; fewer than five words are one shingle;
rows with equal shingle sets are one class, whose node is the smallest doc_id; rows of a null doc_id link with
nothing and have a null component; repeated rows give repeated results; an empty table gives an empty result.
Only the id and text columns are read. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cindersift.llm import banding
from cindersift.llm.graph import components
from cindersift.llm.hashing import U, binary, lists, mixed, pieces, returning, shingles, word_hashes
from cindersift.storage import dropped, written

WORDS = 5
P = 8  # 2 ** P registers
MANTISSA = 10
BAND = 6  # registers in a band key
BANDS = (1 << P) // BAND
#: For each register all registers, in its order of borrowing.
_DONORS = np.argsort(np.random.default_rng(3).random((1 << P, 1 << P)), axis=0)
_ORDER = np.random.default_rng(4).permutation(1 << P)[: BANDS * BAND].reshape(BANDS, BAND)
MARGIN = 5.0


def registers(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of each text's sorted shingle hashes, 0 where a bucket is empty."""
    n = len(at) - 1
    out = np.zeros((n, 1 << P), np.uint16)
    if not len(s):
        return out
    text = np.repeat(np.arange(n), np.diff(at))
    bucket = (s >> U(64 - P)).astype(np.int64)
    first = np.ones(len(s), bool)
    first[1:] = (bucket[1:] != bucket[:-1]) | (text[1:] != text[:-1])
    least = (s[first] << U(P)) >> U(12)  # 52 bits, exact as a double
    width = np.frexp(least.astype(np.float64))[1].astype(np.int64)
    zeros = np.minimum(52 - width, 61)
    mantissa = ((least << (zeros + 13).astype(U)) >> U(64 - MANTISSA)).astype(np.int64)
    out[text[first], bucket[first]] = ((zeros + 1) << MANTISSA) | np.where(width > 0, mantissa, 0)
    return out


def filled(regs: np.ndarray) -> np.ndarray:
    """The registers with what empty ones borrow; rows without a register must not come here."""
    full = regs.copy()
    row, at = np.nonzero(regs == 0)
    for donor in _DONORS:
        if not len(row):
            break
        got = regs[row, donor[at]]
        full[row, at] = got
        row, at = row[got == 0], at[got == 0]
    return full


def band_keys(full: np.ndarray) -> np.ndarray:
    """Band keys of each row of filled registers."""
    key = np.broadcast_to(mixed(np.arange(BANDS, dtype=U) + U(77)), (len(full), BANDS))
    for i in range(BAND):
        key = mixed(key + full[:, _ORDER[:, i]].astype(U))
    return key


def jaccard(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected estimate from registers, and the number of registers that either holds."""
    seen = ((x != 0) | (y != 0)).sum(axis=1)
    same = ((x == y) & (x != 0)).sum(axis=1)
    total = (nx + ny).astype(np.float64)
    chance = 0.68 * nx * ny / np.maximum(total * total, 1) / (1 << MANTISSA)
    return (same / np.maximum(seen, 1) - chance) / (1 - chance), seen


@returning
def _sketches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, data, at in pieces(b.column(2)):
            s, sat = shingles(*word_hashes(data, at), WORDS)
            n = np.diff(sat)
            c = [np.where(n > 0, np.add.reduceat(np.append(mixed(s + U(salt)), U(0)), sat[:-1]), U(0)) if len(n) else s for salt in (1, 2)]
            yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], b.column(1)[lo:hi], pa.array(n), *(pa.array(x.view(np.int64)) for x in c), binary(registers(s, sat))], ["id", "fp", "n", "c1", "c2", "regs"])


def _places(parts: int):
    def places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                full = filled(_regs(b.column(1)))
                node = np.repeat(b.column(0).to_numpy(zero_copy_only=False), BANDS)
                yield banding.packed(band_keys(full).view(np.int64).ravel(), node, np.repeat(banding.sketched(full[:, ::2]), BANDS, axis=0), parts)

    return returning(places)


def _regs(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(len(col), -1)


def _sets(filter_: np.ndarray):
    """Shingle sets of the rows (id, fp, text) that may be asked for, and maps of the hash classes that these occupy."""

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(banding.holds(filter_, b.column(0).to_numpy(zero_copy_only=False))))
            for lo, hi, data, at in pieces(b.column(2)):
                s, sat = shingles(*word_hashes(data, at), WORDS)
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], b.column(1)[lo:hi], binary(banding.occupied(s, sat)), lists(s, sat)], ["id", "fp", "map", "s"])

    return returning(sets)


def _likely(percent: int):
    def likely(na: np.ndarray, nb: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Estimated similarity of pairs, -1 where it is MARGIN standard errors below the threshold or the hash classes rule a link out."""
        t, regs = percent / 100, 2 << P
        good = banding.bounded(na, nb, a[:, regs:], b[:, regs:], percent)
        left = np.flatnonzero(good >= 0)
        j, seen = jaccard(np.ascontiguousarray(a[left, :regs]).view(np.uint16), np.ascontiguousarray(b[left, :regs]).view(np.uint16), na[left], nb[left])
        good[left] = np.where(j >= t - MARGIN * np.sqrt(t * (1 - t) / np.maximum(seen, 1)), np.maximum(j, 0), -1.0)
        return good

    return likely


def near_duplicates(docs: DataFrame, percent: int = 80, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id and kept (id = component_id).

    Documents are linked where 100 * intersection >= percent * union of their shingle sets.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("fp"), F.col(text_col).alias("text"))
    sketches = written(texts.mapInArrow(_sketches, "id long, fp long, n long, c1 long, c2 long, regs binary"), "sketches")
    classes = sketches.where("n > 0 and id is not null").groupBy("c1", "c2", "n").agg(F.min(F.struct("id", "fp")).alias("rep"), F.first("regs").alias("regs"))
    classes = written(classes.select("c1", "c2", "n", F.col("rep.id").alias("node"), F.col("rep.fp").alias("fp"), "regs"), "classes")

    used: list[DataFrame] = []

    def payload(nodes: DataFrame) -> DataFrame:
        own = nodes.join(classes.select("node", "fp", "n", "regs"), "node")
        ids = written(own.select(F.col("node").alias("id"), "fp"), "ids")
        used.append(ids)
        found = texts.where("id is not null").mapInArrow(_sets(banding.wanted(ids.select("id"))), "id long, fp long, map binary, s array<long>")
        found = found.join(ids.hint("shuffle_hash"), ["id", "fp"], "left_semi").dropDuplicates(["id", "fp"])
        return own.join(found.withColumnRenamed("id", "node"), ["node", "fp"]).select("node", "n", F.concat("regs", "map").alias("sketch"), "s")

    def confirmed(pairs: DataFrame, own: DataFrame) -> DataFrame:
        for end in ("a", "b"):
            pairs = pairs.join(own.select(F.col("node").alias(end), F.col("s").alias(f"s{end}")), end)
        both = F.size(F.array_intersect("sa", "sb"))
        return pairs.where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")

    parts = banding.parts(classes.count() * BANDS)
    places = classes.select("node", "regs").mapInArrow(_places(parts), banding.PLACES)
    links = banding.linked(places, parts, banding.differing(percent), payload, _likely(percent), confirmed)
    label = components(links).withColumnRenamed("node", "rep")
    dropped(links, *used)
    named = classes.select("c1", "c2", "n", F.col("node").alias("rep")).join(label, "rep", "left").select("c1", "c2", "n", F.coalesce("component", "rep").alias("component"))
    out = sketches.select("id", "n", "c1", "c2").join(named, ["c1", "c2", "n"], "left")
    component = F.when((F.col("n") == 0) | F.col("id").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, percent: int = 80, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those whose group holds a smaller id; rows of a null id stay."""
    gone = near_duplicates(docs, percent, id_col=id_col, text_col=text_col).where("not kept").select(id_col).distinct()
    return docs.join(gone.hint("shuffle_hash"), docs[id_col].cast("long") == gone[id_col], "left_anti")
