"""Fuzzy line deduplication by MinHash over character shingles.

Lines are split at line feeds. A line's set holds its shingles (code points); a shorter line is one shingle. A scheme
says how long they are: FIVE for corpora, whose lines are mostly short, with 64 one-permutation minima in 16 bands of
four (a pair at 0.8 shares no band with probability 2e-4, at 0.9 with 4e-8); TEN for long lines, with 36 in 12 bands of three
(2e-4 and 5e-8). A minimum without a shingle borrows from the others, in an order of its own, until it has one: a band of a
short line would else be a single shingle that many lines share. Bands propose pairs, exact Jaccard similarity of 0.8 confirms them, and distributed union-find makes components. Of
each component the occurrence with the smallest (doc_id, line number) stays.

Defined results: blank lines (Unicode white space only) always stay; null texts have no lines and stay null; rows that
share a doc_id and a line number are one occurrence, so a repeated row keeps what its twin keeps; rows of a null doc_id
keep all their lines and take part in nothing; a document may lose all its lines and then has a blank text, or goes where
the caller asks for that (a document that was blank before stays). Other columns pass through, whatever their names.
Equal lines are compared by 64-bit hashes, shingles of two lines by 50 bits of theirs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cindersift.llm import banding
from cindersift.llm.graph import components
from cindersift.llm.hashing import U, binary, chunks, mixed, offsets, powers, returning
from cindersift.storage import dropped, written


class Scheme(NamedTuple):
    """Characters of a shingle; bands, and minima of each."""

    shingle: int
    bands: int
    rows: int


TEN = Scheme(10, 12, 3)
#: One inner character alters five shingles: lines from 49 characters on are alike that differ in one.
FIVE = Scheme(5, 16, 4)
PERCENT = 80
#: Bytes of texts looked at together: their arrays stay in a core's cache.
CHUNK = 1 << 17
#: Bits of a shingle's hash in sets; the rest of 64 bits hold the line's place in its chunk.
PACKED = 50
_CODE = np.random.default_rng(7).integers(1, 1 << 63, 1 << 16, dtype=np.uint64)


class Lines:
    """All non-blank lines of some texts: code points, line ends, hashes, the text (row) and the line number of each."""

    def __init__(self, texts: list[str]):
        joined = "\n".join(texts)
        self.text = joined
        self.cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(self.cps)
        self.end = np.append(np.flatnonzero(self.cps == 10), n)
        self.start = np.append(0, self.end[:-1] + 1)
        per_text = np.fromiter((t.count("\n") + 1 for t in texts), np.int64, len(texts))
        row = np.repeat(np.arange(len(texts)), per_text)
        number = np.arange(len(row)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        keep = np.fromiter(map(str.strip, joined.split("\n")), object, len(row)).astype(bool)
        self.start, self.end, self.row, self.number = self.start[keep], self.end[keep], row[keep], number[keep]
        up, self.down = powers(n + 1)
        self.total = np.zeros(n + 1, U)
        if not n or int(self.cps.max()) >> 16 == 0:
            code = _CODE[self.cps]
        else:
            code = _CODE[self.cps & 0xFFFF] + (self.cps >> 16).astype(U) * U(0x9E3779B97F4A7C15)
        np.cumsum(code * up[:n], out=self.total[1:])
        length = (self.end - self.start).astype(U)
        self.hash = mixed((self.total[self.end] - self.total[self.start]) * self.down[self.start] + mixed(length))

    def only(self, lines: np.ndarray) -> Lines:
        """The same texts with some of their lines."""
        out = object.__new__(Lines)
        out.__dict__ |= self.__dict__
        out.start, out.end, out.row, out.number, out.hash = (x[lines] for x in (self.start, self.end, self.row, self.number, self.hash))
        return out

    def distinct(self) -> Lines:
        return self.only(np.sort(np.unique(self.hash, return_index=True)[1]))

    def unseen(self, seen: set[int]) -> Lines:
        """Those whose hash is new to ``seen``, which learns it. Of distinct lines."""
        new = [i for i, h in enumerate(self.hash.tolist()) if h not in seen]
        out = self if len(new) == len(self.hash) else self.only(np.array(new, np.int64))
        seen.update(out.hash.tolist())
        return out

    def texts(self) -> list[str]:
        return [self.text[i:j] for i, j in zip(self.start.tolist(), self.end.tolist())]

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Shingle hashes (with repeats) of the lines in order and the line of each."""
        count = self.end - self.start - (size - 1)
        short = np.flatnonzero(count < 1)
        count = np.maximum(count, 0)
        line = np.repeat(np.arange(len(count)), count)
        at = np.arange(len(line)) + np.repeat(self.start - (np.cumsum(count) - count), count)
        n = len(self.cps) + 1 - size  # places of the text where a shingle may begin
        if 2 * len(at) > n > 0:  # nearly all do: in their order, then without those across line ends
            h = mixed((self.total[size:] - self.total[:n]) * self.down[:n])[at]
        else:
            h = mixed((self.total[at + size] - self.total[at]) * self.down[at])
        if not len(short):
            return h, line
        return np.concatenate([h, mixed(self.hash[short] + U(1))]), np.concatenate([line, short])

    def sets(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles of each line, sorted, and their offsets."""
        h, line = self.shingles(size)
        packed = np.sort((line.astype(U) << U(PACKED)) | (h >> U(64 - PACKED)))
        packed = packed[np.append(True, packed[1:] != packed[:-1])[: len(packed)]]
        return packed & U((1 << PACKED) - 1), np.searchsorted(packed, np.arange(len(self.start) + 1, dtype=U) << U(PACKED))

    def minima(self, scheme: Scheme) -> np.ndarray:
        """The minima of each line, as rows."""
        m = scheme.bands * scheme.rows
        least = np.full(len(self.start) * m, 0xFFFFFFFF, np.uint32)
        h, line = self.shingles(scheme.shingle)
        np.minimum.at(least, line * m + ((h >> U(32)) * U(m) >> U(32)).astype(np.int64), (h & U(0xFFFFFFFE)).astype(np.uint32))
        empty = np.flatnonzero(least == 0xFFFFFFFF)
        first = least.copy()
        for donor in np.argsort(np.random.default_rng(m).random((m, m)), axis=0):
            if not len(empty):
                break
            own = empty % m
            least[empty] = first[empty - own + donor[own]]
            empty = empty[least[empty] == 0xFFFFFFFF]
        return least.reshape(-1, m)

    def keys(self, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
        """Band keys and the sketch of each line."""
        least = self.minima(scheme)
        rows = least.reshape(-1, scheme.bands, scheme.rows).astype(U)
        key = mixed(np.arange(scheme.bands, dtype=U) + U(99))[None, :]
        for i in range(scheme.rows):
            key = mixed(key + rows[:, :, i])
        return key, banding.sketched(least)


def _lines(batch: pa.RecordBatch, col: int) -> Iterator[tuple[int, Lines]]:
    for lo, hi in chunks(offsets(batch.column(col)), CHUNK):
        yield lo, Lines(batch.column(col)[lo:hi].fill_null("").to_pylist())


def _places(scheme: Scheme, parts: int):
    def places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got, seen = [], set()
            for _, x in _lines(b, 0):
                x = x.distinct().unseen(seen)
                key, sketch = x.keys(scheme)
                got.append((key.ravel(), np.repeat(x.hash, scheme.bands), np.repeat(sketch, scheme.bands, axis=0)))
            if got:
                key, node, sketch = (np.concatenate(c) for c in zip(*got))
                yield banding.packed(key.view(np.int64), node.view(np.int64), sketch, parts)

    return returning(places)


OCCURRENCES = "node long, id long, line long, n long, sketch binary, text string"


def _occurrences(scheme: Scheme, filter_: np.ndarray):
    """Every line's hash, text and number; once in a batch, for lines that may be asked for, also the number of their shingles, a map of the hash classes that these occupy, and the line."""

    def occurrences(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: set[int] = set()
            for lo, x in _lines(b, 1):
                asked = np.flatnonzero(banding.holds(filter_, x.hash.view(np.int64)))
                hashes = x.hash[asked].tolist()
                asked = asked[[not (h in seen or seen.add(h)) for h in hashes]] if hashes else asked
                y = x.only(asked)
                s, at = y.sets(scheme.shingle)
                told = np.zeros(len(x.start), bool)
                told[asked] = True
                place = pa.array(np.cumsum(told) - 1, mask=~told)
                own = [c.take(place) for c in (pa.array(np.diff(at)), binary(banding.occupied(s, at)), pa.array(y.texts(), pa.string()))]
                yield pa.RecordBatch.from_arrays([pa.array(x.hash.view(np.int64)), b.column(0).take(pa.array(x.row + lo)), pa.array(x.number), *own], ["node", "id", "line", "n", "sketch", "text"])

    return returning(occurrences)


def _likely(na: np.ndarray, nb: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return banding.bounded(na, nb, a, b, PERCENT)


def _similar(scheme: Scheme):
    def similar(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of lines (a, b, text of a, text of b) to those whose shingle sets are similar enough."""
        for b in batches:
            for lo, hi in chunks(offsets(b.column(2)), CHUNK):
                n = hi - lo
                sets = [Lines(b.column(col)[lo:hi].to_pylist()).sets(scheme.shingle) for col in (2, 3)]
                size = sum(np.diff(at) for _, at in sets)
                both = np.sort(np.concatenate([(np.repeat(np.arange(n, dtype=U), np.diff(at)) << U(PACKED)) | h for h, at in sets]))
                both = np.bincount((both[1:][both[1:] == both[:-1]] >> U(PACKED)).astype(np.int64), minlength=n)
                yield b.select([0, 1]).slice(lo, n).filter(pa.array(100 * both >= PERCENT * (size - both)))

    return returning(similar)


def _rewritten(col: int, drop_emptied: bool):
    def rewrite(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, stays = [], []
            for text, gone in zip(b.column(col).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                stay = True
                if text is not None and gone:
                    gone = set(gone)
                    text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
                    stay = not drop_emptied or bool(text.strip())
                out.append(text)
                stays.append(stay)
            arrays = [pa.array(out, b.schema.field(col).type) if i == col else b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(arrays, [f"c{i}" for i in range(len(arrays))]).filter(pa.array(stays, pa.bool_()))

    return returning(rewrite)


def duplicate_lines(docs: DataFrame, scheme: Scheme = TEN, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line, first_id, first_line): every line occurrence to drop and the one that stays for it."""
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # Every line has a line feed after it but the last: counted without a look into the texts' words.
    breaks = texts.agg(F.sum(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    parts = banding.parts(breaks * scheme.bands)

    found: list[DataFrame] = []

    def payload(nodes: DataFrame) -> DataFrame:
        found.append(written(texts.mapInArrow(_occurrences(scheme, banding.wanted(nodes)), OCCURRENCES), "occurrences"))
        own = found[0].where("text is not null").select("node", "n", "sketch", F.col("text").alias("line"))
        return own.join(nodes.hint("shuffle_hash"), "node", "left_semi").dropDuplicates(["node"])

    def confirmed(pairs: DataFrame, own: DataFrame) -> DataFrame:
        for end in ("a", "b"):  # the texts, which are smaller than their sets
            pairs = pairs.join(own.select(F.col("node").alias(end), F.col("line").alias(f"t{end}")), end)
        return pairs.select("a", "b", "ta", "tb").mapInArrow(_similar(scheme), "a long, b long")

    places = texts.select("text").mapInArrow(_places(scheme, parts), banding.PLACES)
    links = banding.linked(places, parts, banding.differing(PERCENT), payload, _likely, confirmed)
    label = components(links)
    places = found[0].select("node", "id", "line")
    first = places.groupBy("node").agg(F.min(F.struct("id", "line")).alias("first"), F.count("*").alias("n"))
    named = written(first.join(label, "node", "left").where("n > 1 or component is not null").select("node", "first", F.coalesce("component", "node").alias("component")), "named")
    dropped(links, label)
    # A table of its own: joined to a plain scan, a large component's rows can be split over tasks.
    stays = written(named.groupBy("component").agg(F.min("first").alias("stays")), "stays")
    stays = named.select("node", "component").join(stays, "component").select("node", F.col("stays.id").alias("first_id"), F.col("stays.line").alias("first_line"))
    return places.join(stays, "node").where("id <> first_id or line <> first_line").select("id", "line", "first_id", "first_line")


def deduplicated(docs: DataFrame, scheme: Scheme = TEN, *, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = False) -> DataFrame:
    """The documents with one line per component; all columns pass through. drop_emptied: without those that lost their last line that isn't blank."""
    gone = duplicate_lines(docs, scheme, id_col=id_col, text_col=text_col).groupBy("id").agg(F.collect_set("line").alias("gone"))
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # no name of a column can clash
    with_gone = plain.join(gone.hint("shuffle_hash"), plain[f"c{docs.columns.index(id_col)}"].cast("long") == gone["id"], "left").drop("id")
    return with_gone.mapInArrow(_rewritten(docs.columns.index(text_col), drop_emptied), plain.schema).toDF(*docs.columns)
