"""Byte-level BPE encoding and decoding by merge replay.

A text is cut into pieces by the tokenizer's pattern. The distinct pieces of a chunk of texts that are not known yet
are laid out as one array of symbols, with an inverted index from each mergeable pair (by its rank) to its positions.
Merges are applied in rank order to all positions at once, of overlapping ones the leftmost, and touch only the index
entries of the two neighbours, so a run of one letter takes steps by the number of ranks, not of letters. Where a merge
makes a pair of a lower rank, that pair goes before the piece's later positions, so each piece gets exactly the ids of
lowest-rank-first merging. Known pieces are kept in a bounded table for the life of a Python worker.

Defined results: null and empty texts have no ids; any Unicode text round-trips; special tokens are ordinary text;
other columns pass through and rows are neither joined nor dropped, so repeated and null-id rows keep theirs.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from cindersift.llm.hashing import chunks, offsets, returning

#: Pieces that a Python worker keeps (about 200 bytes each) before it starts anew with the next batch.
KNOWN_PIECES = 200_000
#: Bytes of text whose new pieces are replayed together.
REPLAY_BYTES = 4 << 20
_CODECS: dict[str, Codec] = {}


class Numbers(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Codec:
    """Ranks of a byte-level vocabulary: its tokens are the ids, and a pair whose bytes are a token may be merged."""

    def __init__(self, file: bytes, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines()) if a}
        self.ranks = ranks
        self.token = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.token[r] = t
        self.name = [str(i) for i in range(len(self.token))]
        self.width = len(self.token)
        self.length = list(map(len, self.token))
        pairs = {}
        for t, r in ranks.items():
            for i in range(1, len(t)):
                x, y = ranks.get(t[:i]), ranks.get(t[i:])
                if x is not None and y is not None:
                    pairs[x * self.width + y] = r
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.byte_pair = np.array([[pairs.get(x * self.width + y, -1) for y in self.byte.tolist()] for x in self.byte.tolist()])
        self.pair_keys = np.array(sorted(pairs) or [-1], np.int64)
        self.pair_ranks = np.array([pairs.get(k, -1) for k in self.pair_keys.tolist()], np.int64)
        # Tokens that are part of a token of a lower rank: merging them may make a pair that goes first.
        self.early = np.zeros(self.width, bool)
        for part in np.divmod(self.pair_keys, self.width):
            self.early[part[(self.pair_ranks >= 0) & (part > self.pair_ranks)]] = True
        self.pieces = regex.compile(pattern).findall
        self.number = Numbers()
        self.ids, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def replay(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, one after another, and their offsets, by merging over all pieces together.

        A step takes the lowest rank in the index and merges its places, from the left where they overlap. Where a
        merge makes a pair of a lower rank, the later places of that piece wait.
        """
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(data)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        piece = np.repeat(np.arange(len(pieces), dtype=np.int32), np.diff(ends, prepend=0))
        over = ends[piece]
        sym = self.byte[data]
        after = np.arange(1, n + 1)
        before = np.arange(-1, n - 1)
        before[np.append(0, ends[:-1])] = -1
        first = np.full(n, -1)
        first[:-1] = self.byte_pair[data[:-1], data[1:]]
        first[ends - 1] = -1
        index: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []

        def add(at: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for rank, lo, hi in zip(ranks[np.append(0, cuts)].tolist(), [0, *cuts.tolist()], [*cuts.tolist(), len(at)]):
                if rank in index:
                    index[rank].append(at[lo:hi])
                else:
                    index[rank] = [at[lo:hi]]
                    heappush(waiting, rank)

        at = np.flatnonzero(first >= 0)
        if len(at):
            add(at, first[at])
        while waiting:
            rank = heappop(waiting)
            at = index.pop(rank)
            p = at[0] if len(at) == 1 else np.unique(np.concatenate(at))
            q = after[p]
            inside = (q < over[p]) & (sym[p] >= 0)
            p, q = p[inside], q[inside]
            whole = after[q] - p == self.length[rank]  # the same bytes as when it was noted, so the same token
            p, q = p[whole], q[whole]
            if not len(p):
                continue
            chained = q[:-1] == p[1:]
            if chained.any():  # of a run of overlapping places every other one
                at = np.arange(len(p))
                lead = np.maximum.accumulate(np.where(np.append(True, ~chained), at, 0))
                p, q = p[(at - lead) % 2 == 0], q[(at - lead) % 2 == 0]
            if self.early[rank]:
                left, right = before[p], after[q]
                x = np.where(left >= 0, sym[left], -1)
                x[1:][left[1:] == q[:-1]] = rank  # merged just before
                y = np.where(right < over[p], sym[np.minimum(right, n - 1)], -1)
                lower = np.zeros(len(p), bool)
                for keys, there in ((x * self.width + rank, x >= 0), (rank * self.width + y, y >= 0)):
                    found = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
                    lower |= there & (self.pair_keys[found] == keys) & (self.pair_ranks[found] < rank)
                if lower.any():
                    own = piece[p]
                    new = np.append(True, own[1:] != own[:-1])
                    before_it = np.cumsum(lower) - lower  # places so far that make a lower pair
                    waits = before_it > before_it[np.flatnonzero(new)][np.cumsum(new) - 1]
                    if waits.any():
                        index[rank] = [p[waits]]
                        heappush(waiting, rank)
                        p, q = p[~waits], q[~waits]
            sym[p], sym[q] = rank, -1
            right = after[q]
            after[p] = right
            more = right < over[p]
            pr, right = p[more], right[more]
            before[right] = pr
            left = before[p]
            left = left[left >= 0]
            keys = np.concatenate([rank * self.width + sym[right], sym[left] * self.width + rank])
            found = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            real = self.pair_keys[found] == keys
            if real.any():
                add(np.concatenate([pr, left])[real], self.pair_ranks[found[real]])
        alive = sym >= 0
        return sym[alive], np.append(0, np.cumsum(alive)[ends - 1]) if n else np.zeros(1, np.int64)

    def numbered(self, texts: list[str]) -> list[np.ndarray]:
        """The number of each piece of each text; new pieces get the next numbers."""
        number = self.number.__getitem__
        return [np.fromiter(map(number, x), np.int32, len(x)) for x in map(self.pieces, texts)]

    def learn(self) -> None:
        """Ids of the pieces that have a number and no ids yet."""
        new = list(islice(self.number, len(self.at) - 1, None))
        if not new:
            return
        whole = np.fromiter((self.ranks.get(x.encode(), -1) for x in new), np.int64, len(new))
        left = np.flatnonzero(whole < 0)
        flat, at = self.replay([new[i].encode() for i in left.tolist()]) if len(left) else (np.zeros(0, np.int64), np.zeros(1, np.int64))
        size = np.ones(len(new), np.int64)
        size[left] = np.diff(at)
        ends = np.cumsum(size)
        ids = np.empty(ends[-1], np.int32)
        ids[(ends - size)[whole >= 0]] = whole[whole >= 0]
        inner = np.repeat(np.isin(np.arange(len(new)), left, assume_unique=True), size)
        ids[inner] = flat
        self.ids = np.concatenate([self.ids, ids])
        self.at = np.concatenate([self.at, self.at[-1] + ends])

    def forget(self) -> None:
        if len(self.number) > KNOWN_PIECES:
            self.number = Numbers()
            self.ids, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        self.forget()
        numbers = self.numbered(texts)
        self.learn()
        return [self.spelled(x) for x in numbers]

    def spelled(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of consecutive pieces."""
        n = self.at[numbers + 1] - self.at[numbers]
        total = np.cumsum(n)
        return self.ids[np.arange(total[-1] if len(n) else 0) + np.repeat(self.at[numbers] - total + n, n)]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def codec(file: bytes, pattern: str) -> Codec:
    """One codec for each vocabulary in a Python worker."""
    key = hashlib.sha256(file + pattern.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(file, pattern)
    return _CODECS[key]


def _encoded(file: bytes, pattern: str, col: int, digests: bool):
    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(file, pattern)
        name = c.name.__getitem__
        for b in batches:
            at = offsets(b.column(col))
            cut = 0
            while cut < b.num_rows:
                first, parts = cut, []
                c.forget()
                while cut < b.num_rows and (cut == first or at[cut] - at[first] < REPLAY_BYTES):
                    hi = next(chunks(at[cut:]))[1] + cut
                    parts.append((cut, hi, c.numbered(b.column(col)[cut:hi].fill_null("").to_pylist())))
                    cut = hi
                c.learn()
                for lo, hi, numbers in parts:
                    ids = [c.spelled(x) for x in numbers]
                    n = np.fromiter(map(len, ids), np.int64, len(ids))
                    if not digests:
                        own = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(np.concatenate(ids), pa.int32()))
                        yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns, own], [f"c{i}" for i in range(b.num_columns + 1)])
                        continue
                    said, back = [], []
                    for x in map(np.ndarray.tolist, ids):
                        said.append(hashlib.sha256(" ".join(map(name, x)).encode()).hexdigest())
                        back.append(hashlib.sha256(c.decode(x)).hexdigest())
                    yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array(n), pa.array(said, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return returning(encode)


def _decoded(file: bytes, pattern: str, col: int):
    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(file, pattern)
        for b in batches:
            texts = pa.array([None if x is None else c.decode(x) for x in b.column(col).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, texts], [f"c{i}" for i in range(b.num_columns + 1)])

    return decode


def vocabulary(path: str) -> bytes:
    """The ranks file, read by the driver; it goes to the tasks with the code (about a megabyte)."""
    with open(path, "rb") as f:
        return f.read()


def _with(docs: DataFrame, name: str, kind: T.DataType, f) -> DataFrame:
    fields = [*docs.schema.fields, T.StructField(name, kind)]
    plain = T.StructType([T.StructField(f"c{i}", x.dataType) for i, x in enumerate(fields)])
    return docs.mapInArrow(f, plain).toDF(*docs.columns, name)


def encoded(docs: DataFrame, ranks_path: str, pattern: str, *, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """All columns and the ids (array<int>) of the text."""
    return _with(docs, ids_col, T.ArrayType(T.IntegerType()), _encoded(vocabulary(ranks_path), pattern, docs.columns.index(text_col), False))


def decoded(docs: DataFrame, ranks_path: str, pattern: str, *, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """All columns and the bytes of the ids; an id beyond the vocabulary is an error, null ids give null."""
    return _with(docs, bytes_col, T.BinaryType(), _decoded(vocabulary(ranks_path), pattern, docs.columns.index(ids_col)))


def digests(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded, and its ids decoded again."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(_encoded(vocabulary(ranks_path), pattern, 1, True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
