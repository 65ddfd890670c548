"""Benchmark decontamination: a BM25 inverted index of the test items, searched with every training passage.

Passages are windows of twice the longest item's words, one item length apart, so that any item lies whole in one.
A passage's distinct words are the query. Impacts are divided by the item's score against itself, so one threshold
serves all items; document frequencies, the number of items and their mean length are those of the whole benchmark.

The index holds, for each word, its postings (item, impact) in blocks of BLOCK neighbouring items with each block's
greatest impact. Words are numbered by their list's greatest impact, so the lists of a passage come sorted by it.
Block-max WAND runs over all passages of a batch at once: words up to the pivot, whose greatest impacts add up to
less than PIVOT of the threshold, can't lift an item over it by themselves, so only the lists after the pivot are
opened; a block whose maxima (with what the words before the pivot may add) stay below the threshold is skipped;
the postings of the other blocks are added up, and items that can still reach the threshold are scored in full.

What reaches the threshold is verified: the share of the question's five-word shingles and of the answer's three-word
shingles that the passage holds. An item without an answer is all question; a part of fewer words is one shingle,
the whole sequence. Words are runs of letters and digits (bytes above 127 count as letters), A-Z lower-cased.

Defined results: null or empty texts leak nothing; items without a word are ignored, and all others searched, however
short (``min_words`` may say otherwise); an item longer than SEGMENT words is searched in segments, the last of which
ends with it; rows of a null id are searched too, with a null id; repeated rows repeat their result; repeated items
report once per item id; an empty benchmark finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from cindersift.llm import hashing
from cindersift.llm.hashing import U, pieces, returning, rolling, utf8
from cindersift.storage import written

K1, B = 1.2, 0.75
THRESHOLD = 0.35
#: Share of the threshold that the words before the pivot may add up to.
PIVOT = 0.3
QUESTION_SHARE, ANSWER_SHARE = 0.5, 0.3
QUESTION_WORDS, ANSWER_WORDS = 5, 3
SEGMENT = 128
BLOCK = 8
#: Words of items of one index, which is broadcast (about 40 bytes a word); more items are searched in slices, with the same statistics.
SLICE = 1_000_000
#: Bytes of texts looked at together: their arrays stay in a core's cache.
CHUNK = 1 << 18
#: Bounds of (passage, block) looked at together.
CELLS = 1 << 21

WORD_BREAK = np.ones(256, bool)
WORD_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
UNITS = "item long, words binary, question int, answer int"


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return hashing.word_hashes(data, at, WORD_BREAK)


def _expanded(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of ``count`` from ``start``: the range of each element, and the element."""
    of = np.repeat(np.arange(len(count)), count)
    return of, np.arange(len(of)) + np.repeat(start - (np.cumsum(count) - count), count)


def _shares(part: np.ndarray, k: int) -> tuple[int, np.ndarray]:
    k = min(k, len(part))
    return k, np.unique(rolling(part, k)) if k else part


class Index:
    """Postings of units (item id, words, question words, answer words). df: in how many of n units a word is."""

    def __init__(self, units: list[tuple[int, np.ndarray, int, int]], df: dict[int, int], n: int, mean: float, size: int):
        # Units that share their most common word, so mostly of one language, are neighbours, the shorter ones first.
        units = sorted(units, key=lambda u: (max((df[x], x) for x in u[1].tolist()), len(u[1]), u[0], u[1].tobytes()))
        self.size, self.items = size, np.array([u[0] for u in units], np.int64)
        self.grams = [(_shares(w[:q], QUESTION_WORDS), _shares(w[q:], ANSWER_WORDS)) for _, w, q, _ in units]
        length = np.array([len(u[1]) for u in units], np.float64)
        vocabulary, term = np.unique(np.concatenate([u[1] for u in units]), return_inverse=True)
        key, tf = np.unique(term * len(units) + np.repeat(np.arange(len(units)), length.astype(np.int64)), return_counts=True)
        term, unit = key // len(units), key % len(units)
        found = np.array([df[x] for x in vocabulary.tolist()], np.float64)
        idf = np.log1p((n - found + 0.5) / (found + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[unit] / mean))
        impact /= np.bincount(unit, impact, len(units))[unit]
        top = np.zeros(len(vocabulary))
        np.maximum.at(top, term, impact)
        order = np.argsort(top, kind="stable")
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        self.top = top[order]
        # Postings by word (in its new number), then unit.
        order = np.lexsort((unit, number[term]))
        term, self.unit, self.impact = number[term][order], unit[order], impact[order]
        block = term * len(units) + self.unit // BLOCK
        starts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        self.block, self.block_max = self.unit[starts] // BLOCK, np.maximum.reduceat(self.impact, starts)
        self.block_at = np.append(starts, len(term))  # postings of each block
        self.list_at = np.searchsorted(term[starts], np.arange(len(vocabulary) + 1))  # blocks of each word
        self.blocks = -(-len(units) // BLOCK)
        # The same by unit, for scores in full.
        order = np.argsort(self.unit, kind="stable")
        self.own_term, self.own_impact = term[order], self.impact[order]
        self.own_at = np.searchsorted(self.unit[order], np.arange(len(units) + 1))
        # Where to look a word up: by its hash's first bits, then among the few that share them.
        self.vocabulary, self.number = vocabulary, number
        self.shift = U(64 - max(8, int(len(vocabulary) * 8).bit_length()))
        slot, first, most = np.unique(vocabulary >> self.shift, return_index=True, return_counts=True)
        self.first = np.full(1 << (64 - int(self.shift)), -1, np.int32)
        self.first[slot.astype(np.int64)] = first
        self.most = int(most.max())

    def known(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are in the index, and their numbers."""
        at = self.first[(w >> self.shift).astype(np.int64)]
        there = np.flatnonzero(at >= 0)
        at, w = at[there], w[there]
        right = self.vocabulary[at] == w
        for i in range(1, self.most):
            other = np.minimum(at + i, len(self.vocabulary) - 1)
            found = ~right & (self.vocabulary[other] == w)
            at, right = np.where(found, other, at), right | found
        return there[right], self.number[at[right]]

    def windows(self, wat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first word and end of each window of consecutive texts' words."""
        step, n = self.size, np.diff(wat)
        per = np.where(n > 0, np.maximum(1, -(-(n - step) // step)), 0)
        text = np.repeat(np.arange(len(n)), per)
        lo = wat[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)) * step
        return text, lo, np.minimum(lo + 2 * step, wat[1:][text])

    def queries(self, w: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct indexed words (by number) of each window, as (window, word) sorted by both."""
        there, term = self.known(w)
        own = np.repeat(np.arange(len(lo)), np.diff(np.append(lo, len(w))))[there]  # the last window that starts at or before the word
        before = own - 1
        also = (before >= 0) & (hi[np.maximum(before, 0)] > there)
        key = np.unique(np.concatenate([own, before[also]]) * len(self.top) + np.concatenate([term, term[also]]))
        return key // len(self.top), key % len(self.top)

    def retrieved(self, window: np.ndarray, term: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(window, unit, score) of all that reach the threshold, from :meth:`queries`, a range of windows at a time."""
        if not len(window):
            return
        first = np.flatnonzero(np.append(True, window[1:] != window[:-1]))
        per = max(1, CELLS // max(self.blocks, 1))
        for k in range(0, len(first), per):
            i, j = first[k], first[k + per] if k + per < len(first) else len(window)
            yield self._reached(window[i:j], term[i:j], first[k : k + per] - i)

    def _reached(self, window: np.ndarray, term: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(first)
        run = np.repeat(np.arange(n), np.diff(np.append(first, len(window))))
        total = np.cumsum(self.top[term])
        before = np.append(0.0, total)[first]
        sums = total - before[run]
        after = sums >= PIVOT * THRESHOLD  # the lists after the pivot
        rest = np.zeros(n)  # what those before it may add to any unit
        np.maximum.at(rest, run[~after], sums[~after])
        enough = sums[np.append(first[1:], len(window)) - 1] >= THRESHOLD
        opened = np.flatnonzero(after & enough[run])
        t = term[opened]
        of, entry = _expanded(self.list_at[t], self.list_at[t + 1] - self.list_at[t])
        cell = run[opened][of] * self.blocks + self.block[entry]
        least = THRESHOLD - rest - 1e-9
        alive = np.bincount(cell, self.block_max[entry], n * self.blocks).reshape(n, -1) >= least[:, None]
        alive = alive.ravel()
        stays = alive[cell]
        of, entry, cell = of[stays], entry[stays], cell[stays]
        which, posting = _expanded(self.block_at[entry], self.block_at[entry + 1] - self.block_at[entry])
        kept = np.flatnonzero(alive)  # the cells whose postings are added up, a place for each unit of their blocks
        place = (np.cumsum(alive) - 1)[cell] * BLOCK
        part = np.bincount(place[which] + self.unit[posting] % BLOCK, self.impact[posting], len(kept) * BLOCK)
        key = np.flatnonzero(part >= np.repeat(least[kept // self.blocks], BLOCK))
        units = self.blocks * BLOCK
        key = kept[key // BLOCK] // self.blocks * units + kept[key // BLOCK] % self.blocks * BLOCK + key % BLOCK
        # In full: the unit's own words that the window holds.
        run, unit = key // units, key % units
        run, unit = run[unit < len(self.items)], unit[unit < len(self.items)]
        of, entry = _expanded(self.own_at[unit], self.own_at[unit + 1] - self.own_at[unit])
        asked = window[first][run][of] * len(self.top) + self.own_term[entry]
        held = window * len(self.top) + term
        at = np.minimum(np.searchsorted(held, asked), len(held) - 1)
        score = np.round(np.bincount(of, np.where(held[at] == asked, self.own_impact[entry], 0.0), len(run)), 9)  # the order of adding doesn't matter
        keep = score >= THRESHOLD
        return window[first][run[keep]], unit[keep], score[keep]

    def leaks(self, w: np.ndarray, wat: np.ndarray) -> Iterator[tuple[int, int, float, float, float | None]]:
        """(text, item, score, question share, answer share) of consecutive texts' words, the best window of each text and item."""
        text, lo, hi = self.windows(wat)
        grams: dict[int, np.ndarray] = {}
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for found in self.retrieved(*self.queries(w, lo, hi)):
            for x, unit, score in zip(*(f.tolist() for f in found)):
                shares = []
                for (k, own), least in zip(self.grams[unit], (QUESTION_SHARE, ANSWER_SHARE)):
                    if not k:  # no question or no answer to verify
                        shares.append(2.0)
                        continue
                    if k not in grams:
                        grams[k] = rolling(w, k)
                    shares.append(float(np.isin(own, grams[k][lo[x] : max(lo[x], hi[x] - k + 1)]).mean()))
                    if shares[-1] < least:
                        break
                else:
                    key = (int(text[x]), int(self.items[unit]))
                    best[key] = max(best.get(key, (0.0,)), (score, *shares))
        for (t, item), (score, *shares) in sorted(best.items()):
            yield t, item, score, *(None if s > 1 else s for s in shares)


def _units(least: int):
    def units(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(item, question, answer) to units of at most SEGMENT words."""
        for b in batches:
            out = []
            parts = [words(*utf8(b.column(i))) for i in (1, 2)]
            for r, item in enumerate(b.column(0).to_pylist()):
                q, a = (w[at[r] : at[r + 1]] for w, at in parts)
                whole = np.concatenate([q, a])
                if len(whole) < max(least, 1):
                    continue
                for i in [*range(0, max(len(whole) - SEGMENT, 0), SEGMENT), max(len(whole) - SEGMENT, 0)]:
                    part = whole[i : i + SEGMENT]
                    question = min(max(len(q) - i, 0), len(part))
                    out.append((item, part.tobytes(), question, len(part) - question))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 4, (pa.int64(), pa.binary(), pa.int32(), pa.int32()))], ["item", "words", "question", "answer"])

    return units


def _terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for blob in b.column(0).to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.frombuffer(blob, U)).view(np.int64))], ["term"])


def indexes(items: DataFrame, *, item_col: str = "item_id", text_col: str = "text", question_col: str | None = None, answer_col: str | None = None, min_words: int = 1) -> Iterator[Index]:
    """Indexes of slices of the items, fetched one at a time; each item is in one, and all share the statistics of all."""
    question, answer = (F.col(question_col), F.col(answer_col) if answer_col else F.lit("")) if question_col else (F.col(text_col), F.lit(""))
    rows = items.select(F.col(item_col).cast("long").alias("i"), F.coalesce(question, F.lit("")).alias("q"), F.coalesce(answer, F.lit("")).alias("a")).where("i is not null").distinct()
    units = written(rows.mapInArrow(_units(min_words), UNITS), "units")
    size = F.octet_length("words") / 8
    n, total, longest = units.agg(F.count("*"), F.sum(size), F.max(size)).first()
    if not n:
        return
    df = written(units.select("words").mapInArrow(_terms, "term long").groupBy("term").agg(F.count("*").alias("df")), "frequencies")
    slices = int(-(-total // SLICE))
    for k in range(slices):
        part = units.where(F.pmod(F.xxhash64("item"), F.lit(slices)) == k)
        found = df.join(part.select("words").mapInArrow(_terms, "term long").distinct(), "term", "left_semi").toArrow()
        known = dict(zip(found.column(0).to_numpy().view(U).tolist(), found.column(1).to_pylist()))
        own = [(r.item, np.frombuffer(r.words, U), r.question, r.answer) for r in part.collect()]
        if own:
            yield Index(own, known, n, float(total) / n, int(longest))


LEAKS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def _searched(index, col: int):
    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, _, data, at in pieces(b.column(col), CHUNK):
                found = list(index.value.leaks(*words(data, at)))
                if found:
                    t, *rest = zip(*found)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.array(t) + lo)), pa.array(rest[0], pa.int64()), *(pa.array(x, pa.float64()) for x in rest[1:])], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return returning(search)


def _cleaned(index, col: int):
    def clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            for lo, _, data, at in pieces(b.column(col), CHUNK):
                for t, *_ in index.value.leaks(*words(data, at)):
                    keep[lo + t] = False
            yield pa.RecordBatch.from_arrays(b.filter(pa.array(keep)).columns, [f"c{i}" for i in range(b.num_columns)])

    return returning(clean)


def leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **item_cols) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): each document and test item that it holds."""
    spark = docs.sparkSession
    texts, out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), None
    for index in indexes(items, **item_cols):
        found = texts.mapInArrow(_searched(spark.sparkContext.broadcast(index), 1), LEAKS)
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], LEAKS) if out is None else out


def decontaminated(docs: DataFrame, items: DataFrame, *, text_col: str = "text", **item_cols) -> DataFrame:
    """The documents that hold no test item; all columns pass through."""
    plain = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)])
    out = docs
    for index in indexes(items, **item_cols):
        out = out.mapInArrow(_cleaned(docs.sparkSession.sparkContext.broadcast(index), docs.columns.index(text_col)), plain).toDF(*docs.columns)
    return out
