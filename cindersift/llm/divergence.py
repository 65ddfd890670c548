"""How the sources of a language differ in their words: distances of all pairs of sources, and each source's marked terms.

Texts are counted in one pass: a task adds up terms by (lang, source) and passes its sums on when it holds FLUSH of
them, so a hot source reaches the shuffle as counts, not words. Terms in at least MIN_DOCS documents of their language
are kept. A term's share in a group is ``1 + floor(10^9 * (count + 2) / (N + 2 V))``, and two shares differ by
``floor((p - q)^2 / (p + q))``, all in exact integers.

The distance of two sources is that difference summed over all V terms. Most terms are absent from most sources, so the
sum starts from V times the difference of the two shares of an absent term and is corrected: once for each term that one
source has (by its distinct shares, with how many terms hold each), and once for each term that both have. So the work
follows the counts that occur, not V times the pairs. The result itself has a row for every two sources of a language.

A source's marked terms are the K with the largest difference from the language among those above it, by
:func:`cindersift.llm.radix.best`.

Defined results: null text, lang and source are ''; a group without terms, and a language without kept terms, take part
in pairs (distance 0 without kept terms); a source alone in its language has no pair; equal values rank by the item's UTF-8 bytes; repeated
rows count each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cindersift.llm import radix
from cindersift.llm.hashing import returning
from cindersift.storage import dropped, written

MIN_DOCS, K = 10, 10
#: Terms of all groups that a task holds before it passes its sums on.
FLUSH = 200_000
#: Bytes of one text that are split into words at once.
PIECE = 1 << 20
#: A-Z lower-cased; what is neither a letter of ASCII nor beyond it separates terms.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a piece at a time; a piece ends where a term does."""
    lo = 0
    while len(text) - lo > PIECE:
        cut = text.rfind(b" ", lo, lo + PIECE)
        cut = text.find(b" ", lo + PIECE) if cut <= lo else cut
        if cut < 0:
            break
        yield text[lo:cut].split()
        lo = cut
    yield text[lo:].split()


def _rows(groups: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, docs) in groups.items():
        terms = list(n)
        for lo in range(0, max(len(terms), 1), 65536):
            part = terms[lo : lo + 65536]
            # A row without a term tells that the group occurs.
            columns = [[lang] * (len(part) + 1), [source] * (len(part) + 1), [None, *(t.decode() for t in part)], [0, *(n[t] for t in part)], [0, *(docs[t] for t in part)]]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:3]), *(pa.array(c, pa.int64()) for c in columns[3:])], ["lang", "source", "term", "n", "docs"])


@returning
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0
    for b in batches:
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary())):
            n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            had, seen = len(n), set()
            for words in _pieces((text.as_py() or b"").translate(_TABLE)):
                n.update(words)
                seen.update(words)
            docs.update(seen)
            held += len(n) - had
            if held > FLUSH:
                yield from _rows(groups)
                groups, held = {}, 0
    yield from _rows(groups)


def counted(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term of a group; a null term for every group."""
    said = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    parts = said.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 (count + 2) / total), exact for any counts."""
    return (F.call_function("div", (count.cast("decimal(20,0)") + 2) * 1_000_000_000, total.cast("decimal(20,0)")) + 1).cast("long")


def difference(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most 10^9 + 1, so the square is a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


class Shares:
    """What both parts read: ``groups`` (lang, source, total, absent, kept_terms) and ``terms`` (lang, source, term, p, q, absent)."""

    def __init__(self, docs: DataFrame, *, min_docs: int = MIN_DOCS, **cols: str):
        counts = written(counted(docs, **cols), "counts")
        whole = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
        kept = written(whole.where(F.col("docs") >= min_docs).drop("docs"), "vocabulary")
        found = written(counts.where("term is not null").select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "kept")
        langs = kept.groupBy("lang").agg(F.count("*").alias("kept_terms"), F.sum("lang_n").alias("lang_total"))
        sums = found.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
        groups = counts.where("term is null").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
        v = F.coalesce("kept_terms", F.lit(0))
        groups = groups.select("lang", "source", (F.coalesce("group_n", F.lit(0)) + 2 * v).alias("total"), (F.coalesce("lang_total", F.lit(0)) + 2 * v).alias("lang_total"), v.alias("kept_terms"))
        # Without kept terms there is no share; the pairs' distance is 0 whatever stands here.
        self.groups = written(groups.withColumn("absent", F.when(F.col("total") > 0, share(F.lit(0), F.col("total"))).otherwise(1)), "groups")
        named = self.groups.select("lang", "source", "total", "lang_total", "absent")
        terms = found.join(named, ["lang", "source"])
        self.terms = written(terms.select("lang", "source", "term", share(F.col("n"), F.col("total")).alias("p"), share(F.col("lang_n"), F.col("lang_total")).alias("q"), "absent"), "shares")
        dropped(counts, kept, found)


def distances(shares: Shares) -> DataFrame:
    """(lang, source, other, value): for every two sources of a language the sum of differences over its kept terms."""
    side = lambda df, a, *more: df.select("lang", F.col("source").alias(a), *(F.col(c).alias(f"{c}_{a}") for c in more))
    two = side(shares.groups, "a", "absent", "kept_terms").join(side(shares.groups, "b", "absent"), "lang").where("a <> b")
    absent = two.select("lang", "a", "b", (F.col("kept_terms_a") * difference(F.col("absent_a"), F.col("absent_b"))).alias("value"))
    # What a's own terms change beside a source that lacks them: once for each distinct share of a.
    distinct = shares.terms.groupBy("lang", "source", "p", "absent").agg(F.count("*").alias("times"))
    one = side(distinct, "a", "p", "absent", "times").join(side(shares.groups, "b", "absent"), "lang").where("a <> b")
    gain = F.col("times_a") * (difference(F.col("p_a"), F.col("absent_b")) - difference(F.col("absent_a"), F.col("absent_b")))
    one = one.select("lang", "a", "b", gain.alias("value")).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = side(shares.terms, "a", "term", "p", "absent").withColumnRenamed("term_a", "term").join(side(shares.terms, "b", "term", "p", "absent").withColumnRenamed("term_b", "term"), ["lang", "term"]).where("a < b")
    p, q, x, y = (F.col(c) for c in ("p_a", "p_b", "absent_a", "absent_b"))
    more = difference(p, q) - difference(p, y) - difference(x, q) + difference(x, y)
    both = both.select("lang", "a", "b", more.alias("value")).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    # The difference is the same either way round, so parts of (a, b) and (b, a) count for both.
    parts = absent.where("a < b").unionByName(one.select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "value")).unionByName(both)
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    either = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("other")), F.struct(F.col("b").alias("source"), F.col("a").alias("other"))))
    return sums.select("lang", either.alias("x"), "value").select("lang", "x.source", "x.other", "value")


def marked(shares: Shares, k: int = K, *, tie_rows: int = radix.TIE_ROWS) -> DataFrame:
    """(lang, source, item, value, rank): each group's k terms furthest above the language's share."""
    above = shares.terms.where("p > q").select("lang", "source", "term", difference(F.col("p"), F.col("q")).alias("value"))
    return radix.best(above, ["lang", "source"], "value", "term", k, tie_rows=tie_rows)


def audit(docs: DataFrame, *, min_docs: int = MIN_DOCS, k: int = K, tie_rows: int = radix.TIE_ROWS, **cols: str) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` ranks all other sources of the language, ``term`` the k marked terms."""
    shares = Shares(docs, min_docs=min_docs, **cols)
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = distances(shares).select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value").withColumn("rank", F.row_number().over(w))
    terms = marked(shares, k, tie_rows=tie_rows).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(terms)
