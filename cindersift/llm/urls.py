"""URL filters, with DataFrame functions only: rules on host and path first, else a logistic regression on hashed
character n-grams of host and path, trained here from a small labelled URL table.

Features are the distinct 3- and 4-grams of ``^host$`` and of the path, each hashed with its field to one of BINS.
A row's margin is the summed weight of its features over the root of their number, plus a bias. Training takes at most
SAMPLE labelled rows (by a hash of the url), whose hashed features the engine works out; the fit of these few rows is
full-batch gradient descent with a step size of its own for each bin (AdaGrad), on the driver. Scoring is expressions only.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from there up to ``?``, ``#``
or the end. A rule fits its host and all subdomains where the path starts with the rule's; the longest (host and path
together) wins, of equals the one with the longer host, then a block.

Defined results: a null url or one without ``://`` has an empty host and path, no rule fits it unless the rule's host
is empty, and the method judges it; null ids, repeated rows and other columns pass through, but for columns named host,
path, rule, score or verdict, which are replaced; an empty table gives an empty one; without both labels in the table
everything that no rule fits is allowed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BINS = 1 << 14
GRAMS = (3, 4)
STEPS, RATE, SHRINK = 200, 0.3, 1e-3
#: Labelled rows that are learnt from at most, and those of the table made here.
SAMPLE, LABELLED_ROWS = 5000, 2400
MAX_RULES = 1000
#: From this probability the method blocks: a wrong block loses a page that nothing else looks at again.
BLOCK_FROM = 0.6
#: (action, host, path): fixed values
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))

#: The words and forms that the labelled table is made of.
UNWANTED = "bet bets casino win winner pills pharma cheap spam farm ads track tracker adult poker jackpot slots loan loans viagra xxx sexcam escort free bonus clickads banner popup lottery payday replica warez crack keygen phish".split()
WANTED = "news blog docs wiki school library music garden weather travel museum science history cooking theatre sport football city council hospital university journal archive photos maps forum code software recipes books shop bank mail help about team open data health".split()
HOSTS = ("{0}-{1}.example", "{0}{1}.example", "{0}.example", "www.{0}.example", "m.{0}-{1}.example", "{1}.{0}-online.example", "the{0}.example", "{0}{2}.example")
ENDINGS = ("com", "net", "org", "info", "de", "co.uk", "biz")
PATHS = ("/", "", "/en/{2}", "/de/{2}.html", "/fr/{2}/", "/es/{2}?page=2", "/{1}/{0}-{2}", "/index.php?id={2}#top", "/articles/2024/{2}")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _grams(text: Column, field: str) -> Column:
    c = F.split(text, "")

    def grams(n: int) -> Column:
        at = F.sequence(F.lit(1), F.size(c) - (n - 1))
        return F.when(F.size(c) >= n, F.transform(at, lambda i: F.concat(F.lit(field), *[F.element_at(c, (i + F.lit(k)).cast("int")) for k in range(n)]))).otherwise(F.array().cast("array<string>"))

    return F.concat(*map(grams, GRAMS))


def features(host: Column, path: Column) -> Column:
    grams = F.concat(_grams(F.concat(F.lit("^"), host, F.lit("$")), "h"), _grams(path, "p"))
    return F.array_distinct(F.transform(grams, lambda g: F.pmod(F.xxhash64(g), F.lit(BINS)).cast("int")))


def _margin(x: Column, weights: list[float], bias: float) -> Column:
    """Margin of a row's features; the weights are one literal, so a step or a score needs no join."""
    w = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    total = F.aggregate(x, F.lit(0.0), lambda s, i: s + F.element_at(w, i + 1))
    return total / F.sqrt(F.greatest(F.size(x), F.lit(1))) + F.lit(bias)


def _probability(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def labelled(spark: SparkSession, rows: int = LABELLED_ROWS) -> DataFrame:
    """(url, unwanted): the labelled table, made from the word lists and forms by rule; half of it is unwanted."""

    def pick(values, salt: int) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(values))) + 1).cast("int"))

    df = spark.range(rows).withColumn("unwanted", (F.col("id") % 2).cast("int"))
    word = lambda salt: F.when(F.col("unwanted") == 1, pick(UNWANTED, salt)).otherwise(pick(WANTED, salt))
    df = df.withColumns({"w0": word(1), "w1": word(2), "n": F.pmod(F.xxhash64("id", F.lit(3)), F.lit(9000)).cast("string")})
    form = F.concat(F.when(F.pmod(F.xxhash64("id"), F.lit(2)) == 0, "http://").otherwise("https://"), pick(HOSTS, 4), F.lit("."), pick(ENDINGS, 5), pick(PATHS, 6))
    url = F.replace(F.replace(F.replace(form, F.lit("{0}"), F.col("w0")), F.lit("{1}"), F.col("w1")), F.lit("{2}"), F.col("n"))
    return df.select(url.alias("url"), "unwanted")


def trained(table: DataFrame, sample: int = SAMPLE) -> tuple[list[float], float]:
    """Weights of the bins and the bias, from at most ``sample`` rows of a labelled table (url, unwanted of 0 or 1)."""
    host, path = host_and_path(F.col("url"))
    known = table.where("url is not null and unwanted in (0, 1)").orderBy(F.xxhash64("url"), "url", "unwanted").limit(sample)
    rows = known.select(features(host, path).alias("x"), F.col("unwanted").alias("y")).collect()  # at most ``sample`` of bounded length
    label = np.array([r["y"] for r in rows], float)
    weights, bias = np.zeros(BINS), -1.0
    if not 0 < label.sum() < len(rows):
        return weights.tolist(), bias
    size = np.array([max(len(r["x"]), 1) for r in rows], float)
    of = np.repeat(np.arange(len(rows)), [len(r["x"]) for r in rows])
    bins = np.array([i for r in rows for i in r["x"]], np.int64)
    squares, square = np.full(BINS, 1e-8), 1e-8
    for _ in range(STEPS):
        margin = np.bincount(of, weights[bins], len(rows)) / np.sqrt(size) + bias
        error = 1 / (1 + np.exp(-margin)) - label
        slope = np.bincount(bins, (error / np.sqrt(size))[of], BINS) / len(rows) + SHRINK * weights
        squares += slope * slope
        weights -= RATE * slope / np.sqrt(squares)
        square += error.mean() ** 2
        bias -= RATE * error.mean() / math.sqrt(square)
    return weights.tolist(), float(bias)


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The rule that fits, as host and path, and its action; null where none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules go into a plan")
    rule = action = None
    for act, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block", r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        action = F.when(fits, act) if action is None else action.when(fits, act)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, action)


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, model: tuple[list[float], float] | None = None, *, url_col: str = "url") -> DataFrame:
    """All columns, then host, path, rule, verdict (allow or block) and score (the method's probability of unwanted)."""
    weights, bias = model or trained(labelled(pages.sparkSession))
    host, path = host_and_path(F.col(url_col))
    out = pages.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})
    rule, action = ruled(F.col("host"), F.col("path"), rules)
    score = _probability(_margin(features(F.col("host"), F.col("path")), weights, bias))
    out = out.withColumns({"rule": rule, "score": score})
    return out.withColumn("verdict", F.coalesce(action, F.when(F.col("score") >= BLOCK_FROM, "block").otherwise("allow")))
