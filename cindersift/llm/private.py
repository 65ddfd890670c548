"""Personal data by candidate gradient boosting, with DataFrame functions only and no shuffle of texts.

Base spans follow fixed patterns and checks, leftmost and not overlapping within a kind. High-recall generators propose
further, overlapping spans on the same texts: numbers without a plus sign as phones, spelled-out email addresses, and
long tokens as secrets.
Boosted trees of depth two score each from its format and its surroundings; spans over a calibrated threshold that touch
no base span are added. The trees are trained here, on a table of labelled spans made by rule: each round's gradient
histograms are grouped aggregates, of which a few hundred sums reach the driver. The threshold is the lowest at which
PRECISION of the accepted spans of a held-out fifth are right.

Positions are code points, ends exclusive. A running sum of the lengths between matches gives them, in blocks, so its
cost stays near the number of matches; the patterns need time linear in the text.

Defined results: null and empty texts have no spans; every row is judged alone, so repeated rows and null ids keep
theirs; of overlapping added spans the likeliest stays, then the first, then the longest; other columns pass through.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cindersift.storage import written

#: Fixed values, in this order.
KINDS = ("email", "ip", "card", "phone")
#: Kinds of added spans that no base pattern has come after these.
ALL_KINDS = (*KINDS, "secret")
#: The patterns as given, written so that a scan is linear: no start inside a run that an earlier start has refused.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no span of the kind, or no candidate.
NEEDED = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
NEEDED_MORE = {"phone": r"[0-9]{2}", "email": r"(?:[\[({<]|\x20)at(?:[\])}>]|\x20)", "secret": r"[0-9][A-Za-z+/_-]{0,12}[0-9][A-Za-z0-9+/_-]{0,12}[0-9]"}
_PART = r"0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"

#: Generators of further candidates: kind and pattern.
PROPOSED = {
    "phone": r"(?<![0-9A-Za-z+.,])\(?[0-9]{2,5}\)?(?:[\x20./-]{1,2}+\(?[0-9]{2,5}\)?){1,5}+(?![0-9A-Za-z])",
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\]|\{at\}|<at>|(?<=\x20)at(?=\x20))\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?(?:\(dot\)|\[dot\]|\{dot\}|<dot>|(?<=\x20)dot(?=\x20))\x20?)[A-Za-z0-9-]++)++",
    "secret": r"(?<![A-Za-z0-9+/_=.@-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}+(?![A-Za-z0-9+/_=@-])",
}
BEFORE, AFTER = 28, 10
_WORDS = {
    "phone": "tel|telephone|phone|call|fax|mobile|cell|whatsapp|reach|dial|tél|téléphone|telefon|teléfono|llame",
    "email": "mail|e-mail|email|contact|write|reach|correo|courriel|schreib",
    "secret": "token|secret|key|api_key|apikey|access_key|secret_access_key|passwd|password|pwd|credential|auth|authorization|bearer",
    "digest": "sha|sha1|sha256|md5|commit|checksum|digest|hash|revision|etag|uuid|version|blob|file|image|session",
    "other": "order|invoice|no|nr|id|isbn|version|v|page|pages|year|date|room|item|part|art|sku|ref|total|score|chapter|serial",
}
FEATURES = ("phone kind", "digits", "groups", "longest group", "shortest group", "parenthesis", "bracketed at", "spelled dot", "phone word before", "email word before", "other word before", "sign before", "sign after", "date or version", "top-level length", "words", "secret kind", "length", "letters and digits", "secret word before", "digest word before", "common top level")
ROUNDS, RATE, LAMBDA, PRECISION = 16, 0.5, 1.0, 0.99
LABELLED_ROWS = 6000


def _matched(df: DataFrame, text: Column, kind: str, name: str, pattern: str, needed: str | None) -> DataFrame:
    """Adds ``name``: structs (start, m, before, after) of all matches, the surroundings up to the neighbouring matches.

    What several expressions read is a column of its own, so that no lambda evaluates a pattern again.
    """
    found, gaps, lengths, blocks, offsets = (f"__{x}_{name}" for x in ("found", "gaps", "lengths", "blocks", "offsets"))
    none = F.array().cast("array<string>")
    all_ = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    df = df.withColumn(found, all_ if needed is None else F.when(F.rlike(text, F.lit(needed)), all_).otherwise(none))
    df = df.withColumn(gaps, F.when(F.size(found) > 0, F.split(text, pattern, -1)).otherwise(none))
    # The running sum of the lengths, in blocks of the root of their number.
    df = df.withColumn(lengths, F.zip_with(gaps, found, lambda g, m: F.length(g) + F.coalesce(F.length(m), F.lit(0))))
    k = F.greatest(F.ceil(F.sqrt(F.size(lengths).cast("double"))).cast("int"), F.lit(1))
    running = lambda v: F.aggregate(v, F.array(F.lit(0)), lambda acc, e: F.concat(acc, F.array(F.element_at(acc, -1) + e)))
    df = df.withColumn(blocks, F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(lengths) - 1) / k).cast("int"), F.lit(0))), lambda b: running(F.slice(lengths, b * k + 1, k))))
    df = df.withColumn(offsets, running(F.transform(blocks, lambda b: F.element_at(b, -1))))
    starts = F.flatten(F.zip_with(blocks, F.slice(offsets, F.lit(1), F.size(blocks)), lambda b, o: F.transform(F.slice(b, F.lit(1), F.size(b) - 1), lambda e: e + o)))
    zipped = F.arrays_zip(F.col(found).alias("m"), F.slice(gaps, F.lit(1), F.size(found)).alias("g"), F.slice(gaps, F.lit(2), F.size(found)).alias("h"), F.slice(starts, F.lit(1), F.size(found)).alias("s"))
    structs = F.transform(zipped, lambda x: F.struct((x["s"] + F.length(x["g"])).alias("start"), x["m"].alias("m"), F.right(x["g"], F.lit(BEFORE)).alias("before"), F.left(x["h"], F.lit(AFTER)).alias("after")))
    empty = F.array().cast("array<struct<start:int,m:string,before:string,after:string>>")
    return df.withColumn(name, F.when(F.size(found) > 0, structs).otherwise(empty)).drop(found, gaps, lengths, blocks, offsets)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 1, d * 2).otherwise(d)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda s, i: s + value(i))
    return total % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.rlike(m, F.lit(rf"^{_PART}(?:\.{_PART}){{3}}$"))
    n = F.length(_digits(m))
    if kind == "card":
        return F.when(n.between(14, 19), luhn(_digits(m))).otherwise(F.lit(False))
    return n.between(10, 15)


def _features(kind: str, x: Column) -> Column:
    """Format and context features of a candidate struct, as small integers in the order of FEATURES."""
    m, before, after = x["m"], x["before"], x["after"]
    groups = F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0))
    sizes = F.transform(groups, F.length)

    def flag(c: Column) -> Column:
        return F.coalesce(c.cast("int"), F.lit(0))

    def word(name: str) -> Column:
        return flag(F.rlike(before, F.lit(rf"(?iu)(?<!\p{{L}})(?:{_WORDS[name]})[\x20:.#=,]{{0,4}}(?:(?:at|me|us|to|is|on|our|my|the|office|number)[\x20:]{{1,2}}){{0,3}}$")))

    return F.array(
        F.lit(int(kind == "phone")),
        F.least(F.length(_digits(m)), F.lit(24)),
        F.least(F.size(groups), F.lit(9)),
        F.coalesce(F.least(F.array_max(sizes), F.lit(9)), F.lit(0)),
        F.coalesce(F.least(F.array_min(sizes), F.lit(9)), F.lit(0)),
        flag(F.contains(m, F.lit("("))),
        flag(F.rlike(m, F.lit(r"[\[({<]at[\])}>]"))),
        flag(F.rlike(m, F.lit(r"\bdot\b"))),
        word("phone"),
        word("email"),
        word("other"),
        flag(F.rlike(before, F.lit(r"[$€£#=/_-]\x20?$"))),
        flag(F.rlike(after, F.lit(r"^\x20?(?:%|[$€£°]|[kmc]?[mgl]\b|[/_=-])"))),
        flag(F.rlike(m, F.lit(r"^(?:[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}|[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,5}(?:\.[0-9]{1,3}){1,2}|[0-9]{4}\x20?[-/]\x20?[0-9]{2,4})$"))),
        F.least(F.length(F.regexp_extract(m, "([A-Za-z]*)$", 1)), F.lit(9)),
        F.least(F.size(F.split(m, r"\x20")), F.lit(9)),
        F.lit(int(kind == "secret")),
        F.least(F.floor(F.length(m) / 4).cast("int"), F.lit(12)),
        flag(F.rlike(m, F.lit("[A-Za-z]"))) + flag(F.rlike(m, F.lit("[0-9]"))) + flag(F.rlike(m, F.lit("[0-9][A-Za-z]+[0-9][A-Za-z]"))),
        flag(F.rlike(before, F.lit(rf"(?i)(?:{_WORDS['secret']})[\x20\"']{{0,2}}[:=]{{0,2}}[\x20]?(?:bearer\x20)?[\"']?$"))),
        flag(F.rlike(before, F.lit(rf"(?i)(?:{_WORDS['digest']})[\x20\"']{{0,2}}[:=/]{{0,2}}[\x20]?[\"']?$"))),
        flag(F.rlike(m, F.lit(r"(?i)[.\x20\])}>](?:com|org|net|edu|gov|info|io|eu|de|at|ch|fr|be|es|it|nl|uk|us)$"))),
    )


def labelled(spark: SparkSession, rows: int = LABELLED_ROWS) -> DataFrame:
    """(kind, before, m, after, label, fold): labelled spans made by rule from templates, digits and words by hash."""
    positive = [
        ("phone", ["Call ", "tel: ", "phone ", "Fax: ", "mobile ", "reach me at ", "whatsapp ", "Telefon: "], ["({0}) {1}-{2}", "{0}-{1}-{2}", "{0}.{1}.{2}", "{0} {1} {2}", "({0}){1}-{2}"]),
        ("phone", ["or ", "and then ", ""], ["({0}) {1}-{2}"]),
        ("email", ["contact ", "mail me: ", "write to ", "email ", "and ", ""], ["{3} [at] {4} [dot] com", "{3}(at){4}.org", "{3} (at) {4} (dot) net", "{3}[at]{4}[dot]de"]),
        ("email", ["email me at ", "mail: ", "contact "], ["{3} at {4} dot com", "{3} at {4} dot org"]),
        ("secret", ['token = "', "api_key: ", 'secret="', "password=", "Authorization: Bearer ", "key = '", "aws_secret_access_key = ", "auth "], ["{6}", "{7}", "{8}", "{7}{6}"]),
    ]
    negative = [
        ("phone", ["order no. ", "invoice ", "id ", "total ", "page ", "ref ", "item ", "serial ", "part no "], ["{0}-{1}-{2}", "{0} {1} {2}", "{0}.{1}", "{0}-{2}", "{2} {2}"]),
        ("phone", ["on ", "since ", "in ", "from ", "the ", "of ", ""], ["20{5}-{5}-{5}", "{5}.{5}.20{5}", "{5}/{5}/{5}", "19{5}-20{5}", "{0} {1}", "{5} {5}", "{0} {1} {2} {2} {1}", "{5}.{5}", "{0}-{1}", "{2} {2} {2} {2}"]),
        ("phone", ["$", "€ ", "= ", "# "], ["{0} {1}", "{0}.{5}", "{1} {0} {0}"]),
        ("email", ["we met ", "look ", "they were ", "the ", "and ", "", "was "], ["{3} at {4} dot and line", "{3} at {4}.The", "{3} at {4}.1", "{4} at {3}. {4}", "{3} at noon.{4}", "{3} at {4} dot {3}", "{3} at the dot {4}"]),
        ("secret", ["sha256:", "commit ", "checksum ", "md5 = ", "uuid ", "session/", "the ", "see ", ""], ["{6}", "{9}", "{6}{6}", "{2}{2}{2}{2}{2}"]),
        ("secret", ['token = "', "key: ", "password ", "the ", "at ", "and "], ["{9}", "{3}_{4}_{3}_{4}", "{9}/{9}", "{3}{4}{3}{4}{3}"]),
    ]
    after = ["", ".", " and", ", or", " then", " please"]
    templates = [(k, b, f, a, y) for y, group in ((1, positive), (0, negative)) for k, befores, forms in group for b in befores for f in forms for a in after[: 3 if y else 2]]
    words = F.array(*map(F.lit, "anna jonas mira support info lara office sales peter claude ines help team hello".split()))
    sites = F.array(*map(F.lit, "example mailbox acme homebase sunrise letters garden studio".split()))
    table = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(t, ("kind", "before", "form", "after", "label"))]) for t in templates])

    def number(salt: int, lo: int, hi: int) -> Column:
        return (F.lit(lo) + F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(hi - lo))).cast("string")

    def pick(a: Column, salt: int) -> Column:
        return F.element_at(a, (F.pmod(F.xxhash64("id", F.lit(salt)), F.size(a)) + 1).cast("int"))

    df = spark.range(rows).select("id", F.element_at(table, (F.col("id") % len(templates) + 1).cast("int")).alias("t"))
    parts = [number(1, 200, 999), number(2, 200, 999), number(3, 1000, 9999), F.concat(pick(words, 4), F.when(F.pmod(F.xxhash64("id"), F.lit(3)) == 0, number(5, 1, 99)).otherwise("")), pick(sites, 6), number(7, 10, 28)]
    id_ = F.col("id").cast("string").cast("binary")
    parts += [F.sha1(id_), F.regexp_replace(F.base64(F.unhex(F.md5(id_))), "=", ""), F.concat(F.lit("ghp_"), F.substring(F.sha2(id_, 256), 3, 36)), F.concat_ws("-", pick(words, 10), pick(sites, 11), pick(words, 12), pick(sites, 13))]
    m = reduce(lambda s, p: F.replace(s, F.lit("{%d}" % p[0]), p[1]), enumerate(parts), F.col("t.form"))
    return df.select("t.kind", "t.before", m.alias("m"), "t.after", "t.label", F.pmod(F.xxhash64("id", F.lit(9)), F.lit(5)).alias("fold"))


Tree = tuple  # (feature, threshold, low, high) with trees or floats below


def _tree(t: Tree | float, x: Column) -> Column:
    if isinstance(t, float):
        return F.lit(t)
    f, cut, low, high = t
    return F.when(F.element_at(x, f + 1) <= cut, _tree(low, x)).otherwise(_tree(high, x))


def margin(trees: list[Tree], x: Column) -> Column:
    return reduce(lambda s, t: s + _tree(t, x), trees, F.lit(0.0))


def _best(sums: dict[tuple[int, int], tuple[float, float]]) -> tuple[float, int, int, float, float]:
    """(gain, feature, threshold, low value, high value) of the best split of a node's histograms."""
    whole = [v for (f, _), v in sums.items() if f == 0]
    g, h = sum(v[0] for v in whole), sum(v[1] for v in whole)
    best = (1e-9, 0, 1 << 20, RATE * g / (h + LAMBDA), RATE * g / (h + LAMBDA))
    for f in range(len(FEATURES)):
        a = b = 0.0
        for cut in sorted(c for k, c in sums if k == f)[:-1]:
            a, b = a + sums[f, cut][0], b + sums[f, cut][1]
            gain = a * a / (b + LAMBDA) + (g - a) ** 2 / (h - b + LAMBDA) - g * g / (h + LAMBDA)
            if gain > best[0] + 1e-9:
                best = (gain, f, cut, RATE * a / (b + LAMBDA), RATE * (g - a) / (h - b + LAMBDA))
    return best


def trained(table: DataFrame) -> tuple[list[Tree], float]:
    """Trees and the calibrated threshold on their margin, from labelled spans."""
    x = F.struct("m", "before", "after")
    features = F.when(F.col("kind") == "phone", _features("phone", x)).when(F.col("kind") == "secret", _features("secret", x)).otherwise(_features("email", x))
    rows = written(table.select(features.alias("x"), F.col("label").cast("double").alias("y"), "fold"), "spans", by=1)
    train = rows.where("fold <> 0")
    trees: list[Tree] = []
    for _ in range(ROUNDS):
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin(trees, F.col("x"))))
        scored = train.select("x", (F.col("y") - p).alias("g"), (p * (1 - p)).alias("h"))

        def histograms(node: Column) -> dict[int, dict[tuple[int, int], tuple[float, float]]]:
            sums = scored.select(node.alias("node"), "g", "h", F.posexplode("x").alias("f", "v")).groupBy("node", "f", "v").agg(F.sum("g"), F.sum("h"))
            out: dict = {}
            for n, f, v, g, h in sums.collect():  # at most two nodes times features times their few values
                out.setdefault(n, {})[f, v] = (g, h)
            return out

        _, f, cut, low, high = _best(histograms(F.lit(0)).get(0, {}))
        below = histograms((F.element_at("x", f + 1) > cut).cast("int"))
        leaves = [float(v) for v in (low, high)]
        for n in below:
            gain, f2, cut2, a, b = _best(below[n])
            leaves[n] = (f2, cut2, float(a), float(b)) if gain > 1e-6 else leaves[n]
        trees.append((f, cut, *leaves))
    held = rows.where("fold = 0").select("y", F.round(margin(trees, F.col("x")), 4).alias("s")).groupBy("s").agg(F.sum("y"), F.count("*")).collect()
    right = total = 0.0
    threshold = math.inf
    for s, y, n in sorted(held, reverse=True):  # distinct margins of the held-out fifth of the labelled table
        right, total = right + y, total + n
        if right / total >= PRECISION and s > 0:
            threshold = s - 1e-4
    return trees, threshold


def spans(docs: DataFrame, model: tuple[list[Tree], float] | None = None, *, text_col: str = "text") -> DataFrame:
    """All columns and ``spans``, an array of (start, ord, kind, end, base, score) by start and kind: base spans have score 1."""
    trees, threshold = model or trained(labelled(docs.sparkSession))
    text = F.coalesce(F.col(text_col), F.lit(""))
    kind_type = "array<struct<start:int,ord:int,kind:string,end:int,base:boolean,score:double>>"
    out = docs
    for kind in KINDS:
        out = _matched(out, text, kind, f"__{kind}", PATTERNS[kind], NEEDED[kind])
    for kind, pattern in PROPOSED.items():
        out = _matched(out, text, kind, f"__more_{kind}", pattern, NEEDED_MORE[kind])

    def base(kind: str) -> Column:
        ok = F.filter(F.col(f"__{kind}"), lambda x: _valid(kind, x["m"]))
        return F.transform(ok, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("ord"), F.lit(kind).alias("kind"), (x["start"] + F.length(x["m"])).alias("end"), F.lit(True).alias("base"), F.lit(1.0).alias("score"))).cast(kind_type)

    def proposed(kind: str) -> Column:
        scored = F.transform(F.col(f"__more_{kind}"), lambda x: F.struct(x["start"].alias("start"), F.lit(ALL_KINDS.index(kind)).alias("ord"), F.lit(kind).alias("kind"), (x["start"] + F.length(x["m"])).alias("end"), F.lit(False).alias("base"), margin(trees, _features(kind, x)).alias("score")))
        return F.transform(F.filter(scored, lambda x: x["score"] >= threshold), lambda x: x.withField("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-x["score"])))).cast(kind_type)

    if math.isinf(threshold):
        more = F.array().cast(kind_type)
    else:
        more = F.concat(*map(proposed, PROPOSED))
    out = out.withColumn("__base", F.concat(*map(base, KINDS))).withColumn("__more", more)

    out = resolved(out, "__base", "__more", "spans")
    return out.drop(*[f"__{k}" for k in KINDS], *[f"__more_{k}" for k in PROPOSED], "__base", "__more")


def _before(values: Column, least: int) -> Column:
    """For each element the greatest of those before it, at least ``least``; in blocks, as a fold copies what it has so far."""
    n = F.size(values)
    k = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("int"), F.lit(1))
    fold = lambda v: F.aggregate(v, F.array(F.lit(least)), lambda acc, e: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), e))))
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / k).cast("int"), F.lit(0))), lambda b: fold(F.slice(values, b * k + 1, k)))
    offsets = fold(F.transform(blocks, lambda b: F.element_at(b, -1)))
    whole = F.flatten(F.zip_with(blocks, F.slice(offsets, F.lit(1), F.size(blocks)), lambda b, o: F.transform(F.slice(b, F.lit(1), F.size(b) - 1), lambda e: F.greatest(e, o))))
    return F.when(n > 0, whole).otherwise(F.array().cast("array<int>"))


def _runs(df: DataFrame, spans: str, name: str) -> DataFrame:
    """Adds ``name``: the runs of spans (sorted by start) that overlap one another directly or through others, as arrays."""
    starts, reach = f"{name}_starts", f"{name}_reach"
    df = df.withColumn(reach, _before(F.transform(spans, lambda x: x["end"]), -1))
    df = df.withColumn(starts, F.filter(F.transform(spans, lambda x, i: F.when(F.get(F.col(reach), i) <= x["start"], i).otherwise(-1)), lambda i: i >= 0))
    one = lambda s, i: F.slice(F.col(spans), s + 1, F.coalesce(F.get(F.col(starts), i + 1), F.size(spans)) - s)
    return df.withColumn(name, F.transform(starts, one)).drop(starts, reach)


def resolved(df: DataFrame, base: str, more: str, name: str) -> DataFrame:
    """Adds ``name``: the base spans, and the others that touch none of them; of these that overlap, the best.

    A proposal overlaps a base span if one that starts no later ends after its start, or the next one starts before its
    end: two running bounds over all spans in order tell it, and only proposals of one run are compared with each other.
    """

    def over(x: Column, y: Column) -> Column:
        return (x["start"] < y["end"]) & (y["start"] < x["end"])

    def ahead(x: Column, y: Column) -> Column:
        return F.struct(-x["score"], x["start"], -x["end"], x["ord"]) < F.struct(-y["score"], y["start"], -y["end"], y["ord"])

    far = (1 << 31) - 1
    rows = F.array_sort(F.concat(*(F.transform(c, lambda x: F.struct(x["start"].alias("start"), (~x["base"]).alias("more"), x.alias("x"))) for c in (base, more))))
    df = df.withColumn("__all", F.when(F.size(more) > 0, rows).otherwise(F.array().cast("array<struct<start:int,more:boolean,x:struct<start:int,ord:int,kind:string,end:int,base:boolean,score:double>>>")))
    df = df.withColumn("__reach", _before(F.transform("__all", lambda x: F.when(x["more"], -1).otherwise(x["x"]["end"])), -1))
    df = df.withColumn("__next", F.reverse(_before(F.reverse(F.transform("__all", lambda x: F.when(x["more"], -far).otherwise(-x["start"]))), -far)))
    numbered = F.transform("__all", lambda x, i: F.struct(x["x"].alias("x"), (x["more"] & (F.get(F.col("__reach"), i) <= x["start"]) & (-F.get(F.col("__next"), i) >= x["x"]["end"])).alias("clear")))
    df = df.withColumn("__clear", F.transform(F.filter(numbered, lambda x: x["clear"]), lambda x: x["x"]))
    df = _runs(df, "__clear", "__meeting")
    best = lambda r: F.filter(r, lambda x: ~F.exists(r, lambda y: over(x, y) & ahead(y, x)))
    added = F.flatten(F.transform("__meeting", lambda r: F.when(F.size(r) == 1, r).otherwise(best(r))))
    return df.withColumn(name, F.array_sort(F.concat(F.col(base), added))).drop("__all", "__reach", "__next", "__clear", "__meeting")


def redacted(docs: DataFrame, model: tuple[list[Tree], float] | None = None, *, text_col: str = "text") -> DataFrame:
    """All columns, with each span's text replaced by its kind in brackets; of overlapping spans one covers the union."""
    out = _runs(spans(docs, model, text_col=text_col), "spans", "__runs")
    out = out.withColumn("__m", F.transform("__runs", lambda r: F.struct(F.get(r, F.lit(0))["start"].alias("start"), F.get(r, F.lit(0))["kind"].alias("kind"), F.array_max(F.transform(r, lambda x: x["end"])).alias("end"))))
    # As an array of code points: a substring would count from the text's start for every span.
    points = F.when(F.size("__m") > 0, F.regexp_extract_all(F.col(text_col), F.lit("(?s)."), F.lit(0)))
    out = out.withColumn("__points", points)
    cut = lambda lo, n: F.array_join(F.slice("__points", lo + 1, n), "")
    kept_from = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("__m"), i - 1)["end"])
    pieces = F.transform("__m", lambda x, i: F.concat(cut(kept_from(i), x["start"] - kept_from(i)), F.lit("["), x["kind"], F.lit("]")))
    rest = cut(F.element_at("__m", -1)["end"], F.size("__points"))
    return out.withColumn(text_col, F.when(F.size("__m") > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(F.col(text_col))).drop("__m", "__runs", "__points")


def digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts and the digest of base spans, and all spans."""
    found = spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).select("doc_id", "spans")

    def told(x: Column) -> Column:
        return F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
