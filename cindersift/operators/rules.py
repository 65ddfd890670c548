"""Rule packs: tables of patterns compiled into one projection over lines.

A pack is data. Each pattern stands behind the texts that any match of it must hold, which are read off the pattern. All such
texts of all packs are one index, which a batch of lines meets once, equal lines as one; only patterns whose texts a line holds are tried, and only
the numbers of the rules that hit are exploded. The first line of each file and rule is a grouped minimum.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cindersift.functions.text import COMMENT_STARTS, is_comment
from cindersift.operators.graph import shuffled
from cindersift.schema import EXPLOITABILITY, looked_up  # noqa: F401
from cindersift.storage import written

#: Alternatives that a rule may need, beyond which its pattern is tried at once.
ALTERNATIVES = 12
#: Rules of a generated method.
GROUP = 16


@dataclass(frozen=True)
class Rule:
    rule_id: str
    severity: str
    pattern: str
    issue: str = ""
    cwe: str | None = None
    absent: str | None = None  # for whole contents: a pattern that must not be there
    confidence: float | None = None  # of the pack; else from the match's length
    exploitability: float | None = None  # else from the severity
    blast: int | None = None  # else from the id
    description: str = ""


CONTAINER = (
    Rule("own/docker-latest", "medium", r"(?im)^\s*FROM\s+\S+:latest\b", "Unpinned base image", "CWE-1104"),
    Rule("own/docker-no-user", "high", r"(?im)^\s*FROM\s+\S+", "Runs as root", "CWE-250", absent=r"(?im)^\s*USER\s+\S+"),
    Rule("own/docker-add-url", "medium", r"(?im)^\s*ADD\s+https?://", "Remote file added", "CWE-829"),
    Rule("own/compose-privileged", "critical", r"(?im)^\s*privileged:\s*true\b", "Privileged container", "CWE-250"),
)
#: The patterns of a scan of a pasted snippet, all lines of which count, comments too.
SNIPPET = (
    Rule("snippet/eval", "critical", r"eval\s*\(", "Code Injection via eval()"),
    Rule("snippet/inner-html", "high", r"innerHTML\s*=", "XSS via innerHTML"),
    Rule("snippet/secret", "critical", r"""(?i)(password|secret|api_key|token)\s*=\s*['"][^'"]{8,}""", "Hardcoded Secret Detected"),
    Rule("snippet/weak-hash", "high", r"(?i)MD5|SHA1|md5\(|sha1\(", "Weak Cryptographic Hash"),
    Rule("snippet/sql", "critical", r"(?i)SELECT\s+\*?\s+FROM.*\$\{|SELECT.*\+\s*[a-z]", "SQL Injection Risk"),
    Rule("snippet/command", "critical", r"(?i)exec\s*\(|system\s*\(|shell_exec|subprocess\.call.*shell=True", "Command Injection Risk"),
    Rule("snippet/unwrap", "medium", r"\.unwrap\(\)", "Unhandled Error (unwrap)"),
    Rule("snippet/deserialization", "high", r"pickle\.loads|yaml\.load\s*\([^,]+\)", "Deserialization Vulnerability"),
)
#: Words in a rule id and the radius, the first that fits; 2 without any.
BLAST = (
    ("aws gcp azure firebase", 10),
    ("db-url sqli jwt auth", 8),
    ("rce exec pickle eval", 9),
    ("xss csrf localstorage", 5),
    ("secret credential password", 7),
    ("debug ssl", 4),
)


def blast_radius(rule_id: str) -> int:
    """R5."""
    return next((n for words, n in BLAST if any(w in rule_id.lower() for w in words.split())), 2)


def _needed(parsed) -> frozenset[str] | None:
    """Lower-case texts of which any match holds at least one, None where there are none."""
    found, run = [], ""
    for op, arg in [*parsed, (None, None)]:
        name = str(op)
        if name == "LITERAL":
            run += chr(arg).lower()
            continue
        if name == "AT":
            continue
        if run:
            found.append(frozenset([run]))
            run = ""
        inner = None
        if name == "SUBPATTERN":
            inner = _needed(arg[3])
        elif name == "BRANCH":
            parts = [_needed(x) for x in arg[1]]
            inner = None if None in parts else frozenset().union(*parts)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
            inner = _needed(arg[2])
        if inner and len(inner) <= ALTERNATIVES:
            found.append(inner)
    return max(found, key=lambda x: (min(map(len, x)), -len(x)), default=None)


@cache
def needed(pattern: str) -> tuple[str, ...]:
    """Texts (lower case) of which a line must hold one for the pattern to match; none where the pattern doesn't tell."""
    try:
        found = _needed(re._parser.parse(pattern))
    except re.error:  # only other engines know what it says
        found = None
    # A single letter tells too little, a single mark may do.
    return tuple(sorted(found)) if found and all(len(w) >= 2 or not w.isalnum() and not w.isspace() for w in found) else ()


def _finder(rules: Sequence[Rule]) -> Callable[[pa.Array], pa.Array]:
    words = {w: [n for n, r in enumerate(rules, 1) if w in needed(r.pattern)] for r in rules for w in needed(r.pattern)}
    known = [(w.encode(), numbers) for w, numbers in sorted(words.items())]

    def found(lines: pa.Array) -> pa.Array:
        rows = lines.cast(pa.large_binary()).to_pylist()
        low = [b"" if r is None else r.lower() for r in rows]
        whole = b"\n".join(low)
        some = [(w, numbers) for w, numbers in known if w in whole]
        return pa.array([sorted({n for w, numbers in some if w in r for n in numbers}) for r in low], pa.list_(pa.int32()))

    return found


def candidates(code: Column, rules: Sequence[Rule]) -> Column:
    """Numbers (from 1) of the rules whose needed texts a line holds, ASCII letters of either case; none for a null line.

    A batch of lines is searched for each text as one stretch of bytes; only texts that some line of it holds are looked for in
    each line. So a line costs the few texts that occur around it, not all that any rule needs.
    """
    return F.arrow_udf(_finder(rules), "array<int>")(code)


def _gathered(rules: Sequence[Rule]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each batch (line, packs, rest of the row) a row for every distinct line of the same packs: with its candidates and all places it stands at."""
    found = _finder(rules)

    def numbered(column: pa.Array) -> tuple[np.ndarray, int]:
        coded = column.dictionary_encode()
        return pc.fill_null(coded.indices, len(coded.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary) + 1

    def gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            code, packs, rest = b.columns
            (lines, _), (kinds, n) = numbered(code), numbered(packs)
            _, first, inverse = np.unique(lines * n + kinds, return_index=True, return_inverse=True)
            order = np.argsort(inverse, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(inverse))]).astype(np.int32)
            one, of = code.take(pa.array(first)), packs.take(pa.array(first))
            looked = pc.if_else(pc.match_substring(of, "1"), one, pa.scalar(None, one.type))
            yield pa.RecordBatch.from_arrays([one, of, found(looked), pa.ListArray.from_arrays(pa.array(ends), rest.take(pa.array(order)))], ["code", "__packs", "__of", "__places"])

    return gathered


def exploitable(r: Rule) -> float:
    return r.exploitability if r.exploitability is not None else EXPLOITABILITY[r.severity]


def reach(r: Rule) -> int:
    return r.blast if r.blast is not None else blast_radius(r.rule_id)


Packs = Sequence[tuple[Column | None, Sequence[Rule], tuple[str, ...]]]


def _met(line_rows: DataFrame, packs: Packs, when: Column | None) -> DataFrame:
    """(code, __places, hits): the distinct lines of each batch with the numbers of the rules that they match, and where they stand."""
    starts = list(dict.fromkeys(s for _, _, s in packs if s))
    every = [r for _, own, _ in packs for r in own]
    # Which packs look at a row, a 0 or 1 for each: with the line's text it says all that decides what is found.
    looks = [F.lit(True) if which is None else which for which, _, _ in packs]
    flags = F.concat(*[F.when(x if when is None else when & x, "1").otherwise("0") for x in looks])
    rest = [c for c in line_rows.columns if c != "code"]
    rows = line_rows.select("code", flags.alias("__packs"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("__rest"))
    schema = T.StructType([T.StructField("code", T.StringType()), T.StructField("__packs", T.StringType()), T.StructField("__of", T.ArrayType(T.IntegerType())), T.StructField("__places", T.ArrayType(rows.schema["__rest"].dataType))])
    rows = rows.mapInArrow(_gathered(every), schema)
    # What every rule looks at comes out of a generator: an expression would be worked out again for each rule.
    for i, s in enumerate(starts):
        rows = rows.select("*", F.inline(F.array(F.struct(is_comment(F.col("code"), s).alias(f"__c{i}")))))
    hits, number = [], 0
    always = any(not needed(r.pattern) for r in every)
    for i, (_, own, begins) in enumerate(packs, 1):
        pack = F.substring("__packs", i, 1) == "1"
        if begins:
            pack = pack & ~F.col(f"__c{starts.index(begins)}")
        for r in own:
            number += 1
            there = pack & F.array_contains("__of", number) if needed(r.pattern) else pack
            hits.append(F.when(there & F.rlike("code", F.lit(r.pattern)), F.lit(str(number))))
    # Numbers joined as text, a group of rules at a time, each group out of a generator of its own: all of it is generated
    # code in methods small enough to be compiled, and no filter above makes it work twice.
    names = [f"__h{i}" for i in range(0, len(hits), GROUP)]
    for i, name in zip(range(0, len(hits), GROUP), names):
        group = F.nullif(F.concat_ws(",", *hits[i : i + GROUP]), F.lit(""))
        rows = rows.select("*", F.inline(F.array(F.struct((group if always else F.when(F.size("__of") > 0, group)).alias(name)))))
    return rows.select("code", "__places", F.when(F.coalesce(*names).isNotNull(), F.concat_ws(",", *names)).alias("hits"))


def marked(line_rows: DataFrame, packs: Packs, *, when: Column | None = None) -> DataFrame:
    """Adds ``hits``: the numbers of the rules of (which rows, rules, comment starts) that a line matches, null without any, in one pass.

    A rule doesn't look at lines that are comments to its pack, and no rule at rows for which ``when`` doesn't hold. Lines that
    a batch holds several times are matched once.
    """
    return _met(line_rows, packs, when).select("code", "hits", F.inline("__places")).select(*line_rows.columns, "hits")


def told(rows: DataFrame, packs: Packs) -> DataFrame:
    """A row for each of a line's ``hits``, with the rule's values, the matched text, and a confidence from its length where the pack has none."""
    values = [
        {"rule_id": r.rule_id, "severity": r.severity, "issue": r.issue, "description": r.description, "cwe_id": r.cwe, "pattern": r.pattern, "exploitability": exploitable(r), "blast_radius": reach(r), "own": r.confidence}
        for _, own, _ in packs
        for r in own
    ]
    # One literal, whatever the number of rules.
    table = F.from_json(F.lit(json.dumps(values)), "array<struct<rule_id:string,severity:string,issue:string,description:string,cwe_id:string,pattern:string,exploitability:double,blast_radius:int,own:double>>")
    kept = [c for c in rows.columns if c != "hits"]
    out = rows.select(*kept, F.explode(F.split("hits", ",")).alias("__n"))
    out = out.withColumn("__r", F.element_at(table, F.col("__n").cast("int"))).withColumn("matched", F.coalesce(F.regexp_substr("code", F.col("__r.pattern")), F.lit("")))
    sure = F.coalesce("__r.own", F.round(F.least(F.lit(0.95), 0.6 + 0.005 * F.length("matched")), 2))
    return out.select(*kept, *[F.col(f"__r.{c}").alias(c) for c in ("rule_id", "severity", "issue", "description", "cwe_id")], "matched", F.col("__r.exploitability").alias("exploitability"), F.col("__r.blast_radius").alias("blast_radius"), sure.alias("confidence"))


def all_matches(line_rows: DataFrame, packs: Packs) -> DataFrame:
    """Every match of a rule of (which rows, rules, comment starts) on a line that is no comment to the pack, in one pass."""
    found = told(_met(line_rows, packs, None).where("hits is not null"), packs)
    values = [c for c in found.columns if c not in ("code", "__places")]
    return found.select("code", *values, F.inline("__places")).select(*line_rows.columns, *values)


def matches(line_rows: DataFrame, rules: Sequence[Rule], *, starts: tuple[str, ...] = COMMENT_STARTS, rule_filter: str | None = None) -> DataFrame:
    """:func:`all_matches` of one pack, or of one of its rules."""
    return all_matches(line_rows, [(None, [r for r in rules if rule_filter is None or r.rule_id == rule_filter], starts)])


def first_matches(hits: DataFrame, *keys: str) -> DataFrame:
    """The first matching line of each file and rule.

    Matches are written once, numbered, as they are few beside the lines. The least (line, number) of each group is one decimal, which
    hash aggregation takes, so nothing is sorted to group it; the rows themselves come back by their number. Numbers are as many as
    findings, however few bytes they took as a file, so that join is never a broadcast.
    """
    hits = written(hits.withColumn("__row", F.monotonically_increasing_id()), "hits")
    place = F.col("line").cast("decimal(38,0)") * (1 << 62) + F.col("__row")
    first = hits.groupBy(*keys, "rule_id").agg(F.min(place).alias("p")).select((F.col("p") % (1 << 62)).cast("long").alias("__row"))
    return hits.join(shuffled(first), "__row", "left_semi").drop("__row")


def whole_matches(files: DataFrame, rules: Sequence[Rule] = CONTAINER, content: str = "content") -> DataFrame:
    """Rules over whole contents; a match of ``absent`` clears the rule."""
    hits = []
    for r in rules:
        there = F.rlike(content, F.lit(r.pattern))
        if r.absent:
            there = there & ~F.rlike(content, F.lit(r.absent))
        hits.append(F.when(there, F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"))))
    return files.select(*[c for c in files.columns if c != content], F.inline(F.array_compact(F.array(*hits))))
