"""The labelled table of credentials and ordinary tokens that the automata of :mod:`cindersift.llm.secrets` learn from.

Every row follows one form; its random parts come from a generator seeded by the row's number, so the table is the same
on every cluster and in every task. All credentials are invented.
"""

from __future__ import annotations

import random
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ALNUM = string.ascii_letters + string.digits
WEB = ALNUM + "-_"
BASE64 = ALNUM + "+/"
UPPER = string.ascii_uppercase + string.digits
HEX = "0123456789abcdef"
WORDS = """user profile report chapter section index session image button winter garden market order invoice customer release
version config server client module package library document history summary question answer number letter country village
bridge station mountain river window kitchen paper colour green yellow running walking speaking reading under between without
during against table result search account manager service monitor handler request response channel network storage""".split()
SYLLABLES = "an ber con da el fi gra he in jo ka lo mi nu or pe qui ra sta ti un ver wa xe zo".split()


def _from(r: random.Random, chars: str, n: int) -> str:
    return "".join(r.choices(chars, k=n))


def _word(r: random.Random) -> str:
    return r.choice(WORDS) if r.random() < 0.5 else "".join(r.choices(SYLLABLES, k=r.randint(2, 5)))


def _words(r: random.Random, between: str, lo: int = 2, hi: int = 5) -> str:
    return between.join(_word(r) for _ in range(r.randint(lo, hi)))


def _camel(r: random.Random) -> str:
    return r.choice(["get", "set", "is", "load", "find"]) + "".join(_word(r).title() for _ in range(r.randint(2, 4))) + str(r.randint(1, 99))


def _date(r: random.Random) -> str:
    return f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}"


#: Prefixes, alphabets and lengths here are fixed values of public credential formats.
SECRET = (
    lambda r: r.choice(["ghp_", "gho_", "ghu_", "ghs_", "ghr_"]) + _from(r, ALNUM, 36),
    lambda r: "github_pat_" + _from(r, ALNUM, 22) + "_" + _from(r, ALNUM, 59),
    lambda r: "glpat-" + _from(r, WEB, 20),
    lambda r: r.choice(["xoxb-", "xoxp-", "xoxa-"]) + _from(r, string.digits, r.randint(10, 13)) + "-" + _from(r, string.digits, r.randint(10, 13)) + "-" + _from(r, ALNUM, 24),
    lambda r: r.choice(["sk_live_", "rk_live_", "sk_test_", "pk_live_"]) + _from(r, ALNUM, r.choice([24, 32, 99])),
    lambda r: "AIza" + _from(r, WEB, 35),
    lambda r: "ya29." + _from(r, WEB, 68),
    lambda r: "npm_" + _from(r, ALNUM, 36),
    lambda r: "SG." + _from(r, WEB, 22) + "." + _from(r, WEB, 43),
    lambda r: "hf_" + _from(r, string.ascii_letters, 30) + _from(r, ALNUM, 4),
    lambda r: r.choice(["sk-", "sk-proj-"]) + _from(r, ALNUM, 48),
    lambda r: "eyJ" + _from(r, WEB, r.randint(17, 40)) + ".eyJ" + _from(r, WEB, r.randint(30, 120)) + "." + _from(r, WEB, 43),
    lambda r: _from(r, BASE64, 40),
    lambda r: _from(r, BASE64, 43) + "=",
    lambda r: _from(r, BASE64, 22) + "==",
    lambda r: _from(r, ALNUM, r.choice([20, 24, 32, 40, 64])),
    lambda r: "ASIA" + _from(r, UPPER, 16),
    lambda r: _from(r, UPPER, r.choice([24, 32])),
    lambda r: "dop_v1_" + _from(r, HEX, 64),
    lambda r: "pypi-AgEIcHlwaS" + _from(r, WEB, r.randint(60, 120)),
)
PLAIN = (
    lambda r: _words(r, "_") + r.choice(["_", ""]) + str(r.randint(1, 9999)),
    lambda r: _words(r, "-") + "-" + str(r.randint(1, 9999)) + r.choice(["", "-" + _word(r)]),
    lambda r: _words(r, ".") + str(r.randint(1, 99)) + "." + r.choice(["txt", "parquet", "html", "tar.gz", "png"]),
    lambda r: _words(r, "/", 3, 6) + str(r.randint(1, 20)) + "/" + _word(r),
    lambda r: "www." + _word(r) + r.choice([".com/", ".org/", ".net/"]) + _date(r).replace("-", "/") + "/" + _words(r, "-"),
    lambda r: _camel(r),
    lambda r: _date(r) + "T" + f"{r.randint(0, 23):02}-{r.randint(0, 59):02}-{r.randint(0, 59):02}" + r.choice(["Z", "UTC", "-" + _word(r)]),
    lambda r: _date(r) + "-" + _words(r, r.choice("-_")),
    lambda r: "-".join(_from(r, HEX, n) for n in (8, 4, 4, 4, 12)),
    lambda r: r.choice(["INV", "ORD", "REF", "ISBN", "SKU", "DOI"]) + r.choice(["-", ".", "/"]) + "-".join(_from(r, string.digits, r.randint(2, 6)) for _ in range(r.randint(3, 5))),
    lambda r: r.choice(["v", "version-", "release-"]) + ".".join(str(r.randint(0, 30)) for _ in range(3)) + "-" + _word(r) + "." + str(r.randint(1, 9)) + r.choice(["", "-" + _word(r)]),
    lambda r: _word(r) + str(r.randint(10, 99)) + _word(r) + str(r.randint(1, 9)) + _word(r),
    lambda r: "+".join(f"{r.randint(1, 99)}{r.choice('xyzabk')}" for _ in range(r.randint(6, 9))),
    lambda r: _word(r) + "=" + str(r.randint(0, 9999)) + "." + str(r.randint(0, 99)) + r.choice(["px", "em", "ms", "kg"]) + "/" + _word(r),
    lambda r: (_word(r) * 4)[: r.randint(16, 24)] + str(r.randint(0, 9)),
    lambda r: r.choice("abcx-=_.") * r.randint(14, 40) + str(r.randint(0, 99)) + "a",
    lambda r: _words(r, "_").upper() + "_" + str(r.randint(1, 999)),
    lambda r: "".join(_word(r).title() for _ in range(3)) + str(r.randint(1900, 2030)),
)


def form(i: int) -> tuple[str, int, int]:
    """(token, secret, fold) of row i; every other row is a credential."""
    r, secret = random.Random(f"form {i}"), i % 2
    forms = SECRET if secret else PLAIN
    return forms[i // 2 % len(forms)](r), secret, r.randrange(5)


def _made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [form(i) for i in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.string()), *(pa.array([x[k] for x in rows], pa.int32()) for k in (1, 2))], ["token", "secret", "fold"])


def table(spark: SparkSession, rows: int) -> DataFrame:
    return spark.range(rows).mapInArrow(_made, "token string, secret int, fold int")
