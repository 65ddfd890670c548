"""Dependencies at scale: names by index against all pairs, advisories without pairs, addresses of repositories."""

import random

from pyspark.sql import functions as F

from cindersift.operators import deps
from cindersift.sources.scanners import repository_address


def edited(rng, name, times):
    for _ in range(times):
        i = rng.randrange(len(name) + 1)
        name = rng.choice([name[:i] + rng.choice("abxyz") + name[i:], name[:i] + name[i + 1 :], name[:i] + rng.choice("abxyz") + name[i + 1 :]])
    return name


def test_similar_names_are_all_pairs_within_the_distance(spark):
    rng = random.Random(5)
    popular = ["".join(rng.choices("abcde-", k=rng.choice([1, 2, 3, 8, 12, 22, 23, 24, 25, 26, 27, 40, 90]))) for _ in range(150)] + ["", "é日本語"]
    names = [edited(rng, rng.choice(popular), rng.randrange(4)) for _ in range(400)] + [None, "", "a"]
    a, b = spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(p,) for p in popular], "popular string")
    for distance in (1, 2, 3):
        every = a.where("name is not null").distinct().join(b.distinct(), F.length("name") >= 0).withColumn("d", F.levenshtein("name", "popular")).where(F.col("d").between(1, distance))
        want = {tuple(r) for r in every.select("name", "popular", "d").collect()}
        assert {tuple(r) for r in deps.similar_names(a, b, distance).collect()} == want
    got = {r.name: (r.popular, r.distance) for r in deps.typosquats(spark.createDataFrame([("reqests",), ("Lodahs",), ("lodash",)], "name string"), distance=1).collect()}
    assert got == {"reqests": ("requests", 1)}


def test_many_popular_names_meet_few(spark):
    popular = spark.range(100_000).select(F.expr("substring(sha1(cast(cast(id as string) as binary)), 1, 8 + cast(id % 6 as int))").alias("popular"))
    names = popular.limit(300).select(F.concat(F.expr("substring(popular, 1, 3)"), F.lit("z"), F.expr("substring(popular, 5)")).alias("name"))
    pairs = deps.name_candidates(names, popular).groupBy("name").count().agg(F.max("count").alias("most"), F.avg("count").alias("mean"), F.count("*").alias("n")).first()
    print("candidates of a name among 100,000:", pairs)
    assert pairs.n >= 295 and pairs.most < 500 and pairs.mean < 60


def test_advisory_counts_are_those_of_all_pairs(spark):
    rng = random.Random(2)
    version = lambda: ".".join(str(rng.randrange(5)) for _ in range(rng.randrange(1, 4)))
    table = [(rng.choice(["a", "b"]), rng.choice(deps.OPERATORS), version(), rng.choice(["critical", "high", "low", "info"]), f"CVE-{i}") for i in range(1200)] + [(None, "<", "1", "high", "CVE-x")]
    packages = [(rng.choice(["A", "b", "c"]), version()) for _ in range(300)] + [("a", "0.0.0"), (None, "1.0"), ("b", None)]
    parts = lambda v: [int(x) for x in v.split(".")]
    ops = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y, "==": lambda x, y: x == y, "!=": lambda x, y: x != y}
    order = ["critical", "high", "medium", "low", "info"]
    want = {}
    for n, v in packages:
        if n and v and v != "0.0.0":
            under = [s for p, o, b, s, _ in table if p == n.lower() and ops[o](parts(v), parts(b))]
            if under:
                want[n.lower(), v] = (len(under), min(under, key=order.index))
    t = spark.createDataFrame(table, "package string, op string, b string, severity string, cve_id string").withColumn("bound", deps.version_parts(F.col("b"))).drop("b")
    df = spark.createDataFrame(packages, "name string, version string")
    assert {(r.name, r.version): (r.n, r.worst) for r in deps.advisory_counts(df, t).collect()} == want
    pairs = deps.vulnerable(df.distinct(), t).groupBy(F.lower("name").alias("name"), "version").agg(F.countDistinct("cve_id").alias("n"))
    assert {(r.name, r.version): r.n for r in pairs.collect()} == {k: n for k, (n, _) in want.items()}
    assert deps.advisory_counts(df, t.where("false")).count() == 0


def test_legacy_checks(spark):
    rows = [("Django", "9.9", "requirements.txt"), ("django", "0.0.0", "requirements.txt"), ("lodash", "0.0.0", "package.json"), ("django", "1.0", "go.mod"), ("left-pad", "1.0", "package.json")]
    df = spark.createDataFrame(rows, "name string, version string, manifest string")
    assert sorted((r.name, r.severity, r.affected) for r in deps.legacy_vulnerable(df).collect()) == [("Django", "high", "< 4.2.0"), ("lodash", "high", "< 4.17.21")]
    odd = spark.createDataFrame([("scikit_lern",), ("Numppy",), ("numpy",)], "name string")
    assert sorted((r.name, r.popular) for r in deps.legacy_lookalikes(odd).collect()) == [("Numppy", "numpy"), ("scikit_lern", "scikit-learn")]


def test_repository_addresses(spark):
    want = {
        "https://github.com/octocat/Hello-World": ("octocat", "Hello-World"),
        "https://github.com/octocat/Hello-World.git": ("octocat", "Hello-World"),
        "https://github.com/octocat/Hello-World/": ("octocat", "Hello-World"),
        "git@github.com:octocat/Hello-World.git": ("octocat", "Hello-World"),
        "https://github.com/myorg/my-service": ("myorg", "my-service"),
        " https://github.com/a/b/tree/main \n": ("a", "b"),
        "https://github.com/a//": None,
        "http://github.com/a/b": None,
        "https://gitlab.com/owner/repo": None,
        "not-a-url": None,
        "": None,
        None: None,
    }
    rows = spark.createDataFrame([(u,) for u in want], "u string").select("u", repository_address(F.col("u")).alias("a")).collect()
    assert {r.u: tuple(r.a) if r.a else None for r in rows} == want
