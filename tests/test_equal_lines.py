"""Equal lines of a batch are matched once, for the same packs, and every place they stand at comes back."""

from pyspark.sql import functions as F

from cindersift.functions.text import COMMENT_STARTS
from cindersift.operators import rules

PACK = (rules.Rule("x/eval", "high", r"eval\("), rules.Rule("x/digit", "low", r"\d{3}"))


def test_equal_lines_are_matched_once_and_all_places_come_back(spark):
    texts = ["eval(1)", "x = 123", "# eval(9)", "", None, "é eval(456)"]
    rows = [(f"r{i % 3}", i, i % 2 == 0, texts[i % len(texts)]) for i in range(600)]
    df = spark.createDataFrame(rows, "repo string, line int, own boolean, code string").coalesce(1)
    packs = [(F.col("own"), PACK, COMMENT_STARTS), (None, PACK[:1], ())]
    met = rules._met(df, packs, None).select("code", F.size("__places").alias("n")).collect()
    assert len(met) == 6 and sum(r.n for r in met) == 600
    want = sorted((r, i, c, n) for r, i, own, c in rows for n in ([1] if own and c and "eval(" in c and not c.startswith("#") else []) + ([2] if own and c and ("123" in c or "456" in c) else []) + ([3] if c and "eval(" in c else []))
    got = rules.marked(df, packs).where("hits is not null").select("repo", "line", "code", F.explode(F.split("hits", ",").cast("array<int>")).alias("n"))
    assert sorted(map(tuple, got.collect())) == want
    names = {1: "x/eval", 2: "x/digit", 3: "x/eval"}
    assert sorted((r.repo, r.line, r.code, r.rule_id) for r in rules.all_matches(df, packs).collect()) == sorted((r, i, c, names[n]) for r, i, c, n in want)
    none = rules.marked(df, packs, when=F.col("line") < 0)
    assert none.columns == [*df.columns, "hits"] and none.where("hits is null").count() == 600
