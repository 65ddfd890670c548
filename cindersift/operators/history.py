"""Queries over stored scans, repositories and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cindersift.schema import severity_rank

TERMINAL = ("completed", "failed")


def owned(scans: DataFrame, repos: DataFrame, owner) -> DataFrame:
    """Q1: the scans of an owner's repositories."""
    return scans.join(repos.where(F.col("owner") == owner).select("repo_id"), "repo_id")


def report(findings: DataFrame, severity: str | None = None, k: int = 200, scanner: str | None = None) -> DataFrame:
    """Q2: findings, of one severity and one scanner if given, worst first, the first k."""
    chosen = findings if severity is None else findings.where(F.col("severity") == severity)
    chosen = chosen if scanner is None else chosen.where(F.col("scanner") == scanner)
    return chosen.orderBy(F.desc(severity_rank(F.col("severity"))), "scan_id", "seq").limit(k)


#: Types whose latest value an aggregation keeps in place, so that it hashes instead of sorting.
FIXED = ("bigint", "int", "smallint", "tinyint", "double", "float", "boolean", "date", "timestamp")


def latest(scans: DataFrame, *columns: str, completed: bool = True) -> DataFrame:
    """Q3, Q6, Q7: each repository's scan of the largest id, by hash aggregation; other texts come back by the scan's id."""
    rows = scans.where("status = 'completed'") if completed else scans
    kinds = dict(rows.dtypes)
    fixed = [c for c in columns if kinds[c] in FIXED]
    newest_ = rows.groupBy("repo_id").agg(F.max("scan_id").alias("scan_id"), *[F.max_by(c, "scan_id").alias(c) for c in fixed])
    if len(fixed) < len(columns):
        newest_ = newest_.join(rows.select("repo_id", "scan_id", *[c for c in columns if c not in fixed]), ["repo_id", "scan_id"])
    return newest_.select("repo_id", "scan_id", *columns)


def with_latest(repos: DataFrame, scans: DataFrame) -> DataFrame:
    """Q5: every repository, with the score of its latest completed scan or as never scanned."""
    out = repos.join(latest(scans, "score", "findings"), "repo_id", "left")
    return out.select("repo_id", "scan_id", "score", F.coalesce("findings", F.lit(0)).alias("findings"), F.when(F.col("scan_id").isNull(), "never_scanned").otherwise("completed").alias("state"))


def dashboard(repos: DataFrame, scans: DataFrame) -> DataFrame:
    """Q4: repositories, scanned ones, their mean latest score and findings."""
    rows = with_latest(repos, scans)
    return rows.groupBy("state").agg(F.count("*").alias("repos"), F.round(F.avg("score"), 1).alias("mean_score"), F.sum("findings").cast("long").alias("findings"))


def trend(scans: DataFrame, n: int = 20) -> DataFrame:
    """Q8: each repository's last n completed scans, numbered from the oldest of them."""
    back = Window.partitionBy("repo_id").orderBy(F.desc("scan_id"))
    last = scans.where("status = 'completed'").withColumn("b", F.row_number().over(back)).where(F.col("b") <= n)
    return last.select("repo_id", "scan_id", "scan_time", "score", F.row_number().over(Window.partitionBy("repo_id").orderBy("scan_id")).alias("position"))


def diff(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """Q10: fingerprints that are new, fixed or unchanged; repeated ones count once."""
    a = before.select(*keys).distinct().withColumn("was", F.lit(1))
    b = after.select(*keys).distinct().withColumn("is", F.lit(1))
    out = a.join(b, list(keys), "full")
    return out.select(*keys, F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "fixed").otherwise("unchanged").alias("change"))


def score_change(old: Column, new: Column) -> tuple[Column, Column]:
    """The rounded difference, a score of 0 or null counting as 0, and what it means."""
    d = F.round(F.coalesce(new, F.lit(0.0)) - F.coalesce(old, F.lit(0.0)), 1)
    return d, F.when(d > 0, "improved").when(d < 0, "declined").otherwise("unchanged")


def running(scans: DataFrame, now: Column, timeout_s: int = 900) -> DataFrame:
    """Scans that are not finished, and whether they are stuck."""
    age = F.unix_timestamp(now) - F.unix_timestamp("scan_time")
    return scans.where(~F.col("status").isin(*TERMINAL)).withColumn("stuck", age > timeout_s)


def known(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Q12: rows whose key exists."""
    return rows.join(keys, on, "left_semi")


def without_repo(rows: DataFrame, deleted: DataFrame) -> DataFrame:
    """Q14: what a cascading delete leaves."""
    return rows.join(deleted, "repo_id", "left_anti")


def rolled_up(summary: DataFrame, key: str = "scan_id") -> DataFrame:
    """Q15: PASS if all frameworks pass, FAIL if any fails, else WARN."""
    per = summary.groupBy(key).agg(F.bool_and(F.col("status") == "PASS").alias("p"), F.bool_or(F.col("status") == "FAIL").alias("f"))
    return per.select(key, F.when(F.col("p"), "PASS").when(F.col("f"), "FAIL").otherwise("WARN").alias("status"))


def components(findings: DataFrame) -> DataFrame:
    """Q18: packages named by findings."""
    return findings.where("package_name is not null").select("scan_id", "package_name", F.coalesce("package_version", F.lit("unknown")).alias("version"))


def posture(latest_scans: DataFrame, *keys: str) -> DataFrame:
    """Mean score, worst repository, and how many are good, passing and failing."""
    out = latest_scans.groupBy(*keys).agg(
        F.round(F.avg("score"), 2).alias("mean_score"),
        F.min(F.struct("score", "repo_id")).alias("w"),
        F.count(F.when(F.col("score") >= 80, 1)).alias("good"),
        F.count(F.when(F.col("score") >= 70, 1)).alias("passing"),
        F.count(F.when(F.col("score") < 50, 1)).alias("failing"),
    )
    label = F.when(F.col("mean_score") >= 80, "good").when(F.col("mean_score") >= 50, "fair").otherwise("poor")
    return out.withColumn("worst_repo", F.col("w.repo_id")).drop("w").withColumn("label", label)


def search(rows: DataFrame, column: str, needle: str) -> DataFrame:
    """Rows whose column contains the needle, in any case."""
    return rows.where(F.contains(F.lower(column), F.lit(needle.lower())))


def trend_delta(series: DataFrame) -> DataFrame:
    """The last score less the first."""
    per = series.groupBy("repo_id").agg(F.max_by("score", "position").alias("b"), F.min_by("score", "position").alias("a"))
    return per.select("repo_id", F.round(F.col("b") - F.col("a"), 4).alias("delta"))


def sparkline(series: DataFrame) -> DataFrame:
    """Scores between the least and the greatest of their series, 0.5 where these are equal."""
    w = Window.partitionBy("repo_id")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return series.select("repo_id", "position", F.round(F.when(hi > lo, (F.col("score") - lo) / (hi - lo)).otherwise(0.5), 6).alias("y"))


def severity_share(findings: DataFrame) -> DataFrame:
    """Findings of each severity and their share in percent."""
    per = findings.groupBy("severity").agg(F.count("*").alias("n"))
    return per.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


def newest(scans: DataFrame, k: int = 10, key: str = "repo_id") -> DataFrame:
    """Q9: the newest k scans of each repository by id, with their position."""
    w = Window.partitionBy(key).orderBy(F.desc("scan_id"))
    return scans.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def live_status(scans: DataFrame) -> DataFrame:
    """Q17: what a poll of a scan sees: the phase, the status where there is none, and whether it has ended."""
    phase = F.coalesce(F.nullif("phase", F.lit("")), "status") if "phase" in scans.columns else F.col("status")
    return scans.select("scan_id", "status", phase.alias("phase"), "score", F.col("status").isin("completed", "failed").alias("is_complete"))


def running_flags(scans: DataFrame) -> DataFrame:
    """Whether any scan of a repository is running, and how many failed."""
    return scans.groupBy("repo_id").agg(F.bool_or(F.col("status") == "running").alias("any_running"), F.count(F.when(F.col("status") == "failed", 1)).alias("failed"))


def upserted(rows: DataFrame, news: DataFrame, key: str) -> DataFrame:
    """Q13: the rows with those of ``news`` in place of the ones of their key; a null key matches nothing and is added."""
    kept = rows.join(news.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return kept.select(rows.columns).unionByName(news.select(rows.columns))
