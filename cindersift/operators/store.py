"""Stored scans and findings (K1, Q13): tables that a retried write leaves alone, laid out so that reading needs no exchange.

Each table is partitioned by the day (or month, or year) of the scan and bucketed by its key (scans by repository, findings by scan), under one folder.
A write replaces whole partitions, those that it has rows of and no others (dynamic partition overwrite), so writing the same
rows again leaves the same table; rows of a period that came before are merged in first, by key. As rows of a key lie in
one bucket whatever their period, grouping and joining by the key reads buckets side by side.

Defined results: of rows with the same key in one write the last by ``seq`` stays (any where they are equal in it); rows with no time stand in
a partition of their own; an empty write changes nothing; columns that a table doesn't have are an error, missing ones null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cindersift.operators.findings import top_by_risk
from cindersift.schema import truncated
from cindersift.storage import dropped, written

BUCKETS = 64


@dataclass(frozen=True)
class Layout:
    """A table's columns, what its rows are told apart by, what it is bucketed by, and the time that its period comes from."""

    columns: str
    key: tuple[str, ...]
    bucket: str
    time: str = "scan_time"


SCANS = Layout("scan_id long, repo_id long, status string, scan_time timestamp, score double, findings int", ("scan_id",), "repo_id")
FINDINGS = Layout(
    "scan_id long, seq long, scan_time timestamp, file string, line int, rule_id string, severity string, issue string, description string, code_snippet string, confidence double, exploitability double, blast_radius int, layer int, cve_id string, cwe_id string, package_name string, package_version string",
    ("scan_id", "seq"),
    "scan_id",
)
USERS = Layout("user_id long, login string, email string, scan_time timestamp", ("user_id",), "user_id")


class Store:
    """Tables of one folder. ``name`` tells the stores of a session apart; a partition is a ``period`` (day, month, year) of scans, and a file for each bucket."""

    def __init__(self, spark: SparkSession, folder: str, name: str, *, buckets: int = BUCKETS, period: str = "day"):
        self.spark, self.folder, self.name, self.buckets, self.period = spark, folder.rstrip("/"), name, buckets, period

    def _table(self, kind: str) -> str:
        return f"{self.name}_{kind}"

    def opened(self, kind: str, layout: Layout) -> DataFrame:
        """The table, made or found in its folder."""
        table = self._table(kind)
        if not self.spark.catalog.tableExists(table):
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
            folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
            self.spark.sql(f"CREATE TABLE {table} ({layout.columns}, day date) USING parquet PARTITIONED BY (day) CLUSTERED BY ({layout.bucket}) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{kind}'")
            self.spark.catalog.recoverPartitions(table)
        return self.spark.table(table)

    def write(self, kind: str, layout: Layout, rows: DataFrame) -> None:
        """Rows in place of those of their key, in the periods that they are of."""
        now = self.opened(kind, layout)
        names = [f.name for f in now.schema if f.name != "day"]
        if extra := [c for c in rows.columns if c not in (*names, "day")]:
            raise ValueError(f"{kind} has no {', '.join(extra)}")
        kinds = dict(now.dtypes)
        new = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in names]).withColumn("day", F.to_date(F.date_trunc(self.period, layout.time)))
        order = Window.partitionBy(*layout.key).orderBy(*([F.desc("seq")] if "seq" in names and "seq" not in layout.key else [F.lit(0)]))
        new = new.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
        # A period that the rows touch is written anew: its other rows stay.
        days = new.select("day").distinct()
        kept = now.join(days, now["day"].eqNullSafe(days["day"]), "left_semi").join(new.select(*layout.key), [*layout.key], "left_anti").select(*names, "day")
        # The table that is read is also written; so what is to stand there is worked out first.
        whole = written(kept.unionByName(new), f"store-{kind}")
        before = self.spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            # Rows of a bucket come to one task, so a period's bucket is one file.
            whole.repartition(self.buckets, layout.bucket).write.mode("overwrite").insertInto(self._table(kind))
        finally:
            self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
            dropped(whole)

    def save_scans(self, scans: DataFrame) -> None:
        self.write("scans", SCANS, scans)

    def save_findings(self, findings: DataFrame, k: int = 500) -> None:
        """K1: the k riskiest findings of each scan, texts cut."""
        kept = truncated(top_by_risk(findings, k)).drop("position")
        self.write("findings", FINDINGS, kept.select(*[c for c in kept.columns if c in {x.strip().split()[0] for x in FINDINGS.columns.split(",")}]))

    def upsert_users(self, users: DataFrame) -> None:
        """Q13."""
        self.write("users", USERS, users)

    def scans(self) -> DataFrame:
        return self.opened("scans", SCANS)

    def findings(self) -> DataFrame:
        return self.opened("findings", FINDINGS)

    def users(self) -> DataFrame:
        return self.opened("users", USERS)

    def forget(self) -> None:
        """The session's names of the tables; what is in the folder stays."""
        for kind in ("scans", "findings", "users"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(kind)}")
