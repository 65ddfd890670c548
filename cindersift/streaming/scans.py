"""Payloads to scans as a stream (W1), with progress from the running scan itself.

Every micro-batch of webhook payloads becomes scans of the files of its repositories. All a batch writes stands under its own
number (``batch=7``) and replaces what an earlier try of the same batch wrote, so a batch that runs again after a failure leaves
the same rows. The table of scans is written last: a scan is done when it stands there. A commit that a batch before has scanned
isn't scanned again, also when the payload is delivered twice.

Progress needs no second pass over findings: counts by layer are observed metrics of the job that writes them, and a query
listener takes what the stream observes of its payloads. Both go to one table of phases.

Under ``out``: deliveries (every payload and what it did), findings, scans, progress.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from cindersift.operators import findings as P
from cindersift.plans import scan
from cindersift.streaming.webhooks import triggered, verified

LAYERS = (1, 2, 3, 4, 5, 6)
PROGRESS = "batch long, phase string, layer int, n long, ts timestamp"
Told = Callable[[str, dict[str, int]], None]


def layer_counts() -> list:
    return [F.count(F.when(F.col("layer") == n, 1)).alias(f"layer{n}") for n in LAYERS]


def there(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def placed(df: DataFrame, out: str, table: str, batch: int) -> DataFrame:
    """Writes a batch's rows of a table in the place of any earlier ones of the batch, and reads them again."""
    path = f"{out}/{table}/batch={batch}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Progress:
    """The table of phases of a batch; every phase is one small file, replaced when the batch runs again."""

    def __init__(self, spark: SparkSession, out: str, batch: int):
        self.spark, self.out, self.batch = spark, out, batch

    def __call__(self, phase: str, counts: dict[str, int]) -> None:
        rows = [(self.batch, phase, int(k.removeprefix("layer")) if k.startswith("layer") else None, int(v)) for k, v in counts.items()]
        told = self.spark.createDataFrame(rows, "batch long, phase string, layer int, n long").withColumn("ts", F.current_timestamp())
        told.coalesce(1).write.mode("overwrite").parquet(f"{self.out}/progress/batch={self.batch}/phase={phase}")


def progress(spark: SparkSession, out: str) -> DataFrame:
    """All phases of all batches (batch, phase, layer, n, ts); none before the first."""
    if not there(spark, f"{out}/progress"):
        return spark.createDataFrame([], PROGRESS)
    return spark.read.schema(PROGRESS).option("basePath", f"{out}/progress").parquet(f"{out}/progress/*/*")


class Listener(StreamingQueryListener):
    """Takes the metrics that a stream observes of its payloads, once for each batch, and its end, to ``told``."""

    def __init__(self, told: Callable[[int, str, dict[str, int]], None]):
        self.told = told

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        seen = event.progress.observedMetrics.get("payloads")
        if seen is not None:
            self.told(event.progress.batchId, "payloads", seen.asDict())

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def scan_batch(payloads: DataFrame, batch: int, files: DataFrame, out: str, *, secret: bytes | None = None, repos: DataFrame | None = None) -> None:
    """One batch: payloads (event, body, signature) judged, their repositories' files (repo, file, content) scanned, all written under ``out``."""
    spark = payloads.sparkSession
    told = Progress(spark, out, batch)
    judged = triggered(payloads if secret is None else verified(payloads, secret), repos)
    judged = placed(judged.withColumn("scan_id", F.when(F.col("status") == "scan_triggered", F.substring(F.sha2(F.concat_ws("\n", "repository", "commit", "trigger"), 256), 1, 32))), out, "deliveries", batch)
    wanted = judged.where("scan_id is not null").select("scan_id", "repository", "trigger", "branch", "commit").dropDuplicates(["scan_id"])
    if there(spark, f"{out}/scans"):
        done = spark.read.parquet(f"{out}/scans").where(F.col("batch") < batch).select("scan_id")
        wanted = wanted.join(done, "scan_id", "left_anti")
    read, layers = Observation("sifted"), Observation("layers")
    # A scan's files carry its id in the place of their repository, so scans of one repository stay apart.
    own = files.join(wanted.select(F.col("repository").alias("repo"), "scan_id"), "repo").select(F.col("scan_id").alias("repo"), "file", "content")
    found = scan.detected(own.observe(read, F.count("*").alias("files"), F.sum(F.length("content")).alias("chars")))
    told("sifted", {k: v or 0 for k, v in read.get.items()})
    found = placed(P.dedup_best(found.observe(layers, *layer_counts())), out, "findings", batch)
    told("layers", layers.get)
    counts = P.linear_score(P.severity_counts(found, "scan_id")).join(P.risk_score(found), "scan_id")
    scored = wanted.join(counts, "scan_id", "left").withColumns({"score": F.coalesce("score", F.lit(100.0)), "security_score": F.coalesce("security_score", F.lit(100.0)), "total": F.coalesce("total", F.lit(0)), "status": F.lit("completed")})
    done = Observation("scored")
    placed(scored.observe(done, F.count("*").alias("scans")), out, "scans", batch)
    told("scored", done.get)


def scan_stream(payloads: DataFrame, files: DataFrame, out: str, checkpoint: str, *, secret: bytes | None = None, repos: DataFrame | None = None, once: bool = True) -> StreamingQuery:
    """A stream of payloads as scans; started again with the same checkpoint, it goes on behind the last batch that was finished.

    ``once`` takes all input there is and ends; else the stream runs on. Files are read anew for every batch.
    """
    spark = payloads.sparkSession
    seen = payloads.observe("payloads", F.count("*").alias("payloads"), F.count(F.when(F.col("event").isin("push", "pull_request"), 1)).alias("events"))
    listener = Listener(lambda batch, phase, counts: Progress(spark, out, batch)(phase, counts))
    spark.streams.addListener(listener)

    def sink(batch: DataFrame, batch_id: int) -> None:
        scan_batch(batch, batch_id, files, out, secret=secret, repos=repos)

    stream = seen.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    query = (stream.trigger(availableNow=True) if once else stream).start()
    query.listener = listener  # the caller removes it with the query
    return query
