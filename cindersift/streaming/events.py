"""Streams of events: triggers, progress, denylist, rate windows, deduplication, idle sessions and running totals.

Every function takes a batch or a streaming DataFrame of (event_id, ts, key, kind) and gives the same rows for either,
late events within the watermark included, but for the denylist: as a stream it sees an entry only once it has come.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "10 minutes"


def events(spark: SparkSession, sf_dir: str, *, stream: bool = False) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    if stream:
        rows = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 16).parquet(f"{sf_dir}/events.parque[t]")  # a pattern may name a file or a folder
    else:
        rows = spark.read.parquet(path)
    return rows.selectExpr("event_id", "CAST(ts AS TIMESTAMP) AS ts", "user_id AS key", "event_type AS kind", "value")


def _marked(rows: DataFrame, late: str) -> DataFrame:
    return rows.withWatermark("ts", late) if rows.isStreaming else rows


def triggers(rows: DataFrame, kinds: tuple[str, ...] = ("purchase", "signup")) -> DataFrame:
    """The events that start a scan."""
    return rows.where(F.col("kind").isin(*kinds))


def rate_windows(rows: DataFrame, width: str = "1 hour", limit: int = 2, late: str = LATE) -> DataFrame:
    """Events of each key and window, and whether they are over the limit."""
    per = _marked(rows, late).groupBy("key", F.window("ts", width).alias("w")).agg(F.count("*").alias("n"))
    return per.select("key", F.col("w.start").alias("start"), "n", (F.col("n") > limit).alias("limited"))


def sessions(rows: DataFrame, gap: str = "900 seconds", late: str = LATE) -> DataFrame:
    """Runs of a key's events with no longer gap than the timeout."""
    per = _marked(rows, late).groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return per.select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(rows: DataFrame, late: str = LATE) -> DataFrame:
    """Each event once, by id; state is kept as long as the watermark."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if rows.isStreaming else rows.dropDuplicates(["event_id"])


def running_totals(rows: DataFrame) -> DataFrame:
    """Scans of each key and the last one's time."""
    return rows.groupBy("key").agg(F.count("*").alias("total"), F.max("ts").alias("last_ts"))


def denied(rows: DataFrame, denials: DataFrame, ttl_s: int) -> DataFrame:
    """Events of keys that are on a denylist at their time; an entry (key, denied_at) lasts ttl seconds.

    Entries and events meet on key and hour bucket, so a key with many of either stays an equi-join. Streams of both go
    to :func:`denied_stream`, whose state is one entry for each key that is on the list just now.
    """
    if rows.isStreaming:
        return denied_stream(rows, denials, ttl_s)
    hours = F.sequence(F.date_trunc("hour", "denied_at"), F.date_trunc("hour", F.col("denied_at") + F.make_dt_interval(secs=F.lit(ttl_s))), F.expr("interval 1 hour"))
    entries = denials.select("key", "denied_at", F.explode(hours).alias("hour"))
    met = rows.withColumn("hour", F.date_trunc("hour", "ts")).join(entries, ["key", "hour"])
    met = met.where((F.col("ts") >= F.col("denied_at")) & (F.col("ts") < F.col("denied_at") + F.make_dt_interval(secs=F.lit(ttl_s))))
    return met.select(*rows.columns).distinct()


def denied_stream(rows: DataFrame, denials: DataFrame, ttl_s: int, late: str = LATE) -> DataFrame:
    """W3 as a stream: keyed state with a timer. A key's state is the time its entry began and ends; the timer drops it.

    A renewed entry lasts from the renewal on; one that starts after the last has ended takes its place. Rows of a key
    are taken in the order of their time within a batch, an entry before events of the same time.
    """
    columns, told = rows.columns, [f"{n} {t}" for n, t in rows.dtypes]
    entries = denials.select(F.col("denied_at").alias("ts"), "key").withColumn("__entry", F.lit(True))
    both = rows.withColumn("__entry", F.lit(False)).unionByName(entries, allowMissingColumns=True).withWatermark("ts", late)

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        since, until = state.get if state.exists else (0, 0)
        own = pd.concat(list(batches))
        own = own.assign(__us=own["ts"].astype("datetime64[us]").astype("int64")).sort_values(["__us", "__entry"], ascending=[True, False], kind="stable")
        kept = []
        for at, entry in zip(own["__us"].tolist(), own["__entry"].tolist()):
            if entry:
                since, until = (since if since <= at < until else at), at + ttl_s * 1_000_000
            kept.append(not entry and since <= at < until)
        if until:
            state.update((since, until))
            state.setTimeoutTimestamp(max(until // 1000, state.getCurrentWatermarkMs() + 1))
        out = own[kept]
        if len(out):
            yield out[columns]

    return both.groupBy("key").applyInPandasWithState(follow, ", ".join(told), "since long, until long", "append", GroupStateTimeout.EventTimeTimeout)


def progress_sink(path: str):
    """For ``foreachBatch``: the last (scan_id, ts, ...) of each scan in a batch, under the batch's own folder, so a batch that runs again replaces itself."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        last = batch.groupBy("scan_id").agg(F.max_by(F.struct(*batch.columns), "ts").alias("r")).select("r.*")
        last.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return sink


def progress(spark: SparkSession, path: str) -> DataFrame:
    """The last row of each scan in a :func:`progress_sink`."""
    rows = spark.read.parquet(path).drop("batch")
    return rows.groupBy("scan_id").agg(F.max_by(F.struct(*rows.columns), "ts").alias("r")).select("r.*")


def run_available(rows: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Runs a stream over all input there is and writes it as Parquet; returns when done."""
    q = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
