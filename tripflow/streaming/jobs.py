"""Streaming jobs over the same operators as the batch plans.

Streams carry instants, so event times are timestamps (not ntz) here. Every job takes its checkpoint, and a trigger
or None for "all that is available".
"""

from __future__ import annotations

import time
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.cleaning import route, valid_pickups, valid_requests
from ..operators.lifecycle import DROPOFF_WITHIN, PICKUP_WITHIN, completed, dedup, responses
from ..operators.slots import SLIDE, WINDOW, slot_metrics, trip_facts
from ..session import SETTINGS
from ..sources.readers import parse_events, read_table
from ..sources.sinks import DAY, fan_out, upsert

WATERMARKS = {"request": "20 minutes", "pickup": "5 minutes", "slots": "5 minutes"}


def _start(writer, trigger: str | None) -> StreamingQuery:
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()


def ingest(raw: DataFrame, tables: Mapping[str, str], checkpoint: str, trigger: str | None = None) -> StreamingQuery:
    """Raw messages (json_str) to a table per event kind."""
    writer = parse_events(raw).writeStream.queryName("ingest").option("checkpointLocation", checkpoint).foreachBatch(lambda batch, i: fan_out(batch, i, tables))
    return _start(writer, trigger)


def request_stream(events: DataFrame, delay: str = WATERMARKS["request"]) -> DataFrame:
    """Valid requests, once per trip."""
    return dedup(valid_requests(route(events, "request").drop("year", "month", "day")), ["trip_id"], "request_datetime", delay)


def pickup_stream(events: DataFrame, delay: str = WATERMARKS["pickup"]) -> DataFrame:
    return dedup(valid_pickups(route(events, "pickup").drop("year", "month", "day")), ["trip_id"], "pickup_datetime", delay)


def response_stream(requests: DataFrame, pickups: DataFrame, within: str = PICKUP_WITHIN) -> DataFrame:
    return responses(requests, pickups, within)


def complete_stream(response: DataFrame, dropoffs: DataFrame, within: str = DROPOFF_WITHIN) -> DataFrame:
    return completed(response, dropoffs, within)


def slot_stream(trips: DataFrame, window: str = WINDOW, slide: str = SLIDE, delay: str = WATERMARKS["slots"]) -> DataFrame:
    """Slot metrics with state: a window that spans batches keeps all its rows. For update mode."""
    return slot_metrics(trip_facts(trips).withWatermark("ts", delay), window, slide)


def upsert_slots(slots: DataFrame, path: str, checkpoint: str, trigger: str | None = None) -> StreamingQuery:
    """Changed windows replace their rows in the table; late rows within the watermark change a window again."""
    writer = slots.writeStream.queryName("slots").outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(lambda batch, i: upsert(batch, path))
    return _start(writer, trigger)


def watermark_of(query: StreamingQuery) -> str | None:
    """The watermark that a query has come to, as text; None before any."""
    last = query.lastProgress
    mark = last and last["eventTime"].get("watermark")
    return mark if mark and not mark.startswith("1970-01-01T00:00:00") else None


def late_days(facts: DataFrame, watermark: str, window: str = WINDOW, slide: str = SLIDE) -> DataFrame:
    """(date): days with windows that facts came too late for. watermark: the column of the stream's watermark when a fact arrived, null before the first."""
    windows = facts.where(f"window(ts, '{slide}').end <= {watermark}").select(F.window("ts", window, slide).alias("w"), watermark)
    return windows.where(f"w.end <= {watermark}").select(F.to_date("w.end").alias("date")).distinct()


def near_days(facts: DataFrame, days: set[date], window: str = WINDOW) -> DataFrame:
    """Facts of windows that end on one of the days. Days in a row are one range, and times are compared as they are."""
    kind, near = dict(facts.dtypes)["ts"], F.lit(False)
    starts, ends = sorted(d for d in days if d - timedelta(1) not in days), sorted(d + timedelta(1) for d in days if d + timedelta(1) not in days)
    for lo, hi in zip(starts, ends, strict=True):
        near |= (F.col("ts") >= F.lit(lo).cast(kind) - F.expr(f"INTERVAL {window}")) & (F.col("ts") < F.lit(hi).cast(kind))
    return facts.where(near)


def repair_days(trips: DataFrame, path: str, days: DataFrame, window: str = WINDOW, slide: str = SLIDE) -> None:
    """Recomputes all slots that end on these days (column date) from batch trips, rows past any watermark included.

    Only facts of those days, and of one window before them, are aggregated. The days are fetched, as the repair is planned with them.
    Facts are filtered, not trips: a filter on trips that are themselves derived would derive their times once more for each bound.
    """
    wanted = {r.date for r in days.where("date IS NOT NULL").select("date").distinct().collect()}
    slots = slot_metrics(near_days(trip_facts(trips), wanted, window), window, slide)
    upsert(slots.where(F.to_date("window_end").isin(sorted(wanted))), path)


def static_enrich(stream: DataFrame, requests_path: str, path: str, checkpoint: str, within: str = PICKUP_WITHIN, trigger: str | None = None) -> StreamingQuery:
    """Pickups of a stream joined with a table of requests that is partitioned by year, month and day.

    Each micro-batch reads only the days that its own times reach back to; a repeated batch replaces its own rows.
    """
    def join(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            found = enriched(batch, requests_path, within)
            if found is not None:
                found.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)
        finally:
            batch.unpersist()

    return _start(stream.writeStream.queryName("enrich").option("checkpointLocation", checkpoint).foreachBatch(join), trigger)


def enriched(pickups: DataFrame, requests_path: str, within: str = PICKUP_WITHIN) -> DataFrame | None:
    """responses() of a batch of pickups and the requests of the days that it needs; None without pickups. Its two bounds are fetched, so that the scan is planned with them."""
    span = pickups.agg((F.min("pickup_datetime") - F.expr(f"INTERVAL {within}")).cast("string").alias("lo"), F.max("pickup_datetime").cast("string").alias("hi")).first()
    if span.lo is None:
        return None
    requests = read_table(pickups.sparkSession, requests_path, time_range=("request_datetime", span.lo, span.hi)).drop(*DAY)
    return responses(requests, pickups, within)


def stop_after(query: StreamingQuery, batches: int, seconds: float = 600) -> None:
    """Stops a query once it has finished so many micro-batches; an error if it fails or takes longer."""
    end = time.monotonic() + seconds
    while not query.lastProgress or query.lastProgress["batchId"] + 1 < batches:
        if query.exception() or time.monotonic() > end:
            query.stop()
            raise query.exception() or TimeoutError(f"no {batches} micro-batches within {seconds} s")
        time.sleep(0.1)
    query.stop()


def repeat_last_batch(spark: SparkSession, checkpoint: str) -> None:
    """Takes back the last batch's commit, as a crash before it would: the query's next start runs that batch again under its id."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    last = max((f.getPath() for f in files.listStatus(folder) if f.getPath().getName().isdigit()), key=lambda p: int(p.getName()))
    files.delete(last, False)


@contextmanager
def settings(spark: SparkSession, wanted: Mapping[str, str]) -> Iterator[None]:
    """Settings of queries that are started inside."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@contextmanager
def state_settings(spark: SparkSession, partitions: int = 16, batches: int = 20) -> Iterator[None]:
    """Settings of queries with state, for those started inside: state in RocksDB, outside the heap.

    Shuffle partitions and the provider are frozen in a query's checkpoint, so they are set before its first start.
    """
    wanted = {
        "spark.sql.shuffle.partitions": str(partitions), "spark.sql.streaming.minBatchesToRetain": str(batches), "spark.sql.streaming.multipleWatermarkPolicy": "min",
        "spark.sql.streaming.stateStore.providerClass": SETTINGS["spark.sql.streaming.stateStore.providerClass"], "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    }
    with settings(spark, wanted):
        yield
