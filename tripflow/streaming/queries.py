"""Registered queries that run the streaming jobs over the given tables, and the same in batch SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import cleaning, lifecycle
from ..operators.slots import trip_facts
from ..plans import fixtures
from ..plans import queries as batch
from ..sources.readers import read_table
from ..sources.sinks import DAY, UNIQUE_ID, append, encode_events, exists, make_folder, move, start_append, work_folder, written
from . import jobs, progress


def _trip_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips as a stream, their times as instants."""
    path = f"{sf_dir}/lineitem.parquet"
    # As a pattern: a file stream takes a folder or a pattern, not the name of one file.
    lines = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path[:-1] + "[t]")
    return _instants(fixtures.trips_of(lines))


def _instants(df: DataFrame, kind: str = "timestamp") -> DataFrame:
    """df with its times as instants, or back as times of day and year (timestamp_ntz)."""
    return df.withColumns({c: F.col(c).cast(kind) for c, t in df.dtypes if t.startswith("timestamp")})


def _files(spark: SparkSession, sf_dir: str, batches: int, least: int, rows: int = 500_000) -> tuple[int, int]:
    """How many files trips are written as, none of much more than ``rows``, and how many of them make one of so many batches."""
    n = max(least, -(-fixtures.trips(spark, sf_dir).count() // rows))
    return n, -(-n // batches)


def _trip_table(spark: SparkSession, sf_dir: str, folder: str, files: int) -> str:
    """Clean trips as a table of so many files, for streams that take some files a batch."""
    path = f"{folder}/trips"
    _instants(cleaning.clean_trips(fixtures.trips(spark, sf_dir))).repartition(files, "trip_id").write.parquet(path)
    return path


#: Only a repeat of the last batch needs older state, on disk or in memory, and changes are folded into snapshots soon, so that their files can go. Checksums of those
#: files take about a third of the time, and times in Parquet's old form more of it than numbers.
_STATE = {
    "spark.sql.streaming.minBatchesToRetain": "2", "spark.sql.streaming.maxBatchesToRetainInMemory": "1", "spark.sql.streaming.stateStore.minDeltasForSnapshot": "2",
    "spark.sql.streaming.stateStore.maintenanceInterval": "20s", "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false", "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
}


def _in_parts(trips: DataFrame, folder: str, start: Callable[[DataFrame], StreamingQuery], rows: int = 2_500_000, most: int | None = None) -> StreamingQuery:
    """Trips that come in parts of about so many rows (at most ``most`` parts) by the time of request, to one running query; it has been stopped when this returns.

    So rows of a part are as late as its trips are long, and a watermark may be short: state holds a part, not all trips, and stays loaded from part to part.
    A part comes by moving its folder, which must be one step: of half a part, the other half could be late.
    """
    spark, at = trips.sparkSession, F.unix_timestamp("request_datetime")
    span = trips.agg(F.count("*").alias("n"), F.min(at).alias("lo"), F.max(at).alias("hi")).first()
    parts = min(1 + span.n // rows, most or span.n + 1)
    part = F.floor((at - F.lit(span.lo)) * parts / (F.lit(span.hi) - F.lit(span.lo) + 1))
    dealt = trips.withColumn("part", F.coalesce(part.cast("int"), F.lit(0)))
    came = f"{folder}/arrived"
    make_folder(spark, came)
    # As many partitions as cores: a part is small, and each partition of each state is a file a batch.
    with jobs.settings(spark, _STATE | {"spark.sql.shuffle.partitions": str(spark.sparkContext.defaultParallelism)}):
        dealt.write.option(*UNIQUE_ID).partitionBy("part").parquet(f"{folder}/parts")
        query = start(read_table(spark, came, streaming=True, schema=dealt.schema).drop("part"))
    try:
        query.processAllAvailable()
        for i in range(parts):
            if exists(spark, f"{folder}/parts/part={i}"):
                move(spark, f"{folder}/parts/part={i}", f"{came}/part={i}")
                query.processAllAvailable()
    finally:
        query.stop()
    return query


def _gold_of(spark: SparkSession, path: str) -> DataFrame:
    return batch.rounded(_instants(cleaning.restrict(spark.read.parquet(path).drop("slot_day")), "timestamp_ntz"))


def stream_slot_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stateful sliding windows in update mode, upserted into a table by day."""
    folder = work_folder(spark)
    slots = jobs.slot_stream(cleaning.clean_trips(_trip_stream(spark, sf_dir)), delay="30 days")
    jobs.upsert_slots(slots, f"{folder}/gold", f"{folder}/state").awaitTermination()
    return _gold_of(spark, f"{folder}/gold")


_RESPONDED = ["trip_id", "request_datetime", "pickup_datetime", "PULocationID", "DOLocationID"]
_COMPLETED = [*_RESPONDED, "dropoff_datetime", "trip_miles", "trip_time"]
_DELAY = "1 hour"


def _side(trips: DataFrame, valid: Callable[[DataFrame], DataFrame], ts: str, *columns: str) -> DataFrame:
    return lifecycle.dedup(valid(trips).select("trip_id", ts, *columns), ["trip_id"], ts, _DELAY)


def _response_of(trips: DataFrame) -> DataFrame:
    return jobs.response_stream(_side(trips, cleaning.valid_requests, "request_datetime", "PULocationID", "DOLocationID"), _side(trips, cleaning.valid_pickups, "pickup_datetime", "PULocationID"))


def _joined(spark: SparkSession, sf_dir: str, folder: str, build: Callable[[DataFrame], DataFrame], columns: Sequence[str] = _COMPLETED, **parts: int) -> tuple[DataFrame, StreamingQuery]:
    """What a join of streams has appended to a table, its times as times of day and year, and its last query."""
    def start(trips: DataFrame) -> StreamingQuery:
        nonlocal schema
        out = build(trips)
        schema = out.schema
        return start_append(out, f"{folder}/out", f"{folder}/state", "joined", trigger="0 seconds")

    schema = None
    query = _in_parts(_instants(fixtures.trips(spark, sf_dir)).select(*columns), folder, start, **parts)
    return _instants(spark.read.schema(schema).parquet(f"{folder}/out"), "timestamp_ntz"), query


def stream_response_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deduplicated requests and pickups, joined as streams within the interval."""
    return _joined(spark, sf_dir, work_folder(spark), lambda trips: _response_of(trips).select("trip_id", "request_datetime", "pickup_datetime"), _RESPONDED)[0]


def _complete_of(trips: DataFrame) -> DataFrame:
    drops = _side(trips, cleaning.valid_dropoffs, "dropoff_datetime", "DOLocationID", "trip_miles", "trip_time")
    return jobs.complete_stream(_response_of(trips), drops).select("trip_id", "pickup_datetime", "dropoff_datetime", "DOLocationID")


def stream_complete_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses, themselves a join of streams, joined with dropoffs as a stream."""
    return _joined(spark, sf_dir, work_folder(spark), _complete_of)[0]


def stream_restarted_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of a stream that is stopped half way, between two micro-batches, and resumed from its checkpoint; state in RocksDB."""
    folder = work_folder(spark)
    files, a_batch = _files(spark, sf_dir, 2, 4)
    path = _trip_table(spark, sf_dir, folder, files)
    with jobs.state_settings(spark, int(spark.conf.get("spark.sql.shuffle.partitions"))):
        slots = lambda: jobs.slot_stream(read_table(spark, path, streaming=True, max_files=a_batch), delay="30 days")
        # The second batch would begin an hour later, so the query stops between the two.
        jobs.stop_after(jobs.upsert_slots(slots(), f"{folder}/gold", f"{folder}/state", trigger="1 hour"), batches=1)
        jobs.upsert_slots(slots(), f"{folder}/gold", f"{folder}/state").awaitTermination()
    return _gold_of(spark, f"{folder}/gold")


_SPAN = 432_000  # seconds of a part: trips arrive in parts by the time of their end, and some of them a part later
_LATE = "PULocationID % 7 = 0 AND day(dropoff_datetime) % 5 = 0"


def _arrivals(trips: DataFrame) -> DataFrame:
    """arrival: the part that a trip comes in."""
    start = F.unix_timestamp(F.lit(fixtures.START).cast("timestamp"))
    return trips.withColumn("arrival", F.floor((F.unix_timestamp("dropoff_datetime") - start) / _SPAN) + F.expr(f"CASE WHEN {_LATE} THEN 1 ELSE 0 END"))


def stream_late_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per day: requests in the slots of a stream with a watermark of five minutes, requests in the repaired slots, and slots mended.

    Trips are written once, in parts; a part comes by moving its files and is taken by a new start from the same checkpoint. Rows within the watermark change their windows again; those
    beyond it are dropped by the stream, and the days of the windows that they missed are then made anew from all trips.
    """
    folder = work_folder(spark)
    gold, came = f"{folder}/gold", f"{folder}/arrived"
    # Slots need neither of the two columns, which are much of a trip's size.
    dealt = _arrivals(_instants(cleaning.clean_trips(fixtures.trips(spark, sf_dir)).drop("trip_id", "on_scene_datetime")))
    dealt.write.partitionBy("arrival").parquet(f"{folder}/trips")
    parts = [r.arrival for r in spark.read.schema(dealt.schema).parquet(f"{folder}/trips").select("arrival").distinct().orderBy("arrival").collect()]
    marks, mark = [F.lit(None).cast("timestamp")], F.lit(None).cast("timestamp")  # the watermark that each part meets
    for i in parts:
        mark = F.when(F.col("arrival") == i, marks[-1]).otherwise(mark)
        move(spark, f"{folder}/trips/arrival={i}", f"{came}/arrival={i}")
        query = jobs.upsert_slots(jobs.slot_stream(read_table(spark, came, streaming=True, schema=dealt.schema)), gold, f"{folder}/state")
        query.awaitTermination()
        met = jobs.watermark_of(query)
        marks.append(F.lit(met).cast("timestamp") if met else marks[-1])
    trips = spark.read.schema(dealt.schema).parquet(came if parts else f"{folder}/trips")
    requests = lambda: cleaning.restrict(spark.read.parquet(gold)).select("zone_id", "window_end", "requests_60m")
    before = written(requests().withColumnRenamed("requests_60m", "before"))
    times = F.explode(F.array("request_datetime", "pickup_datetime", "dropoff_datetime"))
    jobs.repair_days(trips, gold, jobs.late_days(trips.select(times.alias("ts"), mark.alias("watermark")), "watermark"))
    slots = requests().join(before, ["zone_id", "window_end"], "left").withColumn("before", F.coalesce("before", F.lit(0)))
    days = slots.groupBy(F.to_date("window_end").alias("day")).agg(F.sum("before").alias("requests_before"), F.sum("requests_60m").alias("requests_after"), F.count_if(F.col("before") != F.col("requests_60m")).alias("mended"))
    return days.where("requests_after > 0")


def stream_static_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of pickups, in parts by time, joined, batch by batch, with those days of a table of requests that the batch needs."""
    folder = work_folder(spark)
    trips = _instants(fixtures.trips(spark, sf_dir))
    requests = lifecycle.dedup(cleaning.valid_requests(trips).select("trip_id", "request_datetime", "PULocationID", "DOLocationID"), ["trip_id"], "request_datetime")
    append(cleaning.with_event_day(requests, "request_datetime"), f"{folder}/requests", DAY)
    # No more parts than days: each part reads the whole days that it touches.
    _in_parts(trips.select("trip_id", "request_datetime", "pickup_datetime", "PULocationID"), folder,
              lambda part: jobs.static_enrich(_side(part, cleaning.valid_pickups, "pickup_datetime", "PULocationID"), f"{folder}/requests", f"{folder}/out", f"{folder}/state", trigger="0 seconds"), most=14)
    return _instants(spark.read.parquet(f"{folder}/out").select("trip_id", "request_datetime", "pickup_datetime"), "timestamp_ntz")


def stream_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages taken some files a batch to a table per kind; the last batch runs twice under its id, as after a crash, and adds nothing."""
    folder = work_folder(spark)
    files, a_batch = _files(spark, sf_dir, 3, 6, rows=250_000)
    # A batch is held, in memory or on disk, while its kinds are written: it is bounded by what keeps all cores busy, not a third of all messages.
    a_batch = min(a_batch, max(6, 2 * spark.sparkContext.defaultParallelism))
    encode_events(fixtures.trips(spark, sf_dir).repartition(files)).select(F.col("value").alias("json_str")).write.option("compression", "zstd").parquet(f"{folder}/raw")
    tables = {kind: f"{folder}/{kind}" for kind in ("request", "pickup", "dropoff")}
    take = lambda: jobs.ingest(read_table(spark, f"{folder}/raw", streaming=True, max_files=a_batch), tables, f"{folder}/state").awaitTermination()
    take()
    jobs.repeat_last_batch(spark, f"{folder}/state")
    take()
    counts = [spark.read.parquet(path).groupBy(F.lit(kind).alias("kind"), *DAY).agg(F.count("*").alias("n")) for kind, path in tables.items()]
    return cleaning.union_all(counts)


def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows read and rows of state of a running query, by the reports that its listener has written."""
    folder = work_folder(spark)
    slots = jobs.slot_stream(cleaning.clean_trips(_trip_stream(spark, sf_dir)), delay="30 days")
    with progress.listening(spark, f"{folder}/reports") as listener:
        query = slots.writeStream.queryName("progress").format("noop").outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        listener.wait(query)
    reports = progress.summary(progress.read(spark, f"{folder}/reports")).where(F.col("runId") == str(query.runId))
    return reports.groupBy("name").agg(F.sum("input_rows").alias("input_rows"), F.max_by("state_rows", "batchId").alias("state_rows"))


_LATE_SQL = f"""WITH {batch.CLEAN}, a AS (SELECT *, CAST(floor(date_diff('second', TIMESTAMP '{fixtures.START}', dropoff_datetime) / {_SPAN}) AS BIGINT) + CASE WHEN {_LATE} THEN 1 ELSE 0 END AS arrival FROM clean),
marks AS (SELECT p.arrival, max(a.dropoff_datetime) - INTERVAL '5 minutes' AS mark FROM (SELECT DISTINCT arrival FROM a) p LEFT JOIN a ON a.arrival < p.arrival GROUP BY 1),
pairs AS (SELECT PULocationID AS zone_id, arrival, {batch._slots('request_datetime')} FROM a),
slots AS (SELECT zone_id, window_end, count(*) AS n, count(*) FILTER (WHERE mark IS NULL OR window_end > mark) AS before FROM pairs JOIN marks USING (arrival) GROUP BY ALL)
SELECT CAST(window_end AS DATE) AS day, CAST(sum(before) AS BIGINT) AS requests_before, CAST(sum(n) AS BIGINT) AS requests_after, count(*) FILTER (WHERE before <> n) AS mended FROM slots GROUP BY 1"""

_STATE_SQL = f"""WITH {batch.CLEAN}, facts AS (SELECT PULocationID AS zone, request_datetime AS t FROM clean UNION ALL SELECT PULocationID, pickup_datetime FROM clean UNION ALL SELECT DOLocationID, dropoff_datetime FROM clean UNION ALL SELECT PULocationID, dropoff_datetime FROM clean WHERE {cleaning.VALID_STATS}),
state AS (SELECT DISTINCT zone, {batch._slots('t')} FROM facts)
SELECT 'progress' AS name, (SELECT count(*) FROM lineitem) AS input_rows, (SELECT count(*) FROM state) AS state_rows"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (stream_slot_metrics, stream_response_join, stream_complete_join, stream_restarted_slots, stream_late_repair, stream_static_enrich, stream_fan_out, stream_progress)
}
ORACLE_SQL: dict[str, str] = {
    "stream_slot_metrics": batch.ORACLE_SQL["slot_metrics_all"], "stream_response_join": batch.ORACLE_SQL["response_join"], "stream_complete_join": batch.ORACLE_SQL["complete_join"],
    "stream_restarted_slots": batch.ORACLE_SQL["slot_metrics_all"], "stream_late_repair": _LATE_SQL, "stream_static_enrich": batch.ORACLE_SQL["response_join"],
    "stream_fan_out": batch.ORACLE_SQL["event_route"], "stream_progress": _STATE_SQL,
}
