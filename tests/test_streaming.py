"""Streams give what batches give, with duplicates, late rows and windows that span batches."""

import os

from pyspark.sql import functions as F

from tripflow.operators.cleaning import clean_trips, route
from tripflow.operators.lifecycle import completed, dedup, responses
from tripflow.operators.slots import slot_metrics, trip_facts
from tripflow.plans import fixtures
from tripflow.sources.readers import parse_events, read_events
from tripflow.sources.sinks import encode_events, fan_out, upsert, write_events
from tripflow.streaming import jobs, progress

SF = "/root/testdata/sf0.001"


def messages(spark, tmp_path, files=4):
    """Trip events in files by event time, a tenth of them repeated in the next file."""
    trips = fixtures.trips(spark, SF).where("PULocationID <= 60")
    e = encode_events(trips).withColumn("t", F.get_json_object("value", "$.event_time"))
    bounds = e.selectExpr(f"percentile_approx(unix_timestamp(to_timestamp(t)), array({', '.join(str(i / files) for i in range(1, files))}))").first()[0]
    part = sum([(F.unix_timestamp(F.to_timestamp("t")) > b).cast("int") for b in bounds], F.lit(0))
    e = e.withColumn("part", part).cache()
    folder = str(tmp_path / "events")
    for i in range(files):
        again = e.where((F.col("part") == i - 1) & (F.abs(F.xxhash64("value")) % 10 == 0))
        write_events(e.where(F.col("part") == i).unionAll(again).coalesce(1), folder)
    return trips, folder


def keyed(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()))


def test_lifecycle_stream_is_batch(spark, tmp_path):
    _, folder = messages(spark, tmp_path)
    far = '{{"event_type":"{0}","event_time":"2026-01-01T00:00:00+00:00","trip_id":"far-{0}","{0}_datetime":"2026-01-01T00:00:00+00:00","PULocationID":1,"DOLocationID":1,"trip_miles":1.0,"trip_time":60}}'
    spark.createDataFrame([(far.format(k),) for k in ("request", "pickup", "dropoff")], "value string").coalesce(1).write.mode("append").text(folder)
    os.makedirs(tmp_path / "out")

    def run(name, build):
        events = parse_events(read_events(spark, folder, streaming=True, max_per_trigger=1))
        q = build(events).writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / f"c_{name}")).option("path", str(tmp_path / "out" / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.parquet(str(tmp_path / "out" / name))

    wide = "30 days"  # files are not in order of event time within a trigger's choice
    got = run("response", lambda e: jobs.response_stream(jobs.request_stream(e, wide), jobs.pickup_stream(e, wide)))
    batch = parse_events(read_events(spark, folder))
    one = lambda kind, ts: dedup(route(batch, kind).drop("year", "month", "day"), ["trip_id"], ts)
    want = responses(one("request", "request_datetime").where("DOLocationID <= 263"), one("pickup", "pickup_datetime"))
    assert keyed(got.where("trip_id NOT LIKE 'far%'"), "trip_id", "request_datetime", "pickup_datetime") == keyed(want.where("trip_id NOT LIKE 'far%'"), "trip_id", "request_datetime", "pickup_datetime")
    full = completed(want, one("dropoff", "dropoff_datetime"))
    assert full.count() <= want.count() and "DOLocationID" in full.columns


def test_slots_upsert_across_batches(spark, tmp_path):
    """A slot whose rows come in several batches keeps them all."""
    trips = clean_trips(fixtures.trips(spark, SF).where("PULocationID <= 20"))
    as_instants = trips.select(*[F.col(c).cast("timestamp").alias(c) if c.endswith("_datetime") else F.col(c) for c in trips.columns])
    folder = str(tmp_path / "trips")
    for i in range(3):
        as_instants.where(F.abs(F.xxhash64("trip_id")) % 3 == i).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(as_instants.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    table = str(tmp_path / "gold")
    q = jobs.upsert_slots(jobs.slot_stream(stream, delay="60 days"), table, str(tmp_path / "c"))
    q.awaitTermination()
    want = slot_metrics(trip_facts(as_instants))
    cols = ("zone_id", "window_end", "requests_60m", "pickup_60m", "matched_rp", "dropoff_60m")
    assert keyed(spark.read.parquet(table), *cols) == keyed(want, *cols)
    day = spark.sql("SELECT DATE'2025-01-10' AS date")
    jobs.repair_days(as_instants.limit(0), table, day)  # nothing to say: the table stays
    assert spark.read.parquet(table).count() == want.count()


def test_fan_out_is_idempotent(spark, tmp_path):
    _, folder = messages(spark, tmp_path, 2)
    tables = {k: str(tmp_path / k) for k in ("request", "pickup", "dropoff")}
    q = jobs.ingest(read_events(spark, folder, streaming=True, max_per_trigger=1), tables, str(tmp_path / "c"))
    q.awaitTermination()
    n = {k: spark.read.parquet(p).count() for k, p in tables.items()}
    batch = parse_events(read_events(spark, folder))
    assert n == {k: batch.where(F.col("event_type") == k).count() for k in tables}
    again = parse_events(spark.read.text(folder + "/*").select(F.col("value").alias("json_str"))).limit(5)
    for _ in range(2):
        fan_out(again, 77, tables)
    assert sum(spark.read.parquet(p).where("batch_id = 77").count() for p in tables.values()) == 5


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *x: spark.createDataFrame(list(x), "zone_id int, window_end string, n int").withColumn("window_end", F.to_timestamp("window_end"))
    upsert(rows((1, "2025-01-01 10:00:00", 1), (2, "2025-01-02 10:00:00", 2)), path)
    change = rows((1, "2025-01-01 10:00:00", 5), (3, "2025-01-01 11:00:00", 3))
    upsert(change, path)
    upsert(change, path)
    assert sorted((r.zone_id, r.n) for r in spark.read.parquet(path).collect()) == [(1, 5), (2, 2), (3, 3)]


def test_progress(spark):
    report = {"name": "q", "id": "i", "runId": "r", "batchId": 3, "timestamp": "2025-01-01T00:00:10.000Z", "numInputRows": 7, "durationMs": {"triggerExecution": 12, "add Batch!": 5}, "stateOperators": [{"numRowsTotal": 4}, {"numRowsTotal": 6}]}
    rows = progress.progress_rows(spark, [report, {"name": "z", "timestamp": "bad"}])
    one, two = sorted(progress.summary(rows).collect(), key=lambda r: r["name"])
    assert (one.input_rows, one.trigger_ms, one.state_rows, one.epoch_s) == (7, 12, 10, 1735689610)
    assert (two.input_rows, two.epoch_s, two.state_rows) == (0, 0, 0)
    assert {r.operation for r in progress.operation_ms(rows).collect()} == {"triggerExecution", "add_Batch_"}
