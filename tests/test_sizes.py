"""What must hold however large the tables are, on small ones cut as large ones are."""

import datetime as dt
import glob
import gzip

import duckdb
import pytest
from pyspark.sql import functions as F

from tripflow.operators import cleaning, history
from tripflow.operators.slots import slot_metrics, trip_facts
from tripflow.plans import fixtures
from tripflow.plans import queries as batch
from tripflow.sources import readers, sinks
from tripflow.streaming import jobs
from tripflow.streaming import queries as streams

SF = "/root/testdata/sf0.001"


def same(got, want):
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect())) != []


def test_message_files_are_compressed_and_bounded(spark, tmp_path):
    """F1."""
    messages = sinks.encode_events(fixtures.trips(spark, SF)).coalesce(1)
    sinks.write_events(messages, str(tmp_path / "events"), {"maxRecordsPerFile": "5000"})
    files = glob.glob(str(tmp_path / "events" / "part-*"))
    assert len(files) > 1 and all(f.endswith(".gz") and len(gzip.open(f).readlines()) <= 5000 for f in files)
    got = readers.read_events(spark, str(tmp_path / "events")).select(F.col("json_str").alias("value"))
    same(got, messages)


@pytest.mark.parametrize(("build", "want"), [(streams._complete_of, "complete_join"), (lambda t: streams._response_of(t).select("trip_id", "request_datetime", "pickup_datetime"), "response_join")])
def test_joined_streams_hold_a_part(spark, tmp_path, build, want):
    """no row is lost between parts, and state doesn't keep what earlier parts brought."""
    got, query = streams._joined(spark, SF, str(tmp_path), build, rows=3100)
    same(got, batch.QUERIES[want](spark, SF))
    held = max(s["numRowsTotal"] for s in query.lastProgress["stateOperators"])
    assert held < fixtures.trips(spark, SF).count() / 8


def test_joined_streams_keep_their_state_loaded(spark, tmp_path):
    """F1, F4 of round 4: one query takes all parts, each by one batch of rows; a start for each would load state anew. Parts aren't copied, state's partitions don't follow the session's."""
    runs = []

    def build(trips):
        runs.append(trips)
        return streams._response_of(trips).select("trip_id", "request_datetime", "pickup_datetime")

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got, query = streams._joined(spark, SF, str(tmp_path), build, streams._RESPONDED, rows=1500)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "7"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    same(got, batch.QUERIES["response_join"](spark, SF))
    taken = {p["batchId"]: p["numInputRows"] for p in query.recentProgress if p["numInputRows"]}
    assert len(runs) == 1 and len(taken) == 1 + fixtures.trips(spark, SF).count() // 1500 > 3
    assert not glob.glob(str(tmp_path / "parts" / "*" / "*.parquet"))
    assert query.lastProgress["stateOperators"][0]["numShufflePartitions"] == spark.sparkContext.defaultParallelism


def test_parts_take_all_trips(spark, tmp_path):
    """No trip at all, or one without a time of request, which is in the first part."""
    kept = lambda i, part: part.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / f"{i}" / "state")).option("path", str(tmp_path / f"{i}" / "out")).format("parquet").start()
    trips = spark.range(10).select(F.col("id").cast("string").alias("trip_id"), F.when(F.col("id") > 0, F.timestamp_seconds(F.col("id") * 9000)).alias("request_datetime"))
    for i, n in enumerate((0, 1, 10)):
        streams._in_parts(trips.where(F.col("trip_id") < n), str(tmp_path / f"{i}"), lambda part, i=i: kept(i, part), rows=3)
        assert spark.read.schema(trips.schema).parquet(str(tmp_path / f"{i}" / "out")).count() == n


def test_fan_out_bounds_its_batches_and_files(spark, tmp_path, monkeypatch):
    """F5 of round 4: a batch, which is held while its kinds are written, isn't a third of all messages but what keeps the cores busy; files are packed closely."""
    monkeypatch.setattr(streams, "work_folder", lambda spark: str(tmp_path))
    monkeypatch.setattr(streams, "_files", lambda *a, **b: (12, 12))
    got = streams.stream_fan_out(spark, SF)
    same(got, batch.QUERIES["event_route"](spark, SF))
    at_once = max(6, 2 * spark.sparkContext.defaultParallelism)
    assert len(glob.glob(str(tmp_path / "state" / "commits" / "[0-9]*"))) == -(-12 // at_once) > 1
    files = [f for kind in ("raw", "request", "pickup", "dropoff") for f in glob.glob(str(tmp_path / kind / "**" / "*.parquet"), recursive=True)]
    assert files and all(f.endswith(".zstd.parquet") for f in files)


def test_exact_cuts_of_groups(spark):
    """discrete cuts of groups larger than the sketch is exact for, small ones, a null one and none."""
    rows = spark.range(60_000).select(F.when(F.col("id") < 45_000, 1).when(F.col("id") < 59_000, 2).when(F.col("id") < 59_900, 3).alias("g"), ((F.col("id") * 7919) % 60_013 % 20_011 / 8).alias("x"))
    rows = rows.union(spark.createDataFrame([(4, None)], "g int, x double"))
    for by, frame in (["g"], rows), ([], rows):
        found = history.exact_cuts(frame, "x", [0.0, 0.5, 0.95], by=by, discrete=True, few=1000)
        values = {}
        for r in frame.where("x IS NOT NULL").collect():
            values.setdefault(r.g if by else "all", []).append(r.x)
        want = {g: [sorted(v)[max(-(-len(v) * p // 100), 1) - 1] for p in (0, 50, 95)] for g, v in values.items()}
        assert {(r.g if by else "all"): r._cuts for r in found.collect()} == want


def test_routes_are_counted_in_one_pass(spark):
    """messages are made and parsed once for all kinds; F13: only the fields asked for are parsed."""
    plan = batch.QUERIES["event_route"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
    plan = batch.QUERIES["event_parse"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "trip_miles" not in plan.split("from_json(")[1][:400]
    assert batch._fields("trip_id", "event_time") == "event_time string, trip_id string"


def test_files_grow_in_number_not_in_size(spark):
    """F8, F9."""
    assert streams._files(spark, SF, 3, 6) == (6, 2)
    n, a_batch = streams._files(spark, SF, 3, 6, rows=100)
    assert n * 100 >= fixtures.trips(spark, SF).count() > (n - 1) * 100 and 2 * a_batch < n <= 3 * a_batch


def test_repair_keeps_all_facts_of_long_windows(spark, tmp_path):
    """facts are chosen by ranges of times, without a join of each with the days; windows of more than a day lose none."""
    trips, path = cleaning.clean_trips(fixtures.trips(spark, SF)), str(tmp_path / "g")
    days = spark.sql("SELECT explode(array(DATE'2025-01-09', DATE'2025-01-10', DATE'2025-01-15', NULL)) AS date")
    want = slot_metrics(trip_facts(trips), "72 hours", "24 hours").where("to_date(window_end) IN (DATE'2025-01-09', DATE'2025-01-10', DATE'2025-01-15')").select("zone_id", "window_end", "requests_60m", "dropoff_60m", "matched_rp")
    for some in (days, days.where("date IS NULL")):  # a repair of no day leaves the table as it is
        jobs.repair_days(trips, path, some, "72 hours", "24 hours")
        same(spark.read.parquet(path).select(*want.columns), want)
    near = jobs.near_days(trip_facts(trips), {dt.date(2025, 1, 9)})
    assert "Join" not in near._jdf.queryExecution().optimizedPlan().toString()


def test_late_repair_writes_each_trip_once(spark, tmp_path, monkeypatch):
    """parts come by moving their files, so there is one copy of the trips; the result is that of the SQL."""
    monkeypatch.setattr(streams, "work_folder", lambda spark: str(tmp_path / "f"))
    got = sorted(map(tuple, streams.stream_late_repair(spark, SF).select("day", "requests_before", "requests_after", "mended").collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{SF}/lineitem.parquet')")
    assert got == sorted(con.execute(f"SELECT day, requests_before, requests_after, mended FROM ({streams.ORACLE_SQL['stream_late_repair']})").fetchall()) != []
    assert not glob.glob(str(tmp_path / "f" / "trips" / "*" / "*.parquet"))
    assert spark.read.parquet(str(tmp_path / "f" / "arrived")).count() == cleaning.clean_trips(fixtures.trips(spark, SF)).count()
