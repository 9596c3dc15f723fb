"""What plans read, what streams keep, and tables that grow: the parts that results alone don't show."""

import datetime as dt
import os
import re
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tripflow.operators import cleaning, history
from tripflow.operators.slots import GROUPS, metric_columns, panes, slot_metrics, trip_facts, windows
from tripflow.plans import fixtures
from tripflow.plans import queries as base
from tripflow.plans import tables
from tripflow.sources import readers, sinks
from tripflow.streaming import jobs, progress
from tripflow.streaming.queries import _instants

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def files_read(df):
    """(files, rows) that the file scans of a collected frame have read."""
    found = {"numFiles": 0, "numOutputRows": 0}

    def walk(node):
        if node.metrics().contains("numFiles"):
            for k in found:
                found[k] += node.metrics().apply(k).value()
        if "AdaptiveSparkPlan" in node.nodeName():
            walk(node.executedPlan())
        if node.nodeName().endswith("QueryStage"):
            walk(node.plan())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    df.collect()
    walk(df._jdf.queryExecution().executedPlan())
    return found["numFiles"], found["numOutputRows"]


@pytest.fixture(scope="module")
def gold_path(spark):
    return tables._slot_table(spark, SF, "requests_60m")


# Panes.

def test_panes_are_windows(spark):
    """Panes against sliding windows over the facts themselves, with nulls, equal delays and facts of one kind only."""
    trips = fixtures.trips(spark, SF).where("PULocationID <= 40")
    trips = trips.withColumn("tips", F.when(F.col("trip_miles") < 5, None).otherwise(F.col("tips"))).withColumn("pickup_datetime", F.expr("CASE WHEN PULocationID < 9 THEN request_datetime + INTERVAL 7 SECONDS ELSE pickup_datetime END"))
    facts = trip_facts(trips)
    groups = ("request", "pickup", "pickup_recent", "dropoff", "dropoff_recent", "stats")
    for window, slide, n, by in (("60 minutes", "15 minutes", 4, ("zone_id",)), ("120 minutes", "30 minutes", 4, ()), ("30 minutes", "5 minutes", 6, ("zone_id",)), ("1 hour", "1 hour", 1, ())):
        direct = facts.withColumn("window", F.window("ts", window, slide)).groupBy(*by, "window").agg(*[c for g in groups for c in metric_columns(slide)[g]])
        direct = direct.select(*by, F.col("window.end").alias("window_end"), *[c for c in direct.columns if c not in (*by, "window")])
        made = slot_metrics(facts, window, slide, groups, by)
        assert made.columns == direct.columns and [t for _, t in made.dtypes] == [t for _, t in direct.dtypes]
        wide = windows(panes(facts, slide, n + 2, groups, by), slide, n, groups, by)
        want = sorted(map(tuple, direct.collect()))
        for other in (made, wide):
            got = sorted(map(tuple, other.collect()))
            assert len(got) == len(want)
            for x, y in zip(got, want, strict=True):
                assert x[: len(by) + 1] == y[: len(by) + 1]
                assert [v is None for v in x] == [v is None for v in y]
                assert [v for v in x[len(by) + 1 :] if v is not None] == pytest.approx([v for v in y[len(by) + 1 :] if v is not None], rel=1e-9, abs=1e-9)
    uneven = slot_metrics(facts, "50 minutes", "15 minutes", ("request",))
    assert "window" in plan(uneven) and uneven.agg(F.sum("requests_60m")).first()[0] > 3 * trips.count()


def test_four_rows_a_trip_before_the_first_shuffle(spark):
    trips = cleaning.clean_trips(fixtures.trips(spark, SF))
    text = plan(slot_metrics(trip_facts(trips)))
    assert "Expand" not in text and text.count("Generate explode") == 2
    below = text[text.rindex("Exchange hashpartitioning"):]
    assert below.count("Generate explode") == 1  # the facts; windows are made of panes, above it
    assert trip_facts(trips).count() <= 4 * trips.count()


# Reads that are pruned.

def test_latest_slot_from_footers(spark, gold_path, tmp_path):
    found = readers.latest_slot(spark, gold_path)
    assert re.search(r"PushedAggregation: \[MAX\(slot_s\)\]", plan(found))
    scanned = spark.read.parquet(gold_path).agg(F.max("window_end")).first()[0]
    assert found.first()[0] == scanned
    assert "parquet" in spark.conf.get("spark.sql.sources.useV1SourceList")
    spark.read.parquet(gold_path).drop("slot_s").write.parquet(str(tmp_path / "plain"))
    assert readers.latest_slot(spark, str(tmp_path / "plain")).first()[0] == scanned


def test_snapshots_read_three_days(spark, gold_path):
    gold = readers.read_table(spark, gold_path)
    latest = readers.latest_slot(spark, gold_path)
    found = history.snapshots(gold, latest=latest).select("zone_id", "window_end", "step", "requests_60m")
    files, rows = files_read(found)
    day = spark.read.parquet(gold_path)
    last = latest.first()[0]
    days = {(last - dt.timedelta(minutes=15 * s)).date() for s in (0, 92, 668)}
    assert "dynamicpruning" in plan(found) and len(days) == 3
    assert rows <= day.where(F.col("slot_day").isin(*days)).count() < day.count() / 2
    assert files < len(day.inputFiles()) / 3
    targets = spark.createDataFrame([(last,), (last - dt.timedelta(days=2),)], "window_end timestamp_ntz")
    two = history.rows_at(gold, targets, ["zone_id", "window_end"])
    assert files_read(two)[1] <= day.where(F.col("slot_day").isin(last.date(), (last - dt.timedelta(days=2)).date())).count()
    assert {r[1] for r in two.collect()} == {last, last - dt.timedelta(days=2)}


def test_enrich_reads_the_batch_days(spark, tmp_path):
    trips = _instants(fixtures.trips(spark, SF))
    requests = cleaning.with_event_day(cleaning.valid_requests(trips).select("trip_id", "request_datetime", "PULocationID", "DOLocationID"), "request_datetime")
    sinks.append(requests.repartition(*sinks.DAY), str(tmp_path / "r"), sinks.DAY)
    batch = cleaning.valid_pickups(trips).select("trip_id", "pickup_datetime", "PULocationID").where("to_date(pickup_datetime) = DATE'2025-01-10'")
    found = jobs.enriched(batch, str(tmp_path / "r"))
    stored = spark.read.parquet(str(tmp_path / "r"))
    assert "PartitionFilters: [isnotnull" in plan(found)
    files, _ = files_read(found.select("trip_id"))  # a file a day; the batch's days are the ninth and tenth
    assert files <= 3 < len(stored.inputFiles())
    assert found.count() > 0 and jobs.enriched(batch.where("false"), str(tmp_path / "r")) is None


# Tables that grow.

def test_appends_with_other_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.append_merged(spark.sql("SELECT 1L AS a, 'x' AS b"), path)
    sinks.append_merged(spark.sql("SELECT '2' AS A, 5 AS c"), path)
    sinks.append_merged(spark.sql("SELECT 7S AS c"), path)
    got = readers.read_table(spark, path, merge=True)
    assert dict(got.dtypes) == {"a": "bigint", "b": "string", "c": "int"}
    assert sorted(map(tuple, got.select("a", "b", "c").collect()), key=repr) == sorted([(1, "x", None), (2, None, 5), (None, None, 7)], key=repr)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        sinks.append_merged(spark.sql("SELECT 'two' AS a"), path)


def test_upsert_mends_a_broken_half(spark, tmp_path):
    """An upsert that ended between two days is run again."""
    path = str(tmp_path / "u")
    at = lambda d: dt.datetime(2025, 1, d, 8)
    schema = "zone_id int, window_end timestamp_ntz, v int"
    sinks.upsert(spark.createDataFrame([(1, at(1), 1), (1, at(2), 1), (2, at(2), 1)], schema), path)
    new = spark.createDataFrame([(1, at(1), 9), (1, at(2), 9)], schema)
    sinks.upsert(new.where("window_end < TIMESTAMP_NTZ'2025-01-02 00:00:00'"), path)  # the day that had been replaced
    os.makedirs(f"{path}_staged_left")
    for _ in range(2):
        sinks.upsert(new, path)
        assert sorted((r.zone_id, r.window_end.day, r.v) for r in spark.read.parquet(path).collect()) == [(1, 1, 9), (1, 2, 9), (2, 2, 1)]


def test_jdbc_upsert(spark):
    jdbc = {**tables._database(spark), "dbtable": "small_upsert"}
    sinks.execute(spark, jdbc, ['CREATE TABLE small_upsert ("zone_id" INTEGER NOT NULL, "window_end" TIMESTAMP NOT NULL, "v" INTEGER, "w" VARCHAR(9), PRIMARY KEY ("zone_id", "window_end"))'])
    rows = lambda *r: spark.createDataFrame([(z, dt.datetime(2025, 1, 1), v, f"w{v}") for z, v in r], "zone_id int, window_end timestamp_ntz, v int, w string")
    sinks.upsert_jdbc(rows((1, 1), (2, 2), (2, 3)), jdbc)
    sinks.upsert_jdbc(rows((2, None), (3, 4)), jdbc)
    read = readers.read_predictions(spark, jdbc=jdbc, n_partitions=3)
    assert read.rdd.getNumPartitions() == 3
    assert sorted((r.zone_id, r.v, r.w) for r in read.collect()) == [(1, 1, "w1"), (2, None, "wNone"), (3, 4, "w4")]
    with pytest.raises(Exception):
        sinks.execute(spark, jdbc, ["DELETE FROM small_upsert", "NO SUCH STATEMENT"])
    assert read.count() == 3  # the failed transaction left nothing
    sinks.execute(spark, jdbc, ["DROP TABLE small_upsert"])


# Streams.

def test_state_in_rocksdb_survives_a_restart(spark, tmp_path):
    path = str(tmp_path / "trips")
    _instants(cleaning.clean_trips(fixtures.trips(spark, SF)).where("PULocationID <= 30")).repartition(2).write.parquet(path)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with jobs.state_settings(spark, partitions=3):
        slots = lambda: jobs.slot_stream(readers.read_table(spark, path, streaming=True, max_files=1), delay="30 days")
        first = jobs.upsert_slots(slots(), str(tmp_path / "gold"), str(tmp_path / "state"), trigger="1 hour")
        jobs.stop_after(first, 1)
        half = spark.read.parquet(str(tmp_path / "gold")).agg(F.sum("requests_60m")).first()[0]
        second = jobs.upsert_slots(slots(), str(tmp_path / "gold"), str(tmp_path / "state"))
        second.awaitTermination()
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    report = next(p for p in second.recentProgress if p["numInputRows"])
    state = report["stateOperators"][0]
    assert report["batchId"] == 1 and state["numShufflePartitions"] == 3
    assert any(k.startswith("rocksdb") for k in state["customMetrics"])
    whole = slot_metrics(trip_facts(spark.read.parquet(path)))
    got = spark.read.parquet(str(tmp_path / "gold"))
    assert half < got.agg(F.sum("requests_60m")).first()[0] == whole.agg(F.sum("requests_60m")).first()[0]
    assert got.count() == whole.count()


def test_repeated_batch_adds_nothing(spark, tmp_path):
    raw, tables_ = str(tmp_path / "raw"), {k: str(tmp_path / k) for k in ("request", "pickup")}
    sinks.encode_events(fixtures.trips(spark, SF).limit(300)).select(F.col("value").alias("json_str")).repartition(3).write.parquet(raw)
    take = lambda: jobs.ingest(readers.read_table(spark, raw, streaming=True, max_files=1), tables_, str(tmp_path / "state"))
    first = take()
    first.awaitTermination()
    assert len([p for p in first.recentProgress if p["numInputRows"]]) == 3
    jobs.repeat_last_batch(spark, str(tmp_path / "state"))
    again = take()
    again.awaitTermination()
    assert again.recentProgress[0]["batchId"] == 2 and again.recentProgress[0]["numInputRows"] > 0
    assert [spark.read.parquet(p).count() for p in tables_.values()] == [300, 300]


def test_reports_of_a_running_query(spark, tmp_path):
    spark.range(50).write.parquet(str(tmp_path / "n"))
    with progress.listening(spark, str(tmp_path / "p")) as listener:
        query = spark.readStream.schema("id long").parquet(str(tmp_path / "n")).groupBy(F.col("id") % 7).count().writeStream.queryName("seven").format("noop").outputMode("update").option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
        query.awaitTermination()
        listener.wait(query)
    assert not listener.active
    rows = progress.summary(progress.read(spark, str(tmp_path / "p"))).where("name = 'seven'").orderBy("batchId").collect()
    assert sum(r.input_rows for r in rows) == 50 and rows[-1].state_rows == 7 and all(r.epoch_s > 1.7e9 for r in rows)
    assert progress.operation_ms(progress.read(spark, str(tmp_path / "p"))).count() > 3


def test_repair_reads_only_its_days(spark, tmp_path):
    trips = cleaning.clean_trips(fixtures.trips(spark, SF))
    days = spark.sql("SELECT DATE'2025-01-09' AS date UNION ALL SELECT DATE'2025-01-09'")
    jobs.repair_days(trips, str(tmp_path / "g"), days)
    want = slot_metrics(trip_facts(trips)).where("to_date(window_end) = DATE'2025-01-09'")
    key = lambda df: sorted((r.zone_id, r.window_end, r.requests_60m, r.dropoff_60m, r.matched_rp) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "g"))) == key(want)


# The rest of the library without the training-data folders.

def test_the_rest_runs_without_the_folders(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "tripflow"), tmp_path / "tripflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(os.path.join(root, "tests"), tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "bench.py"):  # the pipeline stays and can't be imported
        shutil.copy(os.path.join(root, name), tmp_path)
    run = lambda *a: subprocess.run([sys.executable, *a], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    names = run("-c", "import __spark_entry__ as e; print(*e.queries()); e.oracle_sql()")
    assert names.returncode == 0 and "slot_metrics_all" in names.stdout and "op1_" not in names.stdout and "pipeline" not in names.stdout.split()
    tests = run("-m", "pytest", "-q", "-x", "tests/test_operators.py", "tests/test_entry.py")
    assert tests.returncode == 0, tests.stdout[-2000:]
