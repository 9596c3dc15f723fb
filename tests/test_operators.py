"""Formula vectors, sources, sinks and models."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tripflow.functions import calendar, clean, labels
from tripflow.operators import cleaning, grid, history, marts, model, quality
from tripflow.plans import fixtures
from tripflow.schemas import FEATURES_WITHOUT_WEATHER
from tripflow.sources import readers, sinks, weather

SF = "/root/testdata/sf0.001"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_holidays_by_rule():
    days = calendar.federal_holidays(range(2024, 2026))
    assert [str(d) for d in days][11:] == ["2025-01-01", "2025-01-20", "2025-02-17", "2025-05-26", "2025-06-19", "2025-07-04", "2025-09-01", "2025-10-13", "2025-11-11", "2025-11-27", "2025-12-25"]
    assert dt.date(2026, 7, 3) in calendar.federal_holidays(range(2026, 2027), observed=True)


def test_cleaning_functions(spark):
    r = one(spark, clean.clean_int(F.lit(" 3.7 ")), clean.clean_int(F.lit("x")), clean.clean_string(F.lit(" NaN ")), clean.clean_double(F.lit("none")), clean.clean_timestamp(F.lit("2025-01-01T05:00:00+02:00")), clean.clean_timestamp(F.lit("soon")), clean.metric_name(F.lit("a b/c")))
    assert tuple(r)[:4] == (3, None, None, None) and r[4] == dt.datetime(2025, 1, 1, 3) and r[5] is None and r[6] == "a_b_c"


def test_imbalance_and_classes(spark):
    value = lambda d, q, a: labels.imbalance(F.lit(d).cast("double"), F.lit(q).cast("long"), F.lit(a))
    r = one(spark, value(32.0, 3, 2.0), value(-5.0, 3, 2.0), value(None, 3, 2.0), value(5.0, None, 2.0))
    assert abs(r[0] - 32**1.2 * 1.5) < 1e-9 and tuple(r)[1:] == (0.0, 0.0, 0.0)
    cuts = [1.0, 2.0, 3.0, 4.0, 5.0]
    r = one(spark, *[labels.six_class(F.lit(x), cuts, c) for c in ("right", "left") for x in (0.5, 1.0, 3.5, 5.0, 9.0)])
    assert list(r) == [0, 0, 3, 4, 5, 0, 1, 3, 5, 5]
    best, p = labels.argmax(F.array(*[F.lit(x) for x in (0.2, 0.4, 0.4)]))
    assert tuple(one(spark, best, p)) == (1, 0.4)


def test_lags_by_row_and_time_agree_on_a_full_grid(spark):
    gold = spark.sql("SELECT CAST(z.id AS INT) AS zone_id, TIMESTAMP_NTZ'2025-01-01 00:00:00' + make_dt_interval(0, 0, 15 * CAST(s.id AS INT)) AS window_end, z.id * s.id AS requests_60m FROM range(1, 4) z, range(100) s")
    by_row, by_time = history.row_lags(gold, ["requests_60m"], [3]), history.time_lags(gold, ["requests_60m"], [3])
    assert by_row.exceptAll(by_time.select(*by_row.columns)).count() == 0
    split = history.time_split(gold, 0.9)
    assert split.where("is_train").count() == 270
    assert split.where("is_train").agg(F.max("window_end")).first()[0] <= split.where("NOT is_train").agg(F.min("window_end")).first()[0]


def test_slots_to_score(spark):
    t = lambda s: spark.sql(s)
    gold = t("SELECT * FROM VALUES (1, TIMESTAMP'2025-01-01 10:00:00'), (2, TIMESTAMP'2025-01-01 10:00:00') AS g(zone_id, window_end)")
    done = t("SELECT * FROM VALUES (1, TIMESTAMP'2025-01-01 10:00:00', TIMESTAMP'2025-01-01 10:05:00') AS p(zone_id, window_end, predicted_at)")
    assert quality.slots_to_score(gold, done).first().reason == "same_slot_more_gold_zones"
    assert quality.slots_to_score(gold, done.limit(0)).first().reason == "new_slot"
    both = done.unionAll(done.withColumn("zone_id", F.lit(2)))
    assert quality.slots_to_score(gold, both).count() == 0
    now = t("SELECT TIMESTAMP'2025-01-01 11:00:00' AS now")
    assert quality.slots_to_score(gold, both, 600, now).first().reason == "same_slot_refresh"
    newer = both.withColumn("window_end", F.expr("window_end + INTERVAL 1 HOUR"))
    assert quality.slots_to_score(gold, newer, 600, now).count() == 0


def test_drifting_files(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    spark.sql("SELECT 1.0D AS PULocationID, 2 AS x").coalesce(1).write.parquet(a)
    spark.sql("SELECT 7 AS PULocationID").coalesce(1).write.parquet(b)
    groups = readers.schema_groups(spark, [a, b]).collect()
    assert len(groups) == 2 and all(g.n_files == 1 for g in groups)
    rows = readers.read_union_by_name(spark, [[a], [b]], {"PULocationID": "int"}).collect()
    assert sorted((r.PULocationID, r.x) for r in rows) == [(1, 2), (7, None)] if all(r.x is not None for r in rows) else {(r.PULocationID, r.x) for r in rows} == {(1, 2), (7, None)}
    missing = lambda: spark.read.parquet(str(tmp_path / "none"))
    assert readers.first_non_empty([missing, lambda: spark.read.parquet(b)]).count() == 1


def test_weather_sources(spark, tmp_path):
    path = str(tmp_path / "w")
    fixtures.weather(spark).where("zone_id = 1").limit(50).withColumnsRenamed({"zone_id": "LocationID", "window_end": "datetime"}).write.csv(path, header=True)
    read = weather.read_weather_csv(spark, path)
    assert weather.normalize_weather(read).count() == 50
    dirty = spark.sql("SELECT '264' AS LocationID, '2025-01-01 00:00:00' AS datetime, 'x' AS temperature_2m UNION ALL SELECT '3.0', '2025-01-01 00:00:00', '4.5'")
    r = weather.normalize_weather(dirty).collect()
    assert [(x.zone_id, x.temperature_2m, x.rain) for x in r] == [(3, 4.5, None)]
    slots = spark.sql("SELECT TIMESTAMP_NTZ'2025-01-20 23:45:00' AS window_end")
    assert weather.needed_days(slots).count() == 5


def test_table_scan_prunes_days(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.sql("SELECT id, TIMESTAMP'2025-01-01 00:00:00' + make_dt_interval(CAST(id AS INT)) AS ts FROM range(40)")
    sinks.append(cleaning.with_event_day(rows, "ts"), path, sinks.DAY)
    found = readers.read_table(spark, path, time_range=("ts", "2025-01-10 00:00:00", "2025-01-12 00:00:00"))
    assert found.count() == 3 and "PartitionFilters: [" in found._jdf.queryExecution().toString()
    limits = spark.sql("SELECT TIMESTAMP'2025-01-02 00:00:00' AS lo, TIMESTAMP'2025-01-03 00:00:00' AS hi")
    assert readers.within(spark.read.parquet(path), "ts", limits).count() == 2
    sinks.rewrite_zstd(rows, str(tmp_path / "z"))
    assert spark.read.parquet(str(tmp_path / "z")).count() == 40


def test_zone_features(spark, tmp_path):
    p = tmp_path / "zones.json"
    p.write_text('{"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"LocationID": 4, "zone": "x"}}, {"geometry": null, "properties": {}}]}')
    rows = readers.read_zone_features(spark, str(p)).where("zone_id IS NOT NULL")
    assert rows.first().zone_id == 4 and "coordinates" in rows.first().geometry
    none = spark.createDataFrame([], "zone_id int, predicted_class int, pred_confidence double, used_model string, model_version string, window_end timestamp")
    assert '"has_prediction":false' in marts.zone_map_rows(rows, none).first().document


def test_train_and_score(spark):
    rows = spark.range(600).selectExpr("CAST(id % 50 + 1 AS INT) AS zone_id", "TIMESTAMP_NTZ'2025-01-01 00:00:00' AS window_end", "CAST(id % 6 AS INT) AS label_6class", "CAST(id % 6 AS DOUBLE) AS requests_60m")
    matrix = cleaning.apply_contract(rows, keep=("window_end", "label_6class"))
    fitted = model.fit(model.with_class_weight(matrix), FEATURES_WITHOUT_WEATHER, trees=5, depth=5)
    scored = model.score(matrix, None, fitted, shadow=fitted, version_b="7")
    assert scored.count() == 600 and scored.where("used_model = 'model_b'").count() == 600
    best = scored.first()
    assert abs(sum(best[f"proba_{i}"] for i in range(6)) - 1) < 1e-5 and best.shadow_predicted_class is None
    assert model.importance(fitted).first().feature == "requests_60m"
    assert model.skipped(matrix).first().n_skipped == 600 and model.skipped(matrix, with_b=True).first().n_skipped == 0
    total = marts.class_distribution(scored).agg(F.sum("zones")).first()[0]
    assert total == 600


def test_neighbours_and_grid(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 1)], "zone_id int, neighbor_zone_id int")
    slots = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP_NTZ'2025-01-01 00:00:00', 5L, 10D), (2, TIMESTAMP_NTZ'2025-01-01 00:00:00', 7L, CAST(NULL AS DOUBLE)), (3, TIMESTAMP_NTZ'2025-01-01 00:00:00', 1L, 4D), (9, TIMESTAMP_NTZ'2025-01-01 00:15:00', 1L, 4D) AS s(zone_id, window_end, requests_60m, pickup_delay_mean)")
    got = {r.zone_id: (r.neighbor_requests_60m, r.neighbor_pickup_delay_mean, r.num_neighbors) for r in grid.neighbor_features(slots, edges).collect()}
    assert got == {1: (8, 4.0, 2), 2: (5, 10.0, 1), 3: (0, 0.0, 0), 9: (0, 0.0, 0)}
    assert grid.dense_grid(slots.select("zone_id").distinct(), cleaning.bounds(slots, "window_end")).count() == 8


def test_exact_cuts_are_percentiles(spark):
    """Whole and bounded ranking against Spark's own exact quantiles, with ties, few rows and no rows."""
    p = F.array(*[F.lit(x) for x in history.PROBS])
    skewed = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.pow((F.col("id") * 7919) % 30_011, F.lit(1.2))).alias("x"))
    tied = spark.range(30_000).select((F.col("id") % 4).cast("double").alias("x"))
    frames = [skewed, tied, skewed.limit(1), skewed.limit(2), skewed.limit(999), tied.union(spark.range(5).select(F.lit(None).cast("double").alias("x")))]
    for frame in frames:
        want = frame.agg(F.percentile("x", p).alias("_cuts")).first()[0]
        assert history.exact_cuts(frame, "x").first()[0] == pytest.approx(want, rel=1e-12)
    assert history.exact_cuts(skewed.limit(0), "x").first()[0] is None


def test_repeated_keys_keep_the_greatest_row(spark):
    new = spark.createDataFrame([(1, 10, 5, "old"), (1, 10, 9, "new"), (2, 10, 3, "one")], "zone_id int, window_end int, at int, v string")
    old = spark.createDataFrame([(1, 10, 1, "gone"), (3, 10, 1, "kept")], new.schema)
    for batch in (new, new.orderBy(F.desc("v"))):
        got = sinks.merge_rows(old, batch, order=["at"])
        assert got.columns == old.columns
        assert sorted(map(tuple, got.collect())) == [(1, 10, 9, "new"), (2, 10, 3, "one"), (3, 10, 1, "kept")]
