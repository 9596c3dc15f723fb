"""Sources: event streams, trips, tables by time range, unions of drifting files, dimensions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.cleaning import union_all
from ..schemas import EVENT, TRIP, TRIP_PROJECTION


def read_events(spark: SparkSession, source: str, options: Mapping[str, str] | None = None, streaming: bool = False, max_per_trigger: int | None = None) -> DataFrame:
    """(json_str, source_ts): a Kafka topic (source "kafka:topic", servers in options), or a folder of JSON-lines files."""
    reader = spark.readStream if streaming else spark.read
    options = dict(options or {})
    if source.startswith("kafka:"):
        defaults = {"subscribe": source.removeprefix("kafka:"), "startingOffsets": "earliest", "failOnDataLoss": "false"}
        if streaming and max_per_trigger:
            defaults["maxOffsetsPerTrigger"] = str(max_per_trigger)
        raw = reader.format("kafka").options(**defaults, **options).load()
        return raw.select(F.col("value").cast("string").alias("json_str"), F.col("timestamp").alias("source_ts"))
    if streaming and max_per_trigger:
        options["maxFilesPerTrigger"] = str(max_per_trigger)
    return reader.options(**options).text(source).select(F.col("value").alias("json_str"), F.col("_metadata.file_modification_time").alias("source_ts"))


def parse_events(raw: DataFrame, schema: T.StructType | str = EVENT) -> DataFrame:
    """Payload columns; a text that isn't JSON gives a row of nulls."""
    return raw.select(F.from_json("json_str", schema).alias("d")).select("d.*")


def day_filter(df: DataFrame, start: str, end: str) -> DataFrame:
    """Prunes year/month/day partitions to those between two dates."""
    day = F.make_date("year", "month", "day")
    years = range(int(start[:4]), int(end[:4]) + 1)
    return df.where(F.col("year").isin(*years) & day.between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def read_table(spark: SparkSession, path: str, streaming: bool = False, time_range: tuple[str, str, str] | None = None, max_files: int | None = None, schema: T.StructType | None = None, merge: bool = False) -> DataFrame:
    """A Parquet table, as a stream with a file cap per trigger or as a batch restricted to (column, from, to).

    merge: the columns of all files, where later appends have brought some; reads every footer, so a known schema is cheaper.
    """
    if merge and not schema:
        schema = spark.read.option("mergeSchema", "true").parquet(path).schema
    if streaming:
        reader = spark.readStream.schema(schema or spark.read.parquet(path).schema)
        return (reader.option("maxFilesPerTrigger", str(max_files)) if max_files else reader).parquet(path)
    df = spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    if time_range:
        c, lo, hi = time_range
        df = df.where(F.col(c).between(F.lit(lo).cast(df.schema[c].dataType), F.lit(hi).cast(df.schema[c].dataType)))
        if {"year", "month", "day"} <= set(df.columns):
            df = day_filter(df, lo[:10], hi[:10])
    return df


def file_statistics(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table whose count, min and max of numbers and dates are read from the files' footers, without their rows.

    Only Spark's newer reader pushes aggregates down, so this table alone is read by it.
    """
    key = "spark.sql.sources.useV1SourceList"
    before = spark.conf.get(key)
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    spark.conf.set(key, ",".join(x for x in before.split(",") if x != "parquet"))
    try:
        return spark.read.parquet(path)
    finally:
        spark.conf.set(key, before)


def latest_slot(spark: SparkSession, path: str, ts: str = "window_end") -> DataFrame:
    """One row (window_end): the latest slot of a table, from the footers' statistics of its slot_s (seconds since 1970) or, in a table without it, from a scan of ts."""
    table = file_statistics(spark, path)
    if "slot_s" not in table.columns:
        return spark.read.parquet(path).agg(F.max(ts).alias("window_end"))
    return table.agg(F.max("slot_s").alias("s")).select((F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("s"))).alias("window_end"))


def within(df: DataFrame, c: str, limits: DataFrame) -> DataFrame:
    """Rows whose c lies in the one-row frame (lo, hi) of another frame's bounds; nothing is collected."""
    return df.join(F.broadcast(limits), F.col(c).between(F.col("lo"), F.col("hi"))).select(*[df[x] for x in df.columns])


def read_trips(spark: SparkSession, *paths: str) -> DataFrame:
    """Trip files, folders or patterns of them, by the columns of TRIP; what a file lacks is null."""
    return spark.read.schema(TRIP).parquet(*paths)


def project_trips(trips: DataFrame) -> DataFrame:
    """The 22 columns that the batch plans use, zones as long, the two shared-ride flags under their short names."""
    def column(c: str) -> Column:
        kind = "bigint" if c.endswith("LocationID") else "string" if c.startswith("share_") else dict(trips.dtypes).get(c, "string")
        return F.col(c.replace("share_", "shared_")).cast(kind).alias(c)

    return trips.select(*[column(c) for c in TRIP_PROJECTION])


def schema_groups(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """(schema, n_files, files): files by their schema; only footers are read."""
    with ThreadPoolExecutor(16) as pool:  # a footer is a small read; only its latency counts
        rows = list(pool.map(lambda f: (f, spark.read.parquet(f).schema.simpleString()), files))
    return spark.createDataFrame(rows, "file string, schema string").groupBy("schema").agg(F.count("*").alias("n_files"), F.sort_array(F.collect_list("file")).alias("files"))


def read_union_by_name(spark: SparkSession, groups: Sequence[Sequence[str]], casts: Mapping[str, str] | None = None) -> DataFrame:
    """Files of several schemas as one frame: each group is read by its own schema, cast tolerantly, and united by name."""
    frames = []
    for paths in groups:
        df = spark.read.parquet(*paths)
        frames.append(df.withColumns({c: F.col(c).try_cast(t) for c, t in (casts or {}).items() if c in df.columns}))
    return union_all(frames)


def first_non_empty(sources: Sequence[Callable[[], DataFrame]]) -> DataFrame:
    """The first source that exists and has a row; the last one's frame or error otherwise."""
    for source in sources[:-1]:
        try:
            df = source()
            if not df.isEmpty():
                return df
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
    return sources[-1]()


def read_predictions(spark: SparkSession, path: str | None = None, jdbc: Mapping[str, str] | None = None, n_partitions: int = 8) -> DataFrame:
    """Predictions from a Parquet table, or over JDBC in ranges of zone_id."""
    if jdbc:
        options = {"partitionColumn": "zone_id", "lowerBound": "1", "upperBound": "264", "numPartitions": str(n_partitions), "preferTimestampNTZ": "true"}
        return spark.read.format("jdbc").options(**options, **jdbc).load()
    return spark.read.parquet(path)


def read_zone_features(spark: SparkSession, path: str) -> DataFrame:
    """(zone_id, geometry as JSON) from a feature collection; the id is the LocationID property."""
    schema = "features array<struct<geometry:string, properties:map<string,string>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    return rows.select(F.element_at("f.properties", "LocationID").try_cast("int").alias("zone_id"), F.col("f.geometry").alias("geometry"))
