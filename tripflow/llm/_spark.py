"""Tables between the jobs of one operator, kept where every executor can read them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only where that is unset and Spark runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        context = spark.sparkContext
        named = context.getCheckpointDir() or ""
        if not named:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = "file://" + tempfile.mkdtemp(prefix="tripflow-")
            context.setCheckpointDir(named)
    return named.rstrip("/")


BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Limits this session's Arrow batches to BATCH_BYTES from now on if they aren't: texts are long, and each task holds some batches.

    Spark reads the setting when a plan runs, so it stays after a query has been built.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


class Tables:
    """Written tables of one operator run: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/tripflow-{tag}-{uuid.uuid4().hex}", 0

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.parquet(path)
        saved = self.spark.read.schema(df.schema).parquet(path)
        saved._tripflow_path = path
        return saved

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._tripflow_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int) -> bool:
    """Whether a frame has at most so many rows; counts no further."""
    return df.limit(rows + 1).count() <= rows


def sized(df: DataFrame, rows: int) -> DataFrame:
    """df to be broadcast if it has at most so many rows, and as it is beyond."""
    return F.broadcast(df) if small(df, rows) else df


def sized_lists(df: DataFrame, lists: str, entries: int) -> DataFrame:
    """The same by the entries of a column of lists, each row counting as one more."""
    total = df.agg(F.sum(F.size(lists) + 1)).first()[0] or 0
    return F.broadcast(df) if total <= entries else df


def apart(df: DataFrame, *names: str) -> DataFrame:
    """df with columns that bear one of the names (in any case) called otherwise; together() takes that back."""
    taken = {n.lower() for n in names}
    return df.withColumnsRenamed({c: f"_own_{c}" for c in df.columns if c.lower() in taken})


def together(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns so named before apart()."""
    return df.select(*[F.col(f"`_own_{c}`").alias(c) if f"_own_{c}" in df.columns else F.col(f"`{c}`") for c in columns])


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; at their end a reused Python worker gives back what Arrow's pool has kept."""
    yield from batches
    pa.default_memory_pool().release_unused()


def key_runs(batches: Iterator[pa.RecordBatch], keys: int, rows: int) -> Iterator[pa.Table]:
    """Sorted batches as tables of about so many rows that never split rows equal in the first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    n, last = 0, None
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch.column(i).to_numpy() for i in range(keys)]
        cut = int(np.argmax(np.all([c == c[-1] for c in columns], axis=0)))  # where the last key begins
        now = tuple(c[-1] for c in columns)
        if n + cut >= rows and (cut or now != last):
            if cut:
                held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held)
            held, n, batch = [], 0, batch.slice(cut)
        held.append(batch)
        n, last = n + len(batch), now
    if n:
        yield pa.Table.from_batches(held)
