"""Sharding by rendezvous hashing, with DataFrame functions only.

Every shard draws ``ln(u) / weight`` for a row's key, u from a hash of key and shard number; the largest draw
wins. A shard's draw depends on nothing else, so a further shard takes rows only into itself, about its weight's share.

Slots number a shard's rows without gaps by a hash of key and text. Ranges of that hash are numbered apart and each
starts where the earlier ones end, so no task holds a whole shard and the slots don't depend on the number of ranges. Rows with equal keys share a shard; a null key is a
key of its own. Null text has no bytes and CRC 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_SCALE = float(2**52)


def shard_of(key: Column, weights: Sequence[float]) -> tuple[Column, Column]:
    """The winning shard, and the draws by shard as an array of (draw, shard) structs."""
    def draw(i: Column, w: Column) -> Column:
        digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit("/"), i.cast("string")).cast("binary"))
        u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / _SCALE
        return F.struct((F.log(u) / w).alias("draw"), i.alias("shard"))

    shards = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)])
    draws = F.transform(shards, lambda s: draw(s["i"], s["w"]))
    return F.array_max(draws)["shard"], draws


def assign(docs: DataFrame, weights: Sequence[float], grown_weight: float | None = None, key: str = "doc_id", text: str = "text", buckets: int = 0) -> DataFrame:
    """key, size, text_crc32, shard, slot and grown_shard (with one more shard of grown_weight; else null).

    buckets: hash ranges of a shard that are numbered apart; 0: as many as shuffle partitions.
    """
    buckets = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    body = F.coalesce(F.col(text), F.lit(""))
    every = [*weights, *([grown_weight] if grown_weight else [])]
    _, draws = shard_of(F.col(key), every)
    rows = docs.select(F.col(key), (F.octet_length(body).cast("long") + 8).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), draws.alias("draws"))
    own = F.array_max(F.slice("draws", 1, len(weights)))["shard"]
    grown = F.array_max("draws")["shard"] if grown_weight else F.lit(None).cast("int")
    place = F.conv(F.substring(F.md5(F.concat_ws("/", F.coalesce(F.col(key).cast("string"), F.lit("null")), "text_crc32").cast("binary")), 1, 8), 16, 10).cast("long")
    rows = rows.select(key, "size", "text_crc32", own.alias("shard"), grown.alias("grown_shard"), place.alias("place")).withColumn("bucket", F.shiftright(F.col("place") * buckets, 32))
    counts = rows.groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("begin"))
    inside = Window.partitionBy("shard", "bucket").orderBy("place", key, "text_crc32", "size")
    numbered = rows.withColumn("n", F.row_number().over(inside))
    slot = (F.col("begin") + F.col("n") - 1).cast("long")
    return numbered.join(begins, ["shard", "bucket"]).select(key, "size", "text_crc32", "shard", slot.alias("slot"), "grown_shard")
