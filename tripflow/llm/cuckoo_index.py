"""Exact dedup by an index of cuckoo filters that takes and gives up live digests.

Texts are equal when they are the same after each run of white space is one space. A text's digest is a 64-bit hash; digests are
dealt to parts, and each part has a cuckoo filter (16-bit fingerprints, four to a bucket, two buckets each) beside its stored
digests, each with its number of rows and its first row. An arriving digest that misses the filter is new and goes in. One that hits
is looked for among the stored digests. A filter that overflows is made anew at twice the size from the stored digests.

A digest that several rows have is not trusted: their contents, bucketed by digest in the index's written segments, are compared with
that of the digest's first row. Digests of different contents are listed and told apart by SHA-256, so no wrong digest merges texts.

Every task first adds up its own rows' digests, so a group of copies arrives as one row a task however large it is. Contents are
compared in a join that Spark may split, and go to no Python worker. A part holds some 100,000 digests.

Null text counts as empty. Keys are integers; of equal texts the row of the smallest key stays, null keys after all others, and
of rows equal in key too any one. Columns other than key and text are left alone, so their names may clash. An empty table makes an empty index.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import Tables, released, sized

SLOTS, KICKS = 4, 500
_M = (1 << 64) - 1

#: kind: 0 a filter, 1 a stored digest, 2 an arriving one, 3 one to be deleted.
STATE = "part int, kind int, digest long, n long, bare boolean, key long, row long, hit boolean, slots binary"


def spread(x: int) -> int:
    """A 64-bit integer with every bit mixed."""
    x &= _M
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _M
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _M
    return x ^ (x >> 31)


class CuckooFilter:
    """Digests as 16-bit fingerprints; says "no" only of digests that aren't in it. A digest is added once."""

    def __init__(self, slots: array | None = None):
        self.slots = slots or array("H", bytes(2 * SLOTS * 64))
        self.mask = len(self.slots) // SLOTS - 1

    def _places(self, digest: int) -> tuple[int, int, int]:
        h = spread(digest)
        mark = (h >> 48) or 1
        one = h & self.mask
        return mark, one, self._other(one, mark)

    def _other(self, bucket: int, mark: int) -> int:
        """A fingerprint's second bucket by either of the two."""
        return bucket ^ (spread(mark) & self.mask)

    def _at(self, bucket: int, mark: int) -> int:
        """The slot of a bucket that holds the fingerprint, or -1."""
        lo = bucket * SLOTS
        for i in range(lo, lo + SLOTS):
            if self.slots[i] == mark:
                return i
        return -1

    def __contains__(self, digest: int) -> bool:
        mark, one, two = self._places(digest)
        return self._at(one, mark) >= 0 or self._at(two, mark) >= 0

    def add(self, digest: int) -> bool:
        """False if it overflows: some digest has then lost its place, and the filter must be made anew."""
        mark, one, two = self._places(digest)
        for bucket in (one, two):
            if (i := self._at(bucket, 0)) >= 0:
                self.slots[i] = mark
                return True
        bucket = two
        for kick in range(KICKS):
            i = bucket * SLOTS + (kick + mark) % SLOTS
            self.slots[i], mark = mark, self.slots[i]
            bucket = self._other(bucket, mark)
            if (i := self._at(bucket, 0)) >= 0:
                self.slots[i] = mark
                return True
        return False

    def discard(self, digest: int) -> None:
        """Takes out one fingerprint of a digest that was added."""
        mark, one, two = self._places(digest)
        i = max(self._at(one, mark), self._at(two, mark))
        if i >= 0:
            self.slots[i] = 0

    def grown(self, digests: Iterable[int]) -> CuckooFilter:
        """A filter of these digests, at least twice the size."""
        digests, size = list(digests), len(self.slots)
        while True:
            size *= 2
            out = CuckooFilter(array("H", bytes(2 * size)))
            if all(map(out.add, digests)):
                return out


class Part:
    """A filter with its stored digests: digest -> [n, first row as (bare, key, row), hit by this batch]."""

    def __init__(self, slots: bytes | None, stored: dict[int, list]):
        self.filter, self.stored = CuckooFilter(array("H", slots) if slots else None), stored

    def arrive(self, digest: int, n: int, first: tuple) -> None:
        if digest in self.filter:
            known = self.stored.get(digest)  # a false hit has none
            if known:
                known[0] += n
                known[1], known[2] = min(known[1], first), True
                return
        self.stored[digest] = [n, first, n > 1]
        if not self.filter.add(digest):
            self.filter = self.filter.grown(self.stored)

    def leave(self, digest: int) -> None:
        if digest in self.filter and self.stored.pop(digest, None):
            self.filter.discard(digest)


def _absorb(table: pa.Table) -> pa.Table:
    """A part's filter, stored and arriving digests -> its new filter and stored digests."""
    table = table.sort_by([("kind", "ascending"), ("bare", "ascending"), ("key", "ascending"), ("row", "ascending")])
    part, kinds = table["part"][0].as_py(), table["kind"].to_numpy()
    first, stored, leaving = np.searchsorted(kinds, [1, 2, 3]).tolist()
    rows = list(zip(*(table[c].to_pylist() for c in ("digest", "n", "bare", "key", "row")), strict=True))
    at = Part(table["slots"][0].as_py() if first else None, {d: [n, (bare, key, row), False] for d, n, bare, key, row in rows[first:stored]})
    for row in rows[leaving:]:
        at.leave(row[0])
    for d, n, bare, key, row in rows[stored:leaving]:
        at.arrive(d, n, (bare, key, row))
    m = len(at.stored)
    held = list(at.stored.values())
    return pa.table({
        "part": pa.array([part] * (m + 1), pa.int32()), "kind": pa.array([0] + [1] * m, pa.int32()), "digest": pa.array([None, *at.stored], pa.int64()), "n": pa.array([None, *[h[0] for h in held]], pa.int64()),
        "bare": pa.array([None, *[h[1][0] for h in held]], pa.bool_()), "key": pa.array([None, *[h[1][1] for h in held]], pa.int64()), "row": pa.array([None, *[h[1][2] for h in held]], pa.int64()), "hit": pa.array([False, *[h[2] for h in held]], pa.bool_()),
        "slots": pa.array([at.filter.slots.tobytes()] + [None] * m, pa.binary()),
    })


def _added_up(batches: Iterator[pa.RecordBatch], most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """(digest, bare, key, row) -> (digest, n, bare, key, row): each digest once for so many rows of a task, with its first row."""
    held: list[pa.RecordBatch] = []

    def sums() -> pa.RecordBatch:
        digest, bare, key, row = (pa.Table.from_batches(held).column(i).to_numpy() for i in range(4))
        order = np.lexsort((row, key, bare, digest))
        at = np.flatnonzero(np.append(True, np.diff(digest[order]) != 0))
        first = order[at]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (digest[first], np.diff(np.append(at, len(order))), bare[first], key[first], row[first])], ["digest", "n", "bare", "key", "row"])

    for batch in batches:
        if len(batch):
            held.append(batch)
        if sum(map(len, held)) >= most:
            yield sums()
            held.clear()
    if held:
        yield sums()


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


class CuckooIndex:
    """The live rows of all insertions: segments of rows with their contents, and a state of filters and stored digests by part.

    Insertions and deletions run Spark jobs at once and write the new state in the shared folder; one caller at a time. Rows are
    numbered for up to 1,024 insertions of a million tasks each.
    """

    def __init__(self, tables: Tables, parts: int = 0, digest=F.xxhash64):
        spark = tables.spark
        self.tables, self.digest = tables, digest
        self.parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.state, self.rows, self.segments = spark.createDataFrame([], STATE), None, 0
        self.mixed = spark.createDataFrame([], "digest long")

    def _arriving(self, rows: DataFrame, kind: int) -> DataFrame:
        sums = rows.select("digest", F.col("key").isNull().alias("bare"), F.coalesce("key", F.lit(0)).alias("key"), "row")
        sums = sums.mapInArrow(lambda batches: released(_added_up(batches)), "digest long, n long, bare boolean, key long, row long")
        return self._dealt(sums.withColumn("kind", F.lit(kind)))

    def _dealt(self, rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("part", F.pmod(F.hash("digest"), F.lit(self.parts)))
        return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in STATE.split(", "))])

    def _advance(self, changes: DataFrame) -> None:
        self.state = self.tables.save(self.state.unionByName(changes).groupBy("part").applyInArrow(_absorb, STATE))

    def insert(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> None:
        """Adds all rows of docs."""
        body = docs.select(F.col(key).cast("long").alias("key"), normalised(text).alias("content"))
        segment = self.tables.save(body.select("key", "content", self.digest("content").alias("digest"), F.sha2("content", 256).alias("sha256"), (F.lit(self.segments << 53) + F.monotonically_increasing_id()).alias("row")))
        self.segments += 1
        self.rows = segment if self.rows is None else self.rows.unionByName(segment)
        self._resize()
        self._advance(self._arriving(segment, 2))
        self._compare()

    def _resize(self, digests: int = 100_000) -> None:
        """More parts when they hold too many digests; stored ones then move with their rows' counts and get new filters."""
        wanted = -(-self.rows.count() // digests)
        if wanted > self.parts:
            self.parts = max(wanted, 2 * self.parts)
            stored = self.state.where("kind = 1").withColumn("kind", F.lit(2))
            self.state = self.tables.save(self._dealt(stored).groupBy("part").applyInArrow(_absorb, STATE))

    def _compare(self) -> None:
        """Holds the contents of the digests that this batch hit against their first rows', and lists the digests of different contents."""
        hit = self.state.where("kind = 1 AND hit").select("digest", F.col("row").alias("first"))
        bucketed = self.rows.join(sized(hit, 1_000_000), "digest").select("digest", "row", "first", "content")
        first = bucketed.where("row = first").select("digest", F.col("content").alias("held"))
        unlike = bucketed.where("row <> first").join(first, "digest").where("content <> held").select("digest")
        self.mixed = self.tables.save(self.mixed.union(unlike).distinct())

    def delete(self, gone: DataFrame, key: str = "doc_id") -> None:
        """Takes out all rows whose key is in gone. Digests without other rows leave the filters; the others' rows arrive anew."""
        keys = gone.select(F.col(key).cast("long").alias("key")).where("key IS NOT NULL").distinct()
        touched = self.tables.save(self.rows.join(keys, "key", "left_semi").select("digest").distinct())
        self.rows = self.rows.join(self.tables.save(keys), "key", "left_anti").select(*self.rows.columns)
        back = self.rows.join(touched, "digest", "left_semi")
        self._advance(self._dealt(touched.withColumn("kind", F.lit(3))).unionByName(self._arriving(back, 2)))

    def classes(self) -> DataFrame:
        """One row per live row: key, keep_id, group_size, kept, sha256 and row, its number in the index."""
        stored = self.state.where("kind = 1 AND n > 1").select("digest", "n", "bare", F.col("key").alias("least"), F.col("row").alias("first"))
        mixed = sized(self.mixed, 1_000_000)
        alike = stored.join(mixed, "digest", "left_anti").withColumn("apart", F.lit(""))
        least = F.min(F.struct(F.col("key").isNull().alias("bare"), F.coalesce("key", F.lit(0)).alias("key"), "row")).alias("f")
        apart = self.rows.join(mixed, "digest", "left_semi").groupBy("digest", F.col("sha256").alias("apart")).agg(F.count("*").alias("n"), least)
        groups = alike.unionByName(apart.select("digest", "n", "f.bare", F.col("f.key").alias("least"), F.col("f.row").alias("first"), "apart"))
        rows = self.rows.select("key", "digest", "sha256", "row").join(mixed.withColumn("is_mixed", F.lit(True)), "digest", "left").withColumn("apart", F.when(F.col("is_mixed"), F.col("sha256")).otherwise(F.lit("")))
        out = rows.join(groups, ["digest", "apart"], "left")
        single = F.col("n").isNull()
        keep = F.when(single, F.col("key")).when(~F.col("bare"), F.col("least"))
        return out.select("key", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"), (single | (F.col("row") == F.col("first"))).alias("kept"), "sha256", "row")


def duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, keep_id, group_size, kept and text_sha256 (of the normalised text) of every row: an index of one insertion. Runs jobs while it is built."""
    index = CuckooIndex(Tables(docs.sparkSession, "cuckoo"))
    index.insert(docs, key, text)
    return index.classes().select(F.col("key").alias(key), "keep_id", "group_size", "kept", F.col("sha256").alias("text_sha256"))
