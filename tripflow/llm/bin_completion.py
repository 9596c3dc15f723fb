"""Best-fit packing of documents into sequences by bin completion.

Pieces of equal length are alike, so the search runs over the counts by length: at most ``capacity`` numbers, whatever
the corpus. Each node takes the largest length left and enumerates the undominated fillings of the rest of its
sequence, least waste first, within the waste that a solution better than the incumbent may still have. A filling is dominated
if unused lengths could take the place of some of its pieces, which would fit into them, without overfilling the sequence. A filling
is tried as often as the counts allow, then half as often, down to once, so every solution can be reached. Best-fit decreasing is the
first incumbent; branches that can't beat the incumbent go, by their waste and by Martello and Toth's bound, and an incumbent
at the lower bound ends the search. Without the limit of ``steps`` the result is the least number of sequences; with it, it
is at most that of best-fit decreasing. The counts, and so the plan's time and memory, don't grow with the corpus; pieces
meet their places by rank within their length, which Spark numbers in hash buckets.

Null and empty texts are the end id alone. Rows are packed one by one, so repeated doc_ids and equal texts are pieces of their own;
pieces alike in doc_id, number and ids take each other's places in any order. Other columns than doc_id and text are not read.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._spark import Tables, released

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def encoder(path: str):
    """The byte-level BPE of a ranks file; ids, those of added tokens included, equal those of the JSON form beside it."""
    import base64
    import json

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(path.removesuffix(".tiktoken") + ".json", encoding="utf-8") as f:
        added = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
    for text in added:
        ranks.pop(text.encode(), None)
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, vocabulary: str | None = None) -> DataFrame:
    """The pieces of each document: whole, or cut to ``capacity`` with the shorter one first."""
    path = vocabulary or default_vocabulary()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_to_numpy
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                ids = np.append(encode(text, allowed_special="all"), end_id).astype("<u4") if text else np.array([end_id], dtype="<u4")
                edges = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
                    for x, v in zip(out, (doc, k, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes())), strict=True):
                        x.append(v)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda batches: released(cut(batches)), PIECES)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's L2: for each threshold, large items alone and what the middle ones can't fit beside them."""
    if not counts:
        return 0
    x = np.array(sorted(counts))
    n = np.append(0, np.cumsum([counts[i] for i in x.tolist()]))
    size = np.append(0, np.cumsum(x * np.diff(n)))
    k = np.append(0, x[x <= capacity // 2])
    half, big, low = (np.searchsorted(x, v, side) for v, side in ((capacity // 2, "right"), (capacity - k, "right"), (k, "left")))
    big = np.maximum(big, half)
    room = (n[big] - n[half]) * capacity - (size[big] - size[half])
    more = -((room - (size[half] - size[low])) // capacity)
    return int((n[-1] - n[half] + np.maximum(more, 0)).max())


def fillings(counts: dict[int, int], room: int, waste: int, work: list[int]) -> Iterator[tuple[tuple[int, ...], int]]:
    """Undominated multisets of available lengths (descending) that leave at most ``waste`` of room, and what they leave: least waste, then largest pieces first.

    work: steps left of the search; each length and each partial filling takes one.
    """
    lengths = sorted((x for x, c in counts.items() if c and x <= room), reverse=True)
    counts = {x: counts[x] for x in lengths}
    whole, every = (1 << room + 1) - 1, sum(1 << x for x in lengths)
    reach = [1]  # sums of lengths[i:], as bits
    for x in reversed(lengths):
        bits, left, k = reach[-1], min(counts[x], room // x), 1
        while left:
            bits |= bits << min(k, left) * x & whole
            left, k = left - min(k, left), 2 * k
        reach.append(bits)
    reach.reverse()
    work[0] -= len(lengths)

    def exact(i: int, target: int, chosen: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        work[0] -= 1
        if not target:
            yield chosen
            return
        for j in range(i, len(lengths)):
            work[0] -= 1
            x = lengths[j]
            for k in range(min(counts[x], target // x), 0, -1):
                if work[0] > 0 and reach[j + 1] >> target - k * x & 1:
                    yield from exact(j + 1, target - k * x, (*chosen, *(x,) * k))
            if not reach[j + 1] >> target & 1:
                return

    def dominated(chosen: tuple[int, ...], left: int) -> bool:
        one = more = 0  # sums of one, and of two or more chosen pieces
        for x in chosen:
            more |= (more | one) << x
            one |= 1 << x
        work[0] -= len(chosen)
        free = every
        for x in set(chosen):
            if counts[x] == chosen.count(x):
                free ^= 1 << x
        near, width = free >> 1, 1  # within 1 to left above a sum
        while width < left:
            near |= near >> min(width, left - width)
            width *= 2
        return bool(more & free) or left > 0 and bool((1 | one | more) & near)

    for left in range(min(room, waste) + 1):
        if work[0] > 0 and reach[0] >> room - left & 1:
            yield from ((f, left) for f in exact(0, room - left, ()) if not dominated(f, left))


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: sequences with the same filling are one entry, so only lengths are looped over."""
    open_: dict[int, list[list]] = {}  # by room left: [filling, number of sequences]
    done: list[tuple[tuple[int, ...], int]] = []
    for x in sorted(counts, reverse=True):
        left = counts[x]
        while left:
            room = min((r for r in open_ if r >= x), default=capacity)
            filling, n = open_[room].pop() if room in open_ else ((), left)
            if room in open_ and not open_[room]:
                del open_[room]
            fit = room // x  # a sequence that got one of this length is the best fit of the next, too
            m = min(n, left // fit)
            if m < n and filling:
                rest = n - m - (1 if left - m * fit else 0)
                if rest:
                    open_.setdefault(room, []).append([filling, rest])
            parts = [(fit, m)] if m else []
            left -= m * fit
            if m < n and 0 < left < fit:
                parts.append((left, 1))
                left = 0
            for k, times in parts:
                now = filling + (x,) * k
                if room - k * x:
                    open_.setdefault(room - k * x, []).append([now, times])
                else:
                    done.append((now, times))
    return done + [(f, n) for groups in open_.values() for f, n in groups]


def plan(counts: dict[int, int], capacity: int, steps: int = 600_000) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences): the better of best-fit decreasing and the search.

    steps: lengths and partial fillings that the search may look at before its incumbent is taken, unless it ends before.
    """
    best = best_fit(counts, capacity)
    best_n, goal = sum(m for _, m in best), lower_bound(counts, capacity)
    total = sum(x * n for x, n in counts.items())
    left, work, seen = dict(counts), [steps], {}

    def options(waste: int) -> Iterator[tuple[tuple[int, ...], int, int]]:
        """(filling, how often, waste of one) for the largest length left."""
        top, now = max(left), dict(left)
        allowed = (best_n - 1) * capacity - total - waste
        for rest, lost in fillings({**now, top: now[top] - 1}, capacity - top, allowed, work):
            filling = (top, *rest)
            m = min(now[x] // filling.count(x) for x in set(filling))
            m = min(m, allowed // lost) if lost else m
            while m:
                yield filling, m, lost
                m //= 2

    # Of a node: its options (dropped far up, and then made again), how many are done, and the step that led to it.
    path: list[list] = [[None, 0, (), 0]]
    n = waste = 0
    while path and best_n > goal and work[0] > 0:
        node = path[-1]
        if node[0] is None:
            node[0] = itertools.islice(options(waste), node[1], None)
        node[1] += 1
        work[0] -= 8
        step = next(node[0], None)
        if step is None:
            _, _, filling, m = path.pop()
            for x in filling:
                left[x] = left.get(x, 0) + m
            n, waste = n - m, waste - m * (capacity - sum(filling)) if filling else waste
            continue
        filling, m, lost = step
        if (best_n - 1) * capacity - total - waste - m * lost < 0:
            continue
        for x in filling:
            left[x] -= m
        rest = {x: c for x, c in left.items() if c}
        if not rest and n + m < best_n:
            best_n, best = n + m, [(f, k) for _, _, f, k in path[1:]] + [(filling, m)]
        state = tuple(sorted(rest.items())) if len(rest) <= 32 else None
        known = rest and n + m + lower_bound(rest, capacity) < best_n and seen.get(state, n + m + 1) > n + m
        if known:
            if state:
                seen[state] = n + m
            for x in set(filling):
                if not left[x]:
                    del left[x]
            n, waste = n + m, waste + m * lost
            path.append([None, 0, filling, m])
            if len(path) > 64:
                path[-65][0] = None
        else:
            for x in filling:
                left[x] += m
    return best


def places(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from rank, to rank, first sequence, sequences, offset in each)."""
    rows, used, base = [], {}, 0
    for lengths, m in patterns:
        offset = 0
        for x in sorted(set(lengths), reverse=True):
            k = lengths.count(x)
            rank = used.get(x, 0)
            rows.append((x, rank, rank + k * m, base, m, offset))
            used[x] = rank + k * m
            offset += k * x
        base += m
    return rows


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 2, vocabulary: str | None = None, buckets: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    spark = docs.sparkSession
    tables = Tables(spark, "packing")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Numbered as they are written, so that wholly equal rows spread over the buckets, too.
    numbered = pieces(docs, capacity, end_id, vocabulary).withColumn("row", F.monotonically_increasing_id())
    cut = tables.save(numbered).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "row"), F.lit(buckets)))
    counts = cut.groupBy("length", "bucket").count()
    by_length = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # capacity rows at most
    # At most one pattern ends each length's count, and a pattern has at most sqrt(2 * capacity) different lengths.
    layout = spark.createDataFrame(places(plan(by_length, capacity)), "length long, low long, high long, base long, m long, at long")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("begin"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "row")
    ranked = cut.withColumn("n", F.row_number().over(inside)).join(begins, ["length", "bucket"]).withColumn("rank", F.col("begin") + F.col("n") - 1)
    l = F.broadcast(layout).alias("l")
    found = ranked.alias("r").join(l, (F.col("r.length") == F.col("l.length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    j = F.col("rank") - F.col("low")
    return found.select("doc_id", "piece", "start", F.col("r.length").alias("length"), "ids_crc32", (F.col("base") + j % F.col("m")).alias("sequence_id"), (F.col("at") + F.floor(j / F.col("m")) * F.col("r.length")).alias("offset"))
