"""SimHash near-duplicates by a binary-trie self-join of the fingerprints.

Equal fingerprints are one trie leaf, so copies never multiply. Two fingerprints within ``budget`` bits agree
on one of budget + 1 bit blocks; Spark groups the leaves by each block in turn, which is the trie's walk over
node pairs without a differing bit down to the block's end, for tries whose bits are rotated to begin with
that block. Below it, each task walks its node pairs level by level: a pair splits into the pairs of its children,
differing bits add up, and pairs over the budget go; the walk holds at most FRONTIER pairs of a level and goes on depth first
beyond that. As long as a node or node pair has more leaves than ``node_rows``, Spark itself splits it by eight further bits into
the pairs of its descendants (again pruned by the budget), so no node has to fit one task.
Links contract to trees in the task, and a distributed union-find joins those.

Null and empty texts have fingerprint zero and are linked like any other. Repeated doc_ids are rows of their own; a null doc_id is
named as the class's only if no row of it has another.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as X
from ._spark import Tables, apart, key_runs, released, sized, together
from .components import EDGE, components, roots


#: Row numbers that may be broadcast (8 bytes each); beyond that the kept rows are joined by shuffle.
BROADCAST_ROWS = 2_000_000
#: Node pairs of one level that the walk holds at once.
FRONTIER = 1 << 20


def fingerprints(texts: pa.Array, shingle: int = 3) -> np.ndarray:
    """SimHash of each text as uint64: XXH64 of space-joined word shingles, repeats included, bit set by majority."""
    out = np.zeros(len(texts), dtype=np.uint64)
    for lo, hi, data, offsets in X.blocks(texts):
        starts, ends, first = X.spans(data, offsets, X.NOT_SPACE)
        if not len(starts):
            continue
        step = 1 << 16
        # Words of a row joined by one space each; a space also follows a row's last word.
        length = ends - starts
        joined = np.full(int(length.sum()) + len(length), 0x20, dtype=np.uint8)
        begin = np.cumsum(length + 1) - (length + 1)
        inside = np.ones(len(joined), dtype=bool)
        inside[begin + length] = False
        joined[inside] = X.LOWER[data[X.NOT_SPACE[data]]]
        at, row = X.grams_in_rows(first, shingle)
        to = at + shingle - 1
        words = np.diff(first)
        few = np.flatnonzero((words > 0) & (words < shingle))
        at, to, row = np.concatenate([at, first[few]]), np.concatenate([to, first[few + 1] - 1]), np.concatenate([row, few])
        order = np.argsort(row, kind="stable")
        at, to, row = at[order], to[order], row[order]
        text = joined.tobytes()
        left, right = begin[at], begin[to] + length[to]
        hashes = np.empty(len(at), dtype=np.uint64)
        for i in range(0, len(at), step):
            pieces = map(text.__getitem__, map(slice, left[i : i + step].tolist(), right[i : i + step].tolist()))
            hashes[i : i + step] = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(42)), np.uint64)
        rows, where, count = np.unique(row, return_index=True, return_counts=True)
        ones = np.zeros((len(rows), 64), dtype=np.int64)
        cuts = np.append(where, len(row))
        i = 0
        while i < len(rows):  # some rows' shingles at once, or the parts of one row
            j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + step, "right")) - 1)
            for part in range(cuts[i], cuts[j], 4 * step):
                bits = np.unpackbits(hashes[part : min(part + 4 * step, cuts[j])].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                if j == i + 1:
                    ones[i] += bits.sum(axis=0, dtype=np.int64)
                else:
                    ones[i:j] = np.add.reduceat(bits, where[i:j] - cuts[i], axis=0, dtype=np.int32)
            i = j
        major = (2 * ones > count[:, None]).astype(np.uint64)
        out[lo + rows] = (major << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return out


def with_fingerprint(docs: DataFrame, name: str, text: str = "text", shingle: int = 3) -> DataFrame:
    """docs and, last, the fingerprint's 64 bits as a signed long; a column so named is replaced."""
    rest = docs.drop(name)
    schema = T.StructType([*rest.schema.fields, T.StructField(name, T.LongType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = fingerprints(batch.column(batch.schema.get_field_index(text)), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value)], [*batch.schema.names, name])

    return rest.mapInArrow(lambda batches: released(add(batches)), schema)


def trie_walk(keys: np.ndarray, budget: int, depth: int, node: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of sorted distinct uint64 keys within ``budget`` bits, among keys of one node, part by part.

    node: start of each key's node (all its keys share their first ``depth`` bits); the whole trie if None.
    """
    starts = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if node is not None else np.zeros(min(1, len(keys)), dtype=np.int64)
    stops = np.append(starts[1:], len(keys))
    alone = stops - starts > 1
    a0, a1 = starts[alone], stops[alone]
    todo = [(depth, (a0, a1, a0.copy(), a1.copy(), np.zeros(len(a0), dtype=np.int64)))]
    while todo:
        level, (a0, a1, b0, b1, used) = todo.pop()
        if not len(a0):
            continue
        if level == 64:
            yield np.minimum(a0, b0), np.maximum(a0, b0)
            continue
        bit = np.uint64(63 - level)
        am, bm = (_first_one(keys, lo, hi, bit) for lo, hi in ((a0, a1), (b0, b1)))  # a node's zeros come first
        same = a0 == b0
        parts = [(a0, am, b0, bm, used), (am, a1, bm, b1, used), (a0, am, bm, b1, used + 1)]
        parts += [tuple(x[~same] for x in (am, a1, b0, bm, used + 1))]
        a0, a1, b0, b1, used = (np.concatenate(x) for x in zip(*parts, strict=True))
        keep = (used <= budget) & (a1 > a0) & (b1 > b0) & ~((a0 == b0) & (a1 - a0 == 1))
        pairs = tuple(x[keep] for x in (a0, a1, b0, b1, used))
        todo += [(level + 1, tuple(x[i : i + FRONTIER] for x in pairs)) for i in range(0, len(pairs[0]), FRONTIER)]


def _first_one(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
    """The first of sorted keys lo..hi-1 (equal above the bit) that has the bit; hi if none has. By halving."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) >> 1
        one = (keys[mid] >> bit & np.uint64(1)).astype(bool)
        hi[open_[one]] = mid[one]
        lo[open_[~one]] = mid[~one] + 1
    return lo


def trie_pairs(keys: np.ndarray, budget: int, depth: int, node: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All that trie_walk finds, at once."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)), *trie_walk(keys, budget, depth, node)]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _rotation(block: int, blocks: int) -> tuple[int, int]:
    """Bits that the block lets the fingerprint rotate left by, and its width."""
    edge = [64 * i // blocks for i in range(blocks + 1)]
    return edge[block], edge[block + 1] - edge[block]


def links(prints: DataFrame, tables: Tables, budget: int = 2, node_rows: int = 200_000) -> DataFrame:
    """(a, b): links that join all distinct fingerprints (column fp) within ``budget`` bits into their classes."""
    blocks = budget + 1

    def rotated(i: int) -> tuple[str, int]:
        left, width = _rotation(i, blocks)
        return (f"(shiftleft(fp, {left}) | shiftrightunsigned(fp, {64 - left}))" if left else "fp"), width

    turned = [rotated(i) for i in range(blocks)]
    each = F.array(*[F.struct(F.lit(i).alias("block"), F.expr(x).alias("key"), F.expr(f"shiftrightunsigned({x}, {64 - w})").alias("node")) for i, (x, w) in enumerate(turned)])
    leaves = prints.select(F.explode(each).alias("l")).select("l.block", "l.node", F.lit(0).cast("long").alias("sub"), F.lit(0).alias("side"), F.lit(0).alias("used"), "l.key")
    group, parts = ["block", "node", "sub"], []
    near = F.array(*[F.lit(m) for m in range(256) if m.bit_count() <= budget])
    for step in range((64 - max(w for _, w in turned)) // 8):
        large = tables.save(leaves.groupBy(*group).count().where(f"count > {node_rows}").drop("count"))
        if large.isEmpty():
            break
        # Spark walks eight further levels of large nodes: a leaf goes to every pair of descendants it may link in. side: whether
        # it is in both nodes of a pair (0), which are the same then, in the first or in the second.
        parts.append(leaves.join(sized(large, 100_000), group, "left_anti"))
        big = leaves.join(sized(large, 100_000), group, "left_semi").withColumn("m", F.explode(near))
        child = F.expr(f"cast(shiftrightunsigned(shiftleft(key, element_at(array({', '.join(str(w) for _, w in turned)}), block + 1) + {8 * step}), 56) as int)")
        big = big.withColumn("c", child).withColumn("d", F.col("c").bitwiseXOR(F.col("m"))).withColumn("used", F.col("used") + F.bit_count("m").cast("int")).where(F.col("used") <= budget)
        side = F.when(F.col("side") != 0, F.col("side")).otherwise(F.when(F.col("c") == F.col("d"), 0).when(F.col("c") < F.col("d"), 1).otherwise(2))
        big = big.withColumn("side", side)
        first, second = F.when(F.col("side") == 2, F.col("d")).otherwise(F.col("c")), F.when(F.col("side") == 2, F.col("c")).otherwise(F.col("d"))
        leaves = tables.save(big.select("block", "node", F.xxhash64("sub", first, second).alias("sub"), "side", "used", "key"))
    for part in parts:
        leaves = leaves.unionAll(part)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(table: pa.Table) -> Iterator[pa.RecordBatch]:
            block, node, sub = (table.column(i).to_numpy() for i in range(3))
            key = table.column(3).to_numpy().view(np.uint64)  # distinct in a group but for hash collisions of groups, which only add pairs of equals
            order = np.lexsort((key, sub, node, block))
            block, node, sub, key = block[order], node[order], sub[order], key[order]
            new = np.append(True, (block[1:] != block[:-1]) | (node[1:] != node[:-1]) | (sub[1:] != sub[:-1]))[: len(key)]
            group = np.cumsum(new)
            for i in range(blocks):
                mine = block == i
                if not mine.any():
                    continue
                left, width = _rotation(i, blocks)
                keys = key[mine]
                back = keys if not left else (keys >> np.uint64(left)) | (keys << np.uint64(64 - left))
                for x, y in trie_walk(keys, budget, width, group[mine]):
                    a, b = roots(back[x].view(np.int64), back[y].view(np.int64))
                    keep = a != b
                    yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

        for table in key_runs(batches, 3, node_rows):
            yield from emit(table)

    spread = leaves.select("block", "node", "sub", "key").repartition("block", "node", "sub").sortWithinPartitions("block", "node", "sub")
    return spread.mapInArrow(walk, EDGE)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", budget: int = 2) -> DataFrame:
    """(id, fp, component_id): each row's fingerprint, and the least id that links reach from it."""
    tables = Tables(docs.sparkSession, "simhash")
    prints = tables.save(with_fingerprint(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), "fp").select("id", "fp"))
    least = tables.save(prints.groupBy("fp").agg(F.min("id").alias("least")))
    node = components(links(least.select("fp"), tables, budget), tables).withColumnRenamed("node", "fp")
    linked = least.join(node, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    firsts = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(firsts, "root").select("fp", "component_id")
    return prints.join(named, "fp", "left")


def keep_one(docs: DataFrame, budget: int = 2) -> DataFrame:
    """One row of docs per class, with all its columns: the first by doc_id (null last), text hash and row of the written table."""
    tables = Tables(docs.sparkSession, "simhash")
    # Written once, so that each row keeps its number.
    printed = tables.save(with_fingerprint(apart(docs, "_fp", "_row"), "_fp").withColumn("_row", F.monotonically_increasing_id()))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("hash"), F.col("_row").alias("row"))
    least = tables.save(printed.groupBy("_fp").agg(F.min(place).alias("least")).withColumnRenamed("_fp", "fp"))
    node = components(links(least.select("fp"), tables, budget), tables).withColumnRenamed("node", "fp")
    linked = least.join(node, "fp", "left").select(F.coalesce("root", "fp").alias("root"), "least")
    keep = tables.save(linked.groupBy("root").agg(F.min("least").alias("first")).select(F.col("first.row").alias("_row")))
    return together(printed.join(sized(keep, BROADCAST_ROWS), "_row", "left_semi"), docs.columns)
