"""Repeated passages by a sparse suffix array.

Suffixes start at words. Only those at minimisers are kept: in every ``width`` consecutive starts the one whose four words
hash least, so two equal passages of ``min_words`` keep the same suffixes wherever they stand. A suffix's first
min_words - width + 1 words make its key. Each further word to the right, and each word to the left, has a code of 16 bits
that depends on all words between it and the suffix's start too: codes say which passages to compare. Each passage that the suffix
stands for has 32 bits of a hash of its own words beside, which decide. Spark deals suffixes by key and sorts them by key and codes to the right: a suffix array of each key, its words in the order of their
codes (any total order of words serves). Neighbours are compared code by code; the length of their common prefix tells for
every depth which suffixes agree that far right. Matches are then extended to the left, word by word, among
those that still agree on enough words to the right. Overlapping repeats of a document join to maximal spans.

Passages of one key that differ are taken for equal only if both a 16-bit code at their edge and their 32-bit hashes collide.

Wholly equal suffixes inside one Arrow batch are matched there and only one of them is sorted with the rest, so a passage that a
third of all rows hold reaches the sort once per batch. Keys are counted first: a phrase that starts more than ``hot_rows``
suffixes, with whatever texts around it, is not brought together; its passages are, each by its own hash. Null texts have no
words. Rows that repeat a doc_id are texts of their own and are reported together. A passage that repeats within one document counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._spark import Tables, key_runs, released, sized

#: Crowded keys that may be broadcast (8 bytes each).
BROADCAST_KEYS = 1_000_000
_CODE, _CHECK = 2, 4  # bytes of a word's code and of a passage's hash


def minimisers(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each start i with a whole window, the leftmost place of the least hash in i .. i + width - 1."""
    at, have = np.arange(len(hashes)), 1
    while have < width:
        step = min(have, width - have)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(hashes[b] < hashes[a], b, a)
        have += step
    return at


def _codes_of(word: np.ndarray, at: np.ndarray, step: int, known: np.ndarray, extent: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of ``most`` words from each ``at`` on, going by ``step``, and a 64-bit hash of the first ``extent`` of them."""
    total = known.copy()
    codes = np.empty((len(at), most, _CODE), dtype=np.uint8)
    for i in range(most):
        grown = X.mix(total + word[np.clip(at + i * step, 0, len(word) - 1)])
        codes[:, i] = grown.view(np.uint8).reshape(-1, 8)[:, :_CODE]
        total = np.where(i < extent, grown, total)
    return codes, total


def _packed(codes: np.ndarray, extent: np.ndarray) -> pa.Array:
    raw = codes[np.arange(codes.shape[1]) < extent[:, None]]
    edges = np.append(0, np.cumsum(extent * _CODE)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(extent), [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(raw.tobytes())])


def _unpacked(column: pa.Array, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of each row, padded to ``most``, and their number."""
    return _matrix(column, np.uint16, most)


def _matrix(column: pa.Array, kind: type, most: int) -> tuple[np.ndarray, np.ndarray]:
    raw, edges = X.flat(column)
    extent = np.diff(edges) // np.dtype(kind).itemsize
    out = np.zeros((len(extent), most), dtype=kind)
    out[np.arange(most) < extent[:, None]] = np.frombuffer(raw.tobytes(), kind)
    return out, extent


def _suffixes(data: np.ndarray, offsets: np.ndarray, min_words: int, width: int) -> tuple[np.ndarray, ...]:
    """Of each kept suffix: row, first passage that it stands for, their number, key, hash of all its words; codes and extent to the left and right. Last, hashes of all passages, in the suffixes' order."""
    starts, ends, first = X.spans(data, offsets, X.NOT_SPACE)
    word = X.span_hash(data, starts, ends)
    begin, row = X.grams_in_rows(first, min_words)
    most = width - 1
    if not len(begin):
        none, codes = np.empty(0, np.int64), np.empty((0, most, _CODE), np.uint8)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), codes, none, codes, none, np.empty(0, np.uint32)
    anchor = minimisers(X.gram_hash(word, 4), width)[begin]
    new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])))
    count = np.diff(np.append(new, len(begin)))
    checks = _passage_hash(word, begin, min_words)
    row, begin, anchor = row[new], begin[new], anchor[new]
    key = X.gram_hash(word, min_words - most)[anchor]
    to_left, to_right = anchor - begin, most - (anchor - begin) + count - 1
    left, left_hash = _codes_of(word, anchor - 1, -1, key, to_left, most)
    right, right_hash = _codes_of(word, anchor + min_words - most, 1, key, to_right, most)
    whole = X.mix(left_hash + X.mix(right_hash + (to_left * width + to_right).astype(np.uint64)))
    return row, begin - first[row], count, key, whole, left, to_left, right, to_right, checks


def _passage_hash(word: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
    """32 bits of a hash of the n words from each begin on."""
    power, inverse = X._powers(len(word) + 1)
    total = np.zeros(len(word) + 1, dtype=np.uint64)
    np.cumsum(X.mix(word) * power[:-1], dtype=np.uint64, out=total[1:])
    return (X.mix((total[begin + n] - total[begin]) * inverse[begin]) >> np.uint64(32)).astype(np.uint32)


def _repeats(key: np.ndarray, left: np.ndarray, to_left: np.ndarray, right: np.ndarray, to_right: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """Of suffixes in order, whether the passage that begins width - 1 - j words left of the suffix is a neighbour's too, for j from 0 to width - 1."""
    most = right.shape[1]
    same = (np.arange(most) < np.minimum(to_right[1:], to_right[:-1])[:, None]) & (right[1:] == right[:-1])
    common = np.logical_and.accumulate(same, axis=1).sum(axis=1)
    common[key[1:] != key[:-1]] = -1
    common = np.append(-1, common)
    out = np.zeros((len(key), most + 1), dtype=bool)
    grown = np.zeros(len(key), dtype=np.uint64)
    for i in range(most + 1):  # i words to the left, the rest of a passage to the right
        if i:
            grown = X.mix(grown + left[:, i - 1])
        at = np.flatnonzero((to_left >= i) & (to_right >= most - i))
        agree = np.cumsum(common < most - i)[at]
        both = X.mix(grown[at] + X.mix(agree.astype(np.uint64) << np.uint64(32) | checks[at, to_left[at] - i]))
        order = np.argsort(both, kind="stable")
        twice = both[order][1:] == both[order][:-1]
        out[at[order[1:][twice]], most - i] = out[at[order[:-1][twice]], most - i] = True
    return out


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of the runs of True."""
    edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


def spans(docs: DataFrame, min_words: int = 50, width: int = 32, hot_rows: int = 100_000) -> DataFrame:
    """(doc_id, start_word, end_word): maximal spans covered by passages of min_words that occur elsewhere too.

    hot_rows: suffixes of one key that may meet in one task; those of larger keys are matched passage by passage.
    """
    if not 4 <= width <= min_words - 3:
        raise ValueError("width must leave four words of a passage")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            parts: list[tuple] = []
            for lo, _, data, offsets in X.blocks(batch.column(1)):
                row, *rest = _suffixes(data, offsets, min_words, width)
                parts.append((row + lo, *rest))
            if not parts:
                continue
            row, begin, count, key, whole, left, to_left, right, to_right, checks = (np.concatenate(x) for x in zip(*parts, strict=True))
            # Suffixes equal in all words that they carry repeat each other: known here, as spans with key null. One of them goes on.
            _, once, which, copies = np.unique(whole ^ key, return_index=True, return_inverse=True, return_counts=True)
            known = np.flatnonzero(copies[which] > 1)
            if len(known):
                yield _batch(None, ids.take(pa.array(row[known])), begin[known], count[known], None, None, None)
            once.sort()
            edges = np.append(0, np.cumsum(count * _CHECK)).astype(np.int32)
            hashes = pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(checks.tobytes())]).take(pa.array(once))
            yield _batch(key[once].view(np.int64), ids.take(pa.array(row[once])), begin[once], count[once], _packed(left[once], to_left[once]), _packed(right[once], to_right[once]), hashes)

    schema = "key long, doc_id long, begin int, n int, left binary, right binary, checks binary"
    kept = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda batches: released(keep(batches)), schema)
    tables = Tables(docs.sparkSession, "suffixes")
    hot = tables.save(kept.where("key is not null").groupBy("key").count().where(F.col("count") > hot_rows).select("key"))
    some = not hot.isEmpty()
    if some:
        marked = kept.join(sized(hot.withColumn("hot", F.lit(True)), BROADCAST_KEYS), "key", "left")
        crowd, kept = marked.where("hot").drop("hot"), marked.where("hot is null").select(*kept.columns)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in key_runs(batches, 1, 50_000):
            done = np.asarray(table.column(5).combine_chunks().is_null())
            if done.any():
                ids, begin, n = (table.column(i).combine_chunks().filter(pa.array(done)) for i in (1, 2, 3))
                yield _spans(ids, begin.to_numpy(), begin.to_numpy() + n.to_numpy() - 1 + min_words)
                table = table.filter(pa.array(~done))
            key = table.column(0).to_numpy()
            alike = key[1:] == key[:-1]
            table = table.filter(pa.array(np.append(alike, False) | np.append(False, alike)) if len(key) else pa.array([], pa.bool_()))
            if not len(table):
                continue
            key, ids, begin, _, left, right, checks = (c.combine_chunks() for c in table.columns)
            (left, to_left), (right, to_right) = _unpacked(left, width - 1), _unpacked(right, width - 1)
            row, a, b = _runs(_repeats(key.to_numpy(), left, to_left, right, to_right, _matrix(checks, np.uint32, width)[0]))
            start = (begin.to_numpy() + to_left - width + 1)[row]
            yield _spans(ids.take(pa.array(row)), start + a, start + b + min_words)

    # Spans that are known go along under keys of their own, spread by document.
    keyed = kept.withColumn("key", F.coalesce("key", F.xxhash64("doc_id", "begin")))
    found = keyed.repartition("key").sortWithinPartitions("key", "right").mapInArrow(match, "doc_id long, start_word int, end_word int")
    if some:
        found = found.unionAll(_crowded(crowd, tables, min_words, width))
    return merged(found)


def _crowded(crowd: DataFrame, tables: Tables, min_words: int, width: int) -> DataFrame:
    """Spans of the suffixes of keys that too many share: a row for each passage, so that no key has to fit one task."""
    most = width - 1

    def grown(codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), most + 1), dtype=np.uint64)
        for i in range(most):
            out[:, i + 1] = X.mix(out[:, i] + codes[:, i])
        return out

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (left, to_left), (right, to_right) = (_unpacked(batch.column(i), most) for i in (4, 5))
            checks = _matrix(batch.column(6), np.uint32, most + 1)[0]
            row, far = np.nonzero((np.arange(most + 1) <= to_left[:, None]) & (most - np.arange(most + 1) <= to_right[:, None]))
            own = checks[row, to_left[row] - far].astype(np.uint64)
            passage = X.mix(grown(left)[row, far] + X.mix(grown(right)[row, most - far] + (own << np.uint64(8) | far.astype(np.uint64))))
            place = (batch.column(2).to_numpy() + to_left)[row] - far
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(row)) for i in range(2)), pa.array(passage.view(np.int64)), pa.array(place.astype(np.int32))], ["key", "doc_id", "passage", "start_word"])

    each = tables.save(crowd.mapInArrow(single, "key long, doc_id long, passage long, start_word int"))
    repeated = tables.save(each.groupBy("key", "passage").count().where("count > 1").drop("count"))
    return each.join(repeated, ["key", "passage"], "left_semi").select("doc_id", "start_word", (F.col("start_word") + min_words).alias("end_word"))


def merged(found: DataFrame) -> DataFrame:
    """Overlapping or touching spans of a document joined."""
    each = found.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start_word", "end_word"))).alias("s")).select("doc_id", "s.start_word", "s.end_word")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(1).value_parent_indices().to_numpy()
            begin, end = (batch.column(i).flatten().to_numpy() for i in (1, 2))
            if not len(row):
                continue
            # Ends so far, never mixed between rows: each row's numbers stand above the earlier rows'.
            shift = row.astype(np.int64) << 32
            reach = np.maximum.accumulate(end + shift)
            cut = np.append(True, begin[1:] + shift[1:] > reach[:-1])
            last = np.append(np.flatnonzero(cut)[1:] - 1, len(row) - 1)
            yield _spans(batch.column(0).take(pa.array(row[cut])), begin[cut], (reach - shift)[last])

    return each.mapInArrow(join, "doc_id long, start_word int, end_word int")


def _batch(key, ids, begin, count, *codes) -> pa.RecordBatch:
    n = len(ids)
    columns = [pa.nulls(n, pa.int64()) if key is None else pa.array(key), ids, pa.array(begin.astype(np.int32)), pa.array(count.astype(np.int32)), *(pa.nulls(n, pa.binary()) if c is None else c for c in codes)]
    return pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "begin", "n", "left", "right", "checks"])


def _spans(ids, begin, end) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))], ["doc_id", "start_word", "end_word"])
