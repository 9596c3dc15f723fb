"""Benchmark decontamination as a prefix-filtered containment join.

Each item is cut into windows of consecutive words; a window is a record of word shingles and counts as contained
only if all its shingles follow each other in a document, so by the prefix principle one shingle of it decides
candidates. Shingles are ordered by rarity, counted over all documents; a window's prefix is its rarest one. A document
shingle that is some window's prefix proposes that window at one place: the place must leave the window inside
the document (positional and length bounds), then the words themselves are compared.

The items' index goes to every task only if the items' texts are within ``index_bytes``; larger sets go in
blocks of that size, each against all documents.

Null or wordless documents have no hits; null or wordless items have no windows. Items that share a window are
all found. Documents repeated with one doc_id are judged row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as X
from ._spark import Tables, apart, released, together

#: Bytes of items' text in one index. The packed index is estimated at some 25 times that on the driver and in every Python worker.
INDEX_BYTES = 4 << 20
_FILTER = 1 << 20


def _words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = X.flat(text)
    data = X.LOWER[data]
    return data, *X.spans(data, offsets, X.ALNUM)


class Windows:
    """The different windows of some items, packed in arrays: their words, their shingles and, once counted, their prefixes."""

    def __init__(self, ids: pa.Array, texts: pa.Array, window: int, shingle: int):
        data, self.starts, self.ends, first = _words(texts)
        self.raw = data.tobytes()
        word = X.span_hash(data, self.starts, self.ends)
        words = np.diff(first)
        size = np.minimum(words, window)
        count = np.where(words > 0, words - size + 1, 0)
        item = np.repeat(np.arange(len(words)), count)
        at = first[:-1][item] + np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
        n = size[item]
        value = np.zeros(len(at), dtype=np.uint64)
        for k in np.unique(n):
            value[n == k] = X.gram_hash(word, int(k))[at[n == k]]
        # Windows of one hash and size are one if their words are equal, too; hashes that lie come apart by a further number.
        value, kept, own = self._distinct(value, at, n)
        order = np.lexsort((item, own))
        once = np.append(True, (own[order][1:] != own[order][:-1]) | (item[order][1:] != item[order][:-1]))[: len(order)]
        self.ids = ids
        self.item, self.item_first = item[order[once]].astype(np.int32), np.searchsorted(own[order[once]], np.arange(len(kept) + 1))
        self.at, self.n, self.hash = at[kept], n[kept], value[kept]
        self.k = np.minimum(self.n, shingle)
        self.lengths = np.unique(self.k).tolist()
        self.grams = {k: X.gram_hash(word, k) for k in self.lengths}
        self.all = {k: np.unique(self.grams[k][self._shingles(k)[0]]) for k in self.lengths}

    def _distinct(self, value: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The hashes, the first of each different window, and every window's number among those."""
        order = np.lexsort((np.arange(len(at)), value, n))
        new = np.ones(len(order), dtype=bool)
        for i in range(1, len(order)):
            a, b = order[i - 1], order[i]
            new[i] = value[a] != value[b] or n[a] != n[b] or self.words(at[a], n[a]) != self.words(at[b], n[b])
        own = np.empty(len(order), dtype=np.int64)
        own[order] = np.cumsum(new) - 1
        return value, order[new], own

    def words(self, at: int, n: int) -> bytes:
        return b" ".join(self.raw[a:b] for a, b in zip(self.starts[at : at + n].tolist(), self.ends[at : at + n].tolist(), strict=True))

    def _shingles(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First words of the k-word shingles of the windows that have such, their windows and their places in those."""
        mine = np.flatnonzero(self.k == k)
        count = self.n[mine] - k + 1
        window = np.repeat(mine, count)
        place = np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count)
        return self.at[window] + place, window, place

    def choose(self, count: dict[int, np.ndarray]) -> None:
        """Takes the rarest shingle of each window as its prefix; ties to the least hash. count: by length, of each of ``all``."""
        self.prefix = {}
        for k in self.lengths:
            at, window, place = self._shingles(k)
            gram = self.grams[k][at]
            often = count[k][np.searchsorted(self.all[k], gram)]
            order = np.lexsort((place, gram, often, window))
            best = order[np.append(True, window[order][1:] != window[order][:-1])]
            best = best[np.argsort(gram[best], kind="stable")]
            self.prefix[k] = gram[best], window[best].astype(np.int32), place[best].astype(np.int32)
        self.grams = self.all = None

    def items(self, window: int) -> list[str]:
        return self.ids.take(pa.array(self.item[self.item_first[window] : self.item_first[window + 1]])).to_pylist()


def _members(hashes: np.ndarray, keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Indices of the hashes that are among sorted keys; table: a bit for each low part that some key has."""
    maybe = np.flatnonzero(table[hashes & np.uint64(_FILTER - 1)])
    return maybe[keys[np.minimum(np.searchsorted(keys, hashes[maybe]), len(keys) - 1)] == hashes[maybe]]


def _table(keys: np.ndarray) -> np.ndarray:
    table = np.zeros(_FILTER, dtype=bool)
    table[keys & np.uint64(_FILTER - 1)] = True
    return table


def _document_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = X.LOWER[data]
    starts, ends, first = X.spans(data, offsets, X.ALNUM)
    return data, starts, ends, first, X.span_hash(data, starts, ends)


def _count_shingles(docs: DataFrame, known: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """How often each of some shingle hashes, sorted by length of the shingle, occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.value
        tables = {k: _table(v) for k, v in keys.items()}
        total = {k: np.zeros(len(v), dtype=np.int64) for k, v in keys.items()}
        for batch in batches:
            for _, _, data, offsets in X.blocks(batch.column(0)):
                _, _, _, first, word = _document_words(data, offsets)
                for k, v in keys.items():
                    at, _ = X.grams_in_rows(first, k)
                    grams = X.gram_hash(word, k)[at]
                    found = np.searchsorted(v, grams[_members(grams, v, tables[k])])
                    if len(found):
                        total[k] += np.bincount(found, minlength=len(v))
        for k, v in total.items():
            some = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, dtype=np.int32)), pa.array(keys[k][some].view(np.int64)), pa.array(v[some])], ["k", "h", "n"])

    rows = docs.select("text").mapInArrow(lambda batches: released(count(batches)), "k int, h long, n long").groupBy("k", "h").agg(F.sum("n").alias("n")).toArrow()
    kind, h, n = (rows.column(i).to_numpy() for i in range(3))
    out = {k: np.zeros(len(v), dtype=np.int64) for k, v in known.items()}
    for k, v in known.items():
        mine = kind == k
        out[k][np.searchsorted(v, h[mine].view(np.uint64))] = n[mine]
    return out


def _find(windows: Windows, tables: dict[int, np.ndarray], data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each row's first word, and of every occurrence: window, start word and row; and each word's hit mask."""
    data, starts, ends, first, word = _document_words(data, offsets)
    raw, found = None, []
    for k, (keys, ids, shift) in windows.prefix.items():
        grams = X.gram_hash(word, k)
        at = _members(grams, keys, tables[k])
        lo, hi = np.searchsorted(keys, grams[at], "left"), np.searchsorted(keys, grams[at], "right")
        reps = hi - lo
        entry = np.repeat(lo, reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        w, begin = ids[entry], np.repeat(at, reps) - shift[entry]
        row = np.searchsorted(first, np.repeat(at, reps), "right") - 1
        fits = (begin >= first[row]) & (begin + windows.n[w] <= first[row + 1])
        w, begin, row = w[fits], begin[fits], row[fits]
        for n in np.unique(windows.n[w]):
            mine = np.flatnonzero(windows.n[w] == n)
            mine = mine[X.gram_hash(word, int(n))[begin[mine]] == windows.hash[w[mine]]]
            for i in mine:
                raw = raw or data.tobytes()
                if b" ".join(raw[starts[x] : ends[x]] for x in range(begin[i], begin[i] + n)) == windows.words(windows.at[w[i]], n):
                    found.append((w[i], begin[i], row[i]))
    w, begin, row = (np.array(x, dtype=np.int64) for x in (zip(*found, strict=True) if found else ([], [], [])))
    return first, w, begin, row, X.covered(begin, begin + windows.n[w], len(starts))


_ADDED = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hit_words", T.ArrayType(T.IntegerType())), T.StructField("item_ids", T.ArrayType(T.StringType()))])


def _scan(docs: DataFrame, windows: Windows) -> DataFrame:
    """docs plus n_words, hit_words (positions of hit words) and item_ids (sorted strings)."""
    rest = docs.drop(*_ADDED.names)
    shared = docs.sparkSession.sparkContext.broadcast(windows)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        tables = {k: _table(v[0]) for k, v in index.prefix.items()}
        for batch in batches:
            n_words, hits, items = [], [], []
            for lo, hi, data, offsets in X.blocks(batch.column(batch.schema.get_field_index("text"))):
                first, w, _, row, mask = _find(index, tables, data, offsets)
                n_words.append(np.diff(first))
                at: list[list] = [[] for _ in range(hi - lo)]
                ids: list[set[str]] = [set() for _ in range(hi - lo)]
                for i, r in zip(w.tolist(), row.tolist(), strict=True):
                    ids[r].update(index.items(i))
                for r in set(row.tolist()):
                    at[r] = np.flatnonzero(mask[first[r] : first[r + 1]]).tolist()
                hits += at
                items += [sorted(x) for x in ids]
            n = np.concatenate(n_words) if n_words else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], [*batch.schema.names, *_ADDED.names])

    return rest.mapInArrow(lambda batches: released(add(batches)), T.StructType([*rest.schema.fields, *_ADDED.fields]))


def mark_contamination(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """docs plus n_words, hit_words and item_ids against all windows of items (item_id, text); columns that were so named are replaced."""
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = -(-size // index_bytes) or 1
    ids = items.where("text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)).alias("block"))

    def index(block: int) -> Windows:
        rows = ids.where(F.col("block") == block).select("item_id", "text").toArrow().combine_chunks()
        item_ids, texts = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (rows.column("item_id"), rows.column("text")))
        windows = Windows(item_ids, texts, window, shingle)
        windows.choose(_count_shingles(docs, windows.all) if len(windows.n) else {k: np.zeros(len(v), np.int64) for k, v in windows.all.items()})
        return windows

    if n_blocks == 1:
        return _scan(docs, index(0))
    # Each block is held against the rows of one written table, and what it finds goes to a table of its own.
    tables = Tables(docs.sparkSession, "blocks")
    rows = tables.save(docs.drop(*_ADDED.names).withColumn("_row", F.monotonically_increasing_id()))
    parts = [tables.save(_scan(rows.select("_row", "text"), index(b)).where(F.size("hit_words") > 0).select("_row", "hit_words", "item_ids")) for b in range(n_blocks)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionAll(part)

    def joined(name: str) -> Column:
        return F.array_sort(F.array_distinct(F.flatten(F.collect_list(name)))).alias(name)

    found = found.groupBy("_row").agg(joined("hit_words"), joined("item_ids"))
    counted = rows.withColumn("n_words", F.size(F.regexp_extract_all(F.col("text"), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))).cast("long"))
    return counted.withColumn("n_words", F.coalesce(F.greatest("n_words", F.lit(0)), F.lit(0))).join(found, "_row", "left").drop("_row").withColumns({c: F.coalesce(c, F.array().cast(_ADDED[c].dataType)) for c in ("hit_words", "item_ids")})


def report(docs: DataFrame, items: DataFrame, **options: int) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    marked = mark_contamination(docs.select("doc_id", "text"), items, **options)
    n_hit = F.size("hit_words").cast("long")
    return marked.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, items: DataFrame, **options: int) -> DataFrame:
    """The rows of docs without any hit, with all their columns."""
    return together(mark_contamination(apart(docs, *_ADDED.names, "_row"), items, **options).where(F.size("hit_words") == 0), docs.columns)
