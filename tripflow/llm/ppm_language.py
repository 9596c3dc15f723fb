"""Language identification by prediction by partial matching.

Per language, counts of byte contexts up to ``order`` bytes form a context tree; a byte costs -log2 of its share in the
longest context that has it, plus the escapes (method C: distinct followers over distinct followers and count) from longer
ones, down to a uniform order -1. Counts are frozen after training, so a text's code length under a language is a sum
over its bytes, and the language with the shortest code is predicted. ASCII capitals count as small letters.

Training reads a sample of the labelled rows: about ``rows_per_language`` whole texts of each language, by a hash of
the row, all of them if there are fewer; the trees' size is bounded by that. Texts of any length are scored whole.

Null texts, empty texts and texts without a letter are ``und`` with score 0, as is everything if no language could be
learned. Ties go to the language that sorts first. The score is the predicted language's posterior under equal priors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as X
from ._spark import released, sized

ORDER = 3
#: Languages whose shares of the sample are broadcast; more are joined.
LANGUAGES = 10_000
_SLOTS = 20
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def _grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each byte with its ORDER predecessors in its text, as one number; zero bytes stand before a text."""
    data = X.LOWER[data].astype(np.uint32)
    total = data.copy()
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    for back in range(1, ORDER + 1):
        before = np.zeros_like(data)
        before[back:] = data[:-back] if back < len(data) else 0
        before[place < back] = 0
        total |= before << np.uint32(8 * back)
    return total


class Trees:
    """Costs in bits of the grams that training saw, by language, and of others by escaping."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.languages = sorted({r[0] for r in rows})
        self.levels = []
        for lang in self.languages:
            key = np.array([r[1] for r in rows if r[0] == lang], dtype=np.uint32)
            n = np.array([r[2] for r in rows if r[0] == lang], dtype=np.float64)
            levels = []
            for k in range(ORDER + 1):  # counts of k context bytes and the byte
                mask = np.uint32((1 << 8 * (k + 1)) - 1)
                grams, at = np.unique(key & mask, return_inverse=True)
                count = np.bincount(at, n)
                contexts, of = np.unique(grams >> np.uint32(8), return_inverse=True)
                kinds, total = np.bincount(of).astype(float), np.bincount(of, count)
                levels.append((grams, -np.log2(count / (kinds + total)[of]), contexts, -np.log2(kinds / (kinds + total))))
            self.levels.append(levels)
        self.keys = np.unique(np.array([r[1] for r in rows], dtype=np.uint32))
        self.cost = np.array([self._cost(levels, self.keys) for levels in self.levels], dtype=np.float32)
        self.slots = np.zeros(1 << _SLOTS, dtype=np.int32)
        self.slots[self._slot(self.keys)] = np.arange(len(self.keys))

    @staticmethod
    def _slot(grams: np.ndarray) -> np.ndarray:
        return (grams * np.uint32(2654435761)) >> np.uint32(32 - _SLOTS)

    @staticmethod
    def _cost(levels: list, grams: np.ndarray) -> np.ndarray:
        cost, open_ = np.zeros(len(grams)), np.arange(len(grams))
        for k in range(ORDER, -1, -1):
            keys, bits, contexts, escape = levels[k]
            g = grams[open_] & np.uint32((1 << 8 * (k + 1)) - 1)
            at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            hit = keys[at] == g
            cost[open_[hit]] += bits[at[hit]]
            open_, context = open_[~hit], g[~hit] >> np.uint32(8)
            at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            known = contexts[at] == context
            cost[open_[known]] += escape[at[known]]
        cost[open_] += 8.0
        return cost

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(rows, languages) bits."""
        grams = _grams(data, offsets)
        at = self.slots[self._slot(grams)]
        other = np.flatnonzero(self.keys[at] != grams)
        found = np.minimum(np.searchsorted(self.keys, grams[other]), len(self.keys) - 1)
        at[other] = found
        other = other[self.keys[found] != grams[other]]
        rare, back = np.unique(grams[other], return_inverse=True)
        out = np.empty((len(offsets) - 1, len(self.languages)))
        total = np.zeros(len(data) + 1)
        for i, levels in enumerate(self.levels):
            bits = self.cost[i][at]
            bits[other] = self._cost(levels, rare)[back]
            np.cumsum(bits, dtype=np.float64, out=total[1:])
            out[:, i] = total[offsets[1:]] - total[offsets[:-1]]
        return out


def held_out(doc_id: Column) -> Column:
    """Whether the row belongs to the fifth that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def drawn(labelled: DataFrame, rows_per_language: int = 1000) -> DataFrame:
    """lang and text of about so many rows of each language, by a hash of doc_id and text, so that null and repeated ids are drawn row by row.

    Rows equal in both are drawn together, as one.
    """
    rows = labelled.where("lang is not null and text is not null and text <> ''").select("doc_id", "lang", "text")
    counts = rows.groupBy("lang").count()
    share = counts.select("lang", (F.lit(float(rows_per_language)) / F.col("count") * 2**31).alias("limit"))
    # The shares meet the rows before any shuffle if there are few languages, so texts stay where they are read.
    picked = rows.join(sized(share, LANGUAGES), "lang").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(2**31)) < F.col("limit"))
    return picked.groupBy("lang", "doc_id", F.sha2("text", 256)).agg(F.any_value("text").alias("text")).select("lang", "text")


def train(labelled: DataFrame, rows_per_language: int = 1000) -> Trees:
    """labelled: doc_id, text, lang of the rows to learn from, of which drawn() takes some."""
    picked = drawn(labelled, rows_per_language)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lang in sorted(set(langs)):
                texts = batch.column(1).filter(pa.array([x == lang for x in langs]))
                for _, _, data, offsets in X.blocks(texts):
                    grams, n = np.unique(_grams(data, offsets), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    found = picked.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = found.toArrow()  # bounded by the sample
    return Trees(list(zip(*(table.column(i).to_pylist() for i in range(3)), strict=True)))


def _has_letter(data: bytes) -> bool:
    return bool(_ASCII_LETTER.search(data)) or any(c.isalpha() for c in data.decode("utf-8", "ignore"))


def predict(docs: DataFrame, trees: Trees, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs plus the predicted language and its score; columns that were so named are replaced."""
    rest = docs.drop(pred, score)
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    schema = T.StructType([*rest.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, "und"], dtype=object)
        for batch in batches:
            best, posterior = np.full(len(batch), len(names) - 1), np.zeros(len(batch))
            for lo, hi, data, offsets in X.blocks(batch.column(batch.schema.get_field_index(text))):
                if not model.languages or not len(data):
                    continue
                bits = model.code_lengths(data, offsets)
                mine = np.array([_has_letter(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
                least = bits.min(axis=1)
                best[lo:hi][mine] = bits.argmin(axis=1)[mine]
                posterior[lo:hi][mine] = (1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1))[mine]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[best], pa.string()), pa.array(posterior)], [*batch.schema.names, pred, score])

    return rest.mapInArrow(lambda batches: released(add(batches)), schema)
