"""Quality rules whose cutoffs carry a guarantee for the verdict of all of them.

Each rule is one rate per document with a fixed list of cutoffs from lenient to strict. Labelled rows are parted by a hash of
doc_id: two fifths select, two fifths certify, one fifth only measures. On the selecting rows of a stratum a path is
laid from no cutoffs at all to the strictest of every rule: each step tightens the rule that rejects the most bad documents for
the good ones it costs. On the certifying rows, which had no part in the path, an exact binomial test asks step by step whether the
rules together can reject more than ``alpha`` of the good documents; the first step that isn't certified ends the list (fixed-sequence
testing, which needs no correction within a stratum), and ``delta`` is divided by the number of strata (Bonferroni). With
probability 1 - delta, in no stratum does the verdict of all rules reject more than alpha of the good documents that pass the base
rule. Of the certified steps the one that separates best on the selecting rows is taken: share of bad rejected less ``care`` times
share of good rejected, ties to the most lenient. A stratum without a certified step rejects nothing but by the base rule.

What is counted per stratum is a histogram over the rules' levels (at most the product of the lists' lengths), so it doesn't grow with
the corpus. The measuring rows' good and rejected documents come with the cutoffs.

Null text counts as empty: no words, so it fails the base rule. A null stratum is a stratum. Labels whose doc_id
repeats count once, as good if any says so; a labelled document whose doc_id repeats counts once, by its greatest stratum and levels.
Rows with a repeated doc_id are each judged by their own text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as X
from ._spark import Tables, apart, released, small, together

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
#: Rates by statistic and their cutoffs, lenient first: reject if the rate is above.
RULES = {
    "symbols_per_word": [1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1],
    "repeat_share": [0.18, 0.15, 0.12, 0.1, 0.08, 0.06, 0.04],
    "dup_lines_per_word": [0.2, 0.1, 0.05, 0.02, 0.01],
    "long_words": [40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0],
}
#: Strata up to this many are broadcast with their cutoffs; beyond it they are joined.
BROADCAST_STRATA = 10_000


def text_stats(texts: pa.Array, window: int = 5) -> np.ndarray:
    """STATS of each text as an (n, 5) integer array."""
    out = np.zeros((len(texts), len(STATS)), dtype=np.int64)
    for lo, hi, data, offsets in X.blocks(texts):
        starts, ends, first = X.spans(data, offsets, X.NOT_SPACE)
        mine = out[lo:hi]
        mine[:, 0] = np.diff(first)
        mine[:, 1] = X.per_row(X.NOT_SPACE[data] & ((data & 0xC0) != 0x80), offsets)
        mine[:, 2] = X.per_row(SYMBOLS[data], offsets)
        begin, end, line_first = X.lines(data, offsets)
        wordy = np.searchsorted(starts, begin) < np.searchsorted(starts, end)
        row = np.repeat(np.arange(hi - lo), np.diff(line_first))[wordy]
        _, twin = _twins(X.span_hash(data, begin[wordy], end[wordy]), row)
        mine[:, 3] = np.bincount(row[twin], minlength=hi - lo)
        at, row = X.grams_in_rows(first, window)
        grams = X.gram_hash(X.span_hash(data, starts, ends), window)
        again, _ = _twins(grams[at], row)
        inside = X.covered(at[again], at[again] + window, len(starts))
        mine[:, 4] = X.per_row(inside, first)
    return out


def _twins(key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks of items that occur twice or more in their row, and of those after the first."""
    own = X.mix(key ^ X.mix(row.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(own, kind="stable")
    same = own[order][1:] == own[order][:-1]
    every, later = np.zeros(len(key), dtype=bool), np.zeros(len(key), dtype=bool)
    later[order[1:][same]] = True
    every[order[:-1][same]] = True
    return every | later, later


def with_stats(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with the five statistics of each whole text after its own columns; those named alike are replaced."""
    names = [prefix + s for s in STATS]
    rest = docs.drop(*[c for c in docs.columns if c.lower() in {n.lower() for n in names}])
    schema = T.StructType([*rest.schema.fields, *(T.StructField(n, T.LongType()) for n in names)])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = text_stats(batch.column(batch.schema.get_field_index(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(found[:, i]) for i in range(len(names)))], [*batch.schema.names, *names])

    return rest.mapInArrow(lambda batches: released(add(batches)), schema)


def rates(prefix: str = "") -> dict[str, Column]:
    words = F.greatest(F.col(prefix + "n_words"), F.lit(1)).cast("double")
    return {
        "symbols_per_word": F.col(prefix + "n_symbols") / words,
        "repeat_share": F.col(prefix + "n_repeat_words") / words,
        "dup_lines_per_word": F.col(prefix + "n_dup_lines") / words,
        "long_words": F.col(prefix + "word_chars") / words,
    }


def base_failed(prefix: str = "") -> Column:
    words = F.col(prefix + "n_words")
    return (words < 10) | (F.lit(100) * F.col(prefix + "n_repeat_words") > F.lit(20) * words)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k): small values certify that the true rate is below p."""
    if n == 0 or k >= n:
        return 1.0
    i = np.arange(k + 1)
    log = math.lgamma(n + 1) - np.array([math.lgamma(x + 1) + math.lgamma(n - x + 1) for x in i]) + i * math.log(p) + (n - i) * math.log1p(-p)
    return float(min(1.0, math.exp(log.max()) * np.exp(log - log.max()).sum()))


def path_choice(levels: np.ndarray, part: np.ndarray, good: np.ndarray, bad: np.ndarray, alpha: float, limit: float, care: float) -> tuple[list[int], int, int] | None:
    """The chosen step of one stratum: each rule's cutoff index (-1: none), and the measuring rows' good documents and those rejected.

    levels: how many of each rule's cutoffs a histogram row exceeds; good, bad: its documents; limit: the level of the test.
    """
    sizes = np.array([len(c) for c in RULES.values()])
    select, certify, measure = part < 2, (part == 2) | (part == 3), part == 4

    def rejected(config: np.ndarray) -> np.ndarray:
        return ((config >= 0) & (config + levels >= sizes)).any(axis=1)

    def gain(config: np.ndarray) -> float:
        out = rejected(config) & select
        return float(bad[out].sum() / max(bad[select].sum(), 1) - care * good[out].sum() / max(good[select].sum(), 1))

    config, path = np.full(len(sizes), -1), []
    while (config < sizes - 1).any():
        steps = [config + (np.arange(len(sizes)) == r) for r in range(len(sizes)) if config[r] < sizes[r] - 1]
        config = max(steps, key=gain)  # the first of equals
        path.append(config)
    certified = []
    for config in path:
        if binomial_tail(int(good[certify & rejected(config)].sum()), int(good[certify].sum()), alpha) > limit:
            break
        certified.append(config)
    best = max(certified, key=gain, default=None)
    if best is None or gain(best) <= 0:
        return None
    return best.tolist(), int(good[measure].sum()), int(good[measure & rejected(best)].sum())


def cutoffs(labelled: DataFrame, stratum: str, alpha: float = 0.02, delta: float = 0.05, care: float = 5.0, prefix: str = "") -> DataFrame:
    """(stratum, rule, cutoff, measured_good, measured_rejected): the chosen cutoffs, and what they do to rows that chose nothing.

    labelled: doc_id, statistics, stratum and ``good`` (0 or 1).
    """
    names = [f"l{i}" for i in range(len(RULES))]
    level = [sum(((rates(prefix)[r] > c).cast("int") for c in cs), F.lit(0)).alias(n) for n, (r, cs) in zip(names, RULES.items(), strict=True)]
    once = labelled.where(~base_failed(prefix)).groupBy("doc_id").agg(F.max("good").alias("good"), F.max(F.struct(F.col(stratum).alias("stratum"), *level)).alias("s"))
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(5)).cast("int").alias("part")
    each = once.select("good", part, "s.*")
    counts = each.groupBy("stratum", "part", *names).agg(F.sum("good").cast("long").alias("n_good"), F.sum(1 - F.col("good")).cast("long").alias("n_bad"))
    strata = each.agg(F.count_distinct(F.struct("stratum")).alias("strata"))
    rules = list(RULES.items())
    kind = labelled.schema[stratum].dataType
    schema = T.StructType([T.StructField("stratum", kind), T.StructField("rule", T.StringType()), T.StructField("cutoff", T.DoubleType()), T.StructField("measured_good", T.LongType()), T.StructField("measured_rejected", T.LongType())])

    def choose(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ("part", *names)])
        stratum = rows.column("stratum")[0].as_py()
        levels = np.stack([rows.column(n).to_numpy() for n in names], axis=1)
        found = path_choice(levels, *(rows.column(c).to_numpy() for c in ("part", "n_good", "n_bad")), alpha, delta / rows.column("strata")[0].as_py(), care)
        picked = [(*rules[r], i) for r, i in enumerate(found[0]) if i >= 0] if found else []
        types = [rows.schema.field("stratum").type, pa.string(), pa.float64(), pa.int64(), pa.int64()]
        columns = [[stratum] * len(picked), [p[0] for p in picked], [p[1][p[2]] for p in picked], *([x] * len(picked) for x in (found[1:] if found else (0, 0)))]
        return pa.table([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=schema.names)

    return counts.crossJoin(F.broadcast(strata)).groupBy("stratum").applyInArrow(choose, schema)


def judge(stats: DataFrame, chosen: DataFrame, stratum: str, prefix: str = "") -> DataFrame:
    """stats plus base_failed and kept, under the chosen cutoffs."""
    wide = chosen.groupBy(F.col("stratum").alias("_stratum")).agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_{r}") for r in RULES])
    side = F.broadcast(wide) if small(wide, BROADCAST_STRATA) else wide
    over = [F.coalesce(rates(prefix)[r] > F.col(f"_{r}"), F.lit(False)) for r in RULES]
    rejected = over[0] | over[1] | over[2] | over[3]
    joined = stats.join(side, F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
    failed = base_failed(prefix)
    return joined.withColumns({"base_failed": failed, "kept": ~failed & ~rejected}).drop("_stratum", *[f"_{r}" for r in RULES])


def good_labels(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max(F.col("quality").cast("long")).alias("good"))


def rule_table(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **limits: float) -> DataFrame:
    """Statistics and verdict of every document: doc_id, stratum, STATS, base_failed, kept."""
    tables = Tables(docs.sparkSession, "rules")
    stats = tables.save(with_stats(docs.select("doc_id", "text", stratum)).drop("text"))
    chosen = tables.save(cutoffs(stats.join(good_labels(labels), "doc_id"), stratum, **limits))
    return judge(stats, chosen, stratum)


def keep_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **limits: float) -> DataFrame:
    """The rows of docs that no rule rejects, with all their columns."""
    tables = Tables(docs.sparkSession, "rules")
    names = [f"_rule_{s}" for s in STATS]
    # Measured twice, for the cutoffs and for the verdict: cheaper than a written copy of all texts.
    labelled = with_stats(docs.select("doc_id", "text", stratum), prefix="_rule_").drop("text").join(good_labels(labels), "doc_id")
    chosen = tables.save(cutoffs(labelled, stratum, prefix="_rule_", **limits))
    rows = with_stats(apart(docs, *names, "kept", "base_failed", "_stratum", *(f"_{r}" for r in RULES)), prefix="_rule_")
    return together(judge(rows, chosen, stratum, "_rule_").where("kept"), docs.columns)
