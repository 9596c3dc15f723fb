"""A corpus pipeline: each stage is written as Parquet and reread as the next one's documents.

quality rules (rejected documents go), line dedup (later lines of a class go), SimHash near-dedup (one document of each class
stays), benchmark decontamination (documents with a benchmark passage go), best-fit packing (the rest as sequences).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tripflow.llm import bin_completion, decontaminate, line_dedup, quality_rules, simhash
from tripflow.llm._spark import Tables, small_batches


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return quality_rules.keep_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return line_dedup.without_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return simhash.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return bin_completion.pack(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("simhash_dedup", near_duplicates), ("decontamination", benchmark), ("packing", packing)]

#: SQL has no exact binomial bounds, MinHash, XXH64 or tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = Tables(spark, "pipeline")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        if name == STAGES[-1][0]:
            return out
        docs = tables.save(out)
    return docs
