"""The corpus pipeline: five stages from documents to shards of a training mixture.

Every stage gets all rows that the one before kept and returns whole rows. Toxic documents go, one document of each
group of near duplicates stays, documents with benchmark passages go, documents are repeated so that expected tokens
by quality meet the target weights (no document is dropped for that), and all rows are put into shards.
Null ids, null texts and extra columns pass through as each operator's docstring says; empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import decontaminate, mixing, near_dup, sharding, toxicity
from folioscope.llm.common import Scope, discard, scope, stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list[Scope] = []


def stage(work: Stage) -> Stage:
    """A stage that first frees what the one before left behind. Its result has been written by then: docs is read from it."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _left:
            _left.pop().free()
        with scope() as own:
            _left.append(own)
            return work(spark, docs, sf_dir)

    return run_stage


@stage
def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(toxicity.learners()))
    return toxicity.drop_toxic(docs, model)


@stage
def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_first(docs)


@stage
def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    classifier = mixing.fit_classifier(docs, mixing.qualities(table(spark, sf_dir, "labels")))
    return mixing.repeated(docs, classifier, mixing.TARGETS, floor=1.0, grow=True)


@stage
def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs, keep=docs.columns)


STAGES = [
    ("toxicity", toxic_out),
    ("ngram_jaccard", near_duplicates_out),
    ("decontamination", benchmark_out),
    ("mixing", mixture),
    ("sharding", shards),
]

#: Classifiers decide in two of the stages, which SQL can't express; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written, read by the next stage, and deleted after that."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for i, (name, work) in enumerate(STAGES):
        docs = work(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage-{name}")
            if before is not None:
                discard(before)
            before = docs
    return docs
