"""The pipeline against brute force where there is one, and against what each stage promises of its own input."""

import os
import re

import pytest

import corpus_pipeline
from folioscope.llm import decontaminate, near_dup, queries
from folioscope.llm.common import stored
from tests.llm.test_operators import FOLD, shingle_set

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, SF), "test-stage")
        seen[name] = (before, docs)
        assert docs.columns == columns or name == "sharding"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = seen["toxicity"]
    gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()}
    assert sum(labels.get(i) == 0 for i in gone) <= 1
    before, after = seen["ngram_jaccard"]
    sets = {r.doc_id: shingle_set(r.text) for r in before.collect()}
    kept = {r.doc_id for r in after.collect()}
    alike = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * max(1, len(sets[a] | sets[b]))
    assert not any(alike(a, b) for a in kept for b in kept if a < b)
    assert all(any(alike(a, b) for b in sets if b != a) for a in set(sets) - kept)
    before, after = seen["decontamination"]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    grams = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = word.findall((r.text or "").translate(FOLD))
        n = min(10, len(w))
        grams |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    def hit(t):
        w = word.findall((t or "").translate(FOLD))
        return any(tuple(w[i : i + n]) in grams for n in {len(g) for g in grams} for i in range(len(w) - n + 1))
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect() if not hit(r.text)}
    before, after = seen["mixing"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}
    before, after = seen["sharding"]
    assert sorted((r.doc_id, r.text) for r in after.collect()) == sorted((r.doc_id, r.text) for r in before.collect())


def test_empty_tables_pass_through(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_ten_operators_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLE) <= set(queries.QUERIES)
    assert near_dup.PERCENT == 80 and decontaminate.WINDOW == 10


def test_odd_rows_pass_all_stages(spark, tmp_path):
    """Null ids and texts, empty and very long texts, repeated rows and columns with inner names go through every stage without loss or crash."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).toPandas()[["doc_id", "text"]]
    rows = [(int(i), t) for i, t in docs.itertuples(index=False)]
    rows += [(None, "a text of its own under no id"), (None, None), (9001, None), (9002, ""), (9003, "long " * 60_000), (9004, "said twice over and over again"), (9004, "said twice over and over again")]
    kind = "doc_id long, text string, rate double, copies int, p string, cls long, _hash string, score double, hits string"
    spark.createDataFrame([(i, t, 1.5, 2, "p", 3, "h", 0.9, "x") for i, t in rows], kind).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.rate, r.copies, r.p, r.cls, r.hits) for r in out} == {(1.5, 2, "p", 3, "x")}
    texts_ = {(r.doc_id, r.text) for r in out}
    assert {rows[-1], rows[-7], rows[-6], rows[-5], rows[-4], rows[-3]} <= texts_
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
