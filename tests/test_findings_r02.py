"""Cases of the second round's findings that the tables of sf0.01 don't have."""

import collections
import datetime
import re
import types

import duckdb
import numpy as np
import pytest

from folioscope.llm import language_model, near_dup, pii
from folioscope.llm.bytescan import blocks
from folioscope.plans import catalogue


def line(order, number, part):
    return (order, part, 1, number, 5.0, 10.0 * number, 0.0, 0.0, "A", "O", datetime.datetime(2020, 1, 1))


LINEITEM = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"


@pytest.fixture
def lines(spark, tmp_path):
    """A folder whose lineitem is the rows given; the other tables are empty."""

    def write(rows):
        spark.createDataFrame(rows, LINEITEM).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
        for t in ("documents", "customer", "part", "orders"):
            spark.range(0).write.parquet(f"{tmp_path}/{t}.parquet")
        return str(tmp_path)

    return write


def oracle(sf, name):
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from read_parquet('{sf}/lineitem.parquet/*.parquet')")
    return con.execute(catalogue.ORACLE[name]).fetchall()


def test_body_tables_of_long_pages(spark, lines):
    sf = lines([line(k, i, 7 * i) for k in (3, 4, 5, 6) for i in range(1, 24 if k != 6 else 9)])
    got = sorted(map(tuple, catalogue.QUERIES["body_tables"](spark, sf).collect()))
    assert got == sorted(oracle(sf, "body_tables")) and (3, 15, 5) in got


def test_mixer_learns_from_every_place(spark):
    texts = ["ab1 2é c3 -" * 3, "ab1", "", None, "ab1 2"]
    mixer = language_model.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).mixer
    assert mixer.places == sum(len((t or "").encode()) + 1 for t in texts)
    assert all(np.abs(mixer.by_bit[8 * kind : 8 * kind + 8]).sum(1).all() for kind in range(5))


def test_frequent_lessons_count_as_often_as_they_occur(spark):
    """An n-gram that stands for many places is learned in parts, and all its places count."""
    mixer = language_model.fit(spark.createDataFrame([(0, "to be")] + [(i, "or not %d" % (i % 7)) for i in range(1, 501)], "doc_id long, text string")).mixer
    assert mixer.places == 6 + 500 * 9 and np.isfinite(mixer.packed()).all()


def test_tag_scores_are_those_of_the_network_that_learned():
    """emissions() has a layout of its own; what learn() works with must come out of it."""
    network, x = pii.Network(3), np.random.default_rng(0).integers(0, pii.INPUTS, (40, 7)).astype(np.uint8)
    f, b = network.run(x, "f")[0][1:], network.run(x[::-1], "b")[0][1:][::-1]
    assert network.states(x, "f").shape == (40, pii.HIDDEN, 7)
    assert np.allclose(network.emissions(x), np.concatenate([f, b], 2) @ network.p["o"] + network.p["ob"], atol=1e-5)


def test_keep_first_has_one_plan_for_its_rows(spark):
    """The rows meet the dropped ones in a merge join, however few these are."""
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "one two three four five six"), (3, "other"), (None, "one two three four five six")], "doc_id long, text string")
    out = near_dup.keep_first(docs)
    assert re.search("SortMergeJoin .*LeftAnti", out._jdf.queryExecution().sparkPlan().toString())
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 1, 3]


def test_n_grams_that_tasks_pass_on_early(spark, monkeypatch):
    """Tasks that may hold few n-grams give the same counts: here each is passed on in many parts, and grouped once more."""
    monkeypatch.setattr(language_model, "HELD", 64)
    monkeypatch.setattr(language_model, "MOST", 64)
    texts = ["to be or not %d" % (i % 7) for i in range(60)] + ["", None, "x" * 999, "gärten"]
    want = collections.Counter()
    for b in blocks(texts, language_model.GAP):
        want.update(language_model.keys(b)[0].tolist())
    held = language_model.n_grams(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    got = [(r.key, r.n) for r in held.select("key", "n").collect()]
    assert len(got) == len(want) and dict(got) == want


def test_two_keys_of_one_place_are_both_kept(monkeypatch):
    """A worker that has worked out the costs of some keys doesn't do so again, also where two of them have one place."""
    asked = []

    class Model:
        token = "two keys"

        def cost(self, key):
            asked.extend(key.tolist())
            return -(key % 97).astype(float)

    monkeypatch.setattr(language_model, "CACHE", 1)
    monkeypatch.setattr(language_model, "_worked_out", {})
    monkeypatch.setattr(language_model, "sent", lambda spark, model: types.SimpleNamespace(value=model))
    run, text = language_model.scorer(None, Model()), next(blocks(["ab"], language_model.GAP))
    first, again = run(text)["score"], run(text)["score"]
    assert first.tolist() == again.tolist() == [-sum(k % 97 for k in language_model.keys(text)[0].tolist())]
    assert len(asked) == 3


def test_panel_columns_of_equal_boxes(spark, lines):
    """Equal extents that begin a column are one column, as in the SQL where one thread orders both of its windows."""
    sf = lines([line(k, i, part) for k in (1, 2) for i, part in enumerate([3, 3, 20, 20, 39, 39], 1)])
    con = duckdb.connect()
    con.execute("set threads = 1")
    con.execute(f"create view lineitem as select * from read_parquet('{sf}/lineitem.parquet/*.parquet')")
    got = sorted(map(tuple, catalogue.QUERIES["panel_columns"](spark, sf).collect()), key=str)
    assert got == sorted(con.execute(catalogue.ORACLE["panel_columns"]).fetchall(), key=str)
    assert all(r[5] is None or r[5] > 2 for r in got) and len(got) > 2
