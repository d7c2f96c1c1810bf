"""Golden cases of the layout operators, round trips, invariance to row order, and parity with DuckDB."""

import glob
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioscope.functions import geometry, text
from folioscope.operators import artwork, barcodes, clusters, header, pages
from folioscope.plans import catalogue

SF = "/root/testdata/sf0.001"
LOST = text.LOST


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("bad,good", [("conƟene", "contiene"), ("ceŌriaxona", "ceftriaxona"), ("30⁰C", "30°C"), ("meƞormina", "metformina"), ("encefalopaơa", "encefalopatía"), ("diİcil", "difícil"), ("BoƩom", "Bottom"), ("Composici贸n", "Composición"), (f"ce{LOST}riaxona", "ceftriaxona"), (f"pancrea{LOST}{LOST}s", "pancreatitis"), (f"{LOST}stulas", "fístulas"), (f"{LOST}tanio", "Titanio"), (f"ac{LOST}vidad", "actividad"), ("plain", "plain")])
def test_repair(spark, bad, good):
    text.enable_gbk(spark)
    assert one(spark, text.repair(F.lit(bad)))["text"] == good


def test_two_lost_glyphs_stay_and_fail(spark):
    text.enable_gbk(spark)
    got = one(spark, text.repair(F.lit(f"Composici{LOST}{LOST}n")))
    assert "titi" not in got["text"] and got["confidence"] == "failed"


@pytest.mark.parametrize("t,want", [("Pasting Side 1", True), ("Varnish Free 2", True), ("Stereo printing instructions are documented in the batch record", False), ("Pantone No.", False), ("Pasting-Side 1", True), ("Pasting Side:", True), ("scale 1:1", True)])
def test_production_marks(spark, t, want):
    assert one(spark, text.is_mark(F.lit(t))) is want


@pytest.mark.parametrize("c,want", [("#196ea6", True), ("#3373a8", True), ("#231f20", False), ("#008ccc", True), ("nonsense", False)])
def test_annotation_colors(spark, c, want):
    assert one(spark, geometry.is_annotation_color(F.lit(c))) is want


def test_scalars(spark):
    assert one(spark, geometry.rotation_name(geometry.rotation(F.lit(0.0), F.lit(-1.0)))) == "90_CCW"
    assert one(spark, text.label_key(F.lit("Size (LxW)"))) == "size lxw"
    assert one(spark, geometry.snap_size(F.lit(2.75))) == 3.0
    assert one(spark, text.canonical(F.lit("Repeat Outer"))) == "repeat_outer" and one(spark, text.canonical(F.lit("Artwork Size:"))) == "artwork_size"
    assert one(spark, geometry.channels_hex(F.array(F.lit(0.5), F.lit(0.0), F.lit(1.0)))) == "#7f00ff"
    assert one(spark, barcodes.check_digit(F.lit("890800121206"))) == 9


def test_header_keeps_declared_values(spark):
    s = spark.createDataFrame([(1, 1, 10.0, "60 mm", "#0000ff"), (1, 2, 300.0, "38.00 mm", "#196ea6"), (1, 3, 300.0, "12 mm", "#231f20")], "page_no int, span_id int, y0 double, text string, color_hex string")
    got = {r.span_id: r for r in pages.routed(s, F.lit(100.0)).collect()}
    assert [got[i].section for i in (1, 2, 3)] == ["header", "annotation", "body"] and got[3].annotation_near_miss


def test_barcode_of_a_known_code(spark):
    df = spark.createDataFrame([("8908001212069",)], "code string").withColumn("m", barcodes.encoded(F.col("code")))
    got = barcodes.decoded(barcodes.symbols(barcodes.drawn(df, ["code"], "m"), ["code"])).first()
    assert got.value == got.code and got.check_digit_valid and len(got.bars) == 30


def test_foil_sheet_has_two_components_in_any_order(spark):
    rows = [(1, 1, 0.0, 0.0, 70.0, 30.0), (1, 2, 131.0, 0.0, 201.0, 30.0), (1, 3, 140.0, 5.0, 148.0, 13.0), (1, 4, 70.3, 30.0, 80.0, 40.0)]
    kind = "page_no int, o int, x0 double, y0 double, x1 double, y1 double"
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        got = {r.o: r.component for r in clusters.touching(spark.createDataFrame(order, kind), ["page_no"], "o", 0.5).collect()}
        assert got == {1: 1, 4: 1, 2: 2, 3: 2}


def test_blocks_split_at_wide_gaps(spark):
    rows = [(1, i, 0.0, y, 30.0, y + 3, f"t{i}") for i, y in enumerate((0.0, 4.3, 8.6, 16.1))]
    got = artwork.loose_blocks(spark.createDataFrame(rows, "page_no int, span_id int, x0 double, y0 double, x1 double, y1 double, text string"), ["page_no"]).orderBy("y0").collect()
    assert [r.text for r in got] == ["t0 t1 t2", "t3"]


def test_callout_prefers_its_own_number(spark):
    lines = spark.createDataFrame([(1, x, x, 0.0, 50.0) for x in (10.0, 15.0, 163.0, 168.0)], "page_no int, x0 double, x1 double, y0 double, y1 double")
    label = spark.createDataFrame([(1, 1, "158 mm", 80.0, 20.0, 90.0, 24.0), (1, 2, "5 mm", 300.0, 20.0, 310.0, 24.0)], "page_no int, span_id int, text string, x0 double, y0 double, x1 double, y1 double")
    got = {r.span_id: r for r in artwork.callouts(label, lines, ["page_no"]).collect()}
    assert (got[1].lo_mm, got[1].hi_mm, got[1].matches_label) == (10.0, 168.0, True) and got[2].measured_mm is None


def test_label_without_neighbour_has_no_value(spark):
    rows = [(1, 1, 20.0, 40.0, 90.0, 48.0, "Version:"), (1, 2, 400.0, 41.0, 420.0, 49.0, "prose"), (1, 3, 500.0, 40.0, 510.0, 48.0, "7")]
    s = spark.createDataFrame(rows, "page_no int, span_id int, x0 double, y0 double, x1 double, y1 double, text string")
    assert header.values_for(s, ["page_no"], "version", r"^(?:[\d.]+)$").first().value == "7"
    assert header.values_for(s.filter("span_id < 2"), ["page_no"], "version").count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_parity(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = con.execute(catalogue.ORACLE[name]).df()
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)

    def rows(df):
        plain = lambda v: None if pd.isna(v) else bool(v) if hasattr(v, "dtype") and v.dtype.kind == "b" else round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else v
        return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)

    assert rows(got) == rows(want)


def test_fold_lines_inside_a_compound_path(spark):
    """One drawing holds the whole dieline; where whole paths give two lines, items add none."""
    items = [("l", 10.0, 40.0, 10.4, 400.0), ("l", 120.2, 400.0, 120.2, 50.0), ("re", 250.0, 50.0, 252.0, 390.0), ("l", 300.0, 50.0, 300.0, 60.0), ("l", 60.0, 90.0, 200.0, 300.0), ("c", 180.0, 50.0, 180.0, 400.0), ("l", 330.0, 0.0, 330.0, 30.0)]
    rows = [(1, 0.0, 40.0, 400.0, 400.0, items), (2, 0.0, 40.0, 400.0, 400.0, items), (2, 100.0, 50.0, 101.0, 390.0, None), (2, 200.0, 50.0, 201.0, 390.0, None), (3, 0.0, 40.0, 400.0, 400.0, None), (4, 0.0, 0.0, 400.0, 400.0, items)]
    paths = spark.createDataFrame(rows, "page_no int, x0 double, y0 double, x1 double, y1 double, items array<struct<op:string,x0:double,y0:double,x1:double,y1:double>>")
    got = sorted((r.page_no, r.zone_no, r.x0, r.x1) for r in pages.zones(paths, F.lit(35.0)).collect())
    assert got == [(1, 0, 10.0, 120.0), (1, 1, 120.0, 250.0), (1, 2, 250.0, 400.0), (2, 0, 0.0, 100.0), (2, 1, 100.0, 200.0), (2, 2, 200.0, 400.0)]
