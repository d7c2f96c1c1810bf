"""Golden cases of the smaller page facts, the page pipeline and the stream wrapper."""

import json

import pytest
from pyspark.sql import functions as F

from folioscope.functions import text
from folioscope.operators import barcodes, details
from folioscope.pipeline import as_documents, extract
from folioscope.sources import layout, sinks
from folioscope.streaming import run_batches, stream_layout

BOX = "x0 double, y0 double, x1 double, y1 double"


@pytest.mark.parametrize("t,want", [("Component Type: Carton", "Carton"), ("Componet Typ: Foil strip", "Foil strip"), ("component type", ""), ("Type of component", None), ("word", None)])
def test_component_type(spark, t, want):
    assert spark.range(1).select(details.after_component_type(F.lit(t)).alias("x")).first().x == want


def test_page_name_from_the_right_neighbour(spark):
    rows = [(1, 1, "header", 10.0, 10.0, 60.0, 20.0, "Component Type"), (1, 2, "header", 90.0, 11.0, 130.0, 21.0, "Insert"), (1, 3, "header", 200.0, 11.0, 230.0, 21.0, "far"), (2, 1, "body", 0.0, 0.0, 5.0, 5.0, "text")]
    s = spark.createDataFrame(rows, f"page_no int, span_id int, section string, {BOX}, text string")
    got = {r.page_no: (r.name, r.detected) for r in details.page_names(s, ["page_no"], F.lit("page")).collect()}
    assert got == {1: ("Insert", True), 2: ("page", False)}


def test_alignment_and_verdicts(spark):
    df = spark.sql("select array(named_struct('c', 'A', 'x0', 0D, 'y0', 0D, 'x1', 5D, 'y1', 9D), named_struct('c', ':', 'x0', 5D, 'y0', 0D, 'x1', 7D, 'y1', 9D), named_struct('c', ' ', 'x0', 7D, 'y0', 0D, 'x1', 9.5D, 'y1', 9D)) as chars, named_struct('x0', 0D, 'y0', 0D, 'x1', 9.5D, 'y1', 9D) as box")
    got = df.select(details.alignment(F.col("chars"), F.col("box")).alias("a")).first().a
    assert got.visible_bbox_mm[2] == 2.47 and [(c["index"], c.x0_mm) for c in got.colons] == [(1, 1.76)]
    assert spark.range(1).select(details.ocr_verdict(F.lit("a  B"), F.lit("A b")).alias("x")).first().x == "ocr_confirmed"


def test_groups_say_where_spans_disagree(spark):
    rows = [(1, 1, 0.0, 0.0, 5.0, 9.0, "a", "F", 8.0, True, None, "#0"), (1, 2, 6.0, 0.0, 9.0, 9.0, "b", "G", 8.0, True, None, "#0")]
    got = details.groups(spark.createDataFrame(rows, f"k int, span_id int, {BOX}, text string, font string, size double, bold boolean, italic boolean, color_hex string"), ["k"]).first()
    assert (got.text, got.font, got.size, got.italic, got.mixed_formatting) == ("a b", None, 8.0, None, True)


def page_tables(spark):
    """One carton: a header of 180 x 48 mm with a cell for each label and value, two faces and a tuck below it, texts, a callout and a barcode."""
    pt = 72 / 25.4
    span = lambda i, x, y, w, t, c=0: ("d", 1, i, 0, i, 0, 1.0, 0.0, t, None, x, y, x + w, y + 8, "AB+Arial-Bold", 8.0, c, 0)
    cells = [("Version:", 30, 40), ("3", 200, 40), ("AC Reference", 30, 60), ("2499", 200, 60), ("Style", 30, 80), ("Side Open Side Open", 200, 80), ("Size in mm (LxWxH)", 30, 100), ("72x20x32 mm", 200, 100), ("Component Type", 30, 120), ("Outer Carton", 200, 120)]
    spans = [span(i, float(x), float(y), 60.0, t) for i, (t, x, y) in enumerate(cells)]
    spans += [span(20, 300.0, 320.0, 30.0, "72.00 mm", 0x196EA6), span(21, 310.0, 400.0, 60.0, "conƟene AC2499V.3"), span(22, 310.0, 411.0, 60.0, "Composición: sal"), span(23, 310.0, 480.0, 60.0, "Pasting-Side 1")]
    words = [("d", 1, r[3], r[2], k, w, r[10] + k, r[11], r[12] - k, r[13]) for r in spans for k, w in enumerate(r[8].split())]
    drawn, n = [], 0

    def rect(x0, y0, x1, y1, kind="s", fill=None, stroke=(0.0,), items=None):
        nonlocal n
        drawn.append(("d", 1, n, kind, list(stroke) if stroke else None, fill, 0.5, float(x0), float(y0), float(x1), float(y1), items))
        n += 1

    rect(20, 30, 20 + 180 * pt, 30 + 48 * pt)
    for y in (36, 56, 76, 96, 116):
        rect(20, y, 150, y + 18)
        rect(150, y, 20 + 180 * pt, y + 18)
    x, y = 300.0, 350.0
    for w, h, dx, dy in ((72, 32, 0, 0), (72, 20, 0, 32), (72, 32, 0, 52), (20, 32, -20, 0), (20, 32, 72, 0)):
        rect(x + dx * pt, y + dy * pt, x + (dx + w) * pt, y + (dy + h) * pt)
    for at in (x, x + 72 * pt):
        rect(at, 310, at + 0.1, 345, stroke=(26 / 255, 110 / 255, 166 / 255))
    code = "8908001212069"
    return spans, words, drawn, code


def test_pipeline_and_stream(spark, tmp_path):
    text.enable_gbk(spark)
    spans, words, drawn, code = page_tables(spark)
    m = spark.range(1).select(barcodes.encoded(F.lit(code)).alias("m"))
    bars = [("re", r.x0 + 400, 600.0, r.x1 + 400, 620.0) for r in barcodes.drawn(m.withColumn("k", F.lit(1)), ["k"], "m").collect()]
    drawn.append(("d", 1, 900, "f", None, [0.0], 0.0, 400.0, 600.0, 495.0, 620.0, bars))
    tables = {
        "pages": spark.createDataFrame([("d", 1, 595.0, 842.0, 1), ("d", 2, 595.0, 842.0, 0)], layout.schema("pages")), "words": spark.createDataFrame(words, layout.schema("words")),
        "spans": spark.createDataFrame(spans, layout.schema("spans")), "drawings": spark.createDataFrame(drawn, layout.schema("drawings")), "images": spark.createDataFrame([("d", 1, 7, 100, 50, 0.0, 0.0, 72.0, 36.0)], layout.schema("images")),
    }
    out = extract(tables)
    page, blank = out["pages"].orderBy("page_no").collect()
    assert (page.n_annotation, page.n_header, page.n_body, page.n_production_mark, page.repairs) == (1, 10, 2, 1, 1)
    assert (page.name, page.name_detected, page.page_kind, page.detected) == ("Outer Carton", True, "component", True)
    assert page.body_text == "contiene AC2499V.3 Composición: sal" and blank.page_kind == "blank" and blank.review_reasons == ["header_not_detected", "page_name_not_detected"]
    table = out["header_tables"].first()
    assert (table.grid_convention, table.table_width_mm, table.table_height_mm, table.column_count) == ("rects", 180.0, 48.0, 2)
    found = {r.canonical: (r.value.text, r.label.cell_source, r.row) for r in out["header_pairs"].collect()}
    assert found["dimension"] == ("72x20x32 mm", "drawn_cell", 4) and found["style"][0] == "Side Open Side Open" and out["header_unassigned"].count() == 0
    ref = out["ac_reference"].filter("page_no = 1").first()
    assert (ref.header_combined, ref.on_pack_instance, ref.consistent, ref.on_pack_position.rotation_deg) == ("AC2499V.3", "AC2499V.3", True, 0)
    sizes = out["dimension_check"].filter("page_no = 1").first()
    assert sizes.declared_mm == [72.0, 20.0, 32.0] and sizes.consistent and sizes.callout_source == "annotations"
    one = out["artwork_components"].orderBy("component_no").collect()  # the second is the barcode's drawing
    assert len(one) == 2 and (one[0].panel_count, one[0].derived_style, one[0].style_agrees, one[0].body_faces_matching_declared_height) == (5, "Side Open Side Open", True, "3/3")
    call = out["artwork_callouts"].first()
    assert (call.measured_mm, call.matches_label, call.measures) == (72.0, True, "panel 1.2 width")
    assert [b.legend for b in out["artwork_blocks"].orderBy("block_no").collect()] == ["ac_reference"] and out["artwork_unplaced"].count() == 0
    assert out["barcodes"].first().value == code and out["images"].first().aspect_ratio == 2.0
    assert out["documents"].first().page_count == 2
    whole = json.loads(as_documents(out, ["spans", "header_tables", "zones"]).first().json)
    assert [p["key"] for p in whole["pages"]] == ["page1", "page2"] and len(whole["pages"][0]["spans"]) == 14 and whole["pages"][1]["spans"] is None and whole["document_meta"]["page_count"] == 2
    tables["spans"].write.parquet(f"{tmp_path}/spans")
    q = run_batches(stream_layout(spark, f"{tmp_path}/spans", "spans"), lambda b: b.groupBy("doc_id").count(), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").first()["count"] == 14
    assert '"x":null' in sinks.as_json(spark.sql("select 1 as k, cast(null as int) as x"), "k", "x").first().json


def test_bad_documents_become_error_rows(spark, tmp_path):
    for name in ("a.pdf", "b.txt"):
        (tmp_path / name).write_bytes(b"x")
    good, bad = layout.read_documents(spark, str(tmp_path))
    assert [r.filename for r in bad.collect()] == ["b.txt"]
    assert "decoder" in layout.decode(good, "pages").first().error
    assert layout.decode(good, "pages", lambda c: iter([{"page_no": 1, "width_pt": 5.0}])).first().width_pt == 5.0
