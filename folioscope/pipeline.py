"""From layout tables to page facts, header tables, components and documents: the stages of extraction in order, all keyed by document and page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope import config
from folioscope.functions import geometry, text
from folioscope.operators import assembly, barcodes, details, header, pages
from folioscope.sources.scratch import Scratch

KEY = ["doc_id", "page_no"]


def spans_of(layout: dict[str, DataFrame], bottom: DataFrame) -> DataFrame:
    """Text spans with all their facts, routed to sections, body and header spans unplaced yet. Boxes in points and, under *_mm, in mm."""
    s = layout["spans"].filter("block_type = 0").join(bottom, KEY)
    raw = F.when(F.size("chars") > 0, F.array_join(F.transform("chars", lambda c: c["c"]), "")).otherwise(F.col("text"))
    s = s.withColumn("text_raw", raw).withColumns({
        "fix": text.repair(F.col("text_raw")), "color_hex": geometry.packed_hex(F.col("color")), "rotation_deg": geometry.rotation(F.col("dir_x"), F.col("dir_y")), "font_name": geometry.base_font(F.col("font")),
        "font_size_pt": geometry.snap_size(F.col("size")), "font_size_pt_raw": F.bround("size", 3), "bold": geometry.is_bold(F.col("font"), F.col("flags")), "italic": geometry.is_italic(F.col("font"), F.col("flags")),
        "bbox": F.transform(F.array("x0", "y0", "x1", "y1"), geometry.snap), "bbox_mm": geometry.box_mm(F.array("x0", "y0", "x1", "y1")), "alignment": details.alignment(F.col("chars"), assembly.box()),
    })
    s = s.withColumns({"text": F.col("fix.text"), "repaired": F.col("fix.repaired"), "confidence": F.col("fix.confidence"), "repair_log": F.col("fix.log"), "rotation_sop": geometry.rotation_name(F.col("rotation_deg")), "turn": F.col("rotation_deg")}).drop("fix")
    return pages.routed(s, F.col("threshold_pt"))


def snapped(df: DataFrame) -> DataFrame:
    """df with its box in whole points."""
    return df.withColumns({c: geometry.snap(F.col(c)) for c in assembly.BOX})


def in_mm(df: DataFrame) -> DataFrame:
    """df with its box in mm, as rounded for output."""
    return df.withColumns({c: F.col("bbox_mm")[i] for i, c in enumerate(assembly.BOX)})


def extract(layout: dict[str, DataFrame], house: str = "", ocr: bool = False, scratch: Scratch | None = None) -> dict[str, DataFrame]:
    """layout: pages, spans, words, drawings and images. Returns everything that is known of the documents, as flat tables by page.

    header_region, spans (routed, zoned, ordered, repaired), zones, paths, images, barcodes, ac_reference, dimension_check,
    color_profile, rotated, header_pairs, header_unassigned, header_tables, the tables of assembly.component, pages (facts,
    kind and review reasons) and documents. What several of them read (routed spans, zones, paths, header pairs) is written
    once to the shared folder; scratch.drop() deletes that when all that is wanted has been read."""
    settled = (scratch or Scratch(layout["pages"].sparkSession)).settled
    sheet = layout["pages"].withColumns({"width_mm": geometry.mm(F.col("width_pt")), "height_mm": geometry.mm(F.col("height_pt"))})
    region = settled(header.header_region(header.rows_of_words(layout["words"], KEY), sheet, KEY))
    bottom = region.select(*KEY, "threshold_pt")
    spans = settled(spans_of(layout, bottom))
    zones = settled(pages.zones(layout["drawings"].join(bottom, KEY), F.col("threshold_pt"), KEY))
    body = pages.in_zones(spans.filter("section = 'body'"), zones, KEY)
    body = settled(pages.line_spacing(pages.reading_order(body, KEY), KEY))
    others = spans.filter("section != 'body'").withColumns({"zone": F.lit(None).cast("string"), "pos": F.col("span_id"), "line_spacing": F.lit(None).cast("double")})
    ordered = body.unionByName(others, allowMissingColumns=True)
    # page names come from header spans in source order and body spans in the first order; span ids stand in for both
    first = pages.first_order(body.drop("pos"), KEY).withColumn("span_id", F.col("pos")).select(*KEY, "span_id", "section", "text", *assembly.BOX)
    named = details.page_names(snapped(first.unionByName(others.filter("section = 'header'").select(*first.columns))), KEY, F.lit(None).cast("string"))
    names = sheet.select(*KEY).join(named, KEY, "left").select(*KEY, F.coalesce("name", pages.slot(F.col("page_no"))["name"]).alias("name"), F.coalesce("detected", F.lit(False)).alias("name_detected"))
    names = settled(names)
    ordered = ordered.join(names, KEY).withColumn("line_spacing", pages.kept_spacing(F.col("line_spacing"), F.col("name"), F.col("name_detected"))).drop("name", "name_detected")
    ordered = settled(ordered)
    paths = settled(details.paths(layout["drawings"]))
    head = ordered.filter("section = 'header'")
    # all spans in the order in which the printed reference is looked for
    place = F.when(F.col("section") == "body", 0).when(F.col("section") == "header", 1).when(F.col("section") == "annotation", 2)
    searched = in_mm(ordered.filter("section != 'production_mark'").withColumns({"ord": F.struct(place.alias("s"), F.col("pos").alias("p")), "in_header": F.col("section") == "header"}))
    texts = pages.page_text(body, KEY)
    reference = settled(header.ac_reference(snapped(head), searched, KEY, texts.select(*KEY, "body_text_all")))
    mm_paths = in_mm(paths)
    sizes = header.dimension_check(snapped(head), ordered, header.component_rects(mm_paths, sheet, KEY), KEY)
    colors = pages.color_histogram(ordered, KEY)
    summary = pages.histogram(colors, KEY)
    symbols = barcodes.decoded(barcodes.symbols(barcodes.bars_of(layout["drawings"], KEY), KEY))
    formats = {"font": F.col("font_name"), "size": F.col("font_size_pt")}
    flat = paths.withColumns({c: F.col("bbox")[i] for i, c in enumerate(assembly.BOX)})
    table = {k: settled(v) for k, v in assembly.header_table(snapped(head).withColumns(formats), flat, KEY, settled).items()}
    said = assembly.declared(table["pairs"], KEY)
    frames = reference.select(*KEY, F.when(F.col("on_pack_position").isNotNull(), F.col("bounds")).alias("artboard"))
    ends = table["tables"].select(*KEY, F.col("table_bbox_mm")[3].alias("end"), "grid_convention")
    meta = settled(sheet.join(said, KEY, "left").join(frames, KEY, "left").join(ends, KEY, "left").withColumn("header_bottom_mm", F.coalesce("end", F.col("height_mm") * config.HEADER_FALLBACK)))
    made = assembly.component(in_mm(body.withColumn("span_id", F.col("pos"))), mm_paths, in_mm(ordered.filter("section = 'annotation'")), meta, KEY, house, settled)
    damage = pages.repair_counts(ordered, KEY)
    ladder = details.ocr_ladder(ordered.filter("section in ('header', 'body')"), KEY, ocr)
    n_paths = paths.groupBy(*KEY).agg(F.count("*").alias("n_paths"))
    n_zones = zones.groupBy(*KEY).agg(F.count("*").alias("zones_detected"))
    facts = sheet.join(region.select(*KEY, "detected", "rows_absorbed"), KEY).join(names, KEY)
    for t in (pages.section_counts(ordered, KEY), texts, damage, ladder, summary, n_paths, n_zones, ends.select(*KEY, "grid_convention")):
        facts = facts.join(t, KEY, "left")
    counts = [f"n_{s}" for s in (*pages.SECTIONS, "annotation_near_miss", "mark_near_miss")]
    facts = facts.fillna(0, [*counts, "repairs", "unresolved", "n_paths", "zones_detected", "ocr_spans"]).fillna("", ["body_text", "body_text_all"])
    facts = facts.withColumn("inferred_annotation_colors", F.coalesce("inferred_annotation_colors", F.array().cast("array<string>")))
    n_text = F.col("n_header") + F.col("n_body") + F.col("n_annotation") + F.col("n_annotation_near_miss") + F.col("n_production_mark")
    facts = pages.reviewed(facts.withColumn("page_kind", pages.page_kind(F.col("grid_convention").isNotNull(), n_text, F.col("n_paths"), F.col("font_count"))))
    documents = pages.rollup(facts.withColumn("failed", F.lit(False)), "doc_id")
    return {
        "header_region": region, "spans": ordered, "zones": zones, "paths": paths, "images": details.images(layout["images"]), "barcodes": symbols, "ac_reference": reference, "dimension_check": sizes, "color_profile": summary,
        "rotated": pages.rotated(ordered.filter("section = 'body'"), KEY), "header_pairs": table["pairs"], "header_unassigned": table["unassigned"], "header_tables": table["tables"],
        **{f"artwork_{k}": v for k, v in made.items()}, "pages": facts, "documents": documents,
    }


def as_documents(out: dict[str, DataFrame], keep: list[str] | None = None) -> DataFrame:
    """doc_id and json: each document's facts and its pages in order, every page with its facts and the rows of the other tables.

    out: extract()'s tables; keep: the names of those to nest, all by default. Rows of a page are gathered in one array, which a page's size bounds."""
    pages_ = out["pages"].select(*KEY, F.struct(*[c for c in out["pages"].columns if c not in KEY]).alias("facts"))
    parts = ["facts"]
    for name in keep or [n for n in out if n not in ("pages", "documents")]:
        rows = out[name].select(*KEY, F.struct(*[c for c in out[name].columns if c not in KEY]).alias("row"))
        pages_ = pages_.join(rows.groupBy(*KEY).agg(F.collect_list("row").alias(name)), KEY, "left")
        parts.append(name)
    page = F.struct(pages.slot(F.col("page_no"))["key"].alias("key"), *parts)
    by = pages_.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_no", F.to_json(page, {"ignoreNullFields": "false"}).alias("json")))), lambda p: p["json"]).alias("pages"))
    meta = out["documents"].select("doc_id", F.to_json(F.struct(*[c for c in out["documents"].columns if c != "doc_id"]), {"ignoreNullFields": "false"}).alias("meta"))
    return by.join(meta, "doc_id").select("doc_id", F.concat(F.lit('{"document_meta":'), "meta", F.lit(',"pages":['), F.array_join("pages", ","), F.lit("]}")).alias("json"))
