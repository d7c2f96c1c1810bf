"""Page-level operators on spans: routing, reading order, spacing, texts, colours, review.

Every operator keys on the columns in `page` and keeps all work of a page in one group, so one partitioning by page
serves all of them. span_id is the source order and the last key of every sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope import config
from folioscope.functions import geometry, text
from folioscope.functions.columns import pairs

PAGE = ["page_no"]


def routed(spans: DataFrame, header_bottom: Column) -> DataFrame:
    """spans with in_header, section and the two near-miss flags; blank spans go.

    A span is an annotation (not in the header), else a production mark, else header or body by its top edge. What the
    rules ask of a text and of a colour is worked out once a span."""
    t, c, h = F.col("text"), F.col("color_hex"), F.col("in_header")
    s = spans.filter(text.strip(F.col("text")) != "").withColumns({
        "in_header": F.col("y0") < header_bottom, "_dim": text.is_dimension(t), "_arrow": text.is_arrow(t), "_mark": text.is_mark(t),
        "_near": geometry.is_annotation_color(c), "_shape": text.strip(t).rlike(config.MARK_SHAPE),
    }).withColumn("_annotation", ~h & ((F.col("_dim") & F.col("_near")) | F.col("_arrow")))
    kept = ~F.col("_annotation") & ~F.col("_mark")
    return s.withColumns({
        "section": F.when(F.col("_annotation"), "annotation").when(F.col("_mark"), "production_mark").when(h, "header").otherwise("body"),
        "annotation_near_miss": kept & ~h & F.col("_dim") & ~F.col("_near"), "mark_near_miss": kept & F.col("_shape") & F.col("_near"),
    }).drop("_dim", "_arrow", "_mark", "_near", "_shape", "_annotation")


SECTIONS = ("annotation", "production_mark", "header", "body")


def section_counts(spans: DataFrame, page: list[str] = PAGE) -> DataFrame:
    return spans.groupBy(*page).agg(*[F.count_if(F.col("section") == s).alias(f"n_{s}") for s in SECTIONS], F.count_if("annotation_near_miss").alias("n_annotation_near_miss"), F.count_if("mark_near_miss").alias("n_mark_near_miss"))


def color_histogram(spans: DataFrame, page: list[str] = PAGE) -> DataFrame:
    """Spans by colour, whether the colour is unknown, and whether it is inferred to be a callout colour.

    Annotations count as spans of their colour; what is inferred rests on header and body alone."""
    copy = F.lit(True) if "section" not in spans.columns else F.col("section").isin("header", "body")
    dim = text.is_dimension(F.col("text"))
    used = spans.withColumn("color_hex", F.lower("color_hex")).filter("color_hex != ''")
    used = used if "section" not in spans.columns else used.filter("section != 'production_mark'")
    by = used.groupBy(*page, "color_hex").agg(F.count("*").alias("spans"), F.count_if(copy & dim).alias("dims"), F.count_if(copy & ~dim).alias("others"))
    known = geometry.is_annotation_color(F.col("color_hex"))
    return by.withColumn("unknown", ~known).select(*page, "color_hex", "spans", "unknown", (F.col("unknown") & (F.col("dims") >= config.INFERRED_SPANS) & (F.col("others") == 0)).alias("inferred"))


def histogram(colors: DataFrame, page: list[str] = PAGE) -> DataFrame:
    """One row a page: colours by falling use, unknown ones, and inferred callout colours. colors: color_histogram()."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("spans")).alias("n"), "color_hex")))
    some = lambda flag: F.array_sort(F.collect_list(F.when(F.col(flag), F.col("color_hex"))))
    return colors.groupBy(*page).agg(F.transform(order, lambda c: F.struct(c["color_hex"].alias("color_hex"), (-c["n"]).alias("spans"))).alias("histogram"), some("unknown").alias("unknown_colors"), some("inferred").alias("inferred_annotation_colors"))


def first_order(spans: DataFrame, page: list[str] = PAGE) -> DataFrame:
    """spans with pos: by top, then left edge in whole points; then source order."""
    return spans.withColumn("pos", F.row_number().over(Window.partitionBy(*page).orderBy("y0", geometry.snap(F.col("x0")), "span_id")))


def reading_order(spans: DataFrame, page: list[str] = PAGE) -> DataFrame:
    """spans with pos: by zone, column, top and left, in whole points; then in the first order."""
    zone = F.coalesce("zone", F.lit("z_outside")) if "zone" in spans.columns else F.lit("")
    w = Window.partitionBy(*page).orderBy(zone, F.bround(geometry.snap(F.col("x0")) / config.COLUMN_PT), geometry.snap(F.col("y0")), geometry.snap(F.col("x0")), "y0", "span_id")
    return spans.withColumn("pos", F.row_number().over(w))


def line_spacing(spans: DataFrame, page: list[str] = PAGE) -> DataFrame:
    """spans (with pos, zone, turn) with line_spacing to the next span of the page, if that is the next line of the same column.

    size and y1 are the true ones, as read."""
    w = Window.partitionBy(*page).orderBy("pos")
    bucket = F.struct(F.coalesce("zone", F.lit("z_outside")), F.bround(geometry.snap(F.col("x0")) / config.COLUMN_PT), "turn")
    n = F.lead(F.struct(bucket.alias("b"), F.col("size"), F.col("y1"))).over(w)
    gap = n["y1"] - F.col("y1")
    fits = (n["b"] == bucket) & (F.col("size") > 0) & (n["size"] > 0) & (F.abs(n["size"] - F.col("size")) <= config.SPACING_TOLERANCE * F.col("size")) & (gap > 0) & (gap <= 4 * F.col("size"))
    return spans.withColumn("line_spacing", F.when(fits, F.bround(gap / F.col("size"), 2)))


def page_text(spans: DataFrame, page: list[str] = PAGE) -> DataFrame:
    """body_text (upright spans) and body_text_all, in order of pos."""
    def joined(keep: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("pos", "text")))), lambda x: x["text"]), " ")
    return spans.groupBy(*page).agg(joined(F.col("turn") == 0).alias("body_text"), joined(F.lit(True)).alias("body_text_all"))


def rotated(spans: DataFrame, page: list[str] = PAGE) -> DataFrame:
    return spans.filter("rotation_deg != 0").select(*page, "span_id", "text", "rotation_deg", geometry.rotation_name(F.col("rotation_deg")).alias("rotation_sop"))


def extents(boxes: DataFrame, page: list[str] = PAGE) -> DataFrame:
    """The extent of all boxes of a page in mm."""
    edges = {"x0": F.min, "y0": F.min, "x1": F.max, "y1": F.max}
    return boxes.groupBy(*page).agg(*[geometry.mm(f(c)).alias(f"{c}_mm") for c, f in edges.items()])


def item_folds(paths: DataFrame, header_bottom: Column, frame: DataFrame, page: list[str]) -> DataFrame:
    """x (rounded) and part (true) of the items that can be fold lines: line segments and rectangles narrower than 3 pt.

    They must be taller than the share of the frame's height and reach below the header."""
    i = F.col("i")
    items = paths.filter(F.col("y1") > header_bottom).select(*page, header_bottom.alias("bottom"), F.explode("items").alias("i")).join(frame, page)
    line = i["op"] == "l"
    left = F.when(line, F.least(i["x0"], i["x1"])).otherwise(i["x0"])
    low = F.when(line, F.greatest(i["y0"], i["y1"])).otherwise(i["y1"])
    tall = F.abs(i["y1"] - i["y0"]) > config.ZONE_FOLD * F.col("fh")
    return items.filter(i["op"].isin("l", "re") & (F.abs(i["x1"] - i["x0"]) < 3) & tall & (low > F.col("bottom"))).select(*page, F.bround(left).alias("x"), F.lit(True).alias("part"))


def zones(paths: DataFrame, header_bottom: Column, page: list[str] = PAGE) -> DataFrame:
    """Zones between tall narrow paths below the header: zone_no (of those kept), zone_id, their box, and its size in mm.

    Only pages with two lines or more have any. Where whole paths give fewer than two lines and paths has `items`, their
    vertical segments and thin rectangles count too. The outer edges are those of the artwork, in whole points."""
    body = paths.filter(F.col("y0") >= header_bottom)
    frame = body.groupBy(*page).agg(F.min("x0").alias("fx0"), F.max("x1").alias("fx1"), F.min("y0").alias("fy0"), F.max("y1").alias("fy1")).withColumn("fh", F.greatest(F.col("fy1") - F.col("fy0"), F.lit(1.0)))
    tall = body.join(frame, page).filter((F.abs(F.col("x1") - F.col("x0")) < 3) & (F.abs(F.col("y1") - F.col("y0")) > config.ZONE_FOLD * F.col("fh")))
    found = tall.select(*page, F.bround("x0").alias("x"), F.lit(False).alias("part"))
    if "items" in paths.columns:
        found = found.unionByName(item_folds(paths, header_bottom, frame, page))
    sets = found.groupBy(*page).agg(F.collect_set(F.when(~F.col("part"), F.col("x"))).alias("whole"), F.collect_set("x").alias("any"))
    lines = sets.select(*page, F.when(F.size("whole") >= 2, F.col("whole")).otherwise(F.col("any")).alias("xs")).filter(F.size("xs") >= 2)
    cuts = lines.join(frame, page).withColumn("c", F.array_sort(F.array_distinct(F.concat(F.array(F.bround("fx0")), "xs", F.array(F.bround("fx1"))))))
    strips = cuts.select(*page, "fy0", "fy1", F.posexplode(pairs(F.col("c"))).alias("i", "z")).filter(F.col("z.hi") - F.col("z.lo") >= config.ZONE_MIN_PT)
    number = F.row_number().over(Window.partitionBy(*page).orderBy("i")) - 1
    return strips.select(
        *page, number.alias("zone_no"), F.concat(F.lit("panel_"), number.cast("string")).alias("zone_id"), F.col("z.lo").alias("x0"), F.col("fy0").alias("y0"), F.col("z.hi").alias("x1"), F.col("fy1").alias("y1"),
        geometry.mm(F.col("z.hi") - F.col("z.lo")).alias("width_mm"), geometry.mm(F.col("fy1") - F.col("fy0")).alias("height_mm"),
    )


def in_zones(spans: DataFrame, zones_: DataFrame, page: list[str] = PAGE) -> DataFrame:
    """spans with zone: the first zone whose box has the centre of the span's box in whole points, `outside`, or null on pages without zones."""
    cx, cy = ((geometry.snap(F.col(f"s.{a}0")) + geometry.snap(F.col(f"s.{a}1"))) / 2 for a in "xy")
    z = zones_.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("zone_no", "zone_id", "x0", "y0", "x1", "y1"))).alias("zs"))
    hit = F.filter("zs", lambda z: (cx >= z["x0"]) & (cx <= z["x1"]) & (cy >= z["y0"] - config.ZONE_Y_PT) & (cy <= z["y1"] + config.ZONE_Y_PT))
    return spans.alias("s").join(z, page, "left").withColumn("zone", F.when(F.col("zs").isNotNull(), F.coalesce(F.try_element_at(hit, F.lit(1))["zone_id"], F.lit("outside")))).drop("zs")


def page_kind(has_grid: Column, n_text: Column, n_paths: Column, n_fonts: Column) -> Column:
    """A drawn header makes a component. Else nothing at all is blank, paths without any text and font outlined text or, if few, a drawing; the rest is illustration."""
    empty = n_text == 0
    return (
        F.when(has_grid, "component").when(empty & (n_paths == 0), "blank").when(empty & (n_fonts == 0) & (n_paths >= config.OUTLINED_PATHS), "outlined_text")
        .when(empty, "technical_drawing").otherwise("illustration")
    )


def kept_spacing(spacing: Column, name: Column, name_detected: Column) -> Column:
    """Line spacing of inserts, and of pages whose name was not found and that may be inserts; null for others."""
    return F.when(F.lower(name).contains("insert") | ~name_detected, spacing)


def review(pages: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """pages with review_reasons, in the order of the rules, and needs_review."""
    out = pages.withColumn("review_reasons", F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules]), F.isnotnull))
    return out.withColumn("needs_review", F.size("review_reasons") > 0)


def rollup(pages: DataFrame, doc: str) -> DataFrame:
    """One row a document: pages, failed pages, sums, sorted distinct reasons (a failed page's first) and needs_review.

    Where pages has them, unresolved damage is summed and reasons to skip reading again are listed."""
    reasons = F.array_sort(F.array_distinct(F.flatten(F.collect_list("review_reasons"))))
    failed = F.count_if("failed")
    more = [F.sum("unresolved").alias("total_unresolved")] * ("unresolved" in pages.columns) + [F.array_sort(F.collect_set("skip_reason")).alias("ocr_skip_reasons")] * ("skip_reason" in pages.columns)
    return pages.groupBy(doc).agg(
        F.count("*").alias("page_count"), failed.alias("failed_pages"), F.sum("repairs").alias("total_repairs"),
        F.array_join(F.when(failed > 0, F.concat(F.array(F.lit("page_extraction_failed")), reasons)).otherwise(reasons), ",").alias("review_reasons"),
        (F.max("needs_review") | (failed > 0)).alias("needs_review"), *more,
    )


def paragraphs(spans: DataFrame, page: list[str] = PAGE) -> DataFrame:
    """Paragraphs with raised and lowered small spans marked: page, block_no, text.

    spans: block_no, line_no, span_id, text, size, y0, y1. Texts are repaired first. The base line is the mean middle of a
    line's spans that are not small. Spans of a line join without a separator, lines by a blank."""
    line = Window.partitionBy(*page, "block_no", "line_no")
    mid = (F.col("y0") + F.col("y1")) / 2
    s = spans.filter(F.length("text") > 0).withColumns({"snapped": geometry.snap_size(F.col("size")), "text": text.repair(F.col("text"))["text"]})
    s = s.withColumn("small", F.col("snapped") < config.SMALL_FONT * F.max("snapped").over(line))
    s = s.withColumn("base", F.avg(F.when(~F.col("small"), mid)).over(line))
    marked = F.when(F.col("small") & (mid < F.col("base") - config.RAISED_PT), F.concat(F.lit("<sup>"), "text", F.lit("</sup>"))).when(F.col("small") & (mid > F.col("base") + config.RAISED_PT), F.concat(F.lit("<sub>"), "text", F.lit("</sub>"))).otherwise(F.col("text"))
    lines = s.groupBy(*page, "block_no", "line_no").agg(text.strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_id", marked.alias("t")))), lambda x: x["t"]), "")).alias("t"))
    blocks = lines.filter("t != ''").groupBy(*page, "block_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "t"))), lambda x: x["t"]), " ").alias("text"))
    return blocks.filter(F.length("text") > 1)


def segments(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Parts of a span between runs of two blanks or more: keys, segment_no, text (repaired), box. spans: chars (c, x0, y0, x1, y1).

    Characters without a box count for the text, not for the box."""
    c = spans.select(*keys, F.posexplode("chars").alias("i", "c"))
    w = Window.partitionBy(*keys).orderBy("i")
    solid = c.filter(text.strip(F.col("c.c")) != "").withColumn("gap", F.col("i") - F.lag("i").over(w) - 1)
    solid = solid.withColumn("segment_no", F.sum((F.coalesce("gap", F.lit(0)) >= config.SEGMENT_GAP).cast("int")).over(w))
    parts = F.array_sort(F.collect_list(F.struct("i", F.concat(F.when(F.col("gap") == 1, F.lit(" ")).otherwise(F.lit("")), F.col("c.c")).alias("t"))))
    box = [f(f"c.{e}").alias(e) for e, f in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max))]
    out = solid.groupBy(*keys, "segment_no").agg(text.strip(F.array_join(F.transform(parts, lambda x: x["t"]), "")).alias("text"), *box)
    return out.withColumn("text", text.repair(F.col("text"))["text"])


def slot(page_no: Column) -> Column:
    """The key and the default name of a page, counted from 1."""
    n = page_no.cast("string")
    return F.struct(F.concat(F.lit("page"), n).alias("key"), F.concat(F.lit("page "), n).alias("name"))


UNRESOLVED = ("guessed", "ocr_disagreement", "failed")


def repair_counts(spans: DataFrame, page: list[str] = PAGE) -> DataFrame:
    """Header and body spans of a page: how many were repaired, how many are in doubt, and the fonts in which these and confirmed guesses stand."""
    s = spans.filter("section in ('header', 'body')")
    doubt = F.coalesce(F.col("confidence").isin(*UNRESOLVED), F.lit(False))
    fonts = F.collect_set(F.when(doubt | (F.col("confidence") == "ocr_confirmed"), F.col("font")))
    return s.groupBy(*page).agg(F.count_if("repaired").alias("repairs"), F.count_if(doubt).alias("unresolved"), F.array_sort(fonts).alias("guessed_fonts"))


def review_rules() -> list[tuple[str, Column]]:
    """Reasons to look at a page again, those first that make the others doubtful. Columns: unresolved, skip_reason, detected, name_detected,
    n_annotation_near_miss, n_mark_near_miss, inferred_annotation_colors."""
    c = F.col
    return [
        ("unresolved_corruption", c("unresolved") > 0), ("ocr", c("skip_reason").isNotNull()), ("header_not_detected", ~c("detected")), ("page_name_not_detected", ~c("name_detected")),
        ("annotation_near_miss", c("n_annotation_near_miss") > 0), ("production_mark_near_miss", c("n_mark_near_miss") > 0), ("unknown_annotation_color", F.size("inferred_annotation_colors") > 0),
    ]


def reviewed(pages: DataFrame) -> DataFrame:
    """pages with review_reasons by all seven rules, and needs_review; a reason to skip reading again is named in its own words."""
    out = review(pages, review_rules())
    named = F.transform("review_reasons", lambda r: F.when(r == "ocr", F.concat(F.lit("ocr_"), F.col("skip_reason"))).otherwise(r))
    return out.withColumn("review_reasons", named)
