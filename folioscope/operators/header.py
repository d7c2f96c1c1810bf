"""Header detection, label lookup, reference and dimension checks, and the header table's grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope import config
from folioscope.functions import geometry, text
from folioscope.functions.columns import pairs
from folioscope.operators import clusters


def rows_of_words(words: DataFrame, page: list[str]) -> DataFrame:
    """Words joined to lines: page, block_no, line_no, text, box."""
    return words.groupBy(*page, "block_no", "line_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "word"))), lambda w: w["word"]), " ").alias("text"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    )


def label_hits(rows: DataFrame) -> DataFrame:
    """Rows with labels, and these, one row each."""
    return rows.withColumn("label", F.explode(text.header_labels(text.label_key(F.col("text")))))


def seed_clusters(hits: DataFrame, page: list[str], gap_pt: float = config.SEED_GAP_MM * 72 / 25.4) -> DataFrame:
    """The page's best cluster of label rows: most distinct labels, topmost of equals: n_labels, y0, y1."""
    w = Window.partitionBy(*page).orderBy("y0")
    seeds = clusters.islands(hits.withColumn("before", F.lag("y0").over(w)), page, ["y0"], F.col("y0") - F.col("before") > gap_pt)
    found = seeds.groupBy(*page, "island").agg(F.countDistinct("label").alias("n_labels"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    best = found.withColumn("best", F.row_number().over(Window.partitionBy(*page).orderBy(F.desc("n_labels"), "y0"))).filter("best = 1")
    return best.filter(F.col("n_labels") >= config.HEADER_MIN_LABELS).drop("best", "island")


def median(values: Column) -> Column:
    """The middle value, or the mean of the two in the middle; 0 without values."""
    n = F.size(values)
    at = lambda i: F.get(F.array_sort(values), F.floor(i).cast("int"))
    return F.when(n > 0, (at((n - 1) / 2) + at(n / 2)) / 2).otherwise(F.lit(0.0))


def header_region(rows: DataFrame, pages_: DataFrame, page: list[str], gap_pt: float = config.SEED_GAP_MM * 72 / 25.4) -> DataFrame:
    """The tabular header of every page, found by its labels: threshold_pt, detected, labels_found, rows_in_band, rows_absorbed, its box in
    points and mm, size in mm, and where it stands.

    rows: text and box of every text row; pages_: width_pt and height_pt. Rows that hold labels are seeds; seeds farther
    apart than gap_pt fall into clusters, and the one of most labels counts, the topmost of equals. With fewer than two
    labels the threshold is a fixed share of the page's height. From the seeds the band grows over the page's rows,
    first down and then up, while a row lies within the tolerance of the row pitch and overlaps the band so far; downwards
    it also has to end in the upper part of the page. Each row decides on the next, so this is a fold over a page's rows."""
    s = rows.withColumn("labels", text.header_labels(text.label_key(F.col("text"))))
    order = Window.partitionBy(*page).orderBy("y0", "x0", "x1", "y1", "text")
    s = s.withColumns({"row_no": F.row_number().over(order), "is_seed": F.size("labels") > 0})
    seen = Window.partitionBy(*page).orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("above", F.when(F.col("is_seed"), F.last(F.when(F.col("is_seed"), F.col("y0")), True).over(seen)))
    s = s.withColumn("cluster", F.sum(F.coalesce((F.col("y0") - F.col("above") > gap_pt).cast("int"), F.lit(0))).over(Window.partitionBy(*page).orderBy("row_no")))
    row = F.struct("row_no", "y0", "x0", "y1", "x1", F.when(F.col("is_seed"), F.col("cluster")).alias("cluster"), "labels")
    g = s.groupBy(*page).agg(F.array_sort(F.collect_list(row)).alias("rs"))
    g = pages_.select(*page, "width_pt", "height_pt").join(g, page, "left")
    ids = F.array_distinct(F.filter(F.transform("rs", lambda r: r["cluster"]), F.isnotnull))
    of = lambda c: F.filter("rs", lambda r: r["cluster"] == c)
    names = lambda rs: F.array_distinct(F.flatten(F.transform(rs, lambda r: r["labels"])))
    best = F.array_min(F.transform(ids, lambda c: F.struct((-F.size(names(of(c)))).alias("n"), F.get(of(c), 0)["y0"].alias("y0"), c.alias("c"))))["c"]
    g = g.withColumn("best", best).withColumn("seeds", F.coalesce(F.filter("rs", lambda r: r["cluster"] == F.col("best")), F.array().cast(g.schema["rs"].dataType)))
    g = g.withColumn("labels_found", F.array_sort(names(F.col("seeds")))).withColumn("detected", F.size("labels_found") >= config.HEADER_MIN_LABELS)
    tops = F.transform("seeds", lambda r: r["y0"])
    steps = F.filter(F.transform(pairs(tops), lambda p: p["hi"] - p["lo"]), lambda d: d > 0)
    heights = F.transform("seeds", lambda r: r["y1"] - r["y0"])
    g = g.withColumn("reach", config.PITCH_TOLERANCE * F.when(F.size(steps) > 0, median(steps)).otherwise(F.greatest(2 * median(heights), F.lit(1.0))))
    first, last = F.get("seeds", 0), F.element_at("seeds", -1)
    g = g.withColumns({"lo": F.array_min(F.transform("seeds", lambda r: r["x0"])), "hi": F.array_max(F.transform("seeds", lambda r: r["x1"])), "first": F.when(F.size("seeds") > 0, first), "last": F.when(F.size("seeds") > 0, last)})

    def state(x0: Column, x1: Column, top: Column, n: Column, stop: Column) -> Column:
        return F.struct(x0.alias("x0"), x1.alias("x1"), top.alias("top"), n.alias("n"), stop.alias("stop"))

    def grown(more: Column, start: Column, down: bool) -> Column:
        def step(a: Column, r: Column) -> Column:
            gap = r["y0"] - a["top"] if down else a["top"] - r["y0"]
            joins = ~a["stop"] & (gap <= F.col("reach")) & (r["x0"] <= a["x1"]) & (r["x1"] >= a["x0"])
            joins = joins & (r["y1"] <= config.HEADER_MAX_EXTENT * F.col("height_pt")) if down else joins
            return F.when(joins, state(F.least(a["x0"], r["x0"]), F.greatest(a["x1"], r["x1"]), r["y0"], a["n"] + 1, F.lit(False))).otherwise(state(a["x0"], a["x1"], a["top"], a["n"], F.lit(True)))
        return F.aggregate(more, start, step)

    none, no = F.lit(0), F.lit(False)
    below = F.filter("rs", lambda r: r["row_no"] > F.col("last.row_no"))
    above = F.reverse(F.filter("rs", lambda r: r["row_no"] < F.col("first.row_no")))
    g = g.withColumn("down", F.when(F.col("detected"), grown(below, state(F.col("lo"), F.col("hi"), F.col("last.y0"), none, no), True)))
    g = g.withColumn("up", F.when(F.col("detected"), grown(above, state(F.col("down.x0"), F.col("down.x1"), F.col("first.y0"), none, no), False)))
    band = F.filter("rs", lambda r: (r["row_no"] >= F.col("first.row_no") - F.col("up.n")) & (r["row_no"] <= F.col("last.row_no") + F.col("down.n")))
    g = g.withColumn("band", F.when(F.col("detected"), band))
    least, most = (lambda c: F.array_min(F.transform("band", lambda r: r[c]))), (lambda c: F.array_max(F.transform("band", lambda r: r[c])))
    g = g.withColumns({"x0": least("x0"), "y0": least("y0"), "x1": most("x1"), "y1": most("y1")})
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    across = F.when(F.abs(F.col("x0") - (F.col("width_pt") - F.col("x1"))) <= F.greatest(F.col("width_pt") * 0.05, F.lit(6.0)), "centre").when(cx < F.col("width_pt") / 2, "left").otherwise("right")
    down = F.when(cy < F.col("height_pt") / 3, "upper").when(cy < 2 * F.col("height_pt") / 3, "middle").otherwise("lower")
    found = F.col("detected")
    return g.select(
        *page, F.when(found, F.least(F.col("y1") + config.HEADER_PAD_PT, "height_pt")).otherwise(F.col("height_pt") * config.HEADER_FALLBACK).alias("threshold_pt"), "detected", "labels_found",
        F.when(found, F.size("band")).otherwise(0).alias("rows_in_band"), F.when(found, F.size("band") - F.size("seeds")).otherwise(0).alias("rows_absorbed"), "x0", "y0", "x1", "y1",
        F.when(found, geometry.box_mm(F.array("x0", "y0", "x1", "y1"))).alias("bbox_mm"), geometry.mm(F.col("x1") - F.col("x0")).alias("width_mm"), geometry.mm(F.col("y1") - F.col("y0")).alias("height_mm"),
        F.when(found, down).alias("vertical_position"), F.when(found, across).alias("horizontal_position"),
    )


def values_for(spans: DataFrame, page: list[str], label: str, shape: str | None = None) -> DataFrame:
    """page, value: of the topmost label occurrence that has one. A number at the label's end comes first, unless it is all the
    label there is; else the nearest span to the right in the row band that is no label itself and has the shape."""
    own = spans.withColumns({"key": text.label_key(F.col("text")), "cy": (F.col("y0") + F.col("y1")) / 2, "v": text.strip(F.col("text"))}).withColumn("labels", text.header_labels(F.col("key")))
    inline = F.regexp_extract("v", config.INLINE_VALUE, 1)
    accepted = lambda c: c.rlike(shape) if shape else F.lit(True)
    labels = own.filter(F.array_contains("labels", label)).withColumn("inline", inline)
    labels = labels.select(*page, F.col("span_id").alias("l_id"), F.col("y0").alias("l_y0"), F.col("x1").alias("l_x1"), F.col("cy").alias("l_cy"), F.when((F.col("inline") != "") & (text.label_key(F.col("inline")) != F.col("key")) & accepted(F.col("inline")), F.col("inline")).alias("inline"))
    others = own.filter((F.size("labels") == 0) & (F.col("v") != "") & accepted(F.col("v"))).select(*page, "span_id", "x0", "cy", "v")
    near = labels.join(others, page, "left")
    fits = (F.abs(F.col("cy") - F.col("l_cy")) <= config.ROW_BAND_PT) & (F.col("x0") - F.col("l_x1") >= 0)
    right = near.groupBy(*page, "l_id", "l_y0", "inline").agg(F.min_by("v", F.when(fits, F.struct(F.col("x0") - F.col("l_x1"), F.col("span_id")))).alias("right"))
    found = right.withColumn("value", F.coalesce("inline", "right")).filter("value is not null")
    return found.groupBy(*page).agg(F.min_by("value", F.struct("l_y0", "l_id")).alias("value"))


def ac_reference(header_spans: DataFrame, spans: DataFrame, page: list[str], texts: DataFrame | None = None) -> DataFrame:
    """The reference that the header's fields make, the first one printed on the page, and whether they agree (null if one is missing).

    spans: all spans in the order in which they are searched (column ord): text, in_header, box in mm (x0 ... y1) and whatever
    else is to be reported of the place (rotation_deg, rotation_sop, font_size_pt). Header cells that are a label and nothing
    else are not searched. texts: page and body_text_all, searched where no span has the reference."""
    number = values_for(header_spans, page, "ac reference", config.NUMBER_SHAPE).withColumnRenamed("value", "ac_number")
    version = values_for(header_spans, page, "version", config.VERSION_SHAPE).withColumnRenamed("value", "version")
    edges = {"x0": F.min, "y0": F.min, "x1": F.max, "y1": F.max}
    bounds = spans.groupBy(*page).agg(F.struct(*[f(c).alias(c) for c, f in edges.items()]).alias("bounds"))
    label = F.col("in_header") & text.is_header_label(text.label_key(F.col("text")))
    hits = spans.filter(~label).withColumn("hit", F.trim(F.regexp_extract("text", config.AC_PATTERN, 0))).filter("hit != ''")
    more = [c for c in ("rotation_deg", "rotation_sop", "font_size_pt") if c in spans.columns]
    printed = hits.groupBy(*page).agg(F.min_by(F.struct("hit", "x0", "y0", "x1", "y1", *more), "ord").alias("p"))
    out = spans.select(*page).distinct().join(number, page, "left").join(version, page, "left").join(printed, page, "left").join(bounds, page, "left")
    out = out.join(texts, page, "left") if texts is not None else out.withColumn("body_text_all", F.lit(""))
    joined = F.trim(F.regexp_extract(F.coalesce("body_text_all", F.lit("")), config.AC_PATTERN, 0))
    out = out.withColumn("on_pack_instance", F.coalesce("p.hit", F.when(joined != "", joined)))
    out = out.withColumn("header_combined", F.concat(F.lit("AC"), F.trim("ac_number"), F.lit("V."), F.trim("version")))
    plain = lambda c: F.regexp_replace(F.lower(c), "[^0-9a-z]", "")
    edge = F.when(F.col("p").isNotNull(), edge_position(F.col("p.x0"), F.col("p.y0"), F.col("p.x1"), F.col("p.y1"), F.col("bounds")))
    return out.select(*page, "header_combined", "ac_number", "version", "on_pack_instance", F.col("p").alias("on_pack_position"), edge.alias("edge"), "bounds", (plain(F.col("header_combined")) == plain(F.col("on_pack_instance"))).alias("consistent"))


def edge_position(x0: Column, y0: Column, x1: Column, y1: Column, box: Column, margin: float = config.AC_EDGE_MM) -> Column:
    return F.when(box["x1"] - x1 <= margin, "right").when(x0 - box["x0"] <= margin, "left").when(y0 - box["y0"] <= margin, "top").when(box["y1"] - y1 <= margin, "bottom").otherwise("interior")


def component_rects(paths: DataFrame, pages_: DataFrame, page: list[str]) -> DataFrame:
    """w and h (mm) of every path of positive size that is not the sheet. paths: box in mm, drawing_id; pages_: width_mm, height_mm."""
    r = paths.select(*page, "drawing_id", F.bround(F.col("x1") - F.col("x0"), 2).alias("w"), F.bround(F.col("y1") - F.col("y0"), 2).alias("h")).filter("w > 0 and h > 0")
    sheet = (F.abs(F.col("w") - F.col("width_mm")) <= config.SHEET_TOLERANCE_MM) & (F.abs(F.col("h") - F.col("height_mm")) <= config.SHEET_TOLERANCE_MM)
    return r.join(pages_.select(*page, "width_mm", "height_mm"), page).filter(~sheet).drop("width_mm", "height_mm")


def side_pairs(nums: Column) -> Column:
    """Every unordered pair (a <= b) of numbers at different places, distinct."""
    return F.array_distinct(F.flatten(F.transform(nums, lambda a, i: F.transform(F.slice(nums, i + 2, F.greatest(F.size(nums) - i - 1, F.lit(0))), lambda b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))))))


def measured_pairs(declared: DataFrame, rects: DataFrame, page: list[str]) -> DataFrame:
    """Every unordered pair of declared numbers and the rectangle nearest to it, either way round, if within the tolerance: matched, measured w and h, delta_mm.

    declared: page, nums; rects: page, w, h (mm), drawing_id; the first of equally near ones counts."""
    want = declared.select(*page, F.explode(side_pairs(F.col("nums"))).alias("p")).select(*page, "p.a", "p.b")
    delta = F.least(F.greatest(F.abs(F.col("w") - F.col("a")), F.abs(F.col("h") - F.col("b"))), F.greatest(F.abs(F.col("w") - F.col("b")), F.abs(F.col("h") - F.col("a"))))
    near = want.join(rects, page, "left").withColumn("delta", delta)
    best = near.groupBy(*page, "a", "b").agg(F.min(F.when(F.col("delta") <= config.DIMENSION_TOLERANCE_MM, F.struct("delta", "drawing_id", "w", "h"))).alias("m"))
    return best.select(*page, "a", "b", F.col("m").isNotNull().alias("matched"), F.col("m.w").alias("w"), F.col("m.h").alias("h"), F.bround("m.delta", 3).alias("delta_mm"))


def dimension_check(header_spans: DataFrame, spans: DataFrame, rects: DataFrame, page: list[str]) -> DataFrame:
    """Declared size, printed callouts and drawn rectangles of every page, held against each other.

    spans: section, annotation_near_miss and text. Callouts are dimension texts among annotations, or where there are none,
    among near misses. A comparison is null if a side is missing; consistent is null if both comparisons are."""
    declared = values_for(header_spans, page, "dimension", config.DIMENSION_SHAPE).select(*page, F.col("value").alias("declared_raw"), text.numbers(F.col("value")).alias("nums"))
    nums = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(c & text.is_dimension(F.col("text")), text.numbers(F.col("text")))))))
    calls = spans.groupBy(*page).agg(nums(F.col("section") == "annotation").alias("marked"), nums(F.col("annotation_near_miss")).alias("missed"))
    calls = calls.select(*page, F.when(F.size("marked") > 0, F.col("marked")).otherwise(F.col("missed")).alias("calls"), F.when(F.size("marked") > 0, "annotations").when(F.size("missed") > 0, "annotation_near_misses").alias("callout_source"))
    fits = measured_pairs(declared, rects, page)
    results = F.array_sort(F.collect_list(F.struct("a", "b", "matched", "w", "h", "delta_mm")))
    fits = fits.groupBy(*page).agg(results.alias("measured_pairs"), F.min("matched").alias("all_matched"))
    some = rects.select(*page, F.lit(True).alias("has_rects")).distinct()
    out = calls.join(declared, page, "left").join(fits, page, "left").join(some, page, "left")
    left = F.filter("calls", lambda c: ~F.exists("nums", lambda d: F.abs(c - d) <= config.DIMENSION_TOLERANCE_MM))
    out = out.withColumns({"measured_ok": F.when(F.col("has_rects"), F.col("all_matched")), "left": F.when(F.size("nums") > 0, left).otherwise(F.col("calls"))})
    out = out.withColumn("callouts_ok", F.when((F.size("nums") > 0) & (F.size("calls") > 0), F.size("left") == 0))
    return out.select(
        *page, "declared_raw", F.when(F.size("nums") > 0, F.col("nums")).alias("declared_mm"), F.when(F.size("calls") > 0, F.col("calls")).alias("callouts_mm"), "callout_source", "measured_pairs",
        F.col("measured_ok").alias("declared_vs_measured"), F.col("callouts_ok").alias("declared_vs_callouts"), F.when(F.size("left") > 0, F.col("left")).alias("unmatched_callouts_mm"),
        F.when(F.coalesce("measured_ok", "callouts_ok").isNotNull(), F.coalesce("measured_ok", F.lit(True)) & F.coalesce("callouts_ok", F.lit(True))).alias("consistent"),
    )


def value_windows(labels: DataFrame, values: DataFrame, page: list[str]) -> DataFrame:
    """Labels with the values of the next column in their window: from halfway to the label above to halfway to the one below.

    labels and values: page, col, span_id, y0, yc; labels stand in the order of their tops. One row a match."""
    w = Window.partitionBy(*page, "col").orderBy("y0", "span_id")
    l = labels.withColumns({"lo": F.coalesce((F.lag("yc").over(w) + F.col("yc")) / 2, F.lit(float("-inf"))), "hi": F.coalesce((F.lead("yc").over(w) + F.col("yc")) / 2, F.lit(float("inf")))})
    v = values.select(*page, (F.col("col") - 1).alias("col"), F.col("span_id").alias("value_id"), F.col("yc").alias("v_yc"))
    return l.join(v, [*page, "col"]).filter((F.col("v_yc") >= F.col("lo")) & (F.col("v_yc") < F.col("hi"))).select(*page, F.col("span_id").alias("label_id"), "value_id")


def unassigned(values: DataFrame, matches: DataFrame, page: list[str]) -> DataFrame:
    return values.join(matches.select(*page, F.col("value_id").alias("span_id")), [*page, "span_id"], "left_anti")


def header_grid(paths: DataFrame, page: list[str]) -> DataFrame:
    """The drawn grid of every page's header table: grid_convention (rects, lines or null), table box in points and mm, cells, col_edges, border_stroke_pt.

    paths: drawing_id, box (whole points), box_mm (array of four), fill_color_hex, stroke_width_pt. Filled paths are no part of
    a grid. More than one rectangle makes cells of all but the largest, which is the border. Else two verticals and a
    horizontal make a ruled grid: the verticals give columns, top and bottom; a horizontal divides the columns whose middle it crosses."""
    eps = config.GRID_EPS_PT
    wide, high = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    kind = F.when((wide > eps) & (high > eps), "r").when((high <= eps) & (wide > config.GRID_LINE_PT), "h").when((wide <= eps) & (high > config.GRID_LINE_PT), "v")
    stroked = paths.filter("fill_color_hex is null").withColumn("kind", kind).filter("kind is not null")
    item = F.struct("drawing_id", "x0", "y0", "x1", "y1", "box_mm", "stroke_width_pt")
    of = lambda k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, item)))
    g = stroked.groupBy(*page).agg(of("r").alias("rs"), of("h").alias("hs"), of("v").alias("vs"))
    size = lambda r: geometry.area(r["x0"], r["y0"], r["x1"], r["y1"])
    border = F.array_min(F.transform("rs", lambda r: F.struct((-size(r)).alias("size"), r["drawing_id"].alias("o"), r.alias("r"))))["r"]
    g = g.withColumns({"as_rects": F.size("rs") > 1, "as_lines": (F.size("rs") <= 1) & (F.size("vs") >= 2) & (F.size("hs") >= 1), "border": border})
    g = g.withColumn("inner", F.filter("rs", lambda r: r["drawing_id"] != F.col("border.drawing_id")))
    xs = clusters.anchors(F.when(F.col("as_rects"), F.concat(F.transform("inner", lambda r: r["x0"]), F.transform("inner", lambda r: r["x1"]))).otherwise(F.transform("vs", lambda v: v["x0"])), eps)
    g = g.withColumns({"col_edges": xs, "top": F.array_min(F.transform("vs", lambda v: v["y0"])), "bottom": F.array_max(F.transform("vs", lambda v: v["y1"]))})

    def column(c: Column) -> Column:
        middle = (c["lo"] + c["hi"]) / 2
        rules = F.transform(F.filter("hs", lambda h: (h["x0"] - eps <= middle) & (middle <= h["x1"] + eps)), lambda h: h["y0"])
        ys = F.filter(F.concat(F.array("top", "bottom"), rules), lambda y: (y >= F.col("top") - eps) & (y <= F.col("bottom") + eps))
        return F.transform(pairs(clusters.anchors(ys, eps)), lambda y: F.struct(c["lo"].alias("x0"), y["lo"].alias("y0"), c["hi"].alias("x1"), y["hi"].alias("y1")))

    ruled = F.flatten(F.transform(pairs(F.col("col_edges")), column))
    drawn = F.transform("inner", lambda r: F.struct(r["x0"].alias("x0"), r["y0"].alias("y0"), r["x1"].alias("x1"), r["y1"].alias("y1")))
    strokes = lambda items: F.array_sort(F.array_distinct(F.filter(F.transform(items, lambda r: r["stroke_width_pt"]), F.isnotnull)))
    edge = lambda i, f: f(F.transform("vs", lambda v: v["box_mm"][i]))
    by_lines = F.array(edge(0, F.array_min), edge(1, F.array_min), edge(2, F.array_max), edge(3, F.array_max))
    either = lambda a, b: F.when(F.col("as_rects"), a).when(F.col("as_lines"), b)
    box = F.struct(F.col("border.x0").alias("x0"), F.col("border.y0").alias("y0"), F.col("border.x1").alias("x1"), F.col("border.y1").alias("y1"))
    lines = F.struct(F.get("col_edges", 0).alias("x0"), F.col("top").alias("y0"), F.element_at("col_edges", -1).alias("x1"), F.col("bottom").alias("y1"))
    return g.filter("as_rects or as_lines").select(
        *page, either(F.lit("rects"), F.lit("lines")).alias("grid_convention"), either(box, lines).alias("table_bbox"), either(F.col("border.box_mm"), by_lines).alias("table_bbox_mm"),
        either(drawn, ruled).alias("cells"), "col_edges", either(strokes(F.col("inner")), strokes(F.concat("hs", "vs"))).alias("border_stroke_pt"),
    )


def cell_of(box: Column, cells: Column) -> Column:
    """The smallest cell that holds a box's centre, the first of equals; null if none does."""
    e = config.GRID_EPS_PT
    cx, cy = (box["x0"] + box["x1"]) / 2, (box["y0"] + box["y1"]) / 2
    holds = F.filter(F.transform(cells, lambda c, i: F.struct(geometry.area(c["x0"], c["y0"], c["x1"], c["y1"]).alias("size"), i.alias("i"), c.alias("c"))), lambda x: (cx >= x["c"]["x0"] - e) & (cx <= x["c"]["x1"] + e) & (cy >= x["c"]["y0"] - e) & (cy <= x["c"]["y1"] + e))
    return F.array_min(holds)["c"]


def column_of(x: Column, bounds: Column) -> Column:
    """The first column, counted from 0, that holds x within two points; -1 if none does or there are no columns."""
    hits = F.filter(F.transform(bounds, lambda c, i: F.struct(i.alias("i"), c.alias("c"))), lambda h: (h["c"]["lo"] - 2 <= x) & (x < h["c"]["hi"] + 2))
    return F.coalesce(F.get(hits, 0)["i"], F.lit(-1))


def unanimous(column: str) -> Column:
    """The value of a column if all rows of the group agree, nulls counting as a value."""
    return F.when(F.countDistinct(F.coalesce(F.col(column).cast("string"), F.lit("\0"))) == 1, F.first(column))


def declared_fields(pairs: DataFrame, page: list[str]) -> DataFrame:
    """One map of canonical field to value text per page; the last pair of a field wins. pairs: page, pos, canonical, value."""
    last = pairs.groupBy(*page, "canonical").agg(F.max_by("value", "pos").alias("value"))
    return last.groupBy(*page).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("canonical", "value")))).alias("fields"))
