"""Artwork reconstruction: panels, their addresses and columns, blocks of copy, layout and dimension callouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope import config
from folioscope.functions import geometry, text
from folioscope.functions.columns import nearest, pairs
from folioscope.operators import clusters


def same_keys(keys: list[str], a: str, b: str) -> Column:
    held = F.col(f"{a}.{keys[0]}") == F.col(f"{b}.{keys[0]}")
    for k in keys[1:]:
        held = held & (F.col(f"{a}.{k}") == F.col(f"{b}.{k}"))
    return held


def contains(o: str, i: str, eps: float = config.NEST_MM) -> Column:
    """Whether box o holds box i; boxes that are the same within eps hold neither the other."""
    at = lambda a, c: F.col(f"{a}.{c}")
    inside = (at(o, "x0") <= at(i, "x0") + eps) & (at(o, "y0") <= at(i, "y0") + eps) & (at(o, "x1") >= at(i, "x1") - eps) & (at(o, "y1") >= at(i, "y1") - eps)
    same = (F.abs(at(o, "x0") - at(i, "x0")) <= eps) & (F.abs(at(o, "y0") - at(i, "y0")) <= eps) & (F.abs(at(o, "x1") - at(i, "x1")) <= eps) & (F.abs(at(o, "y1") - at(i, "y1")) <= eps)
    return inside & ~same


def panels(boxes: DataFrame, page: list[str], ord_: str) -> DataFrame:
    """Boxes of panel size that no other such box contains."""
    big = boxes.filter((F.col("x1") - F.col("x0") >= config.PANEL_MIN_MM) & (F.col("y1") - F.col("y0") >= config.PANEL_MIN_MM))
    return big.alias("i").join(big.alias("o"), same_keys(page, "i", "o") & (F.col(f"i.{ord_}") != F.col(f"o.{ord_}")) & contains("o", "i"), "left_anti")


def below_header(paths: DataFrame, bottom: Column) -> DataFrame:
    """Paths (mm) that don't lie wholly in the header; all of them where the bottom is null."""
    return paths.filter(bottom.isNull() | (F.col("y1") > bottom + config.NEST_MM))


def is_callout(color: Column, w: Column, h: Column) -> Column:
    """A rule or an arrowhead in an annotation colour, which a printed band of the same colour is not."""
    return geometry.is_annotation_color(F.coalesce(color, F.lit(""))) & ((F.least(w, h) < config.CALLOUT_THIN_MM) | (w * h <= config.CALLOUT_AREA_MM2))


def columns(boxes: DataFrame, keys: list[str], lo: str, hi: str, gutter: float = config.GUTTER_MM, order: list | None = None) -> DataFrame:
    """Columns of a panel: merged x extents, the gutter before each, and how many boxes it was merged from."""
    c = clusters.merged(boxes, keys, lo, hi, gutter, order).groupBy(*keys, F.col("island").alias("column_no")).agg(F.min(lo).alias(lo), F.max(hi).alias(hi), F.count("*").alias("n_spans"))
    return c.withColumn("gutter", F.col(lo) - F.lag(hi).over(Window.partitionBy(*keys).orderBy("column_no")))


def panel_columns(texts: DataFrame, boxes: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Columns of each panel from the x extents of its texts and inner boxes, numbered from 1, and texts with their column.

    texts: ord and box; boxes: box_no and box. A text or box counts for the column that holds its centre; of two columns the
    later takes a text."""
    both = texts.select(*keys, "x0", "x1").unionByName(boxes.select(*keys, "x0", "x1"))
    c = columns(both, keys, "x0", "x1").withColumn("column", (F.col("column_no") + 1).cast("int"))
    at = c.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("column", "x0", "x1"))).alias("cs"))

    def placed(rows: DataFrame) -> DataFrame:
        centre = (F.col("x0") + F.col("x1")) / 2
        hits = F.transform(F.filter("cs", lambda k: (k["x0"] - 0.01 <= centre) & (centre <= k["x1"] + 0.01)), lambda k: k["column"])
        return rows.join(at, keys, "left").withColumn("in", hits).drop("cs")

    told = placed(texts).withColumn("column", F.array_max("in"))
    n = placed(texts).select(*keys, F.explode("in").alias("column")).groupBy(*keys, "column").agg(F.count("*").alias("text_span_count"))
    m = placed(boxes).select(*keys, F.explode("in").alias("column")).groupBy(*keys, "column").agg(F.count("*").alias("inner_box_count"))
    r = lambda v: F.bround(v, 2)
    out = c.join(n, [*keys, "column"], "left").join(m, [*keys, "column"], "left").fillna(0, ["text_span_count", "inner_box_count"])
    out = out.select(*keys, "column", r("x0").alias("x0_mm"), r("x1").alias("x1_mm"), r(F.col("x1") - F.col("x0")).alias("width_mm"), r("gutter").alias("gutter_before_mm"), "text_span_count", "inner_box_count")
    return out, told.drop("in")


def addresses(panels_: DataFrame, keys: list[str], ord_: str, eps: float = config.PANEL_ROW_MM) -> DataFrame:
    """panels with grid_row (anchored bands of tops, to a tenth) and grid_col (rank by left edge in the row), both from 1, and their
    distances from the left and top of all panels of the keys."""
    all_ = Window.partitionBy(*keys)
    tops = panels_.groupBy(*keys).agg(clusters.anchors(F.collect_set(F.bround("y0", 1)), eps).alias("tops"))
    rows = panels_.join(tops, keys).withColumn("grid_row", nearest(F.col("tops"), F.col("y0")) + 1).drop("tops")
    rows = rows.withColumn("grid_col", F.row_number().over(Window.partitionBy(*keys, "grid_row").orderBy("x0", "y0", ord_)))
    return rows.withColumns({"from_left_mm": F.bround(F.col("x0") - F.min("x0").over(all_), 2), "from_top_mm": F.bround(F.col("y0") - F.min("y0").over(all_), 2)})


def layout(panels_: DataFrame, keys: list[str], declared: Column | None = None) -> DataFrame:
    """Body faces (large panels), the axis on which they run, the style that follows, or a note why there is none.

    declared: array of declared sizes; with three or more, how many faces are as long as the greatest of them."""
    w, h = F.bround(F.col("x1") - F.col("x0"), 2), F.bround(F.col("y1") - F.col("y0"), 2)
    p = panels_.withColumns({"w": w, "h": h, "declared": declared if declared is not None else F.lit(None).cast("array<double>")})
    p = p.withColumn("face", F.col("w") * F.col("h") >= F.max(F.col("w") * F.col("h")).over(Window.partitionBy(*keys)) * config.BODY_FACE)
    side = F.abs(F.greatest("w", "h") - F.array_max("declared")) <= config.FACE_MM
    g = p.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if("face").alias("faces"), F.count_distinct(F.when(F.col("face"), F.bround("x0", 1))).alias("nx"), F.count_distinct(F.when(F.col("face"), F.bround("y0", 1))).alias("ny"),
        F.count_if(F.col("face") & side).alias("fits"), F.max(F.size("declared")).alias("sizes"),
    )
    note = F.when(F.col("n") < 3, "too few panels to infer a carton layout").when(F.col("faces") < 2, "only one large panel; not a wrap-around blank")
    g = g.withColumns({"some": note.isNull(), "axis": F.when(note.isNull() & (F.col("ny") > F.col("nx")), "vertical").when(note.isNull() & (F.col("nx") > F.col("ny")), "horizontal")})
    return g.select(
        *keys, F.when(F.col("some"), F.col("faces")).alias("body_face_count"), F.col("axis").alias("body_face_run_axis"),
        F.when(F.col("axis") == "vertical", "Side Open Side Open").when(F.col("axis") == "horizontal", "Top Open Bottom *").alias("derived_style"),
        F.coalesce(note, F.when(F.col("axis").isNull(), "body faces do not form a clear run on either axis")).alias("note"),
        F.when(F.col("axis").isNotNull() & (F.col("sizes") >= 3), F.concat_ws("/", F.col("fits").cast("string"), F.col("faces").cast("string"))).alias("body_faces_matching_declared_height"),
    )


def opening(style: Column) -> Column:
    """side or top, as a style names it, or null."""
    t = F.regexp_replace(F.lower(style), "[^a-z ]", " ")
    return F.when(t.contains("side open"), "side").when(t.contains("top open"), "top")


def style_agrees(derived: Column, declared: Column) -> Column:
    """Whether a declared style names the same opening; null if either is missing or names none."""
    return F.when(declared != "", F.coalesce(opening(declared) == opening(derived), F.when(opening(declared).isNotNull() & derived.isNotNull(), F.lit(False))))


def table_edges(outer: Column, nested: Column) -> Column:
    """(xs, ys): column and row edges of the table that boxes nested in a box draw, or null. Two columns at least make a table.

    Two boxes with both extents are cells, and then nothing else is asked; else verticals, with the outer box's edges, make a ruled grid."""
    e, least = config.TABLE_EPS_MM, config.TABLE_LINE_MM
    wide, high = (lambda b: b["x1"] - b["x0"]), (lambda b: b["y1"] - b["y0"])
    rects = F.filter(nested, lambda b: (wide(b) > e) & (high(b) > e))
    across = F.filter(nested, lambda b: (high(b) <= e) & (wide(b) > least))
    down = F.filter(nested, lambda b: (wide(b) <= e) & (high(b) > least))
    of = lambda items, c: F.transform(items, lambda b: b[c])
    drawn = F.struct(clusters.anchors(F.concat(of(rects, "x0"), of(rects, "x1")), e).alias("xs"), clusters.anchors(F.concat(of(rects, "y0"), of(rects, "y1")), e).alias("ys"))
    ruled = F.struct(clusters.anchors(F.concat(F.array(outer["x0"], outer["x1"]), of(down, "x0")), e).alias("xs"), clusters.anchors(F.concat(F.array(outer["y0"], outer["y1"]), of(across, "y0")), e).alias("ys"))
    some = F.when(F.size(rects) >= 2, drawn).when(F.size(down) > 0, ruled)
    return F.when((F.size(some["xs"]) >= 3) & (F.size(some["ys"]) >= 2), some)


def table_grid(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes (box_no, box) that hold a drawn table of other boxes: keys, box_no, edges, table_rows, table_cols."""
    o, i = boxes.alias("o"), boxes.alias("i")
    held = o.join(i, same_keys(keys, "o", "i") & (F.col("o.box_no") != F.col("i.box_no")) & contains("o", "i"))
    box = lambda a: F.struct(*[F.col(f"{a}.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])
    nested = held.groupBy(*[F.col(f"o.{k}").alias(k) for k in [*keys, "box_no"]]).agg(F.first(box("o")).alias("outer"), F.array_sort(F.collect_list(box("i"))).alias("nested"))
    return drawn_tables(nested, [*keys, "box_no"])


def drawn_tables(nested: DataFrame, keys: list[str]) -> DataFrame:
    """Of boxes (outer) with the boxes that count as theirs (nested), those that are tables: keys, edges, table_rows, table_cols.

    Which boxes count is the caller's choice; none is left out here for where it lies."""
    out = nested.withColumn("edges", table_edges(F.col("outer"), F.col("nested"))).filter("edges is not null")
    return out.select(*keys, "edges", (F.size("edges.ys") - 1).alias("table_rows"), (F.size("edges.xs") - 1).alias("table_cols"))


def band_of(value: Column, edges: Column) -> Column:
    """The 0-based band between consecutive edges whose middle is nearest, the earliest of equals."""
    return nearest(F.transform(pairs(edges), lambda p: (p["lo"] + p["hi"]) / 2), value)


def loose_blocks(elements: DataFrame, keys: list[str], house: str = "") -> DataFrame:
    """Elements in order of top and left as blocks: a gap of more than BLOCK_GAP_MM under the element before starts one."""
    order = ["y0", "x0", "span_id"]
    e = clusters.gaps(elements, keys, order, "y0", "y1", config.BLOCK_GAP_MM)
    parts = F.array_sort(F.collect_list(F.struct(*order, "text")))
    b = e.groupBy(*keys, F.col("island").alias("block_no")).agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("text"), F.count("*").alias("span_count"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return b.withColumn("legends", F.array_join(text.legends(F.col("text"), house), ","))


def claimed(elements: DataFrame, boxes: DataFrame, keys: list[str], eps: float = config.NEST_MM) -> DataFrame:
    """Elements with the first box (by top, left, order) that holds their centre. boxes: box_no and a box."""
    cx, cy = (F.col("e.x0") + F.col("e.x1")) / 2, (F.col("e.y0") + F.col("e.y1")) / 2
    hit = same_keys(keys, "e", "b") & (cx >= F.col("b.x0") - eps) & (cx <= F.col("b.x1") + eps) & (cy >= F.col("b.y0") - eps) & (cy <= F.col("b.y1") + eps)
    j = elements.alias("e").join(boxes.alias("b"), hit)
    return j.groupBy(*[F.col(f"e.{k}").alias(k) for k in keys], F.col("e.span_id").alias("span_id")).agg(F.min_by("b.box_no", F.struct("b.y0", "b.x0", "b.box_no")).alias("box_no"))


def blocks(texts: DataFrame, boxes: DataFrame, keys: list[str], house: str = "") -> DataFrame:
    """Blocks of copy of each panel, numbered from 1 by top and left: text, legends, box, whether it is boxed or a table, column, span_count.

    texts: span_id (in order), text, box, column. A drawn box holds the texts whose centre it has and no earlier box took; the
    others split where the gap under the text before is wide. Texts of a table read cell by cell, others by top and left."""
    own = texts.join(claimed(texts, boxes, keys), [*keys, "span_id"], "left")
    loose = clusters.gaps(own.filter("box_no is null"), keys, ["y0", "x0", "span_id"], "y0", "y1", config.BLOCK_GAP_MM)
    boxed = own.filter("box_no is not null").withColumn("island", F.lit(None).cast("long"))
    both = boxed.unionByName(loose).join(table_grid(boxes, keys), [*keys, "box_no"], "left")
    row, col = band_of((F.col("y0") + F.col("y1")) / 2, F.col("edges.ys")), band_of((F.col("x0") + F.col("x1")) / 2, F.col("edges.xs"))
    first = lambda c: F.when(F.col("edges").isNotNull(), c).otherwise(0)
    parts = F.array_sort(F.collect_list(F.struct(first(row).alias("r"), first(col).alias("c"), "y0", "x0", "span_id", text.strip(F.col("text")).alias("text"), "column")))
    g = both.groupBy(*keys, "box_no", "island").agg(
        parts.alias("parts"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("span_count"), F.first("table_rows").alias("table_rows"), F.first("table_cols").alias("table_cols"),
    )
    g = g.withColumn("text", text.squeeze(F.array_join(F.transform("parts", lambda p: p["text"]), " "))).withColumn("legends", text.legends(F.col("text"), house))
    drawn = boxes.select(*keys, "box_no", rounded_box().alias("box_mm"))
    g = g.join(drawn, [*keys, "box_no"], "left")
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(F.bround("y0", 2), F.bround("x0", 2), "box_no", "island"))
    return g.select(
        *keys, number.alias("block_no"), F.get("legends", 0).alias("legend"), "legends", "text", rounded_box().alias("bbox_mm"), F.col("box_no").isNotNull().alias("boxed"), "box_mm",
        F.get("parts", 0)["column"].alias("column"), "span_count", F.col("table_rows").isNotNull().alias("is_table"), "table_rows", "table_cols",
    )


def rounded_box() -> Column:
    """The box of a row in mm, two decimals, as an array."""
    return F.array(*[F.bround(c, 2) for c in ("x0", "y0", "x1", "y1")])


def extension_lines(paths: DataFrame, page: list[str]) -> DataFrame:
    """Callout paths that are lines: page, axis (x for verticals), at (their place), lo and hi (their extent)."""
    e = config.LINE_EPS_MM
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    axis = F.when((w <= e) & (h > e), "x").when((h <= e) & (w > e), "y")
    upright = F.col("axis") == "x"
    return paths.withColumn("axis", axis).filter("axis is not null").select(*page, "axis", F.bround(F.when(upright, F.col("x0")).otherwise(F.col("y0")), 2).alias("at"), F.when(upright, F.col("y0")).otherwise(F.col("x0")).alias("lo"), F.when(upright, F.col("y1")).otherwise(F.col("x1")).alias("hi"))


def callouts(labels: DataFrame, paths: DataFrame, page: list[str], targets: DataFrame | None = None, regions: DataFrame | None = None) -> DataFrame:
    """What each dimension label measures: page, span_id, label, declared_mm, orientation, lo_mm, hi_mm, measured_mm, matches_label, measures.

    labels: span_id, text, box in mm; those without a number go. paths: callout paths in mm. A label higher than wide
    measures between horizontal lines, another between vertical ones; lines count whose extent has the label's centre.
    Of all pairs around the label, the one nearest to its number is measured, the first of equals. targets: ord, axis, lo,
    hi and name of what may be measured; regions: ord, name and length of declared parts inside a panel."""
    e = config.LINE_EPS_MM
    l = labels.withColumn("declared_mm", F.get(text.numbers(F.col("text")), 0)).filter("declared_mm is not null")
    l = l.withColumn("axis", F.when(F.col("y1") - F.col("y0") > F.col("x1") - F.col("x0"), "y").otherwise("x"))
    mid = lambda a: (F.col(f"{a}0") + F.col(f"{a}1")) / 2
    l = l.withColumns({"centre": F.when(F.col("axis") == "x", mid("x")).otherwise(mid("y")), "other": F.when(F.col("axis") == "x", mid("y")).otherwise(mid("x"))})
    cuts = extension_lines(paths, page).withColumnRenamed("lo", "l0").withColumnRenamed("hi", "l1")
    near = l.join(cuts, [*page, "axis"], "left").withColumn("at", F.when((F.col("other") >= F.col("l0") - e) & (F.col("other") <= F.col("l1") + e), F.col("at")))
    g = near.groupBy(*page, "span_id").agg(*[F.first(c).alias(c) for c in ("text", "axis", "declared_mm", "centre")], F.array_sort(F.collect_set("at")).alias("ats"))
    lows, highs = F.filter("ats", lambda a: a <= F.col("centre")), F.filter("ats", lambda a: a >= F.col("centre"))
    options = F.flatten(F.transform(lows, lambda a: F.transform(F.filter(highs, lambda b: b > a), lambda b: F.struct(F.abs(b - a - F.col("declared_mm")).alias("off"), a.alias("lo"), b.alias("hi")))))
    g = g.withColumns({"best": F.array_min(options), "lows": lows, "highs": highs})
    around = (F.size("lows") > 0) & (F.size("highs") > 0)
    g = g.withColumns({"lo_mm": F.when(around, F.coalesce("best.lo", F.array_max("lows"))), "hi_mm": F.when(around, F.coalesce("best.hi", F.array_min("highs")))})
    g = g.withColumn("measured_mm", F.bround(F.col("hi_mm") - F.col("lo_mm"), 2))
    g = g.withColumn("matches_label", F.abs(F.col("measured_mm") - F.col("declared_mm")) <= config.MATCH_MM)
    name = F.when(F.col("lo_mm").isNull(), "extension lines not found")
    if targets is not None:
        hits = g.select(*page, "span_id", "axis", "lo_mm", "hi_mm").join(targets, [*page, "axis"]).filter((F.abs(F.col("lo_mm") - F.col("lo")) <= config.MATCH_MM) & (F.abs(F.col("hi_mm") - F.col("hi")) <= config.MATCH_MM))
        g = g.join(hits.groupBy(*page, "span_id").agg(F.min_by("name", "ord").alias("part")), [*page, "span_id"], "left")
        name = F.coalesce(name, "part")
    if regions is not None:
        long = g.select(*page, "span_id", "lo_mm", "hi_mm").join(regions, page).filter(F.abs(F.col("hi_mm") - F.col("lo_mm") - F.col("length")) <= config.MATCH_MM)
        g = g.join(long.groupBy(*page, "span_id").agg(F.min_by("name", "ord").alias("region")), [*page, "span_id"], "left")
        name = F.coalesce(name, F.concat(F.lit("declared "), F.replace("region", F.lit("_"), F.lit(" "))))
    name = F.coalesce(name, F.format_string("unmatched span of %.2f mm", F.col("hi_mm") - F.col("lo_mm")))
    return g.select(*page, "span_id", F.col("text").alias("label"), "declared_mm", F.when(F.col("axis") == "y", "vertical").otherwise("horizontal").alias("orientation"), "lo_mm", "hi_mm", "measured_mm", "matches_label", name.alias("measures"))


def position(box: Column, width: Column, height: Column, artboard: Column, component: Column) -> Column:
    """Distances of a box (struct of x0 ... y1, mm) in three frames: the page, the artboard and its component; null for a frame that is missing."""
    r = lambda v: F.bround(v, 2)
    page = F.struct(r(box["x0"]).alias("left"), r(box["y0"]).alias("top"), r(box["x1"]).alias("right"), r(box["y1"]).alias("bottom"), r(width - box["x1"]).alias("right_margin"), r(height - box["y1"]).alias("bottom_margin"))
    edges = lambda f: [r(box["x0"] - f["x0"]).alias("left"), r(f["x1"] - box["x1"]).alias("right"), r(box["y0"] - f["y0"]).alias("top"), r(f["y1"] - box["y1"]).alias("bottom")]
    centre = lambda f, a: r((box[f"{a}0"] + box[f"{a}1"]) / 2 - (f[f"{a}0"] + (f[f"{a}1"] - f[f"{a}0"]) / 2)).alias(f"center_offset_{a}")
    return F.struct(
        F.when(width.isNotNull() & height.isNotNull(), page).alias("page"), F.when(artboard.isNotNull(), F.struct(*edges(artboard))).alias("artboard"),
        F.when(component.isNotNull(), F.struct(*edges(component), centre(component, "x"), centre(component, "y"))).alias("component"),
    )
