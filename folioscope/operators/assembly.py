"""The two reconstructions of a page, put together: the header table from its spans and rules, the component from its drawn panels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope import config
from folioscope.functions import geometry, text
from folioscope.functions.columns import nearest, pairs
from folioscope.operators import artwork, clusters, details, header

BOX = ("x0", "y0", "x1", "y1")


def box(prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in BOX])


Settle = Callable[[DataFrame], DataFrame]


def header_table(spans: DataFrame, paths: DataFrame, page: list[str], settled: Settle = lambda df: df) -> dict[str, DataFrame]:
    """Header tables from header spans and paths: `pairs` of label and value, `unassigned` spans, and one row a page in `tables`.

    spans: span_id, text, box (whole points), bbox_mm and the formats of details.FORMATS; blank ones don't count. paths: drawing_id,
    box (whole points), bbox_mm, fill_color_hex, stroke_width_pt. A span is a label if its text names a field. A value belongs to
    the label in the column before whose window it is in: from halfway to the label above to halfway to the one below.
    settled may store what several of the results read (grids, classified spans, matches)."""
    s = spans.filter(text.strip(F.col("text")) != "").withColumns({"yc": (F.col("y0") + F.col("y1")) / 2, "xc": (F.col("x0") + F.col("x1")) / 2})
    edges = {"x0": F.min, "y0": F.min, "x1": F.max, "y1": F.max}
    extent = s.groupBy(*page).agg(F.struct(*[f(c).alias(c) for c, f in edges.items()]).alias("text_bbox"), F.array(*[f(F.col("bbox_mm")[i]) for i, f in enumerate(edges.values())]).alias("text_extent_bbox_mm"))
    near = paths.join(extent.select(*page, F.col("text_bbox.y1").alias("text_end")), page).filter(details.in_band(F.col("y0"), F.col("y1"), F.col("text_end")))
    near = settled(near)
    grid = settled(header.header_grid(near.withColumn("box_mm", F.col("bbox_mm")), page).withColumn("bounds", F.when(F.size("col_edges") >= 2, pairs(F.col("col_edges")))))
    s = settled(s.join(grid.select(*page, "bounds", "cells"), page, "left").withColumns({"canonical": text.canonical(F.col("text")), "col": header.column_of(F.col("xc"), F.col("bounds"))}))
    labels, plain = s.filter("canonical is not null"), s.filter("canonical is null")
    found = settled(header.value_windows(labels.select(*page, "col", "span_id", "y0", "yc"), plain.select(*page, "col", "span_id", "yc"), page))
    values = plain.join(found.withColumnRenamed("value_id", "span_id"), [*page, "span_id"])
    rows = labels.groupBy(*page).agg(clusters.anchors(F.collect_list("yc"), config.ROW_PT).alias("row_tops"))
    fills = near.filter("fill_color_hex is not null")

    def described(members: DataFrame, side: str) -> DataFrame:
        """One group for each label of a page: text, cell, formats, alignments and swatch. members: label_id and spans."""
        keys = [*page, "label_id"]
        g = details.groups(members, keys).join(members.groupBy(*keys).agg(F.first("col").alias("col"), F.first("bounds").alias("bounds"), F.first("cells").alias("cells")), keys)
        known = (F.col("col") >= 0) & F.col("bounds").isNotNull()
        col = F.when(known, F.get("bounds", F.col("col")))
        g = g.withColumns({"drawn": header.cell_of(box(), F.col("cells")), "column": col})
        by_column = F.struct(F.col("column.lo").alias("x0"), F.col("y0"), F.col("column.hi").alias("x1"), F.col("y1"))
        g = g.withColumns({"cell": F.coalesce("drawn", F.when(F.col("column").isNotNull(), by_column), box()), "cell_source": F.when(F.col("drawn").isNotNull(), "drawn_cell").when(F.col("column").isNotNull(), "column_only").otherwise("text_extent")})
        place = g.select(*keys, *[F.col(f"cell.{c}").alias(c) for c in BOX])
        g = g.join(details.swatches(place, fills.select(*page, "drawing_id", "fill_color_hex", *BOX), page, "label_id"), keys, "left")
        across = details.horizontal_alignment(F.col("x0"), F.col("x1"), F.col("cell.x0"), F.col("cell.x1"))
        down = F.when(F.col("cell_source") == "drawn_cell", details.vertical_alignment(F.col("y0"), F.col("y1"), F.col("cell.y0"), F.col("cell.y1")))
        mm = geometry.box_mm(F.array(*[F.col(f"cell.{c}") for c in BOX]))
        fields = ["text", box().alias("text_bbox"), "cell", mm.alias("cell_bbox_mm"), "cell_source", *details.FORMATS, "mixed_formatting", across.alias("align_h"), down.alias("align_v"), "swatch"]
        return g.select(*keys, F.struct(*fields).alias(side))

    one = described(labels.withColumn("label_id", F.col("span_id")), "label")
    two = described(values.withColumn("col", F.col("col")), "value")
    found_pairs = labels.select(*page, F.col("span_id").alias("label_id"), "canonical", "col", "yc").join(rows, page).join(one, [*page, "label_id"]).join(two, [*page, "label_id"], "left")
    row = nearest(F.col("row_tops"), F.col("yc")) + 1
    col_pair = F.when(F.col("col") >= 0, F.floor(F.col("col") / 2).cast("int") + 1)
    out = found_pairs.select(*page, "label_id", row.alias("row"), col_pair.alias("col_pair"), "canonical", "label", "value")
    out = out.withColumn("pos", F.row_number().over(Window.partitionBy(*page).orderBy("row", F.coalesce("col_pair", F.lit(0)), "label_id")))
    unassigned = plain.join(found.select(*page, F.col("value_id").alias("span_id")), [*page, "span_id"], "left_anti").select(*page, "span_id", "text")
    cells = grid.select(*page, "table_bbox", F.explode("cells").alias("c")).select(*page, *[F.col(f"c.{c}").alias(c) for c in BOX], *[F.col(f"table_bbox.{c}").alias(f"table_{c}") for c in BOX])
    heights = details.row_heights(cells, page).groupBy(*page).agg(F.count("*").cast("int").alias("drawn_rows"), F.transform(F.array_sort(F.collect_list(F.struct("top", "height_mm"))), lambda h: h["height_mm"]).alias("row_heights_mm"))
    left = labels.groupBy(*page).agg(F.size(clusters.anchors(F.collect_list(F.when(F.col("col") == 0, F.col("yc"))), config.ROW_PT)).alias("left_rows"), F.size(clusters.anchors(F.collect_list("yc"), config.ROW_PT)).alias("all_rows"))
    strokes = details.border_strokes(near, page).withColumnRenamed("border_stroke_pt", "any_stroke_pt")
    t = extent.join(grid, page, "left").join(heights, page, "left").join(left, page, "left").join(strokes, page, "left")
    drawn = F.col("table_bbox").isNotNull()
    t = t.withColumns({"table": F.coalesce("table_bbox", "text_bbox"), "table_mm": F.coalesce("table_bbox_mm", "text_extent_bbox_mm"), "source": F.when(drawn, "drawn_border").otherwise("text_extent")})
    n = F.size("bounds")
    tables = t.select(
        *page, F.col("table").alias("table_bbox"), F.col("table_mm").alias("table_bbox_mm"), F.col("source").alias("table_bbox_source"), "text_extent_bbox_mm",
        (F.col("table.x1") - F.col("table.x0")).alias("table_width_pt"), (F.col("table.y1") - F.col("table.y0")).alias("table_height_pt"),
        F.bround(F.col("table_mm")[2] - F.col("table_mm")[0], 2).alias("table_width_mm"), F.bround(F.col("table_mm")[3] - F.col("table_mm")[1], 2).alias("table_height_mm"),
        F.coalesce("drawn_rows", F.when(F.col("left_rows") > 0, F.col("left_rows")), "all_rows", F.lit(0)).alias("row_count"), "row_heights_mm",
        F.when(n > 0, n).alias("column_count"), F.when(n > 0, F.ceil(n / 2).cast("int")).alias("col_pair_count"),
        F.coalesce(F.when(F.size("border_stroke_pt") > 0, F.col("border_stroke_pt")), "any_stroke_pt").alias("border_stroke_pt"), "grid_convention",
        F.transform("cells", lambda c: geometry.box_mm(F.array(*[c[k] for k in BOX]))).alias("cells_mm"),
    )
    return {"pairs": out, "unassigned": unassigned, "tables": tables}


def declared(pairs_: DataFrame, page: list[str]) -> DataFrame:
    """What a header says of its component: page, declared_style, declared_mm, printing_zone and repeat (their first numbers)."""
    fields = header.declared_fields(pairs_.select(*page, "pos", "canonical", F.col("value.text").alias("value")), page)
    nums = lambda f: text.numbers(F.col("fields")[f])
    return fields.select(*page, F.col("fields")["style"].alias("declared_style"), F.when(F.size(nums("dimension")) > 0, nums("dimension")).alias("declared_mm"), *[F.get(nums(f), 0).alias(f) for f in ("printing_zone", "repeat")])


def component(body: DataFrame, paths: DataFrame, annotations: DataFrame, meta: DataFrame, page: list[str], house: str = "", settled: Settle = lambda df: df) -> dict[str, DataFrame]:
    """The printed component below the header from its drawn geometry: components, panels, columns, blocks, callouts, unplaced texts, pages.

    body: span_id (in reading order), text, box in mm. paths: drawing_id, box in mm, stroke_color_hex, fill_color_hex.
    annotations: span_id, text, box in mm. meta, one row a page: width_mm, height_mm, artboard (struct or null), header_bottom_mm,
    declared_style, declared_mm, printing_zone, repeat. Panels that touch are one component, of which the largest comes first.
    settled may store what several of the results read (panels, components, texts, inner boxes, blocks, columns)."""
    below = artwork.below_header(paths.join(meta.select(*page, "header_bottom_mm"), page), F.col("header_bottom_mm"))
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    told = settled(below.withColumn("callout", artwork.is_callout(F.coalesce("stroke_color_hex", "fill_color_hex"), w, h)))
    marks, solid = told.filter("callout"), told.filter("not callout").select(*page, "drawing_id", *BOX, "fill_color_hex")
    p = artwork.panels(solid, page, "drawing_id")
    p = p.withColumn("panel_id", F.row_number().over(Window.partitionBy(*page).orderBy("y0", "x0", "drawing_id")))
    p = settled(p)
    p = settled(p.join(clusters.touching(p, page, "panel_id", config.NEST_MM), [*page, "panel_id"]))
    edges = {"x0": F.min, "y0": F.min, "x1": F.max, "y1": F.max}
    c = p.groupBy(*page, "component").agg(*[f(k).alias(k) for k, f in edges.items()], F.count("*").alias("panel_count"))
    size = F.bround(w, 2) * F.bround(h, 2)
    c = c.withColumn("component_no", F.row_number().over(Window.partitionBy(*page).orderBy(-size, F.bround("y0", 2), "component")))
    own = [*page, "component_no"]
    p = p.join(c.select(*page, "component", "component_no", box().alias("frame")), [*page, "component"]).drop("component")
    p, c = settled(artwork.addresses(p, own, "panel_id")), settled(c)
    facts = meta.select(*page, "width_mm", "height_mm", "artboard", "declared_style", "declared_mm")
    key = [*page, "panel_id"]
    shape = artwork.layout(p.join(facts.select(*page, "declared_mm"), page).select(*own, *BOX, "declared_mm"), own, F.col("declared_mm"))
    c = c.join(shape, own).join(facts, page)
    agrees = artwork.style_agrees(F.col("derived_style"), F.col("declared_style"))
    differs = F.concat(F.lit("blank is drawn as '"), "derived_style", F.lit("' but the header Style cell says '"), "declared_style", F.lit("'"))
    components = c.select(
        *own, artwork.rounded_box().alias("bbox_mm"), F.bround(w, 2).alias("component_width_mm"), F.bround(h, 2).alias("component_height_mm"), "panel_count", "body_face_count", "body_face_run_axis", "derived_style", "declared_style",
        agrees.alias("style_agrees"), F.when(~agrees, differs).otherwise(F.col("note")).alias("note"), "body_faces_matching_declared_height",
        artwork.position(box(), F.col("width_mm"), F.col("height_mm"), F.col("artboard"), F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>")).alias("position"),
    )
    o, i = p.alias("o"), solid.alias("i")
    inner = o.join(i, artwork.same_keys(page, "o", "i") & artwork.contains("o", "i")).select(*[F.col(f"o.{k}").alias(k) for k in key], F.col("i.drawing_id").alias("box_no"), *[F.bround(f"i.{k}", 2).alias(k) for k in BOX])
    cx, cy = (F.col("s.x0") + F.col("s.x1")) / 2, (F.col("s.y0") + F.col("s.y1")) / 2

    def inside(a: str, b: str, places: int | None = None) -> Column:
        at = lambda k: F.bround(f"{b}.{k}", places) if places else F.col(f"{b}.{k}")
        return artwork.same_keys(page, a, b) & (at("x0") <= cx) & (cx <= at("x1")) & (at("y0") <= cy) & (cy <= at("y1"))

    texts = body.alias("s").join(p.alias("o"), inside("s", "o")).select(*[F.col(f"o.{k}").alias(k) for k in key], F.col("s.span_id").alias("span_id"), F.col("s.text").alias("text"), *[F.col(f"s.{k}").alias(k) for k in BOX])
    texts, inner = settled(texts), settled(inner)
    columns, placed = artwork.panel_columns(texts, inner, key)
    columns, blocks = settled(columns), settled(artwork.blocks(settled(placed), inner, key, house))
    counts = [
        inner.groupBy(*key).agg(F.count("*").alias("inner_box_count")), columns.groupBy(*key).agg(F.count("*").alias("column_count")), texts.groupBy(*key).agg(F.count("*").alias("text_span_count")),
        blocks.groupBy(*key).agg(F.count("*").alias("block_count"), F.count_if(F.col("legend").isNull()).alias("unidentified_block_count")),
    ]
    panels = p.join(facts.select(*page, "width_mm", "height_mm", "artboard"), page).select(
        *own, "panel_id", "grid_row", "grid_col", artwork.rounded_box().alias("bbox_mm"), F.bround(w, 2).alias("panel_width_mm"), F.bround(h, 2).alias("panel_height_mm"), "from_left_mm", "from_top_mm", "fill_color_hex",
        artwork.position(box(), F.col("width_mm"), F.col("height_mm"), F.col("artboard"), F.col("frame")).alias("position"),
    )
    for n in counts:
        panels = panels.join(n, key, "left")
    panels = panels.fillna(0, ["inner_box_count", "column_count", "text_span_count", "block_count", "unidentified_block_count"])
    axes = lambda name, ord_, row: [F.struct(ord_.alias("ord"), F.lit(a).alias("axis"), F.bround(row(f"{a}0"), 2).alias("lo"), F.bround(row(f"{a}1"), 2).alias("hi"), F.concat(name, F.lit(" " + side)).alias("name")) for a, side in (("x", "width"), ("y", "height"))]
    whole = c.select(*page, F.explode(F.array(*axes(F.concat(F.lit("component "), F.col("component_no").cast("string"), F.lit(" full")), F.struct(F.col("component_no").alias("c"), F.lit(0).alias("r"), F.lit(0).alias("k")), F.col))).alias("t"))
    parts = p.select(*page, F.explode(F.array(*axes(F.concat(F.lit("panel "), F.col("grid_row").cast("string"), F.lit("."), F.col("grid_col").cast("string")), F.struct(F.col("component_no").alias("c"), F.col("grid_row").alias("r"), F.col("grid_col").alias("k")), F.col))).alias("t"))
    targets = whole.unionByName(parts).select(*page, "t.*")
    regions = meta.select(*page, F.explode(F.array(F.struct(F.lit(0).alias("ord"), F.lit("printing_zone").alias("name"), F.col("printing_zone").alias("length")), F.struct(F.lit(1).alias("ord"), F.lit("repeat").alias("name"), F.col("repeat").alias("length")))).alias("r")).select(*page, "r.*").filter("length is not null")
    callouts = artwork.callouts(annotations, marks, page, targets, regions)
    unplaced = body.alias("s").join(p.alias("o"), inside("s", "o", 2), "left_anti").select(*page, "span_id", "text")
    per = components.groupBy(*page).agg(F.count("*").alias("component_count"), F.sum("panel_count").alias("panel_count"), F.min_by(F.struct("bbox_mm", "component_width_mm", "component_height_mm"), "component_no").alias("primary"))
    pages = meta.select(*page).join(per, page, "left").join(marks.groupBy(*page).agg(F.count("*").alias("callout_path_count")), page, "left").fillna(0, ["component_count", "panel_count", "callout_path_count"])
    pages = pages.withColumn("boundary_source", F.when(F.col("component_count") > 0, "dieline_paths"))
    return {"components": components, "panels": panels, "columns": columns, "blocks": blocks, "callouts": callouts, "unplaced": unplaced, "pages": pages}
