"""Smaller page facts: images and paths, alignment, page names, header bands, strokes, swatches, row heights, OCR ladder, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope import config
from folioscope.functions import geometry, text
from folioscope.operators.header import unanimous


def images(df: DataFrame) -> DataFrame:
    """Placed images with sizes in mm and pixel aspect ratio (null without a height)."""
    return df.withColumns({
        "width_mm": geometry.mm(F.col("x1") - F.col("x0")), "height_mm": geometry.mm(F.col("y1") - F.col("y0")),
        "aspect_ratio": F.when(F.col("height_px") > 0, F.bround(F.col("width_px") / F.col("height_px"), 2)),
    })


def paths(drawings: DataFrame) -> DataFrame:
    """Drawings with a box as paths: stroke width, stroke and fill colours (null without one), the colour that stands for both, and boxes in whole points and mm."""
    of = lambda c: F.when(F.size(c) > 0, geometry.channels_hex(F.col(c)))
    out = drawings.filter("x0 is not null and y0 is not null and x1 is not null and y1 is not null")
    box = F.array("x0", "y0", "x1", "y1")
    return out.withColumns({
        "stroke_width_pt": F.bround(F.coalesce("width", F.lit(0.0)), 2), "stroke_color_hex": of("stroke"), "fill_color_hex": of("fill"), "color_hex": F.coalesce(of("stroke"), of("fill"), F.lit("#000000")),
        "bbox": F.transform(box, geometry.snap), "bbox_mm": geometry.box_mm(box),
    })


def visible(chars: Column) -> Column:
    """The characters that are not blank."""
    return F.filter(chars, lambda c: text.strip(c["c"]) != "")


def alignment(chars: Column, box: Column) -> Column:
    """What a span's characters say beyond its box: the visible box if an edge moved, and its colons.

    chars: array of (c, x0, y0, x1, y1), without a box where x0 is null; box: struct of x0, y0, x1, y1, or null."""
    seen = F.filter(visible(chars), lambda c: c["x0"].isNotNull())
    edges = [F.array_min(F.transform(seen, lambda c: c["x0"])), F.array_min(F.transform(seen, lambda c: c["y0"])), F.array_max(F.transform(seen, lambda c: c["x1"])), F.array_max(F.transform(seen, lambda c: c["y1"]))]
    moved = F.lit(False)
    for e, name in zip(edges, ("x0", "y0", "x1", "y1"), strict=True):
        moved = moved | (F.abs(e - box[name]) > 0.01)
    mark = lambda c, i: F.struct(c["c"].alias("char"), i.alias("index"), geometry.box_mm(F.array(c["x0"], c["y0"], c["x1"], c["y1"])).alias("bbox_mm"), geometry.mm(c["x0"]).alias("x0_mm"))
    marks = F.filter(F.transform(chars, mark), lambda m: (m["char"] == ":") & m["x0_mm"].isNotNull())
    return F.struct(F.when((F.size(seen) > 0) & F.coalesce(moved, F.lit(True)), F.transform(F.array(*edges), geometry.mm)).alias("visible_bbox_mm"), F.when(F.size(marks) > 0, marks).alias("colons"))


def after_component_type(t: Column) -> Column:
    """The text after the words `component type`, each within one edit, or null. One colon or dash between is dropped."""
    exact = F.regexp_extract(t, r"(?is)^.*?component\s+type(.*)$", 1)
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    two = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.struct(i.alias("i"), F.lower(F.try_element_at(words, i)).alias("a"), F.lower(F.regexp_replace(F.try_element_at(words, i + 1), "[:-]+$", "")).alias("b")))
    hit = F.try_element_at(F.filter(two, lambda p: F.coalesce(text.within_one_edit(p["a"], F.lit("component")) & text.within_one_edit(p["b"], F.lit("type")), F.lit(False))), F.lit(1))["i"]
    rest = F.call_function("regexp_extract", t, F.concat(F.lit(r"(?s)^\s*(?:\S+\s+){"), hit.cast("string"), F.lit(r"}\S+?([:-]*(?:\s.*)?)$")), F.lit(1))
    plain = lambda c: text.strip(F.regexp_replace(c, r"^\s*[:\-]?\s*", ""))
    return F.when(t.rlike(r"(?i)component\s+type"), plain(exact)).when(hit.isNotNull(), plain(rest))


def page_names(spans: DataFrame, page: list[str], default: Column) -> DataFrame:
    """page, name, detected: what follows the component-type label, in it or in the nearest span to its right.

    spans: section, span_id, text, box (whole points). Header spans are asked before body spans; the first label with a value wins.
    A label whose leftmost neighbour is blank has none."""
    s = spans.filter("section in ('header', 'body')").withColumns({"ord": F.struct((F.col("section") != "header").alias("body"), F.col("span_id")), "cy": (F.col("y0") + F.col("y1")) / 2})
    labels = s.withColumn("inline", after_component_type(text.strip(F.col("text")))).filter("inline is not null").select(*page, F.col("ord").alias("l_ord"), F.col("span_id").alias("l_id"), F.col("x0").alias("l_x0"), F.col("cy").alias("l_cy"), "inline")
    near = labels.join(s.select(*page, "span_id", "ord", "x0", "cy", text.strip(F.col("text")).alias("v")), page, "left")
    fits = (F.col("span_id") != F.col("l_id")) & (F.abs(F.col("cy") - F.col("l_cy")) < 15) & (F.col("x0") > F.col("l_x0"))
    value = near.groupBy(*page, "l_ord", "inline").agg(F.min_by("v", F.when(fits, F.struct("x0", "ord"))).alias("right"))
    value = value.withColumn("value", F.when(F.col("inline") != "", F.col("inline")).when(F.col("right") != "", F.col("right"))).filter("value is not null")
    found = value.groupBy(*page).agg(F.min_by("value", "l_ord").alias("found"))
    return spans.select(*page).distinct().join(found, page, "left").select(*page, F.coalesce("found", default).alias("name"), F.col("found").isNotNull().alias("detected"))


def in_band(y0: Column, y1: Column, bottom: Column) -> Column:
    """Whether a path belongs to the header whose texts end at bottom: most of its height lies above that and a pad; of a flat rule, its top."""
    end, h = bottom + config.BAND_PAD_PT, y1 - y0
    return F.when(h <= config.GRID_EPS_PT, y0 <= end).otherwise(F.greatest(F.least(y1, end) - y0, F.lit(0.0)) / h >= config.BAND_OVERLAP)


def border_strokes(paths_: DataFrame, page: list[str]) -> DataFrame:
    """The distinct stroke widths of a table's cells: of all unfilled paths but the largest ones, or of all if nothing else is left."""
    size = geometry.area(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    p = paths_.filter("fill_color_hex is null and stroke_width_pt is not null").withColumn("small", size < 0.9 * F.max(size).over(Window.partitionBy(*page)))
    return p.groupBy(*page).agg(F.sort_array(F.collect_set(F.when(F.col("small"), F.col("stroke_width_pt")))).alias("some"), F.sort_array(F.collect_set("stroke_width_pt")).alias("all")).select(*page, F.when(F.size("some") > 0, F.col("some")).otherwise(F.col("all")).alias("border_stroke_pt"))


def swatches(groups: DataFrame, fills: DataFrame, page: list[str], key: str) -> DataFrame:
    """The first filled path inside each group's box (2 pt tolerance). fills: drawing_id, fill_color_hex, box."""
    g, f = groups.alias("g"), fills.alias("f")
    hit = (F.col("f.x0") >= F.col("g.x0") - 2) & (F.col("f.x1") <= F.col("g.x1") + 2) & (F.col("f.y0") >= F.col("g.y0") - 2) & (F.col("f.y1") <= F.col("g.y1") + 2)
    for c in page:
        hit = hit & (F.col(f"g.{c}") == F.col(f"f.{c}"))
    return g.join(f, hit).groupBy(*[F.col(f"g.{c}").alias(c) for c in [*page, key]]).agg(F.min_by("f.fill_color_hex", "f.drawing_id").alias("swatch"))


FORMATS = ("font", "size", "bold", "italic", "color_hex")


def groups(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans of a cell or value as one group: text in order of top and left, extent, and formatting where all spans agree."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "span_id", "text"))), lambda s: text.strip(s["text"])), " ")
    return spans.groupBy(*keys).agg(
        text.squeeze(joined).alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        *[unanimous(f).alias(f) for f in FORMATS], F.coalesce(*[F.when(F.countDistinct(F.coalesce(F.col(f).cast("string"), F.lit("\0"))) > 1, True) for f in FORMATS], F.lit(False)).alias("mixed_formatting"),
    )


def alignment_in(lo: Column, hi: Column, cell_lo: Column, cell_hi: Column, names: tuple[str, str, str], eps: float = 3.0) -> Column:
    """Which of three places a text takes in its cell: nearer the start, in the middle, nearer the end."""
    before, after = lo - cell_lo, cell_hi - hi
    return F.when(F.abs(before - after) <= eps, names[1]).when(after < before, names[2]).otherwise(names[0])


def horizontal_alignment(text0: Column, text1: Column, cell0: Column, cell1: Column) -> Column:
    return alignment_in(text0, text1, cell0, cell1, ("left", "center", "right"))


def vertical_alignment(text0: Column, text1: Column, cell0: Column, cell1: Column) -> Column:
    return alignment_in(text0, text1, cell0, cell1, ("top", "middle", "bottom"))


def row_heights(cells: DataFrame, page: list[str]) -> DataFrame:
    """Rows of a drawn grid: tops (one decimal) whose cells cover the table's width, with the top of the row and its height.

    cells: box, and table_x0, table_x1, table_y1 of the table. The last row ends with the table."""
    rows = cells.groupBy(*page, F.bround("y0", 1).alias("top")).agg(F.sum(F.col("x1") - F.col("x0")).alias("covered"), F.min("y0").alias("y0"), F.max(F.col("table_x1") - F.col("table_x0")).alias("w"), F.max("table_y1").alias("end"))
    rows = rows.filter(F.col("covered") >= F.col("w") - 2 * config.GRID_EPS_PT)
    return rows.withColumn("height_mm", geometry.mm(F.coalesce(F.lead("y0").over(Window.partitionBy(*page).orderBy("top")), F.col("end")) - F.col("y0"))).select(*page, "top", "y0", "height_mm")


#: Most damaged spans of a page that are read again.
OCR_SPANS = 15


def ocr_ladder(spans: DataFrame, page: list[str], available: bool) -> DataFrame:
    """page, guessed, ocr_spans, skip_reason: why guessed spans of a page are not read again, or null."""
    n = F.count_if(F.col("confidence") == "guessed")
    reason = F.when(n == 0, None).when(F.lit(not available), "ocr_unavailable").when(n > OCR_SPANS, "ocr_skipped_too_many_corrupt_spans")
    return spans.groupBy(*page).agg(n.alias("guessed"), reason.alias("skip_reason")).select(*page, "guessed", F.when(F.col("skip_reason").isNull(), F.col("guessed")).otherwise(F.lit(0)).alias("ocr_spans"), "skip_reason")


def ocr_verdict(repaired: Column, read: Column) -> Column:
    """guessed without a reading, ocr_confirmed if it agrees but for case and blanks, else ocr_disagreement."""
    return F.when(read.isNull(), "guessed").when(text.compare_key(repaired) == text.compare_key(read), "ocr_confirmed").otherwise("ocr_disagreement")


def numbered(paragraphs: DataFrame, doc: str, order: list[str], filename: str) -> DataFrame:
    """One row a document: its paragraphs numbered from 0 across pages, one a line, and its file name without the ending."""
    at = F.row_number().over(Window.partitionBy(doc).orderBy(*order)) - 1
    p = paragraphs.withColumn("n", at)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: F.concat(F.lit("["), x["n"].cast("string"), F.lit("] "), x["text"]))
    return p.groupBy(doc).agg(F.count("*").alias("paragraphCount"), F.array_join(lines, "\n").alias("text"), F.regexp_replace(F.first(filename), r"\.[^.]*$", "").alias("fileName"), F.lit("pdf").alias("fileType"))
