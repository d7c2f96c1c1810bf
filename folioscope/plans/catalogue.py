"""Registered layout queries, by fixture, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope import config
from folioscope.functions import geometry, text
from folioscope.operators import barcodes, clusters, pages
from folioscope.plans.registry import ORACLE, QUERIES, query  # noqa: F401
from folioscope.sources import fixtures, sinks

HEADER_PT = 120.0


def spans(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.fixture(spark, sf, fixtures.SPANS)


def paths(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.fixture(spark, sf, fixtures.PATHS)


def corrupt(spark: SparkSession, sf: str) -> DataFrame:
    text.enable_gbk(spark)
    return fixtures.fixture(spark, sf, fixtures.CORRUPT)


def routed(spark: SparkSession, sf: str) -> DataFrame:
    return pages.routed(spans(spark, sf), F.lit(HEADER_PT))


# ---- SQL shared by the oracles

def in_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def channel_sql(i: int) -> str:
    return f"cast('0x' || substr(color_hex, {2 * i + 2}, 2) as integer)"


NEAR_SQL = "(" + " or ".join("(" + " and ".join(f"abs({channel_sql(i)} - {int(c[2 * i + 1 : 2 * i + 3], 16)}) <= {config.COLOR_TOLERANCE}" for i in range(3)) + ")" for c in config.ANNOTATION_COLORS) + ")"
DIM_SQL = r"regexp_matches(text, '(?i)^\s*[\d.]+\s*mm\s*$')"
KEY_SQL = r"trim(trim(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9: ]', ' ', 'g'), '\s+', ' ', 'g')), ':'))"
MARK_SQL = f"(k in ({in_list(config.MARK_TERMS)}) or " + " or ".join(f"(starts_with(k, '{t} ') and length(k) - {len(t)} <= {config.MARK_SUFFIX})" for t in config.MARK_TERMS) + ")"
ROUTED_SQL = f"""with fx as ({fixtures.SPANS}), f as (select *, {NEAR_SQL} as near, {DIM_SQL} as dim, {KEY_SQL} as k, y0 < {HEADER_PT} as in_header,
  trim(text) in ({in_list(config.ARROWS)}) as arrow from fx where trim(text) <> ''),
g as (select *, {MARK_SQL} as mark, not in_header and ((near and dim) or arrow) as annotation, not in_header and dim and not near as dim_miss,
  regexp_matches(trim(text), '^[A-Za-z][A-Za-z0-9 .:/-]{{2,28}}$') and near as mark_shape from f),
r as (select *, case when annotation then 'annotation' when mark then 'production_mark' when in_header then 'header' else 'body' end as section,
  dim_miss and not mark and not annotation as annotation_near_miss, mark_shape and not mark and not annotation as mark_near_miss from g)
"""


@query("route_section_counts", ROUTED_SQL + "select page_no, " + ", ".join(f"count(*) filter (section = '{s}') as n_{s}" for s in pages.SECTIONS) + ", count(*) filter (annotation_near_miss) as n_annotation_near_miss, count(*) filter (mark_near_miss) as n_mark_near_miss from r group by page_no")
def route_section_counts(spark, sf):
    return pages.section_counts(routed(spark, sf))


@query("color_profile", ROUTED_SQL + "select page_no, color_hex, count(*) as spans, not any_value(near) as unknown, not any_value(near) and count(*) filter (dim and section <> 'annotation') >= 2 and count(*) filter (not dim and section <> 'annotation') = 0 as inferred from r where section <> 'production_mark' group by page_no, color_hex")
def color_profile(spark, sf):
    return pages.color_histogram(routed(spark, sf))


@query("color_summary", ROUTED_SQL + """, c as (select page_no, color_hex, count(*) as n, not any_value(near) as u, not any_value(near) and count(*) filter (dim and section <> 'annotation') >= 2 and count(*) filter (not dim and section <> 'annotation') = 0 as i from r where section <> 'production_mark' group by page_no, color_hex)
select page_no, string_agg(color_hex || ':' || n, ',' order by n desc, color_hex) as histogram, coalesce(string_agg(color_hex, ',' order by color_hex) filter (u), '') as unknown_colors, coalesce(string_agg(color_hex, ',' order by color_hex) filter (i), '') as inferred_annotation_colors from c group by page_no""")
def color_summary(spark, sf):
    h = pages.histogram(pages.color_histogram(routed(spark, sf)))
    joined = F.array_join(F.transform("histogram", lambda c: F.concat_ws(":", c["color_hex"], c["spans"].cast("string"))), ",")
    return h.select("page_no", joined.alias("histogram"), F.array_join("unknown_colors", ",").alias("unknown_colors"), F.array_join("inferred_annotation_colors", ",").alias("inferred_annotation_colors"))


COLORS_SQL = "select l_orderkey as k, '#' || lpad(printf('%x', cast(l_partkey * 7919 % 16777216 as bigint)), 6, '0') as color_hex from lineitem"


@query("annotation_color_match", f"select color_hex, count(*) as n, any_value({NEAR_SQL}) as is_annotation from ({COLORS_SQL}) group by color_hex")
def annotation_color_match(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet").select(geometry.packed_hex(F.col("l_partkey") * 7919 % 16777216).alias("color_hex"))
    return df.groupBy("color_hex").agg(F.count("*").alias("n")).withColumn("is_annotation", geometry.is_annotation_color(F.col("color_hex")))


MARKS = "select p_partkey, case p_partkey % 9 when 0 then 'Pasting-Side 1' when 1 then 'STEREO.print' when 2 then ' Varnish: free;' when 3 then ':scale 1:1:' when 4 then p_name when 5 then 'Stereo printing instructions' when 6 then 'die line ' || (p_partkey % 20000) when 7 then 'gusset (' || (p_partkey % 100) || ')' else 'tuck flap: ' || substr(p_name, 1, 1 + cast(p_partkey % 5 as int)) end as text from part"


@query("production_mark_keys", f"with f as (select p_partkey, text, {KEY_SQL} as k from ({MARKS})) select p_partkey, k as mark_key, {MARK_SQL} as is_mark from f")
def production_mark_keys(spark, sf):
    df = fixtures.fixture(spark, sf, MARKS)
    return df.select("p_partkey", text.mark_key(F.col("text")).alias("mark_key"), text.is_mark(F.col("text")).alias("is_mark"))


@query("repair_ligatures", f"with fx as ({fixtures.CORRUPT}) select doc_id, replace(replace(replace(text, 'Ɵ', 'ti'), 'Ō', 'ft'), 'Ʃ', 'tt') as repaired, cast(length(text) - length(replace(replace(replace(text, 'Ɵ', ''), 'Ō', ''), 'Ʃ', '')) as bigint) as n from fx")
def repair_ligatures(spark, sf):
    log = text.ligature_log(F.col("text"))
    return corrupt(spark, sf).select("doc_id", text.decode_ligatures(F.col("text")).alias("repaired"), F.aggregate(log, F.lit(0).cast("long"), lambda a, x: a + x["count"]).alias("n"))


@query("repair_mojibake", "select doc_id, text as repaired from documents")
def repair_mojibake(spark, sf):
    return corrupt(spark, sf).select("doc_id", text.repair_mojibake(text.decode_ligatures(F.col("text"))).alias("repaired"))


@query("repair_confidence_counts", f"with fx as ({fixtures.CORRUPT}) select case when text = clean then 'none' else 'high' end as confidence, count(*) as n from fx group by 1")
def repair_confidence_counts(spark, sf):
    return corrupt(spark, sf).groupBy(F.coalesce(text.repair(F.col("text"))["confidence"], F.lit("none")).alias("confidence")).agg(F.count("*").alias("n"))


@query("label_key", r"select p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || ' (LxW) #' || p_type), '[^a-z0-9]+', ' ', 'g'), '\s+', ' ', 'g')) as label_key from part")
def label_key(spark, sf):
    df = spark.read.parquet(f"{sf}/part.parquet")
    return df.select("p_partkey", text.label_key(F.concat("p_name", F.lit(" (LxW) #"), "p_type")).alias("label_key"))


@query("page_bbox_mm", f"with fx as ({fixtures.SPANS}) select page_no, round_even(min(x0) * 25.4 / 72, 2) as x0_mm, round_even(min(y0) * 25.4 / 72, 2) as y0_mm, round_even(max(x1) * 25.4 / 72, 2) as x1_mm, round_even(max(y1) * 25.4 / 72, 2) as y1_mm from fx group by page_no")
def page_bbox_mm(spark, sf):
    return pages.extents(spans(spark, sf))


#: Narrow paths stand at every second one; on every third page they are items of one path instead.
FOLDS = f"""select page_no, drawing_id, x0 + 0.4 as x0, y0, case when drawing_id % 2 = 0 then x0 + 2 else x1 end as x1, case when drawing_id % 2 = 0 then y0 + 10 * (drawing_id % 4 + 4) else y1 end as y1, page_no % 3 = 0 as compound from ({fixtures.PATHS})"""
FOLDS_SQL = f"""with w as ({FOLDS}), u as (select page_no, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from w where compound group by page_no),
d as (select page_no, x0, y0, x1, y1 from w where not compound union all select * from u),
m as (select page_no, min(x0) as a, max(x1) as b, min(y0) as t, max(y1) as e, greatest(max(y1) - min(y0), 1) as h from d where y0 >= 20 group by page_no),
l as (select distinct d.page_no, round_even(d.x0, 0) as x from d join m on d.page_no = m.page_no where d.y0 >= 20 and d.x1 - d.x0 < 3 and d.y1 - d.y0 > 0.3 * m.h
  union select distinct w.page_no, round_even(w.x0, 0) as x from w join m on w.page_no = m.page_no join u on w.page_no = u.page_no where compound and u.y1 > 20 and w.x1 - w.x0 < 3 and w.y1 - w.y0 > 0.3 * m.h and w.y1 > 20),
n as (select page_no from l group by page_no having count(*) >= 2),
c as (select page_no, x from l where page_no in (select page_no from n) union select page_no, round_even(a, 0) from m where page_no in (select page_no from n) union select page_no, round_even(b, 0) from m where page_no in (select page_no from n)),
p as (select page_no, x as x0, lead(x) over (partition by page_no order by x) as x1 from c),
z as (select p.page_no, cast(row_number() over (partition by p.page_no order by p.x0) - 1 as integer) as zone_no, p.x0, p.x1, m.t as y0, m.e as y1 from p join m on p.page_no = m.page_no where p.x1 - p.x0 >= 20)
"""


def folds(spark, sf):
    w = fixtures.fixture(spark, sf, FOLDS)
    items = w.filter("compound").groupBy("page_no").agg(*[f(c).alias(c) for c, f in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max))], F.collect_list(F.struct(F.when(F.col("drawing_id") % 2 == 0, "re").otherwise("l").alias("op"), "x0", "y0", "x1", "y1")).alias("items"))
    return w.filter("not compound").drop("compound", "drawing_id").withColumn("items", F.lit(None).cast(items.schema["items"].dataType)).unionByName(items)


@query("zones", FOLDS_SQL + "select page_no, zone_no, 'panel_' || zone_no as zone_id, x0, x1, y0, y1, round_even((x1 - x0) * 25.4 / 72, 2) as width_mm, round_even((y1 - y0) * 25.4 / 72, 2) as height_mm from z")
def zones(spark, sf):
    return pages.zones(folds(spark, sf), F.lit(20.0))


@query("zone_assignment", FOLDS_SQL + f""", s as ({fixtures.SPANS})
select s.page_no, s.span_id, case when s.page_no in (select page_no from z) then coalesce((select 'panel_' || cast(min(zone_no) as varchar) from z where z.page_no = s.page_no and (s.x0 + s.x1) / 2 between z.x0 and z.x1 and (s.y0 + s.y1) / 2 between z.y0 - 12 and z.y1 + 12), 'outside') end as zone from s""")
def zone_assignment(spark, sf):
    return pages.in_zones(spans(spark, sf), pages.zones(folds(spark, sf), F.lit(20.0))).select("page_no", "span_id", "zone")


ORDER_SQL = f"with fx as ({fixtures.SPANS}), o as (select *, cast(row_number() over (partition by page_no order by round_even(x0 / 40, 0), y0, x0, span_id) as integer) as pos from fx)"


@query("reading_order", ORDER_SQL + " select page_no, span_id, pos from o")
def reading_order(spark, sf):
    return pages.reading_order(spans(spark, sf)).select("page_no", "span_id", "pos")


@query("line_spacing", ORDER_SQL + """, n as (select *, lead(y1) over w as ny, lead(size) over w as ns, lead(turn) over w as nt, lead(round_even(x0 / 40, 0)) over w as nb from o window w as (partition by page_no order by pos))
select page_no, span_id, case when nb = round_even(x0 / 40, 0) and nt = turn and abs(ns - size) <= 0.25 * size and ny - y1 > 0 and ny - y1 <= 4 * size then round_even((ny - y1) / size, 2) end as line_spacing from n""")
def line_spacing(spark, sf):
    df = pages.reading_order(spans(spark, sf)).withColumn("zone", F.lit("z_outside"))
    return pages.line_spacing(df).select("page_no", "span_id", "line_spacing")


@query("body_text", ORDER_SQL + " select page_no, coalesce(string_agg(text, ' ' order by pos) filter (turn = 0), '') as body_text, string_agg(text, ' ' order by pos) as body_text_all from o group by page_no")
def body_text(spark, sf):
    return pages.page_text(pages.reading_order(spans(spark, sf)))


@query("rotated_elements", f"with fx as ({fixtures.SPANS}) select page_no, span_id, text, cast(turn * 90 as integer) as rotation_deg, case turn when 1 then '90_CW' when 2 then '180' else '90_CCW' end as rotation_sop from fx where turn <> 0")
def rotated_elements(spark, sf):
    df = spans(spark, sf)
    dx, dy = F.element_at(F.array(*[F.lit(float(v)) for v in (1, 0, -1, 0)]), F.col("turn") + 1), F.element_at(F.array(*[F.lit(float(v)) for v in (0, 1, 0, -1)]), F.col("turn") + 1)
    return pages.rotated(df.withColumn("rotation_deg", geometry.rotation(dx, dy)))


CHARS_SQL = "select p_partkey, replace(p_name, ' ', case when p_partkey % 3 = 0 then '   ' else ' ' end) as t from part"


@query("char_segments", rf"with s as ({CHARS_SQL}) select p_partkey, count(*) as n_segments, string_agg(x, '|' order by i) as joined from (select p_partkey, unnest(regexp_split_to_array(trim(t), ' {{2,}}')) as x, generate_subscripts(regexp_split_to_array(trim(t), ' {{2,}}'), 1) as i from s) group by p_partkey")
def char_segments(spark, sf):
    df = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.replace("p_name", F.lit(" "), F.lit("   "))).otherwise(F.col("p_name")).alias("t"))
    df = df.select("p_partkey", F.transform(F.split("t", ""), lambda c, i: F.struct(c.alias("c"), (i * 5.0).alias("x0"), F.lit(0.0).alias("y0"), (i * 5.0 + 5).alias("x1"), F.lit(8.0).alias("y1"))).alias("chars"))
    out = pages.segments(df, ["p_partkey"]).groupBy("p_partkey")
    return out.agg(F.count("*").alias("n_segments"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment_no", "text"))), lambda x: x["text"]), "|").alias("joined"))


@query("components", f"""with recursive fx as ({fixtures.PATHS}), e as (select a.page_no, a.drawing_id as u, b.drawing_id as v from fx a join fx b on a.page_no = b.page_no and a.x0 <= b.x1 + 0.5 and b.x0 <= a.x1 + 0.5 and a.y0 <= b.y1 + 0.5 and b.y0 <= a.y1 + 0.5),
r(page_no, u, v) as (select page_no, u, u from e union select r.page_no, r.u, e.v from r join e on r.page_no = e.page_no and r.v = e.u)
select page_no, cast(u as bigint) as drawing_id, cast(min(v) as bigint) as component from r group by page_no, u""")
def components(spark, sf):
    return clusters.touching(paths(spark, sf), ["page_no"], "drawing_id", 0.5)


@query("page_kind", f"""with s as ({fixtures.SPANS}), p as ({fixtures.PATHS}), a as (select page_no, count(*) filter (y0 >= 400) as n_text from s group by page_no), b as (select page_no, count(*) filter (y1 > 60) * 30 as n_paths from p group by page_no)
select a.page_no, case when a.page_no % 11 = 0 then 'component' when n_text = 0 and n_paths = 0 then 'blank' when n_text = 0 and a.page_no % 2 = 0 and n_paths >= 120 then 'outlined_text' when n_text = 0 then 'technical_drawing' else 'illustration' end as page_kind from a join b on a.page_no = b.page_no""")
def page_kind(spark, sf):
    a = spans(spark, sf).groupBy("page_no").agg(F.count_if(F.col("y0") >= 400).alias("n_text"))
    b = paths(spark, sf).groupBy("page_no").agg((F.count_if(F.col("y1") > 60) * 30).alias("n_paths"))
    return a.join(b, "page_no").select("page_no", pages.page_kind(F.col("page_no") % 11 == 0, F.col("n_text"), F.col("n_paths"), F.col("page_no") % 2).alias("page_kind"))


RAISED_SQL = f"""with fx as ({fixtures.SPANS}), f as (select page_no, span_id, replace(text, 'si', 'sƟ') as raw, replace(text, 'si', 'sti') as text, cast((span_id - 1) // 6 as integer) as block_no, cast((span_id - 1) // 3 as integer) as line_no, case span_id % 3 when 0 then 4.0 when 1 then 8.0 else 7.0 end as size,
  case when span_id % 3 = 0 and span_id % 2 = 0 then 6.0 when span_id % 3 = 2 then 11.0 else 10.0 end as mid from fx)"""


@query("gpmi_paragraphs", RAISED_SQL + """, g as (select *, max(size) over l as top from f window l as (partition by page_no, block_no, line_no)),
h as (select *, avg(case when size >= 0.82 * top then mid end) over (partition by page_no, block_no, line_no) as base from g),
m as (select *, case when size < 0.82 * top and mid < base - 0.3 then '<sup>' || text || '</sup>' when size < 0.82 * top and mid > base + 0.3 then '<sub>' || text || '</sub>' else text end as t from h),
n as (select page_no, block_no, line_no, trim(string_agg(t, '' order by span_id)) as t from m group by page_no, block_no, line_no)
select page_no, block_no, string_agg(t, ' ' order by line_no) as text from n where t <> '' group by page_no, block_no having length(string_agg(t, ' ' order by line_no)) > 1""")
def gpmi_paragraphs(spark, sf):
    text.enable_gbk(spark)
    k = F.col("span_id")
    mid = F.when((k % 3 == 0) & (k % 2 == 0), 6.0).when(k % 3 == 2, 11.0).otherwise(10.0)
    size = F.when(k % 3 == 0, 4.0).when(k % 3 == 1, 8.0).otherwise(7.0)
    df = spans(spark, sf).select("page_no", "span_id", F.replace("text", F.lit("si"), F.lit("sƟ")).alias("text"), F.floor((k - 1) / 6).cast("int").alias("block_no"), F.floor((k - 1) / 3).cast("int").alias("line_no"), size.alias("size"), (mid - 3).alias("y0"), (mid + 3).alias("y1"))
    return pages.paragraphs(df)


@query("document_rollup", ROUTED_SQL + """, p as (select page_no, count(*) filter (section = 'production_mark') as repairs, count(*) filter (annotation_near_miss) > 0 as a, count(*) filter (mark_near_miss) > 0 as m, page_no % 50 = 0 as failed from r group by page_no)
select o_custkey as doc, count(*) as page_count, count(*) filter (failed) as failed_pages, cast(sum(repairs) as bigint) as total_repairs,
  concat_ws(',', case when bool_or(failed) then 'page_extraction_failed' end, case when bool_or(a) then 'annotation_near_misses' end, case when bool_or(m) then 'mark_near_misses' end) as review_reasons, bool_or(a) or bool_or(m) or bool_or(failed) as needs_review
from p join orders on page_no = o_orderkey group by o_custkey""")
def document_rollup(spark, sf):
    p = pages.section_counts(routed(spark, sf)).withColumns({"repairs": F.col("n_production_mark"), "failed": F.col("page_no") % 50 == 0})
    p = pages.review(p, [("annotation_near_misses", F.col("n_annotation_near_miss") > 0), ("mark_near_misses", F.col("n_mark_near_miss") > 0)])
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("page_no"), F.col("o_custkey").alias("doc"))
    return pages.rollup(p.join(o, "page_no"), "doc")


@query("render_scale", "select l_orderkey as page_no, l_linenumber as dpi_step, cast(round_even(596.0 * (150 + 50 * l_linenumber) / 72, 0) as bigint) as width_px, round_even((150 + 50 * l_linenumber) / 72, 6) as scale_px_per_pt, round_even((150 + 50 * l_linenumber) / 25.4, 6) as scale_px_per_mm from (select distinct l_orderkey, l_linenumber from lineitem)")
def render_scale(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("page_no"), F.col("l_linenumber").alias("dpi_step")).distinct()
    return df.withColumn("r", sinks.render_scale(F.lit(596.0), F.lit(842.0), (150 + 50 * F.col("dpi_step")).cast("double"))).select("page_no", "dpi_step", "r.width_px", "r.scale_px_per_pt", "r.scale_px_per_mm")


CODE_SQL = "select p_partkey, cast(890800121206 + p_partkey * 7919 as varchar) as s from part"
SUM_SQL = " + ".join(f"cast(substr(s, {i}, 1) as integer) * {3 if i % 2 == 0 else 1}" for i in range(1, 13))
CHECK_SQL = f"(10 - ({SUM_SQL}) % 10) % 10"


def codes(spark, sf):
    s = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", (F.lit(890800121206) + F.col("p_partkey") * 7919).cast("string").alias("s"))
    return s.withColumn("check_digit", barcodes.check_digit(F.col("s")))


@query("barcode_check_digit", f"select p_partkey, {CHECK_SQL} as check_digit from ({CODE_SQL})")
def barcode_check_digit(spark, sf):
    return codes(spark, sf).select("p_partkey", "check_digit")


@query("barcode_decode", f"select p_partkey, s || cast({CHECK_SQL} as varchar) as value, true as check_digit_valid, 33.51 as width_mm from ({CODE_SQL})")
def barcode_decode(spark, sf):
    c = codes(spark, sf).withColumn("m", barcodes.encoded(F.concat("s", F.col("check_digit").cast("string"))))
    found = barcodes.decoded(barcodes.symbols(barcodes.drawn(c, ["p_partkey"], "m"), ["p_partkey"]))
    return found.select("p_partkey", "value", "check_digit_valid", "width_mm")


from folioscope.plans import facts, headers, panels  # noqa: E402,F401  (they register themselves)
