"""Queries on single texts, colours, boxes and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope import config
from folioscope.functions import geometry, text
from folioscope.operators import barcodes, details, header, pages
from folioscope.plans.registry import query
from folioscope.sources import fixtures, layout, sinks

LOST, SOFT = text.LOST, text.SOFT


def part(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet")


COLORS = "select p_partkey, case p_partkey % 6 when 0 then null when 1 then [(p_partkey % 100) / 100.0] when 2 then [(p_partkey % 7) / 7.0, (p_partkey % 11) / 11.0, (p_partkey % 13) / 13.0] when 3 then [(p_partkey % 8) / 8.0, (p_partkey % 4) / 4.0, 0.5, (p_partkey % 16) / 16.0] when 4 then [0.5, 0.5] else [] end as c from part"


def color_arrays(spark, sf):
    k = F.col("p_partkey")
    share = lambda n: (k % n) / F.lit(float(n))
    c = F.when(k % 6 == 1, F.array((k % 100) / F.lit(100.0))).when(k % 6 == 2, F.array(share(7), share(11), share(13))).when(k % 6 == 3, F.array(share(8), share(4), F.lit(0.5), share(16))).when(k % 6 == 4, F.array(F.lit(0.5), F.lit(0.5))).when(k % 6 == 5, F.array().cast("array<double>"))
    return part(spark, sf).select("p_partkey", c.alias("c"))


def hex_sql(v: str) -> str:
    return f"printf('%02x', cast(trunc({v}) as int))"


CMYK_SQL = " || ".join(hex_sql(f"255 * (1 - c[{i}]) * (1 - c[4])") for i in (1, 2, 3))
RGB_SQL = " || ".join(hex_sql(f"c[{i}] * 255") for i in (1, 2, 3))


@query("channel_colors", f"with f as ({COLORS}) select p_partkey, '#' || case len(c) when 1 then repeat({hex_sql('c[1] * 255')}, 3) when 3 then {RGB_SQL} when 4 then {CMYK_SQL} else '000000' end as color_hex from (select p_partkey, coalesce(c, []) as c from f)")
def channel_colors(spark, sf):
    return color_arrays(spark, sf).select("p_partkey", geometry.channels_hex(F.col("c")).alias("color_hex"))


@query("path_projection", f"with f as ({COLORS}), g as (select p_partkey, coalesce(c, []) as c, p_partkey % 4 = 0 as filled from f), h as (select *, '#' || case len(c) when 1 then repeat({hex_sql('c[1] * 255')}, 3) when 3 then {RGB_SQL} when 4 then {CMYK_SQL} else '000000' end as x from g) select p_partkey, round_even(p_partkey % 50 / 16.0, 2) as stroke_width_pt, case when len(c) > 0 and not filled then x end as stroke_color_hex, case when len(c) > 0 and filled then x end as fill_color_hex, case when len(c) > 0 then x else '#000000' end as color_hex, round_even((p_partkey % 90) * 25.4 / 72, 2) as x0_mm from h where p_partkey % 5 > 0")
def path_projection(spark, sf):
    k = F.col("p_partkey")
    none = F.lit(None).cast("array<double>")
    d = color_arrays(spark, sf).withColumns({"fill": F.when(k % 4 == 0, F.col("c")).otherwise(none), "stroke": F.when(k % 4 != 0, F.col("c")).otherwise(none), "width": (k % 50) / F.lit(16.0), "x0": F.when(k % 5 > 0, (k % 90).cast("double")), "y0": F.lit(0.0), "x1": F.lit(99.0), "y1": F.lit(9.0)})
    return details.paths(d).select("p_partkey", "stroke_width_pt", "stroke_color_hex", "fill_color_hex", "color_hex", F.col("bbox_mm")[0].alias("x0_mm"))


@query("image_sizes", "select p_partkey, round_even((10 + p_size * 3) * 25.4 / 72, 2) as width_mm, round_even(p_size * 25.4 / 72, 2) as height_mm, case when p_size % 5 > 0 then round_even((100 + p_size) / cast(p_size % 5 * 49 as double), 2) end as aspect_ratio from part")
def image_sizes(spark, sf):
    i = part(spark, sf).select("p_partkey", F.lit(5.0).alias("x0"), F.lit(7.0).alias("y0"), (15.0 + F.col("p_size") * 3).alias("x1"), (7.0 + F.col("p_size")).alias("y1"), (100 + F.col("p_size")).alias("width_px"), (F.col("p_size") % 5 * 49).alias("height_px"))
    return details.images(i).select("p_partkey", "width_mm", "height_mm", "aspect_ratio")


FONTS = ["ABCDEF+Arial-BoldMT", "Helvetica-BoldItalic", "TimesNewRomanPS-ItalicMT", "MyriadPro-Semibold", "Univers-Black", "A+B+Frutiger Light", "OpenSans-Regular", "Gill Oblique Medium", "Slant-PS", "Arial"]


@query("font_styles", "with f as (select p_partkey, [" + ", ".join(f"'{f}'" for f in FONTS) + f"][1 + cast(p_partkey % {len(FONTS)} as int)] as font, cast(case p_partkey % 3 when 0 then 0 when 1 then 262144 else 64 end as int) as flags from part) select p_partkey, (flags & 262144) <> 0 or regexp_matches(lower(font), 'bold|black|heavy|demi') as bold, (flags & 64) <> 0 or regexp_matches(lower(font), 'italic|oblique|slant') as italic, trim(" + "replace(" * len(config.FONT_SUFFIXES) + "regexp_extract(font, '[^+]*$')" + "".join(f", '{s}', '')" for s in config.FONT_SUFFIXES) + ") as base_font from f")
def font_styles(spark, sf):
    k = F.col("p_partkey")
    f = part(spark, sf).select("p_partkey", F.get(F.array(*map(F.lit, FONTS)), (k % len(FONTS)).cast("int")).alias("font"), F.when(k % 3 == 0, 0).when(k % 3 == 1, 1 << 18).otherwise(1 << 6).alias("flags"))
    return f.select("p_partkey", geometry.is_bold(F.col("font"), F.col("flags")).alias("bold"), geometry.is_italic(F.col("font"), F.col("flags")).alias("italic"), geometry.base_font(F.col("font")).alias("base_font"))


@query("snapped_sizes", "select distinct l_quantity / 8 as size, round_even(l_quantity / 8 / 0.5, 0) * 0.5 as snapped, round_even(l_quantity / 8, 0) as whole from lineitem")
def snapped_sizes(spark, sf):
    s = spark.read.parquet(f"{sf}/lineitem.parquet").select((F.col("l_quantity") / 8).alias("size")).distinct()
    return s.select("size", geometry.snap_size(F.col("size")).alias("snapped"), geometry.snap(F.col("size")).alias("whole"))


@query("unknown_code_points", f"with f as (select doc_id, substr(text, 1, 200) || case doc_id % 4 when 0 then ' Жα😀' when 1 then ' ½€Ω½' else '' end as t from documents where text is not null), c as (select doc_id, unnest(list_distinct(regexp_split_to_array(t, ''))) as c from f) select doc_id, string_agg('U+' || format('{{:04X}}', ord(c)), ',' order by 'U+' || format('{{:04X}}', ord(c))) as unknown from c where c <> '' and ord(c) > 127 and not contains('{config.EXPECTED}', c) group by doc_id")
def unknown_code_points(spark, sf):
    more = F.when(F.col("doc_id") % 4 == 0, " Жα😀").when(F.col("doc_id") % 4 == 1, " ½€Ω½").otherwise("")
    d = spark.read.parquet(f"{sf}/documents.parquet").filter("text is not null").select("doc_id", text.unknown_code_points(F.concat(F.substring("text", 1, 200), more)).alias("u"))
    return d.select("doc_id", F.array_join("u", ",").alias("unknown")).filter("unknown != ''")


@query("plausible_texts", "select doc_id, regexp_matches(t, '^[\\x{0000}-\\x{024f}\\x{2000}-\\x{20cf}\\x{2122}]+$') as plausible from (select doc_id, substr(text, 1, 80) || case doc_id % 4 when 0 then 'ж' when 1 then '™€' when 2 then '中' else 'ɏ' end as t from documents where text is not null)")
def plausible_texts(spark, sf):
    k = F.col("doc_id") % 4
    more = F.when(k == 0, "ж").when(k == 1, "™€").when(k == 2, "中").otherwise("ɏ")
    return spark.read.parquet(f"{sf}/documents.parquet").filter("text is not null").select("doc_id", text.plausible(F.concat(F.substring("text", 1, 80), more)).alias("plausible"))


#: Damage of eight kinds to plain sentences, what repair makes of it, and how sure it is.
DAMAGE = [
    ("conƟene aƩached 30⁰C", "contiene attached 30°C", "high", 3), ("Pas�ng Side y ce�riaxona", "Pasting Side y ceftriaxona", "high", 2), ("x��y z", "x��y z", "failed", 1), ("ac�vidad �ene", "actividad tiene", "guessed", 1),
    ("a­b ­ c", "atib ­ c", "guessed", 1), ("fin.­ Ya", "fin. Ya", "high", 1), ("Composici贸n", "Composición", "high", 1), ("plain text", "plain text", None, 0), ("中文 stays", "中文 stays", None, 0),
    ("o�, m��n ac�vo", "o�, m��n activo", "failed", 2), ("ﬁn ﬂor", "fin flor", "high", 2), ("te�o Bo�om", "tetio Bottom", "guessed", 2),
]


@query("repair_text", "with d(i, good, confidence, lines) as (values " + ", ".join(f"({i}, '{g}', {'null' if c is None else chr(39) + c + chr(39)}, {n})" for i, (_, g, c, n) in enumerate(DAMAGE)) + f") select p_partkey, p_name || ' ' || good as repaired, confidence, lines > 0 as was_repaired, cast(lines as int) as log_lines from part join d on d.i = p_partkey % {len(DAMAGE)}")
def repair_text(spark, sf):
    text.enable_gbk(spark)
    bad = F.get(F.array(*[F.lit(b) for b, *_ in DAMAGE]), (F.col("p_partkey") % len(DAMAGE)).cast("int"))
    r = part(spark, sf).select("p_partkey", text.repair(F.concat("p_name", F.lit(" "), bad)).alias("r"))
    return r.select("p_partkey", F.col("r.text").alias("repaired"), "r.confidence", F.col("r.repaired").alias("was_repaired"), F.size("r.log").alias("log_lines"))


@query("compare_keys", r"select p_partkey, lower(trim(regexp_replace(p_name || chr(10) || '  ' || p_type || chr(9), '\s+', ' ', 'g'))) as compare_key from part")
def compare_keys(spark, sf):
    return part(spark, sf).select("p_partkey", text.compare_key(F.concat("p_name", F.lit("\n  "), "p_type", F.lit("\t"))).alias("compare_key"))


@query("one_edit_apart", "select a.p_partkey, levenshtein(substr(a.p_name, 1, 6), substr(a.p_type, 1, 5 + cast(a.p_partkey % 3 as int))) <= 1 or levenshtein(a.p_name, b) <= 1 as alike from (select *, case p_partkey % 5 when 0 then p_name when 1 then 'x' || p_name when 2 then substr(p_name, 2) when 3 then 'z' || substr(p_name, 2) else 'yy' || p_name end as b from part) a")
def one_edit_apart(spark, sf):
    k, n = F.col("p_partkey"), F.col("p_name")
    b = F.when(k % 5 == 0, n).when(k % 5 == 1, F.concat(F.lit("x"), n)).when(k % 5 == 2, F.expr("substr(p_name, 2)")).when(k % 5 == 3, F.concat(F.lit("z"), F.expr("substr(p_name, 2)"))).otherwise(F.concat(F.lit("yy"), n))
    return part(spark, sf).select("p_partkey", (text.within_one_edit(F.substring("p_name", 1, 6), F.expr("substr(p_type, 1, 5 + cast(p_partkey % 3 as int))")) | text.within_one_edit(n, b)).alias("alike"))


TYPES = [("Component Type: Carton", "Carton"), ("component   TYPE", ""), ("Componet Typ: Foil strip", "Foil strip"), ("the Component Types - x", "s - x"), ("comXonent type:- Label", "- Label"), ("Type of component", None), ("a component typo: b", "b"), ("compnent  tpye: c", None)]


@query("component_types", "with d(i, v) as (values " + ", ".join(f"({i}, {'null' if v is None else chr(39) + v + chr(39)})" for i, (_, v) in enumerate(TYPES)) + f") select p_partkey, case when v is null then null else trim(v || ' ' || p_name) end as value from part join d on d.i = p_partkey % {len(TYPES)}")
def component_types(spark, sf):
    t = F.concat(F.get(F.array(*[F.lit(a) for a, _ in TYPES]), (F.col("p_partkey") % len(TYPES)).cast("int")), F.lit(" "), "p_name")
    return part(spark, sf).select("p_partkey", details.after_component_type(t).alias("value"))


@query("folded_texts", "select doc_id, strip_accents(lower(substr(text, 1, 300))) as folded from documents where text is not null")
def folded_texts(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").filter("text is not null").select("doc_id", text.strip_accents(F.lower(F.substring("text", 1, 300))).alias("folded"))


@query("first_order", f"select page_no, span_id, cast(row_number() over (partition by page_no order by y0, x0, span_id) as int) as pos from ({fixtures.SPANS})")
def first_order(spark, sf):
    return pages.first_order(fixtures.fixture(spark, sf, fixtures.SPANS)).select("page_no", "span_id", "pos")


@query("kept_spacing", "select l_orderkey as page_no, l_linenumber, l_discount, case when l_orderkey % 3 = 0 or l_linenumber % 2 = 0 then l_discount end as line_spacing from lineitem")
def kept_spacing(spark, sf):
    l = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("page_no"), "l_linenumber", "l_discount")
    return l.withColumn("line_spacing", pages.kept_spacing(F.col("l_discount"), F.when(F.col("page_no") % 3 == 0, "Insert A").otherwise("Carton"), F.col("l_linenumber") % 2 == 1))





def chars(spark, sf):
    p = part(spark, sf).select("p_partkey", F.concat(F.lit(" "), "p_name", F.lit(": "), "p_type", F.lit(" ")).alias("t"))
    lost = lambda i, v: F.when(i % 7 != 6, v)
    return p.select("p_partkey", "t", F.transform(F.split("t", ""), lambda c, i: F.struct(c.alias("c"), lost(i, i * 5.0).alias("x0"), lost(i, F.lit(2.0)).alias("y0"), lost(i, i * 5.0 + 5).alias("x1"), lost(i, F.lit(10.0)).alias("y1"))).alias("chars"))


CHARS_SQL = "with t as (select p_partkey, ' ' || p_name || ': ' || p_type || ' ' as t from part), c as (select p_partkey, i, substr(t, i + 1, 1) as c, length(t) as n from (select *, unnest(range(0, length(t))) as i from t))"


@query("char_alignment", CHARS_SQL + " select p_partkey, round_even(min(i) filter (c <> ' ' and i % 7 <> 6) * 5 * 25.4 / 72, 2) as visible_x0_mm, round_even((max(i) filter (c <> ' ' and i % 7 <> 6) * 5 + 5) * 25.4 / 72, 2) as visible_x1_mm, coalesce(string_agg(i || '@' || cast(cast(round_even(i * 5.0 * 25.4 / 72, 2) * 100 as bigint) as varchar), ',' order by i) filter (c = ':' and i % 7 <> 6), '') as colons from c group by p_partkey")
def char_alignment(spark, sf):
    box = F.struct(F.lit(0.0).alias("x0"), F.lit(2.0).alias("y0"), (F.length("t") * 5.0).alias("x1"), F.lit(10.0).alias("y1"))
    a = chars(spark, sf).select("p_partkey", details.alignment(F.col("chars"), box).alias("a"))
    colons = F.array_join(F.transform("a.colons", lambda c: F.concat(c["index"].cast("string"), F.lit("@"), F.round(c["x0_mm"] * 100).cast("bigint").cast("string"))), ",")
    return a.select("p_partkey", F.col("a.visible_bbox_mm")[0].alias("visible_x0_mm"), F.col("a.visible_bbox_mm")[2].alias("visible_x1_mm"), F.coalesce(colons, F.lit("")).alias("colons"))


@query("visible_chars", CHARS_SQL + " select p_partkey, count(*) filter (c <> ' ') as n from c group by p_partkey")
def visible_chars(spark, sf):
    return chars(spark, sf).select("p_partkey", F.size(details.visible(F.col("chars"))).cast("long").alias("n"))


NAMES = f"select page_no, span_id, case when span_id in (0, 2) then 'header' else 'body' end as section, x0, y0, x1, y1, case when span_id = 4 and page_no % 3 = 0 then 'Component Type' when span_id = 2 and page_no % 4 = 0 then 'Component type: ' || text when span_id = 2 and page_no % 4 = 1 then 'component type' when span_id = 3 and page_no % 5 = 0 then ' ' else text end as text from ({fixtures.HEADERS})"


@query("page_names", f"""with f as ({NAMES}), l as (select *, case when page_no % 4 = 0 and span_id = 2 then trim(regexp_replace(text, '^(?i)component\\s+type\\s*[:-]?\\s*', '')) else '' end as inline from f where (span_id = 4 and page_no % 3 = 0) or (span_id = 2 and page_no % 4 <= 1)),
r as (select l.page_no, l.section <> 'header' as body, l.span_id, coalesce(nullif(l.inline, ''), (select nullif(arg_min(trim(o.text), (o.x0, o.section <> 'header', o.span_id)), '') from f o where o.page_no = l.page_no and o.span_id <> l.span_id and abs((o.y0 + o.y1) / 2 - (l.y0 + l.y1) / 2) < 15 and o.x0 > l.x0)) as v from l),
b as (select page_no, arg_min(v, (body, span_id)) as v from r where v is not null group by page_no)
select p.page_no, coalesce(b.v, 'page ' || p.page_no) as name, b.v is not null as detected from (select distinct page_no from f) p left join b on b.page_no = p.page_no""")
def page_names(spark, sf):
    return details.page_names(fixtures.fixture(spark, sf, NAMES), ["page_no"], pages.slot(F.col("page_no"))["name"])


@query("page_slots", "select distinct l_orderkey as page_no, 'page' || l_orderkey as key, 'page ' || l_orderkey as name from lineitem")
def page_slots(spark, sf):
    return spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("page_no")).distinct().withColumn("s", pages.slot(F.col("page_no"))).select("page_no", "s.*")


#: Spans with the outcome of their repair.
REPAIRED = f"select page_no, span_id, text, case span_id % 4 when 0 then 'body' when 3 then 'annotation' else 'header' end as section, span_id % 5 < 2 as repaired, case (page_no + span_id) % 7 when 0 then 'guessed' when 1 then 'failed' when 2 then 'ocr_confirmed' when 3 then 'high' end as confidence, 'F' || (span_id % 3) as font from ({fixtures.SPANS})"


@query("repair_counts", f"with s as (select * from ({REPAIRED}) where section in ('header', 'body')) select page_no, count(*) filter (repaired) as repairs, count(*) filter (confidence in ('guessed', 'failed')) as unresolved, coalesce(string_agg(distinct font, ',' order by font) filter (confidence in ('guessed', 'failed', 'ocr_confirmed')), '') as guessed_fonts from s group by page_no")
def repair_counts(spark, sf):
    return pages.repair_counts(fixtures.fixture(spark, sf, REPAIRED)).withColumn("guessed_fonts", F.array_join("guessed_fonts", ","))


@query("ocr_ladder", f"with s as (select page_no, count(*) filter (confidence = 'guessed') * 8 as guessed from ({REPAIRED}) group by page_no) select page_no, case when guessed between 1 and 15 then guessed else 0 end as ocr_spans, case when guessed > 15 then 'ocr_skipped_too_many_corrupt_spans' end as skip_reason from s")
def ocr_ladder(spark, sf):
    eight = fixtures.fixture(spark, sf, REPAIRED).select("page_no", "confidence", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("i"))
    return details.ocr_ladder(eight, ["page_no"], True).drop("guessed")


@query("ocr_verdicts", "select p_partkey, case when p_partkey % 3 = 0 then 'guessed' when p_partkey % 3 = 1 then 'ocr_confirmed' else 'ocr_disagreement' end as verdict from part")
def ocr_verdicts(spark, sf):
    k = F.col("p_partkey") % 3
    read = F.when(k == 1, F.concat(F.lit(" "), F.upper("p_name"), F.lit("\n"))).when(k == 2, F.concat("p_name", F.lit("x")))
    return part(spark, sf).select("p_partkey", details.ocr_verdict(F.col("p_name"), read).alias("verdict"))


@query("page_review", "with o as (select o_orderkey as page_no, o_custkey % 3 as a, o_custkey % 4 as b, o_orderkey % 5 as c, o_orderkey % 7 as d from orders) select page_no, concat_ws(',', case when a = 0 then 'unresolved_corruption' end, case when b = 0 then 'ocr_extraction_timeout' end, case when c = 0 then 'header_not_detected' end, case when d = 0 then 'page_name_not_detected' end, case when c = 1 then 'annotation_near_miss' end, case when d = 1 then 'production_mark_near_miss' end, case when a = 1 and b = 1 then 'unknown_annotation_color' end) as review_reasons, a = 0 or b = 0 or c <= 1 or d <= 1 or (a = 1 and b = 1) as needs_review from o")
def page_review(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("page_no"), (F.col("o_custkey") % 3).alias("a"), (F.col("o_custkey") % 4).alias("b"), (F.col("o_orderkey") % 5).alias("c"), (F.col("o_orderkey") % 7).alias("d"))
    one = lambda c: F.when(c, 1).otherwise(0)
    o = o.withColumns({
        "unresolved": one(F.col("a") == 0), "skip_reason": F.when(F.col("b") == 0, "extraction_timeout"), "detected": F.col("c") != 0, "name_detected": F.col("d") != 0, "n_annotation_near_miss": one(F.col("c") == 1),
        "n_mark_near_miss": one(F.col("d") == 1), "inferred_annotation_colors": F.when((F.col("a") == 1) & (F.col("b") == 1), F.array(F.lit("#abcdef"))).otherwise(F.array().cast("array<string>")),
    })
    return pages.reviewed(o).select("page_no", F.array_join("review_reasons", ",").alias("review_reasons"), "needs_review")


@query("medians", "select l_orderkey as page_no, coalesce(median(l_quantity) filter (l_quantity > 20), 0) as median from lineitem group by l_orderkey")
def medians(spark, sf):
    q = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("page_no")).agg(F.collect_list(F.when(F.col("l_quantity") > 20, F.col("l_quantity").cast("double"))).alias("v"))
    return q.select("page_no", header.median(F.col("v")).alias("median"))


@query("edge_positions", f"with b as (select page_no, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from ({fixtures.SPANS}) group by page_no) select s.page_no, span_id, case when b.x1 - s.x1 <= 15 then 'right' when s.x0 - b.x0 <= 15 then 'left' when s.y0 - b.y0 <= 15 then 'top' when b.y1 - s.y1 <= 15 then 'bottom' else 'interior' end as edge from ({fixtures.SPANS}) s join b on b.page_no = s.page_no")
def edge_positions(spark, sf):
    s = fixtures.fixture(spark, sf, fixtures.SPANS)
    b = s.groupBy("page_no").agg(F.struct(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).alias("b"))
    return s.join(b, "page_no").select("page_no", "span_id", header.edge_position(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.col("b")).alias("edge"))


@query("box_areas", f"select page_no, drawing_id, greatest(x1 - 10 * drawing_id - x0, 0) * greatest(y1 - y0 - 20, 0) as area from ({fixtures.PATHS})")
def box_areas(spark, sf):
    p = fixtures.fixture(spark, sf, fixtures.PATHS)
    return p.select("page_no", "drawing_id", geometry.area(F.col("x0"), F.col("y0"), F.col("x1") - 10 * F.col("drawing_id"), F.col("y1") - 20).alias("area"))


@query("gpmi_documents", "with p as (select conv_id, turn, text from conversations where text is not null), n as (select *, row_number() over (partition by conv_id order by turn) - 1 as i from p) select conv_id, count(*) as \"paragraphCount\", string_agg('[' || i || '] ' || text, chr(10) order by i) as text, 'doc.' || conv_id as \"fileName\", 'pdf' as \"fileType\" from n group by conv_id")
def gpmi_documents(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet").filter("text is not null").select("conv_id", "turn", "text", F.concat(F.lit("doc."), F.col("conv_id").cast("string"), F.lit(".PDF")).alias("file"))
    return details.numbered(c, "conv_id", ["turn"], "file")


@query("near_miss_audit", f"with f as (select page_no, span_id, text from ({fixtures.SPANS}) where color_hex = '#231f20' and y0 >= 120 and regexp_matches(text, '^[0-9.]+ mm$')) select page_no, count(*) as n, min(text) as first_text from f group by page_no")
def near_miss_audit(spark, sf):
    r = pages.routed(fixtures.fixture(spark, sf, fixtures.SPANS), F.lit(120.0)).filter("annotation_near_miss")
    return r.groupBy("page_no").agg(F.count("*").alias("n"), F.min("text").alias("first_text"))


@query("page_json", "select o_orderkey, '{\"page\":' || o_orderkey || ',\"status\":\"' || o_orderstatus || '\",\"note\":null}' as json from orders")
def page_json(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.col("o_orderkey").alias("page"), F.col("o_orderstatus").alias("status"), F.lit(None).cast("string").alias("note"))
    return sinks.as_json(o, "o_orderkey", "page", "status", "note")


@query("dead_letters", "select o_orderkey, 'bad page' as error from orders where o_orderkey % 9 = 0")
def dead_letters(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, "bad page").alias("error"))
    return sinks.split_errors(o)[1]


@query("request_bodies", "select page_id, html from pages where page_id % 4 > 0 and html is not null and trim(html) <> ''")
def request_bodies(spark, sf):
    p = spark.read.parquet(f"{sf}/pages.parquet")
    body = F.when(p.page_id % 4 > 0, F.to_json(F.struct("html"))).when(p.page_id % 8 == 0, F.lit('{"html": ""}')).otherwise(F.lit("{}"))
    return layout.read_bodies(p.select("page_id", body.alias("body")))[0].select("page_id", "html")


@query("rendered_documents", "select o_custkey as doc, count(*) as page_count, cast(min(o_orderkey) as bigint) as first_page, cast(1654 as bigint) as width_px from orders group by o_custkey")
def rendered_documents(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("page_no"), F.lit(595.276).alias("width_pt"), F.lit(841.89).alias("height_pt"))
    r = sinks.rendered(o, "doc", 200)
    return r.select("doc", "page_count", F.get("pages", 0)["page_number"].alias("first_page"), F.get("pages", 0)["scale"]["width_px"].alias("width_px"))


#: Barcodes of which some have a bar moved, and bars that are no rectangles of filled drawings.
@query("barcode_findings", """with s as (select p_partkey, cast(890800121206 + p_partkey * 7919 as varchar) as s from part) select p_partkey, case when p_partkey % 4 < 2 then s || cast((10 - (""" + " + ".join(f"cast(substr(s, {i}, 1) as integer) * {3 if i % 2 == 0 else 1}" for i in range(1, 13)) + """) % 10) % 10 as varchar) end as value, case p_partkey % 4 when 2 then 'guard patterns do not match EAN-13' when 3 then 'unrecognised right chunk 1111111' end as reason from s""")
def barcode_findings(spark, sf):
    s = part(spark, sf).select("p_partkey", (F.lit(890800121206) + F.col("p_partkey") * 7919).cast("string").alias("s"))
    m = barcodes.encoded(F.concat("s", barcodes.check_digit(F.col("s")).cast("string")))
    k = F.col("p_partkey") % 4
    m = F.when(k == 2, F.concat(F.lit("1"), F.lit("1"), F.substring(m, 3, 93))).when(k == 3, F.concat(F.substring(m, 1, 85), F.lit("1111111"), F.lit("101"))).otherwise(m)
    bars = barcodes.drawn(s.withColumn("m", m), ["p_partkey"], "m")
    item = F.struct(F.lit("re").alias("op"), "x0", "y0", "x1", "y1")
    drawings = bars.groupBy("p_partkey").agg(F.collect_list(item).alias("items")).withColumn("type", F.lit("f"))
    noise = drawings.withColumn("type", F.lit("s"))
    found = barcodes.decoded(barcodes.symbols(barcodes.bars_of(drawings.unionByName(noise), ["p_partkey"]), ["p_partkey"]))
    return found.select("p_partkey", "value", "reason")
