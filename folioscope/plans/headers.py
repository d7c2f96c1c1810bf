"""Queries on header tables: detection, values, references, sizes, drawn grids and the table put together."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope import config
from folioscope.functions import geometry, text
from folioscope.operators import assembly, clusters, details, header
from folioscope.plans.registry import query
from folioscope.sources import fixtures


def headers(spark, sf):
    return fixtures.fixture(spark, sf, fixtures.HEADERS)


def sheets(spark, sf):
    return fixtures.fixture(spark, sf, "select distinct c_custkey as page_no, 595.0D as width_pt, 842.0D as height_pt from customer")


ALIASES = "(values " + ", ".join(f"('{a}', '{c}', {i})" for i, (a, c) in enumerate(config.HEADER_LABELS)) + ") a(alias, label, ord)"
FIELDS = "(values " + ", ".join(f"('{a}', '{c}', {i})" for i, (a, c) in enumerate(config.FIELD_LABELS)) + ") f(alias, label, ord)"
KEYED_SQL = f"""with recursive fx as ({fixtures.HEADERS}), k as (select *, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g')) as key from fx),
h as (select distinct page_no, span_id, y0, y1, label from k join {ALIASES} on contains(key, alias))"""


@query("header_label_hits", KEYED_SQL + " select page_no, span_id, label from h")
def header_label_hits(spark, sf):
    return header.label_hits(headers(spark, sf)).select("page_no", "span_id", "label")


@query("header_clusters", KEYED_SQL + """, b as (select *, lag(y0) over (partition by page_no order by y0, span_id) as before from h), i as (select *, sum(case when y0 - before > 141.7322 then 1 else 0 end) over (partition by page_no order by y0, span_id) as c from b),
g as (select page_no, c, count(distinct label) as n_labels, min(y0) as y0, max(y1) as y1 from i group by page_no, c)
select page_no, n_labels, y0, y1 from (select *, row_number() over (partition by page_no order by n_labels desc, y0) as best from g) where best = 1 and n_labels >= 2""")
def header_clusters(spark, sf):
    return header.seed_clusters(header.label_hits(headers(spark, sf)), ["page_no"])


WORDS = f"select page_no, span_id as block_no, 0 as line_no, cast(x0 + 0.0 as double) as x0, y0, x1, y1, text from ({fixtures.HEADERS})"


def words(spark, sf):
    """The spans as words of a row each, in reverse order."""
    s = headers(spark, sf).select("page_no", F.col("span_id").alias("block_no"), F.lit(0).alias("line_no"), "x0", "y0", "x1", "y1", F.split("text", " ").alias("ws"))
    return s.select("page_no", "block_no", "line_no", "x0", "y0", "x1", "y1", F.posexplode("ws").alias("word_no", "word")).withColumns({"x0": F.col("x0") + F.col("word_no"), "x1": F.col("x1") - F.col("word_no")}).repartition("word")


@query("word_rows", f"select page_no, span_id as block_no, text, x0, y0, x1, y1 from ({fixtures.HEADERS})")
def word_rows(spark, sf):
    return header.rows_of_words(words(spark, sf), ["page_no"]).select("page_no", "block_no", "text", "x0", "y0", "x1", "y1")


#: Growth by one row at a time, by recursion: down from the last seed, then up from the first with the band as it is by then.
REGION_SQL = KEYED_SQL + """, n as (select *, row_number() over (partition by page_no order by y0, x0, x1, y1, text) as r from k),
s as (select n.*, sum(case when y0 - before > 141.7322834645669 then 1 else 0 end) over (partition by page_no order by r) as c from (select n.*, lag(y0) over (partition by page_no order by r) as before from n where exists (select 1 from h where h.page_no = n.page_no and h.span_id = n.span_id)) n),
g as (select s.page_no, c, count(distinct h.label) as labels, min(s.y0) as top, string_agg(distinct h.label, ',' order by h.label) as names from s join h on h.page_no = s.page_no and h.span_id = s.span_id group by s.page_no, c),
b as (select * from (select *, row_number() over (partition by page_no order by labels desc, top, c) as best from g) where best = 1),
q as (select s.page_no, s.r, s.x0, s.x1, s.y0, s.y1, s.y0 - lag(s.y0) over (partition by s.page_no order by s.r) as step from s join b on b.page_no = s.page_no and b.c = s.c and b.labels >= 2),
p as (select page_no, min(r) as first, max(r) as last, count(*) as seeds, min(x0) as lo, max(x1) as hi, min(y0) as t, max(y0) as e, 1.8 * case when count(*) filter (step > 0) > 0 then median(step) filter (step > 0) else greatest(2 * median(y1 - y0), 1) end as reach from q group by page_no),
d(page_no, r, lo, hi, top) as (select page_no, last, lo, hi, e from p union all select d.page_no, n.r, least(d.lo, n.x0), greatest(d.hi, n.x1), n.y0 from d join n on n.page_no = d.page_no and n.r = d.r + 1 join p on p.page_no = d.page_no where n.y0 - d.top <= p.reach and n.x0 <= d.hi and n.x1 >= d.lo and n.y1 <= 0.45 * 842),
de as (select page_no, max(r) as last, min(lo) as lo, max(hi) as hi from d group by page_no),
u(page_no, r, lo, hi, top) as (select p.page_no, first, de.lo, de.hi, t from p join de on de.page_no = p.page_no union all select u.page_no, n.r, least(u.lo, n.x0), greatest(u.hi, n.x1), n.y0 from u join n on n.page_no = u.page_no and n.r = u.r - 1 join p on p.page_no = u.page_no where u.top - n.y0 <= p.reach and n.x0 <= u.hi and n.x1 >= u.lo),
ue as (select page_no, min(r) as first from u group by page_no),
z as (select n.page_no, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1, count(*) as n from n join de on de.page_no = n.page_no join ue on ue.page_no = n.page_no where r between ue.first and de.last group by n.page_no)
select c.page_no, z.page_no is not null as detected, coalesce(b.names, '') as labels_found, coalesce(z.n, 0) as rows_in_band, coalesce(z.n - p.seeds, 0) as rows_absorbed, coalesce(least(z.y1 + 6, 842), 842 * 0.2) as threshold_pt, round_even((z.x1 - z.x0) * 25.4 / 72, 2) as width_mm, round_even((z.y1 - z.y0) * 25.4 / 72, 2) as height_mm,
  case when z.page_no is null then null when (z.y0 + z.y1) / 2 < 842 / 3.0 then 'upper' when (z.y0 + z.y1) / 2 < 2 * 842 / 3.0 then 'middle' else 'lower' end as vertical_position, case when z.page_no is null then null when abs(z.x0 - (595 - z.x1)) <= 29.75 then 'centre' when (z.x0 + z.x1) / 2 < 297.5 then 'left' else 'right' end as horizontal_position
from (select distinct page_no from fx) c left join z on z.page_no = c.page_no left join p on p.page_no = c.page_no left join b on b.page_no = c.page_no"""


@query("header_region", REGION_SQL)
def header_region(spark, sf):
    r = header.header_region(headers(spark, sf), sheets(spark, sf), ["page_no"])
    return r.select("page_no", "detected", F.array_join("labels_found", ",").alias("labels_found"), "rows_in_band", "rows_absorbed", "threshold_pt", "width_mm", "height_mm", "vertical_position", "horizontal_position")


def value_sql(label: str, shape: str, name: str) -> str:
    """Values of a label, as CTEs that end in {name}(page_no, value)."""
    return f""", {name}_l as (select k.*, regexp_extract(trim(text), '(\\d[\\d.\\-/]*)\\s*$', 1) as inline from k where exists (select 1 from h where h.page_no = k.page_no and h.span_id = k.span_id and h.label = '{label}')),
{name}_i as (select *, case when inline <> '' and trim(regexp_replace(regexp_replace(lower(inline), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g')) <> key and regexp_matches(inline, '{shape}') then inline end as v from {name}_l),
{name}_o as (select k.* from k where not exists (select 1 from h where h.page_no = k.page_no and h.span_id = k.span_id) and regexp_matches(trim(text), '{shape}')),
{name}_r as (select l.page_no, l.span_id, l.y0, coalesce(l.v, (select arg_min(trim(o.text), (o.x0 - l.x1, o.span_id)) from {name}_o o where o.page_no = l.page_no and abs((o.y0 + o.y1) / 2 - (l.y0 + l.y1) / 2) <= 6 and o.x0 - l.x1 >= 0)) as value from {name}_i l),
{name} as (select page_no, arg_min(value, (y0, span_id)) as value from {name}_r where value is not null group by page_no)"""


@query("value_for_label", KEYED_SQL + value_sql("version", config.VERSION_SHAPE.replace("\\", "\\"), "v") + " select page_no, value from v")
def value_for_label(spark, sf):
    return header.values_for(headers(spark, sf), ["page_no"], "version", config.VERSION_SHAPE)


REFERENCE_SQL = KEYED_SQL + value_sql("ac reference", config.NUMBER_SHAPE, "a") + value_sql("version", config.VERSION_SHAPE, "v") + f""", l as (select distinct alias from {ALIASES}),
m as (select *, regexp_extract(text, '(?i)\\bAC\\s*(\\d+)\\s*V\\.?\\s*(\\d+)\\b', 0) as hit from k where key not in (select alias from l)),
o as (select page_no, arg_min((hit, x0, y0, x1, y1), span_id) as p from m where hit <> '' group by page_no),
b as (select page_no, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from fx group by page_no)
select b.page_no, 'AC' || a.value || 'V.' || v.value as header_combined, a.value as ac_number, v.value as version, p[1] as on_pack_instance,
  case when p is null then null when b.x1 - p[4] <= 15 then 'right' when p[2] - b.x0 <= 15 then 'left' when p[3] - b.y0 <= 15 then 'top' when b.y1 - p[5] <= 15 then 'bottom' else 'interior' end as edge,
  regexp_replace(lower('AC' || a.value || 'V.' || v.value), '[^0-9a-z]', '', 'g') = regexp_replace(lower(p[1]), '[^0-9a-z]', '', 'g') as consistent
from b left join a on a.page_no = b.page_no left join v on v.page_no = b.page_no left join o on o.page_no = b.page_no"""


@query("ac_reference", REFERENCE_SQL)
def ac_reference(spark, sf):
    h = headers(spark, sf)
    all_ = h.withColumns({"ord": F.col("span_id"), "in_header": F.lit(True)})
    return header.ac_reference(h, all_, ["page_no"]).drop("on_pack_position", "bounds")


@query("canonical_fields", rf"""with fx as ({fixtures.HEADERS}), k as (select page_no, span_id, trim(regexp_replace(regexp_replace(lower(text), '[.#:()\[\]]', ' ', 'g'), '\s+', ' ', 'g')) as key from fx),
t as (select page_no, span_id, label, ord, case when key = alias then 0 when starts_with(key, alias || ' ') or ends_with(key, ' ' || alias) then 1 when contains(key, alias) then 2 end as tier from k join {FIELDS} on contains(key, alias)),
b as (select page_no, span_id, arg_min(label, (tier, ord)) as canonical from t group by page_no, span_id)
select k.page_no, k.span_id, b.canonical from k left join b on b.page_no = k.page_no and b.span_id = k.span_id""")
def canonical_fields(spark, sf):
    return headers(spark, sf).select("page_no", "span_id", text.canonical(F.col("text")).alias("canonical"))


RECTS_SQL = f"select page_no, drawing_id, round_even(x1 - x0, 2) as w, round_even(y1 - y0, 2) as h from ({fixtures.PATHS})"


def rects(spark, sf):
    p = fixtures.fixture(spark, sf, fixtures.PATHS)
    return header.component_rects(p, p.select("page_no").distinct().withColumns({"width_mm": F.lit(45.0), "height_mm": F.lit(20.0)}), ["page_no"])


@query("component_rects", f"select * from ({RECTS_SQL}) where w > 0 and h > 0 and not (abs(w - 45) <= 1 and abs(h - 20) <= 1)")
def component_rects(spark, sf):
    return rects(spark, sf)


@query("measured_pairs", f"""with r as (select * from ({RECTS_SQL}) where w > 0 and h > 0 and not (abs(w - 45) <= 1 and abs(h - 20) <= 1)), p(a, b) as (values (20.0, 38.0), (38.0, 38.0), (20.0, 20.0)),
g as (select distinct page_no from r), c as (select r.*, a, b, least(greatest(abs(w - a), abs(h - b)), greatest(abs(w - b), abs(h - a))) as d from r cross join p), m as (select page_no, a, b, arg_min((w, h, d), (d, drawing_id)) as best from c where d <= 0.5 group by page_no, a, b)
select g.page_no, p.a, p.b, m.best is not null as matched, m.best[1] as w, m.best[2] as h, round_even(m.best[3], 3) as delta_mm from g cross join p left join m on m.page_no = g.page_no and m.a = p.a and m.b = p.b""")
def measured_pairs(spark, sf):
    r = rects(spark, sf)
    declared = r.select("page_no").distinct().withColumn("nums", text.numbers(F.lit("38x38x20x20 mm")))
    return header.measured_pairs(declared, r, ["page_no"])


#: Spans of a page are callouts in an annotation's colour on odd pages and in an unknown one on even ones; every fifth page has none.
CALLS = f"select page_no, 100 + span_id as span_id, x0, y0 + 600 as y0, x1, y1 + 600 as y1, case when page_no % 5 = 0 then text else (30 + page_no % 10) || '.00 mm' end as text, case when page_no % 2 = 1 then '#196ea6' else '#999999' end as color_hex from ({fixtures.HEADERS}) where span_id in (20, 21)"
CHECK_SQL = KEYED_SQL + value_sql("dimension", config.DIMENSION_SHAPE, "v") + f""", c as ({CALLS}), n as (select v.page_no, value, list_transform(regexp_extract_all(value, '\\d+(?:\\.\\d+)?'), lambda x: cast(x as double)) as nums from v),
k2 as (select page_no, case when page_no % 5 = 0 then null else 30.0 + page_no % 10 end as call, case when page_no % 5 = 0 then null when page_no % 2 = 1 then 'annotations' else 'annotation_near_misses' end as callout_source from fx group by page_no),
r as (select page_no, drawing_id, w, h from ({RECTS_SQL}) where w > 0 and h > 0),
e as (select distinct page_no, least(a, b) as a, greatest(a, b) as b from (select page_no, nums[i] as a, nums[j] as b from (select page_no, nums, unnest(range(1, len(nums) + 1)) as i from n) t, lateral (select unnest(range(i + 1, len(nums) + 1)) as j))),
f as (select e.page_no, e.a, e.b, min(least(greatest(abs(w - a), abs(h - b)), greatest(abs(w - b), abs(h - a)))) as d from e left join r on r.page_no = e.page_no group by e.page_no, e.a, e.b),
ok as (select page_no, bool_and(coalesce(d <= 0.5, false)) as m from f group by page_no),
x as (select k2.*, value, nums, case when exists (select 1 from r where r.page_no = k2.page_no) then ok.m end as m, case when nums is not null and call is not null then exists (select 1 from (select unnest(nums) as q) where abs(q - call) <= 0.5) end as calls_ok from k2 left join n on n.page_no = k2.page_no left join ok on ok.page_no = k2.page_no)
select page_no, value as declared_raw, callout_source, m as declared_vs_measured, calls_ok as declared_vs_callouts, case when m is null and calls_ok is null then null else coalesce(m, true) and coalesce(calls_ok, true) end as consistent from x"""


@query("dimension_check", CHECK_SQL)
def dimension_check(spark, sf):
    h = headers(spark, sf)
    calls = fixtures.fixture(spark, sf, CALLS).withColumns({"section": F.when((F.col("page_no") % 2 == 1) & text.is_dimension(F.col("text")), "annotation").otherwise("body"), "annotation_near_miss": (F.col("page_no") % 2 == 0) & text.is_dimension(F.col("text"))})
    p = fixtures.fixture(spark, sf, fixtures.PATHS)
    r = header.component_rects(p, p.select("page_no").distinct().withColumns({"width_mm": F.lit(-9.0), "height_mm": F.lit(-9.0)}), ["page_no"])
    out = header.dimension_check(h, h.select("page_no", F.lit("header").alias("section"), F.lit(False).alias("annotation_near_miss"), "text").unionByName(calls.select("page_no", "section", "annotation_near_miss", "text")), r, ["page_no"])
    return out.select("page_no", "declared_raw", "callout_source", "declared_vs_measured", "declared_vs_callouts", "consistent")


#: Drawn tables: by page, ruled grids whose horizontals reach only part of the width, or cells as rectangles within a border; some paths are filled.
DRAWN = f"""select page_no, drawing_id, kind, case kind when 'v' then x0 when 'h' then 30.0 else x0 end as x0, case kind when 'v' then 20.0 when 'h' then y1 else y0 end as y0, case kind when 'v' then x0 + 0.3 when 'h' then 30.0 + 60 * (drawing_id % 4) else x1 end as x1,
  case kind when 'v' then 160.0 when 'h' then y1 + 0.4 else y1 end as y1, case when drawing_id % 6 = 5 then '#ff0000' end as fill_color_hex, 0.25 * (drawing_id % 3) as stroke_width_pt
  from (select *, case when page_no % 3 = 0 then 'r' when drawing_id % 2 = 0 then 'h' else 'v' end as kind from ({fixtures.PATHS})) t"""
DRAWN_SQL = f"""with recursive fx as (select *, (x1 - x0) * (y1 - y0) as size from ({DRAWN}) where fill_color_hex is null), c0 as (select page_no, case when x1 - x0 > 0.5 and y1 - y0 > 0.5 then 'r' when y1 - y0 <= 0.5 and x1 - x0 > 5 then 'h' when x1 - x0 <= 0.5 and y1 - y0 > 5 then 'v' end as k, * exclude (page_no) from fx),
n as (select page_no, count(*) filter (k = 'r') as r, count(*) filter (k = 'h') as h, count(*) filter (k = 'v') as v from c0 group by page_no), conv as (select page_no, case when r > 1 then 'rects' when v >= 2 and h >= 1 then 'lines' end as convention from n),
o as (select page_no, arg_max(drawing_id, (size, -drawing_id)) as o from c0 where k = 'r' group by page_no),
rc as (select c0.page_no, x0, y0, x1, y1 from c0 join o on o.page_no = c0.page_no and c0.drawing_id <> o.o join conv on conv.page_no = c0.page_no and convention = 'rects' where k = 'r'),
v as (select c0.* from c0 join conv on conv.page_no = c0.page_no and convention = 'lines' where k = 'v'), t as (select page_no, min(y0) as top, max(y1) as bottom from v group by page_no),
vx(page_no, x) as (select page_no, min(x0) from v group by page_no union all select page_no, x from (select vx.page_no, (select min(v.x0) from v where v.page_no = vx.page_no and v.x0 - vx.x > 0.5) as x from vx) where x is not null),
cc as (select * from (select page_no, x as x0, lead(x) over (partition by page_no order by x) as x1 from vx) where x1 is not null),
ys as (select cc.page_no, cc.x0, cc.x1, h.y0 as y from cc join c0 h on h.page_no = cc.page_no and h.k = 'h' and h.x0 - 0.5 <= (cc.x0 + cc.x1) / 2 and (cc.x0 + cc.x1) / 2 <= h.x1 + 0.5 join t on t.page_no = cc.page_no where h.y0 between top - 0.5 and bottom + 0.5 union all select cc.page_no, cc.x0, cc.x1, top from cc join t on t.page_no = cc.page_no union all select cc.page_no, cc.x0, cc.x1, bottom from cc join t on t.page_no = cc.page_no),
yd(page_no, x0, x1, y) as (select page_no, x0, x1, min(y) from ys group by all union all select page_no, x0, x1, y from (select yd.page_no, yd.x0, yd.x1, (select min(ys.y) from ys where ys.page_no = yd.page_no and ys.x0 = yd.x0 and ys.y - yd.y > 0.5) as y from yd) where y is not null),
lc as (select * from (select page_no, x0, y as y0, x1, lead(y) over (partition by page_no, x0 order by y) as y1 from yd) where y1 is not null),
cells as (select page_no, 'rects' as grid_convention, x0, y0, x1, y1 from rc union all select page_no, 'lines', x0, y0, x1, y1 from lc)"""


def drawn(spark, sf):
    return fixtures.fixture(spark, sf, DRAWN).withColumn("box_mm", geometry.box_mm(F.array("x0", "y0", "x1", "y1")))


def drawn_cells(spark, sf):
    g = header.header_grid(drawn(spark, sf), ["page_no"])
    return g.select("page_no", "grid_convention", "table_bbox", F.explode("cells").alias("c")).select("page_no", "grid_convention", "table_bbox", "c.x0", "c.y0", "c.x1", "c.y1")


@query("header_grid_cells", DRAWN_SQL + " select * from cells")
def header_grid_cells(spark, sf):
    return drawn_cells(spark, sf).drop("table_bbox")


@query("header_grid_strokes", DRAWN_SQL + """ select c0.page_no, string_agg(distinct cast(cast(stroke_width_pt * 100 as int) as varchar), ',' order by cast(cast(stroke_width_pt * 100 as int) as varchar)) as strokes from c0 join conv on conv.page_no = c0.page_no left join o on o.page_no = c0.page_no
where (convention = 'rects' and k = 'r' and drawing_id <> o.o) or (convention = 'lines' and k in ('h', 'v')) group by c0.page_no""")
def header_grid_strokes(spark, sf):
    g = header.header_grid(drawn(spark, sf), ["page_no"])
    return g.select("page_no", F.array_join(F.array_sort(F.transform("border_stroke_pt", lambda x: (x * 100).cast("int").cast("string"))), ",").alias("strokes"))


@query("grid_columns", DRAWN_SQL + """, e as (select page_no, x0 as x from rc union all select page_no, x1 from rc union all select page_no, x0 from v),
ex(page_no, x) as (select page_no, min(x) from e group by page_no union all select page_no, x from (select ex.page_no, (select min(e.x) from e where e.page_no = ex.page_no and e.x - ex.x > 0.5) as x from ex) where x is not null)
select * from (select page_no, cast(row_number() over (partition by page_no order by x) - 1 as int) as col, x as lo, lead(x) over (partition by page_no order by x) as hi from ex) where hi is not null""")
def grid_columns(spark, sf):
    from folioscope.functions.columns import pairs
    g = header.header_grid(drawn(spark, sf), ["page_no"])
    return g.select("page_no", F.posexplode(pairs(F.col("col_edges"))).alias("col", "p")).select("page_no", "col", "p.lo", "p.hi")


@query("smallest_cells", DRAWN_SQL + """, p as (select page_no, drawing_id as span_id, (x0 + x1) / 2 + 1 as cx, (y0 + y1) / 2 + 1 as cy from fx)
select p.page_no, p.span_id, arg_min(c.x0, ((c.x1 - c.x0) * (c.y1 - c.y0), c.x0, c.y0)) as cell_x0, arg_min(c.y0, ((c.x1 - c.x0) * (c.y1 - c.y0), c.x0, c.y0)) as cell_y0 from p join cells c on c.page_no = p.page_no and cx between c.x0 - 0.5 and c.x1 + 0.5 and cy between c.y0 - 0.5 and c.y1 + 0.5 group by p.page_no, p.span_id""")
def smallest_cells(spark, sf):
    d = drawn(spark, sf).filter("fill_color_hex is null")
    g = header.header_grid(drawn(spark, sf), ["page_no"]).select("page_no", F.array_sort("cells").alias("cells"))
    box = F.struct(*[(F.col(c) + 1).alias(c) for c in ("x0", "y0", "x1", "y1")])
    return d.join(g, "page_no").withColumn("c", header.cell_of(box, F.col("cells"))).filter("c is not null").select("page_no", F.col("drawing_id").alias("span_id"), F.col("c.x0").alias("cell_x0"), F.col("c.y0").alias("cell_y0"))


@query("row_heights", DRAWN_SQL + """, b as (select o.page_no, c0.x0, c0.x1, c0.y1 from o join c0 on c0.page_no = o.page_no and c0.drawing_id = o.o union all select page_no, min(x0), max(x0), max(y1) from v group by page_no),
r as (select c.page_no, round_even(c.y0, 1) as top, sum(c.x1 - c.x0) as covered, min(c.y0) as y0, any_value(b.x1 - b.x0) as w, any_value(b.y1) as e from cells c join b on b.page_no = c.page_no and (c.grid_convention = 'lines') = (b.page_no % 3 <> 0) group by c.page_no, round_even(c.y0, 1))
select page_no, top, round_even((coalesce(lead(y0) over (partition by page_no order by top), e) - y0) * 25.4 / 72, 2) as height_mm from r where covered >= w - 1""")
def row_heights(spark, sf):
    cells = drawn_cells(spark, sf)
    return details.row_heights(cells.withColumns({f"table_{c}": F.col(f"table_bbox.{c}") for c in ("x0", "x1", "y1")}), ["page_no"]).drop("y0")


@query("border_strokes", f"""with fx as (select * from ({DRAWN}) where fill_color_hex is null), s as (select *, (x1 - x0) * (y1 - y0) < 0.9 * max((x1 - x0) * (y1 - y0)) over (partition by page_no) as small from fx)
select page_no, list_sort(list(distinct stroke_width_pt))[1] as least, count(distinct stroke_width_pt) as n from s where small or page_no not in (select page_no from s where small) group by page_no""")
def border_strokes(spark, sf):
    return details.border_strokes(drawn(spark, sf), ["page_no"]).select("page_no", F.array_min("border_stroke_pt").alias("least"), F.size("border_stroke_pt").cast("long").alias("n"))


@query("paths_in_band", f"select page_no, drawing_id from ({DRAWN}) where case when y1 - y0 <= 0.5 then y0 <= 60 + 20 else greatest(least(y1, 80) - y0, 0) / (y1 - y0) >= 0.8 end")
def paths_in_band(spark, sf):
    return drawn(spark, sf).filter(details.in_band(F.col("y0"), F.col("y1"), F.lit(60.0))).select("page_no", "drawing_id")


WINDOW_SQL = f"""with fx as ({fixtures.SPANS}), l as (select page_no, cast(floor(x0 / 100) as integer) as col, span_id, y0, (y0 + y1) / 2 as yc from fx where text = 'Version'), v as (select page_no, cast(floor(x0 / 100) as integer) as col, span_id, (y0 + y1) / 2 as yc from fx where text <> 'Version'),
w as (select *, coalesce((lag(yc) over p + yc) / 2, -1e300) as lo, coalesce((lead(yc) over p + yc) / 2, 1e300) as hi from l window p as (partition by page_no, col order by y0, span_id)),
m as (select w.page_no, w.span_id as label_id, v.span_id as value_id from w join v on w.page_no = v.page_no and v.col = w.col + 1 and v.yc >= w.lo and v.yc < w.hi)"""


def windowed(spark, sf):
    s = fixtures.fixture(spark, sf, fixtures.SPANS).select("page_no", F.floor(F.col("x0") / 100).cast("int").alias("col"), "span_id", "y0", ((F.col("y0") + F.col("y1")) / 2).alias("yc"), "text")
    values = s.filter("text != 'Version'").drop("text", "y0")
    return values, header.value_windows(s.filter("text = 'Version'").drop("text"), values, ["page_no"])


@query("header_value_windows", WINDOW_SQL + " select * from m")
def header_value_windows(spark, sf):
    return windowed(spark, sf)[1]


@query("unassigned_spans", WINDOW_SQL + " select page_no, span_id from v where not exists (select 1 from m where m.page_no = v.page_no and m.value_id = v.span_id)")
def unassigned_spans(spark, sf):
    return header.unassigned(*windowed(spark, sf), ["page_no"]).select("page_no", "span_id")


#: The header rows in a ruled grid of three columns, so that labels and values stand beside each other; every fourth page has no rules.
RULES = """select page_no, cast(case when k < 5 then k else 10 + k end as int) as drawing_id, cast(case k when 0 then 10 when 1 then 100 when 2 then 200 else 10 end as double) as x0, cast(case when k < 3 then 30 else 34 + 28 * (k - 3) end as double) as y0, cast(case k when 0 then 10 when 1 then 100 when 2 then 200 else 200 end as double) as x1, cast(case when k < 3 then 160 else 34 + 28 * (k - 3) end as double) as y1
  from (select distinct c_custkey as page_no from customer) c cross join (select 0 as k union all select 1 union all select 2 union all select 3 union all select 4 union all select 5) n where page_no % 4 <> 0"""
TABLE_SQL = f"""with fx as (select page_no, span_id, round_even(x0, 0) as x0, y0, x1, y1, text from ({fixtures.HEADERS}) where span_id < 20), k as (select *, trim(regexp_replace(regexp_replace(lower(text), '[.#:()\\[\\]]', ' ', 'g'), '\\s+', ' ', 'g')) as key, (y0 + y1) / 2 as yc, (x0 + x1) / 2 as xc from fx),
t as (select page_no, span_id, label, ord, case when key = alias then 0 when starts_with(key, alias || ' ') or ends_with(key, ' ' || alias) then 1 else 2 end as tier from k join {FIELDS} on contains(key, alias)),
b as (select page_no, span_id, arg_min(label, (tier, ord)) as canonical from t group by page_no, span_id),
s as (select k.*, canonical, case when k.page_no % 4 = 0 then -1 when xc >= 8 and xc < 102 then 0 when xc >= 98 and xc < 202 then 1 else -1 end as col from k left join b on b.page_no = k.page_no and b.span_id = k.span_id),
l as (select *, coalesce((lag(yc) over w + yc) / 2, -1e300) as lo, coalesce((lead(yc) over w + yc) / 2, 1e300) as hi from s where canonical is not null window w as (partition by page_no, col order by y0, span_id)),
m as (select l.page_no, l.span_id as label_id, v.* exclude (page_no) from l join s v on v.canonical is null and v.page_no = l.page_no and v.col = l.col + 1 and v.yc >= l.lo and v.yc < l.hi)"""


def table(spark, sf):
    h = headers(spark, sf).filter("span_id < 20").withColumn("x0", F.bround("x0"))
    mm = geometry.box_mm(F.array("x0", "y0", "x1", "y1"))
    h = h.withColumns({"bbox_mm": mm, "font": F.when(F.col("span_id") % 4 == 3, "A").otherwise("B"), "size": F.lit(8.0), "bold": F.lit(False), "italic": F.lit(None).cast("boolean"), "color_hex": F.lit("#000000")})
    p = fixtures.fixture(spark, sf, RULES).withColumns({"bbox_mm": mm, "fill_color_hex": F.lit(None).cast("string"), "stroke_width_pt": F.lit(0.5)})
    return assembly.header_table(h, p, ["page_no"])


@query("header_table_pairs", TABLE_SQL + """, v as (select page_no, label_id, string_agg(trim(text), ' ' order by y0, x0, span_id) as value from m group by page_no, label_id)
select l.page_no, l.span_id as label_id, l.canonical, cast(case when l.col >= 0 then l.col // 2 + 1 end as int) as col_pair, l.text as label, v.value from l left join v on v.page_no = l.page_no and v.label_id = l.span_id""")
def header_table_pairs(spark, sf):
    return table(spark, sf)["pairs"].select("page_no", "label_id", "canonical", "col_pair", F.col("label.text").alias("label"), F.col("value.text").alias("value"))


@query("header_table_rows", TABLE_SQL.replace("with fx", "with recursive fx") + """, r(page_no, y) as (select page_no, min(yc) from l group by page_no union all select page_no, y from (select r.page_no, (select min(l.yc) from l where l.page_no = r.page_no and l.yc - r.y > 8) as y from r) where y is not null),
a as (select page_no, y, row_number() over (partition by page_no order by y) as n from r)
select l.page_no, l.span_id as label_id, cast(arg_min(n, (abs(a.y - l.yc), n)) as int) as row from l join a on a.page_no = l.page_no group by l.page_no, l.span_id""")
def header_table_rows(spark, sf):
    return table(spark, sf)["pairs"].select("page_no", "label_id", "row")


@query("header_table_unassigned", TABLE_SQL + " select page_no, span_id, text from s where canonical is null and not exists (select 1 from m where m.page_no = s.page_no and m.span_id = s.span_id)")
def header_table_unassigned(spark, sf):
    return table(spark, sf)["unassigned"]


@query("header_table_cells", TABLE_SQL + """, g as (select page_no, label_id, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from m group by page_no, label_id),
c as (select g.*, (y0 + y1) / 2 as cy, 30 as top from g)
select page_no, label_id, case when page_no % 4 = 0 then 'text_extent' else 'drawn_cell' end as cell_source, case when abs((x0 - 100) - (200 - x1)) <= 3 then 'center' when 200 - x1 < x0 - 100 then 'right' else 'left' end as align_h from c""")
def header_table_cells(spark, sf):
    return table(spark, sf)["pairs"].filter("value is not null").select("page_no", "label_id", F.col("value.cell_source").alias("cell_source"), F.col("value.align_h").alias("align_h"))


@query("header_tables", TABLE_SQL + """, x as (select page_no, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from fx group by page_no)
select page_no, case when page_no % 4 = 0 then 'text_extent' else 'drawn_border' end as table_bbox_source, case when page_no % 4 <> 0 then 'lines' end as grid_convention,
  case when page_no % 4 = 0 then round_even(round_even(x1 * 25.4 / 72, 2) - round_even(x0 * 25.4 / 72, 2), 2) else 67.03 end as table_width_mm, case when page_no % 4 = 0 then round_even(round_even(y1 * 25.4 / 72, 2) - round_even(y0 * 25.4 / 72, 2), 2) else 45.86 end as table_height_mm,
  cast(case when page_no % 4 <> 0 then 2 end as int) as column_count, cast(case when page_no % 4 <> 0 then 1 end as int) as col_pair_count from x""")
def header_tables(spark, sf):
    return table(spark, sf)["tables"].select("page_no", "table_bbox_source", "grid_convention", "table_width_mm", "table_height_mm", "column_count", "col_pair_count")


@query("declared_fields", TABLE_SQL + """, v as (select page_no, label_id, string_agg(trim(text), ' ' order by y0, x0, span_id) as value from m group by page_no, label_id)
select l.page_no, l.canonical, arg_max(coalesce(v.value, '-'), (l.y0, l.span_id)) as value from l left join v on v.page_no = l.page_no and v.label_id = l.span_id group by l.page_no, l.canonical""")
def declared_fields(spark, sf):
    p = table(spark, sf)["pairs"].select("page_no", "pos", "canonical", F.col("value.text").alias("value"))
    f = header.declared_fields(p, ["page_no"])
    return f.select("page_no", F.explode(F.map_entries("fields")).alias("e")).select("page_no", F.col("e.key").alias("canonical"), F.coalesce("e.value", F.lit("-")).alias("value"))


@query("span_formatting", f"""with fx as (select page_no // 10 as doc, page_no, span_id, color_hex, size, case when span_id = 2 then null else 'F' || (span_id % 3) end as font from ({fixtures.SPANS}))
select page_no, case when count(distinct coalesce(font, '-')) = 1 then any_value(font) end as font, case when count(distinct size) = 1 then any_value(size) end as size, case when count(distinct color_hex) = 1 then any_value(color_hex) end as color_hex,
  count(distinct coalesce(font, '-')) > 1 or count(distinct size) > 1 or count(distinct color_hex) > 1 as mixed_formatting from fx group by page_no""")
def span_formatting(spark, sf):
    s = fixtures.fixture(spark, sf, fixtures.SPANS).withColumns({"font": F.when(F.col("span_id") != 2, F.concat(F.lit("F"), (F.col("span_id") % 3).cast("string"))), "bold": F.lit(True), "italic": F.lit(None).cast("boolean")})
    return details.groups(s, ["page_no"]).select("page_no", "font", "size", "color_hex", "mixed_formatting")


@query("swatches", f"""with fx as (select page_no, drawing_id, x0, y0, x1, y1, color_hex from ({fixtures.PATHS})), g as (select page_no, drawing_id as group_no, x0 - 3 as x0, y0 - 3 as y0, x1 + 30 as x1, y1 + 30 as y1 from fx)
select g.page_no, group_no, arg_min(color_hex, fx.drawing_id) as swatch from g join fx on fx.page_no = g.page_no and fx.x0 >= g.x0 - 2 and fx.y0 >= g.y0 - 2 and fx.x1 <= g.x1 + 2 and fx.y1 <= g.y1 + 2 group by g.page_no, group_no""")
def swatches(spark, sf):
    p = fixtures.fixture(spark, sf, fixtures.PATHS)
    g = p.select("page_no", F.col("drawing_id").alias("group_no"), (F.col("x0") - 3).alias("x0"), (F.col("y0") - 3).alias("y0"), (F.col("x1") + 30).alias("x1"), (F.col("y1") + 30).alias("y1"))
    return details.swatches(g, p.withColumnRenamed("color_hex", "fill_color_hex"), ["page_no"], "group_no")


@query("dedupe_edges", f"""with recursive fx as (select page_no, x1 / 9 as x from ({fixtures.PATHS})), r(page_no, x) as (select page_no, min(x) from fx group by page_no union all
  select page_no, x from (select r.page_no, (select min(fx.x) from fx where fx.page_no = r.page_no and fx.x - r.x > 0.5) as x from r) where x is not null)
select page_no, count(*) as n_edges, max(x) as last_edge from r group by page_no""")
def dedupe_edges(spark, sf):
    a = fixtures.fixture(spark, sf, fixtures.PATHS).groupBy("page_no").agg(clusters.anchors(F.collect_list(F.col("x1") / 9), 0.5).alias("a"))
    return a.select("page_no", F.size("a").cast("long").alias("n_edges"), F.array_max("a").alias("last_edge"))
