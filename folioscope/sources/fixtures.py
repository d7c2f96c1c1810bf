"""Layout tables derived from the star-schema tables, spelled alike for Spark and for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NUMBERED = """select *, cast(row_number() over (partition by l_orderkey
  order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as int) as rn from lineitem"""

SPANS = f"""select l_orderkey as page_no, rn as span_id, cast((l_partkey % 40) * 10 as double) as x0, cast((l_partkey % 60) * 12 as double) as y0,
  cast((l_partkey % 40) * 10 + l_quantity * 2 + 10 as double) as x1, cast((l_partkey % 60) * 12 + 8 as double) as y1,
  cast(5 + (l_partkey % 9) * 0.25 as double) as size, cast(rn % 4 as int) as turn,
  case when l_returnflag = 'A' then '#1a6ea6' when l_returnflag = 'R' then '#231f20' else '#3373a9' end as color_hex,
  case when rn % 4 = 0 then concat(cast(cast(l_quantity as int) as varchar(10)), ' mm') when rn % 4 = 1 then 'Pasting Side 1'
    when rn % 4 = 2 then 'Version' else concat('AC', cast(l_partkey as varchar(10)), 'V.', cast(l_linenumber as varchar(10))) end as text
  from ({NUMBERED}) t"""

PATHS = f"""select l_orderkey as page_no, rn as drawing_id, cast(rn * 30 as double) as x0, cast(l_linenumber * 20 as double) as y0,
  cast(rn * 30 + 10 + l_quantity as double) as x1, cast(l_linenumber * 20 + 5 + (l_partkey % 40) as double) as y1,
  case when l_returnflag = 'A' then '#0000ff' else '#000000' end as color_hex from ({NUMBERED}) t"""

CORRUPT = """select doc_id, text as clean,
  replace(replace(replace(replace(text, 'ti', 'Ɵ'), 'ft', 'Ō'), 'tt', 'Ʃ'), 'ó', '贸') as text from documents"""

#: Rows of a header table for every customer, of eleven kinds by page: labels with and without punctuation, values inline, beside and
#: missing, rows without a label above and below the table, a stray label far down, and pages with one label or none.
HEADERS = """select * from (select c_custkey as page_no, cast(k as int) as span_id, cast(case when k % 2 = 0 then 20 else 120 + c_custkey % 7 end as double) as x0,
  cast(case when k >= 20 then 500 else 40 + (14 + c_custkey % 3) * (k // 2) end as double) as y0, cast(case when k % 2 = 0 then 90 else 180 end as double) as x1,
  cast(case when k >= 20 then 508 else 48 + (14 + c_custkey % 3) * (k // 2) end as double) as y1,
  case k when 0 then case when c_custkey % 11 = 0 then 'nothing' else 'title ' || c_custkey end when 2 then case when c_custkey % 5 = 0 then 'nothing' when c_custkey % 4 = 1 then 'A.C. Reference' when c_custkey % 4 = 2 then 'AC-Ref: ' || c_custkey else 'AC Reference:' end
    when 3 then case when c_custkey % 6 = 5 then 'see below' else cast(c_custkey as varchar(12)) end
    when 4 then case when c_custkey % 10 = 0 then 'nothing' when c_custkey % 4 = 3 then 'Version# 1' || c_nationkey || '-2' else 'Version No.' end when 5 then cast(c_nationkey as varchar(12))
    when 6 then 'Repeat(Outer)' when 7 then '52.5 mm' when 8 then case when c_custkey % 3 = 0 then 'Size (LxWxH)' else 'Size in mm [L x W]' end when 9 then (30 + c_custkey % 9) || 'x38x' || (60 + c_custkey % 5) || ' mm'
    when 10 then 'Print.Side' when 11 then 'inside' when 20 then case when c_custkey % 7 = 0 then 'Version: old' else 'body text' end else 'on AC ' || c_custkey || ' V' || (c_nationkey + c_custkey % 2) end as text
  from customer cross join (select 0 as k union all select 2 union all select 3 union all select 4 union all select 5 union all select 6 union all select 7 union all select 8 union all select 9 union all select 10 union all select 11 union all select 20 union all select 21) n) t
  where not (span_id = 21 and page_no % 3 = 0) and not (span_id in (3, 11) and page_no % 8 = 7)"""


def tables(spark: SparkSession, sf_dir: str) -> None:
    for t in ("lineitem", "documents", "customer", "part", "orders"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def fixture(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    tables(spark, sf_dir)
    return spark.sql(sql.replace("//", "div"))
