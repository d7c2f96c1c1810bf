"""The four ways in which values of a page are grouped: anchored, by neighbour, by running maximum, by touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def anchors(values: Column, eps: float) -> Column:
    """The sorted values that lie more than eps above the anchor before; each starts a cluster."""
    none = F.array().cast("array<double>")
    return F.aggregate(F.array_sort(values), none, lambda a, v: F.when((F.size(a) == 0) | (v - F.try_element_at(a, F.lit(-1)) > eps), F.concat(a, F.array(v))).otherwise(a))


def nearest(anchors_: Column, value: Column) -> Column:
    """The 1-based number of the nearest anchor, the earliest of equals."""
    return F.array_min(F.transform(anchors_, lambda a, i: F.struct(F.abs(a - value).alias("d"), (i + 1).alias("i"))))["i"]


def islands(df: DataFrame, keys: list[str], order: list, starts: Column) -> DataFrame:
    """df with island: counts the rows that start a group. `starts` may use lag over the same window."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_start", F.coalesce(starts.cast("int"), F.lit(0))).withColumn("island", F.sum("_start").over(w)).drop("_start")


def gaps(df: DataFrame, keys: list[str], order: list, lo: str, hi: str, gap: float) -> DataFrame:
    """df with island, where a row starts one if it begins more than gap after the end of the row before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return islands(df.withColumn("_prev", F.lag(hi).over(w)), keys, order, F.col(lo) - F.col("_prev") > gap).drop("_prev")


def merged(df: DataFrame, keys: list[str], lo: str, hi: str, gap: float, order: list | None = None) -> DataFrame:
    """df with island, where a row starts one if it begins more than gap after the greatest end so far; one that begins at the gap joins."""
    order = order or [lo, hi]
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return islands(df.withColumn("_far", before), keys, order, F.col(lo) > F.col("_far") + gap).drop("_far")


def touching(boxes: DataFrame, keys: list[str], ord_: str, eps: float) -> DataFrame:
    """keys, ord_, component (the least ord_ of boxes that touch, directly or through others).

    One fold over a page's boxes: each box unites the components that it touches. A page has at most some thousand boxes."""
    b = boxes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(ord_).cast("long").alias("o"), "x0", "y0", "x1", "y1"))).alias("bs"))

    def meets(a: Column, c: Column) -> Column:
        return (a["x0"] <= c["x1"] + eps) & (c["x0"] <= a["x1"] + eps) & (a["y0"] <= c["y1"] + eps) & (c["y0"] <= a["y1"] + eps)

    none = F.array().cast("array<array<struct<o:bigint,x0:double,y0:double,x1:double,y1:double>>>")
    groups = F.aggregate("bs", none, lambda gs, x: F.concat(F.filter(gs, lambda g: ~F.exists(g, lambda y: meets(x, y))), F.array(F.concat(F.array(x), F.flatten(F.filter(gs, lambda g: F.exists(g, lambda y: meets(x, y))))))))
    out = b.select(*keys, F.explode(groups).alias("g")).select(*keys, F.array_min(F.transform("g", lambda x: x["o"])).alias("component"), F.explode("g").alias("x"))
    return out.select(*keys, F.col("x.o").alias(ord_), "component")
