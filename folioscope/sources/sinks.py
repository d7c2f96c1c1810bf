"""Outputs: nested JSON by document, typed Parquet, render scales and dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_json(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """key and json: the given columns as one JSON text, nulls kept."""
    return df.select(key, F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("encoding", "UTF-8").option("ignoreNullFields", "false").json(path)


def write_parquet(df: DataFrame, path: str, *partition: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition).parquet(path)


def render_scale(width_pt: Column, height_pt: Column, dpi: Column) -> Column:
    """Pixels of a rendered page and its scale factors."""
    return F.struct(
        F.bround(width_pt * dpi / 72).cast("long").alias("width_px"), F.bround(height_pt * dpi / 72).cast("long").alias("height_px"),
        F.bround(dpi / 72, 6).alias("scale_px_per_pt"), F.bround(dpi / 25.4, 6).alias("scale_px_per_mm"),
    )


def split_errors(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Good rows and dead letters."""
    return df.filter(F.col(error).isNull()).drop(error), df.filter(F.col(error).isNotNull())


def rendered(pages: DataFrame, doc: str, dpi: float, image: Column | None = None) -> DataFrame:
    """All pages of each document with their scale, in order: page_count and pages. image: PNG bytes where a rasteriser is installed; sent as base64."""
    page = F.struct(F.col("page_no").alias("page_number"), render_scale(F.col("width_pt"), F.col("height_pt"), F.lit(float(dpi))).alias("scale"), (F.base64(image) if image is not None else F.lit(None).cast("string")).alias("png_base64"))
    return pages.groupBy(doc).agg(F.count("*").alias("page_count"), F.array_sort(F.collect_list(page)).alias("pages"))
