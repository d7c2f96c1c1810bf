"""Layout tables: pages, spans, words, drawings and images keyed by document and page.

read_layout() takes Parquet or JSON tables with these schemas; read_documents() takes files as bytes and hands them to
a decoder. No decoder for page formats is installed here, so decoding is a function that the caller supplies; without
one, each document becomes an error row, as a damaged one does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

KEYS = "doc_id string, page_no int"
BOX = "x0 double, y0 double, x1 double, y1 double"
TABLES = {
    "pages": f"{KEYS}, width_pt double, height_pt double, font_count int",
    "spans": f"{KEYS}, span_id int, block_no int, line_no int, block_type int, dir_x double, dir_y double, text string, chars array<struct<c:string,x0:double,y0:double,x1:double,y1:double>>, {BOX}, font string, size double, color int, flags int",
    "words": f"{KEYS}, block_no int, line_no int, word_no int, word string, {BOX}",
    "drawings": f"{KEYS}, drawing_id int, type string, stroke array<double>, fill array<double>, width double, {BOX}, items array<struct<op:string,x0:double,y0:double,x1:double,y1:double>>",
    "images": f"{KEYS}, xref int, width_px int, height_px int, {BOX}",
}


def schema(table: str) -> StructType:
    return _parse_datatype_string(TABLES[table])


def read_layout(spark: SparkSession, path: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """The layout tables under path; pruning and pushdown are Spark's."""
    return {t: spark.read.schema(schema(t)).format(fmt).load(f"{path}/{t}") for t in TABLES}


def read_documents(spark: SparkSession, path: str, suffix: str = ".pdf") -> tuple[DataFrame, DataFrame]:
    """Files as (doc_id, filename, content), and the names of files that are of another kind."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("path").alias("doc_id"), "content")
    fits = F.lower("filename").endswith(suffix)
    return files.filter(fits), files.filter(~fits).select("doc_id", "filename", F.lit(f"not a {suffix} file").alias("error"))


def decode(files: DataFrame, table: str, decoder: Callable[[bytes], Iterator[dict]] | None = None) -> DataFrame:
    """One layout table from document bytes, and an error column; a document that fails yields one row with its error."""
    fields = schema(table).fieldNames()

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for doc, content in zip(b["doc_id"], b["content"], strict=True):
                try:
                    if decoder is None:
                        raise RuntimeError("no decoder for this document format is installed")
                    rows += [{f: r.get(f) for f in fields} | {"doc_id": doc, "error": None} for r in decoder(content)]
                except Exception as e:  # one bad document must not stop the others
                    rows.append(dict.fromkeys(fields) | {"doc_id": doc, "error": str(e)})
            yield pd.DataFrame(rows, columns=[*fields, "error"], dtype=object)

    return files.select("doc_id", "content").mapInPandas(run, schema(table).add("error", "string"))


def capabilities() -> dict[str, bool]:
    """What optional parts of this installation can do."""
    from importlib.util import find_spec

    return {"decode_pages": find_spec("fitz") is not None, "ocr": find_spec("pytesseract") is not None, "html_to_pdf": find_spec("playwright") is not None}


def read_bodies(bodies: DataFrame, column: str = "body", field: str = "html") -> tuple[DataFrame, DataFrame]:
    """JSON request bodies as rows with the field's text, and those that have none or an empty one, with an error."""
    parsed = bodies.withColumn(field, F.from_json(F.col(column), f"{field} string")[field])
    has = F.coalesce(F.trim(field) != "", F.lit(False))
    return parsed.filter(has), parsed.filter(~has).drop(field).withColumn("error", F.lit(f"missing '{field}'"))


def ocr_language(installed: list[str]) -> str:
    """The languages in which damaged texts are read again: Spanish and English where Spanish is installed."""
    return "spa+eng" if "spa" in installed else "eng"
