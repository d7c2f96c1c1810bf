"""Exact deduplication by content-defined chunk recipes, in DataFrame operations only.

A text is cut where its own content says so (two characters on each side of the cut), so equal passages are cut
alike wherever they stand. A first pass makes the dictionary of distinct chunks: each chunk's text is moved once,
after every task has merged its own repeats, and chunks of equal hash are compared in full. That proves which hashes
name one text only. A second pass then describes each document by its recipe, the ordered list of verified chunk
identifiers; documents are equal exactly if their recipes are, so no document is moved.

Null text counts as empty. Texts are equal when identical after lower-casing A-Z. Rows that share both doc_id and
text are one document and share its fate; a null doc_id never wins over another one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import ascii_lower, documents, stored

#: A cut lies between a word that ends in o or u and one that starts with an or en: about one in 900 characters.
CUT = r"(?<=[ou][ \n])(?=[ae]n)"
#: Longer chunks are cut on, counted from their own start.
MAX_CHARS = 4096


def chunks(text: Column) -> Column:
    """The text as an array of chunks; their concatenation is the text. The empty text has none."""
    parts = F.split(text, CUT)
    long = F.exists(parts, lambda p: F.length(p) > MAX_CHARS)

    def pieces(p: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), ((F.greatest(F.length(p), F.lit(1)) - 1) / MAX_CHARS).cast("int")), lambda i: F.substring(p, i * MAX_CHARS + 1, F.lit(MAX_CHARS)))

    return F.when(text == "", F.array().cast("array<string>")).when(long, F.flatten(F.transform(parts, pieces))).otherwise(parts)


def chunk_hash(chunk: Column, bits: int) -> Column:
    return F.xxhash64(chunk) if bits == 64 else F.pmod(F.xxhash64(chunk), F.lit(1 << bits))


def chunk_dictionary(df: DataFrame, text: str = "text", bits: int = 64) -> DataFrame:
    """(h, chunk, n): every distinct chunk of the normalised texts, its hash and its number of occurrences."""
    norm = df.select(ascii_lower(F.coalesce(F.col(text), F.lit(""))).alias("norm"))
    return norm.select(F.explode(chunks(F.col("norm"))).alias("chunk")).select(chunk_hash(F.col("chunk"), bits).alias("h"), "chunk").groupBy("h", "chunk").agg(F.count("*").alias("n"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text: str = "text", bits: int = 64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    bits: of the chunk hash; fewer than 64 only to test what happens when hashes collide."""
    spark = df.sparkSession
    shared = chunk_dictionary(df, text, bits).groupBy("h").count().filter("count > 1").select("h")
    n_shared = shared.count()
    norm = df.select(F.col(id_col).alias("doc_id"), ascii_lower(F.coalesce(F.col(text), F.lit(""))).alias("norm"))
    docs = norm.select(
        "doc_id", F.sha2("norm", 256).alias("text_sha256"), F.octet_length("norm").alias("n_bytes"),
        F.transform(chunks(F.col("norm")), lambda c: chunk_hash(c, bits)).alias("recipe"),
    )
    if n_shared:
        docs = docs.join(told_apart(spark, df, shared, norm, text, bits), ["text_sha256", "n_bytes"], "left")
    else:
        docs = docs.withColumn("marks", F.lit(None).cast("string"))
    key = ["n_bytes", "recipe", "marks"]
    docs = stored(docs.withColumn("marks", F.coalesce("marks", F.lit(""))), "recipes")  # two readers, one pass over the texts
    # groups are few and stored, so that the join is of two shuffles, of which Spark can split a large group's; a text of its own needs none
    groups = stored(docs.groupBy(*key).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1"), "copies")
    joined = docs.join(groups.hint("merge"), key, "left").withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")))
    return joined.select(
        "doc_id", "keep_id", F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "text_sha256",
    )


def told_apart(spark: SparkSession, df: DataFrame, shared: DataFrame, norm: DataFrame, text: str, bits: int) -> DataFrame:
    """For texts with a chunk whose hash other chunks share: marks that say, chunk by chunk, which text was meant.

    Of the chunks of one hash, each gets a number by the order of their texts; only the few of shared hashes move."""
    by_hash = chunk_dictionary(df, text, bits).join(shared, "h", "left_semi").groupBy("h").agg(F.array_sort(F.collect_set("chunk")).alias("all"))
    found = norm.select(F.sha2("norm", 256).alias("text_sha256"), F.octet_length("norm").alias("n_bytes"), F.posexplode(chunks(F.col("norm"))).alias("pos", "chunk"))
    found = found.withColumn("h", chunk_hash(F.col("chunk"), bits)).join(by_hash, "h")
    found = found.select("text_sha256", "n_bytes", "pos", F.array_position("all", F.col("chunk")).alias("number")).distinct()
    return found.groupBy("text_sha256", "n_bytes").agg(F.array_sort(F.collect_list(F.struct("pos", "number"))).alias("marks")).withColumn("marks", F.to_json("marks"))


def kept_rows(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """df without the rows that exact_dedup() drops."""
    dropped = exact_dedup(df, id_col, text).filter("not kept").select(F.col("doc_id").alias(id_col))
    return df.join(dropped, id_col, "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


SQL = """
with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from documents),
c as (select norm, max(doc_id) as keep_id, count(*) as group_size from d group by norm)
select d.doc_id, c.keep_id, c.group_size, d.doc_id = c.keep_id as kept, sha256(d.norm) as text_sha256
from d join c on d.norm = c.norm
"""
