"""Sharding by sampled splitters, in DataFrame operations only; the law is `bytes`: shards are nearly equal in size.

Records are ordered by the hash of their text, so equal texts stand together, and then by a hash of id and text.
A sample in which a record's chance is its share of all bytes gives quantile boundaries, which cut the order into
many ranges. What each range holds is then counted exactly. A range that is overfull, as when one text has a third
of all rows, is subdivided at quantiles of a denser sample, again and again until none is or only rows alike in all
remain. Prefix sums over the ranges and within each give every record its exact place among all bytes, and that
place, that of its middle, its shard: a shard is off its share by half a record at each end. A group of equal texts that
is small against a shard stays whole and goes where its middle goes.

Only boundaries, the sample and totals of ranges reach the driver; their number is a parameter, whatever the input.
Null text has size 8 and crc32 0. Null ids are ordered first. Rows alike in id and text are interchangeable.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.common import documents

SHARDS = 24
#: Ranges for each shard at most, rows for each range at least, sampled keys for each range, and how often overfull ranges may be cut again.
RANGES, ROWS, KEYS, ROUNDS = 32, 64, 32, 5
#: A group of equal texts up to this part of a shard is not cut.
WHOLE = 0.01
#: A range is overfull at so many times its share.
OVERFULL = 2.0
LEAST = -(1 << 63)

Bounds = list[tuple[int, int]]


def steps(n: int) -> Column:
    """Falling powers of two, for a binary search in n values."""
    return F.array(*[F.lit(1 << i) for i in reversed(range(max(1, n.bit_length())))])


def place(bounds: Bounds) -> Column:
    """The number of boundaries at or below a record's key (_k1, _k2), by binary search in constant arrays."""
    if not bounds:
        return F.lit(0)
    one, two = F.lit([b[0] for b in bounds]), F.lit([b[1] for b in bounds])

    def reached(i: Column) -> Column:
        k = F.try_element_at(one, i)
        return (k < F.col("_k1")) | ((k == F.col("_k1")) & (F.try_element_at(two, i) <= F.col("_k2")))

    return F.aggregate(steps(len(bounds)), F.lit(0), lambda at, s: F.when(F.coalesce(reached(at + s), F.lit(False)), at + s).otherwise(at))


def looked_up(key: Column, values: dict[int, int]) -> Column:
    """The value of a key in a small constant table, by binary search."""
    keys = sorted(values)
    of = F.lit(keys)
    at = F.aggregate(steps(len(keys)), F.lit(0), lambda at, s: F.when(F.coalesce(F.try_element_at(of, at + s) <= key, F.lit(False)), at + s).otherwise(at))
    return F.try_element_at(F.lit([values[k] for k in keys]), at)


def keyed(df: DataFrame, id_col: str, text: str, extra: list[str]) -> DataFrame:
    return df.select(
        F.col(id_col).alias("doc_id"), *[F.col(c).alias(f"_keep_{c}") for c in extra],
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit(1), F.col(id_col), F.col(text)).alias("_k2"),
    )


def cut(rows: DataFrame, share: float, seed: int) -> Bounds:
    """Boundaries about every share bytes, from a size-weighted sample of the keys.

    A boundary stands at the start of a text's group unless several sampled keys are of that group."""
    drawn = F.pmod(F.xxhash64(F.lit(seed), "_k1", "_k2"), F.lit(1 << 30)) / float(1 << 30) < F.col("size") * (KEYS / share)
    sample = sorted((r._k1, r._k2) for r in rows.filter(drawn).select("_k1", "_k2").collect())
    often = Counter(k for k, _ in sample)
    return sorted({(a, b) if often[a] >= KEYS else (a, LEAST) for a, b in sample[KEYS::KEYS]})


def ranged(rows: DataFrame, bounds: Bounds) -> DataFrame:
    return rows.withColumn("_range", place(bounds))


def totals(rows: DataFrame) -> dict[int, tuple[int, int]]:
    return {r._range: (r.b, r.n) for r in rows.groupBy("_range").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}


def ranges(slim: DataFrame, n_shards: int) -> tuple[Bounds, dict[int, tuple[int, int]]]:
    """Boundaries, and bytes and rows of the ranges between them."""
    held = totals(ranged(slim, []))
    if not held:
        return [], {}
    size, n = held[0]
    share = size / max(1, min(n_shards * RANGES, n // ROWS))
    bounds = cut(slim, share, 0)
    for again in range(1, ROUNDS):
        held = totals(ranged(slim, bounds))
        over = [r for r, (b, n) in held.items() if b > OVERFULL * share and n > ROWS]
        more = {*bounds, *cut(ranged(slim, bounds).filter(F.col("_range").isin(over)), share / 2, again)} if over else {*bounds}
        if len(more) == len(bounds):
            return bounds, held
        bounds = sorted(more)
    return bounds, totals(ranged(slim, bounds))


def sharded(rows: DataFrame, spans: list[int], total: int, n_shards: int) -> DataFrame:
    """rows with their shard, from the bytes before each record in the order of all."""
    order = Window.partitionBy("_range").orderBy("_k1", "_k2", "doc_id")
    same = Window.partitionBy("_range", "_k1")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.element_at(F.lit(spans), F.col("_range") + 1)
    rows = rows.withColumn("_before", before).withColumn("_group", F.sum("size").over(same)).withColumn("_first", F.min("_before").over(same))
    # a record's middle decides, so that of a long one at a boundary no more than half is on the wrong side
    at = F.when(F.col("_group") <= WHOLE * total / n_shards, F.col("_first") + F.col("_group") / 2).otherwise(F.col("_before") + F.col("size") / 2)
    return rows.withColumn("shard", F.least(F.floor(at * n_shards / total), F.lit(n_shards - 1)).cast("int"))


OWN = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def shard(df: DataFrame, n_shards: int = SHARDS, id_col: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row, and the columns in keep as they are.

    Own columns win over clashing names in keep."""
    slim = keyed(df, id_col, text, [])
    bounds, held = ranges(slim, n_shards)
    total = sum(b for b, _ in held.values()) or 1
    spans = list(accumulate((held.get(i, (0, 0))[0] for i in range(len(bounds) + 1)), initial=0))
    # once over slim rows for the rows of each shard in each range; then whole rows move, once
    both = F.col("_range").cast("long") * n_shards + F.col("shard")
    counts = {r.k: r.n for r in sharded(ranged(slim, bounds), spans, total, n_shards).groupBy(both.alias("k")).agg(F.count("*").alias("n")).collect()}
    offsets, seen = {}, [0] * n_shards
    for k in sorted(counts):
        offsets[k] = seen[k % n_shards]
        seen[k % n_shards] += counts[k]
    extra = [c for c in keep or [] if c not in OWN]
    full = sharded(ranged(keyed(df, id_col, text, extra), bounds), spans, total, n_shards)
    within = Window.partitionBy("_range", "shard").orderBy("_k1", "_k2", "doc_id")
    slot = (F.row_number().over(within) - 1 + looked_up(both, offsets or {0: 0})).cast("long")
    return full.select("doc_id", *[F.col(f"_keep_{c}").alias(c) for c in extra], "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))
