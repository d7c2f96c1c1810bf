"""Benchmark decontamination: a broadcast hash set of normalised benchmark windows, a scan of every document's
windows, and verification of each hit word by word.

A window is WINDOW consecutive words of an item after lower-casing A-Z (an item of fewer words is one window). The
scan hashes all windows of a document at once, looks them up in a bit table and then in the sorted hashes, and compares
the words themselves. What is broadcast is a few flat arrays: the words and 20 bytes for each window, at most 11 times
the bytes of its texts. A benchmark of more than BROADCAST bytes is dealt into blocks of about that size, or of one
item: one block after another is fetched, broadcast, scanned for and destroyed, and the hits are united.

Null texts, in documents and benchmark, have no words. Rows of a null or shared id are judged each by its own text, and
repeated rows alike. Items that share an id are one item, and a null id is written `null`. Empty tables give no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.bytescan import ALNUM, Block, U, blocks, rolling, scanned, span
from folioscope.llm.common import documents, find_code, plain, sent, stored, table

WINDOW = 10
#: Bytes of benchmark text in one broadcast, about.
BROADCAST = 8 << 20
BITS = 20
SCHEMA = "n_words long, hits array<struct<first:long,last:long>>, items array<string>"


def words_of(block: Block):
    starts, ends, first = block.words(ALNUM)
    return starts, ends, first, span(block.sums(), starts, ends)


class Windows:
    """The benchmark's windows: by length, their hashes in order, each with its item and first word. The words stand in one buffer."""

    def __init__(self, items: list[tuple[str, str]]):
        self.names = sorted({i for i, _ in items})
        name = {n: k for k, n in enumerate(self.names)}
        words, of = [], {}
        size = 0
        for block in blocks([t for _, t in items]):
            starts, ends, first, h = words_of(block)
            for i in range(block.n):
                lo, hi = int(first[i]), int(first[i + 1])
                if (n := min(WINDOW, hi - lo)) > 0:
                    r = rolling(h[lo:hi], n)
                    of.setdefault(n, []).append((r, np.full(len(r), name[items[block.lo + i][0]], np.int32), np.arange(size + lo, size + lo + len(r))))
            words += [block.bytes[s:e].tobytes() for s, e in zip(starts, ends, strict=True)]
            size += len(starts)
        self.text = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) if words else np.zeros(0, np.int64)
        self.starts, self.ends = np.concatenate([[0], ends]).astype(np.int64), (ends - 1).astype(np.int64)
        self.by, self.bits = {}, {}
        for n, parts in of.items():
            h, item, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            self.by[n] = h[order], item[order], at[order]
            self.bits[n] = np.zeros(1 << BITS, bool)
            self.bits[n][(h >> U(64 - BITS)).astype(np.int64)] = True

    def items_of(self, h: int, n: int, words: bytes) -> set[int]:
        """The items that have this window."""
        known, item, at = self.by[n]
        lo, hi = np.searchsorted(known, U(h), "left"), np.searchsorted(known, U(h), "right")
        return {int(item[k]) for k in range(lo, hi) if self.text[self.starts[at[k]] : self.ends[at[k] + n - 1]] == words}

    def scan(self, block: Block):
        """For each text of the block: number of words, runs of hit words, items; and where the words are."""
        starts, ends, first, h = words_of(block)
        delta, items = np.zeros(len(h) + 1, np.int64), [set() for _ in range(block.n)]
        seen: dict[tuple, set] = {}
        for n, (known, _, _) in self.by.items():
            r = rolling(h, n)
            found = np.flatnonzero(self.bits[n][(r >> U(64 - BITS)).astype(np.int64)])
            found = found[known[np.minimum(np.searchsorted(known, r[found]), len(known) - 1)] == r[found]]
            of = np.searchsorted(first, found, "right") - 1
            for at, d in zip(found.tolist(), of.tolist(), strict=True):
                if at + n <= first[d + 1]:
                    words = b" ".join(block.bytes[starts[i] : ends[i]].tobytes() for i in range(at, at + n))
                    if (n, words) not in seen:
                        seen[n, words] = self.items_of(int(r[at]), n, words)
                    if same := seen[n, words]:
                        items[d] |= same
                        delta[at] += 1
                        delta[at + n] -= 1
        hit = np.concatenate([[0], (np.cumsum(delta[:-1]) > 0).astype(np.int8), [0]])
        edge = np.flatnonzero(np.diff(hit))
        runs = [[] for _ in range(block.n)]
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            d = int(np.searchsorted(first, s, "right")) - 1
            while s < e:  # a run that ends with one text may go on with the next
                stop = min(e, int(first[d + 1]))
                if s < stop:
                    runs[d].append((s - int(first[d]), stop - int(first[d])))
                s, d = max(s, stop), d + 1
        return np.diff(first), runs, [sorted(self.names[k] for k in i) for i in items], (starts, ends, first)


def benchmark_blocks(benchmark: DataFrame, item: str, text: str, most: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark's items in lists of about `most` bytes each, fetched one after another; one empty list if there is no text."""
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("i"), F.col(text).alias("t")).filter("t is not null")
    size = rows.agg(F.sum(F.octet_length("t") + F.octet_length("i"))).first()[0] or 0
    n = max(1, -(-size // most))
    for k in range(n):
        yield [(r.i, r.t) for r in (rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) if n > 1 else rows).toLocalIterator()]


def hits(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", most: int = BROADCAST) -> DataFrame:
    """doc_id, n_words, hits (runs of hit words), items and text_hash of every row of df."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))

    def scan(windows) -> DataFrame:
        def run(block: Block) -> dict:
            n, runs, items, _ = windows.value.scan(block)
            return {"n_words": n, "hits": [[{"first": s, "last": e} for s, e in r] for r in runs], "items": items}

        return scanned(rows, "text", ["doc_id", "text_hash"], run, SCHEMA)

    parts = benchmark_blocks(benchmark, item, item_text, most)
    held, following = next(parts), next(parts, None)
    if following is None:
        return scan(sent(spark, Windows(held)))
    found = []
    while held is not None:
        windows = spark.sparkContext.broadcast(Windows(held))
        found.append(stored(scan(windows).filter("size(hits) > 0").drop("n_words"), "benchmark-hits"))
        windows.destroy()
        held, following = following, next(parts, None)
    both = found[0]
    for f in found[1:]:
        both = both.unionByName(f)
    # rows alike in id and text have the same hits: any one of them stands for all
    united = both.groupBy("doc_id", "text_hash").agg(F.array_sort(F.flatten(F.collect_set("hits"))).alias("hits"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    merged = F.aggregate(
        "hits", F.array().cast("array<struct<first:long,last:long>>"),
        lambda a, x: F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["last"] >= x["first"]), F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(F.element_at(a, F.lit(-1))["first"].alias("first"), F.greatest(F.element_at(a, F.lit(-1))["last"], x["last"]).alias("last"))))).otherwise(F.concat(a, F.array(x))),
    )
    united = united.withColumn("hits", merged).alias("u")
    one = scan(sent(spark, Windows([]))).alias("o")
    joined = one.join(united, F.col("o.doc_id").eqNullSafe(F.col("u.doc_id")) & (F.col("o.text_hash") == F.col("u.text_hash")), "left")
    return joined.select("o.doc_id", "o.text_hash", "o.n_words", F.coalesce("u.hits", "o.hits").alias("hits"), F.coalesce("u.items", "o.items").alias("items"))


def report(df: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return hits(df, benchmark, **options).select(
        "doc_id", "n_words", F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["last"] - x["first"]).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


def decontaminate(df: DataFrame, benchmark: DataFrame, remove: str = "documents", text: str = "text", item: str = "item_id", item_text: str = "text", most: int = BROADCAST) -> DataFrame:
    """df without contaminated documents, or (remove='spans') with the hit words cut out of its texts."""
    spark = df.sparkSession
    names, at = df.columns, df.columns.index(text)
    out = plain(df)
    schema = out.schema
    if remove == "spans":
        return spans_cut(df, benchmark, text, item, item_text, most)

    def without(windows, rows: DataFrame) -> DataFrame:
        def run(batches):
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for block in blocks(b.column(at).to_pylist()):
                    _, runs, _, _ = windows.value.scan(block)
                    keep[block.lo : block.lo + block.n] = [not r for r in runs]
                yield b.filter(pa.array(keep))

        find_code(spark)
        return rows.mapInArrow(run, schema)

    parts = benchmark_blocks(benchmark, item, item_text, most)
    held = next(parts)
    while (following := next(parts, None)) is not None:  # each block acts on what the others left; a hit is the same whatever came before
        windows = spark.sparkContext.broadcast(Windows(held))
        out = stored(without(windows, out), "decontaminated")
        windows.destroy()
        held = following
    return without(sent(spark, Windows(held)), out).toDF(*names)


def spans_cut(df: DataFrame, benchmark: DataFrame, text: str, item: str, item_text: str, most: int) -> DataFrame:
    """df with the hit words cut out of its texts, from the first byte of a run's first word to the last of its last."""
    spark, names, at = df.sparkSession, df.columns, df.columns.index(text)
    rows = plain(df)
    schema = rows.schema
    parts = list(benchmark_blocks(benchmark, item, item_text, most))
    if len(parts) > 1:
        raise ValueError("spans are cut for a benchmark of one broadcast; pass a larger `most`")
    windows = sent(spark, Windows(parts[0]))

    def run(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            for block in blocks(texts):
                _, runs, _, (starts, ends, first) = windows.value.scan(block)
                for d, r in enumerate(runs):
                    if r:
                        raw, done, out = texts[block.lo + d].encode(), 0, []
                        for s, e in r:
                            out.append(raw[done : starts[first[d] + s] - block.begin[d]])
                            done = ends[first[d] + e - 1] - block.begin[d]
                        texts[block.lo + d] = b"".join([*out, raw[done:]]).decode()
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    find_code(spark)
    return rows.mapInArrow(run, schema).toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


SQL = """
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
b as (select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
i as (select item, least(10, len(w)) as n, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda k: list_slice(w, k, k + least(10, len(w)) - 1))) as g from b where len(w) > 0),
lens as (select distinct n from i),
d as (select doc_id, n, unnest(range(1, len(w) - n + 2)) as k, w from w cross join lens where len(w) >= n),
g as (select doc_id, n, k, list_slice(w, k, k + n - 1) as g from d),
h as (select g.doc_id, g.n, g.k, i.item from g join i on g.g = i.g and g.n = i.n),
p as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(k, k + n)) as p from h) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from h) group by doc_id)
select w.doc_id, cast(len(w.w) as bigint) as n_words, cast(coalesce(p.n_hit, 0) as bigint) as n_hit, cast(coalesce(t.n_items, 0) as bigint) as n_items,
  sha256(coalesce(t.items, '')) as items_sha256, coalesce(p.n_hit, 0) > 0 as contaminated
from w left join p on w.doc_id = p.doc_id left join t on w.doc_id = t.doc_id
"""
