"""Suffix-array deduplication: removal of bytes that lie in a LENGTH-byte string which also starts earlier.

Positions are ranked by prefix doubling. A rank is a name of the string at a position; equal strings have equal ranks
whatever machine names them, so the doublings up to HALF bytes run inside a task and need no global renumbering. Spark
then groups (rank, position) rows at HALF bytes, drops the positions whose rank is unique, pairs the rank of each
remaining position with the one HALF bytes on, and groups again; at LENGTH = 2 * HALF bytes the threshold is passed and
doubling ends. What decides on removal is two names of 64 bits each, of different bases.

Three things keep the first sort small without losing a repeat. Exact copies of a text are named once a task, and
known as copies by their digest. Of the HALF-byte strings only those that are least in some LENGTH-byte window are
ranked (about one in 25): equal windows choose alike, so every repeated window has a ranked position in common with
its earlier occurrence. And each ranked position carries the name of its whole surroundings: a later one in the same
surroundings is a repeat in all its windows and goes no further, so only windows at the edges of repeats are ranked
at full length.

Groups are sorted by windows, but for two kinds of positions, which are dealt out evenly instead. Repeats of an earlier
position within a block of texts are settled in their task. And the ranks that make up at least one in HOT of the
positions of a sample of the texts (at most HOT names, broadcast) are settled afterwards by partial aggregates and a
join that Spark can split, so that a passage that very many texts share is no hot group. The sample decides only on
which way a rank is settled, not on how.

Order is by doc_id, then offset; a null doc_id comes first. Null text is empty. A document is a doc_id, null or not,
with a text (its 64-bit hash): rows that share both are one document with one result each, and texts that share an id
are documents of their own, in the order of their hashes. Texts under LENGTH bytes lose nothing. Ids are integers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.bytescan import BASE, INVERSE, Block, U, blocks, mix, powers, scanned, span
from folioscope.llm.common import discard, documents, find_code, stored

HALF = 50
LENGTH = 2 * HALF
TOP = U(2**64 - 1)
NULL_ID = -(1 << 63)
#: A rank is hot with more than this part of all positions, by a sample of one text in SAMPLE.
HOT, SAMPLE = 500, 64
SETTLED, OPEN = 1, 2


def slide(x: np.ndarray, n: int, least) -> np.ndarray:
    """least(x[i], ... x[i+n-1]) for every i, by doubling."""
    done, out = 1, x
    while done < n:
        step = min(done, n - done)
        out = least(out[: len(out) - step], out[step:])
        done += step
    return out


#: The base of the second names.
OTHER = 0xC2B2AE3D27D4EB4F
OTHER_INVERSE = pow(OTHER, -1, 1 << 64)


def second_sums(block: Block) -> np.ndarray:
    out = np.zeros(len(block.bytes) + 1, U)
    np.cumsum(mix(block.bytes.astype(U) + U(1)) * powers(OTHER, len(block.bytes)), out=out[1:])
    return out


def span_by(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Second names of the substrings [start, end)."""
    return mix((sums[end] - sums[start]) * powers(OTHER_INVERSE, len(sums))[start] + (end - start).astype(U) * U(OTHER))


class Ranks:
    """Ranks of a block's positions at HALF bytes, the least of each window, and which windows lie within one text."""

    def __init__(self, block: Block):
        self.block, a = block, block.bytes
        self.sums, self.second = block.sums(), second_sums(block)
        n = len(a)
        self.rank = mix((self.sums[HALF:] - self.sums[:-HALF]) * powers(INVERSE, n + 1)[: n + 1 - HALF])
        room = np.zeros(n + 1, np.int32)
        long = block.size >= LENGTH
        np.add.at(room, block.begin[long], 1)
        np.add.at(room, block.end[long] - LENGTH + 1, -1)
        windows = max(n - LENGTH + 1, 0)
        self.inside = (np.cumsum(room) > 0)[:windows]
        self.least = slide(self.rank[: windows + HALF], HALF + 1, np.minimum)[:windows] if windows else self.rank[:0]

    def chosen(self) -> np.ndarray:
        """Positions whose rank is least in some window."""
        if not self.inside.any():
            return np.zeros(0, np.int64)
        m = np.zeros(len(self.inside) + 2 * HALF, U)
        m[HALF : HALF + len(self.inside)] = np.where(self.inside, self.least, U(0))
        top = slide(m, HALF + 1, np.maximum)[: len(self.inside) + HALF]
        return np.flatnonzero(top == self.rank[: len(top)])

    def around(self, at: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Names of all bytes that share a window with the ranked string at each position, and of its place in them."""
        lo, hi = np.maximum(at - HALF, self.block.begin[of]), np.minimum(at + LENGTH, self.block.end[of])
        return mix(span_by(self.second, lo, hi) + (at - lo).astype(U) * U(BASE))

    def windows_of(self, at: np.ndarray) -> np.ndarray:
        """The windows whose least rank stands at one of these positions."""
        v = np.full(len(self.inside) + HALF, TOP)
        v[at] = self.rank[at]
        return np.flatnonzero(self.inside & (slide(v, HALF + 1, np.minimum)[: len(self.inside)] == self.least))

    def doubled(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks at LENGTH bytes: the pair of ranks HALF bytes apart, and a second name."""
        return mix(self.rank[at] * U(BASE) + self.rank[at + HALF]), span_by(self.second, at, at + LENGTH)


def again_here(doc: np.ndarray, key: np.ndarray, at: np.ndarray, *names: np.ndarray) -> np.ndarray:
    """Which positions of a block have an earlier one of the same names in it. Repeated rows share their positions."""
    order = np.lexsort((at, key, doc, *names))
    new = np.ones(len(order), bool)
    for n in names:
        new[1:] &= n[order][1:] == n[order][:-1]
    new[1:] = ~new[1:]
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order
    out = np.zeros(len(order), bool)
    out[order] = (doc[order] != doc[first]) | (key[order] != key[first]) | (at[order] != at[first])
    return out


class Hot:
    """The names that very many positions share, sorted."""

    def __init__(self, names: list[int]):
        self.names = np.sort(np.array(names, np.int64).view(U))

    def states(self, names: np.ndarray, own: np.ndarray) -> np.ndarray:
        """SETTLED for repeats of the same block, OPEN and a hot name's number, else 0."""
        out = np.zeros(len(names), np.int32)
        if len(self.names):
            at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
            out = np.where(self.names[at] == names, OPEN + at, 0).astype(np.int32)
        out[own] = SETTLED
        return out


def hot_names(rows: DataFrame) -> Hot:
    """The names in rank that make up more than one in HOT of rows."""
    counts = stored(rows.groupBy("rank").agg(F.count("*").alias("n")), "sampled-ranks")
    total = counts.agg(F.sum("n")).first()[0] or 0
    out = Hot([r["rank"] for r in counts.filter(F.col("n") * HOT > total).filter("n > 2").collect()])
    discard(counts)
    return out


def sampled(docs: DataFrame) -> DataFrame:
    return docs.filter(F.pmod(F.xxhash64("key", "doc", F.lit(5)), F.lit(SAMPLE)) == 0)


def columns(names: np.ndarray, doc: np.ndarray, key: np.ndarray, at: np.ndarray, own: np.ndarray, hot: Hot, more: np.ndarray) -> list:
    """Arrays of rank, the other name, doc, key, at and state; what is not settled by its rank gets one of its own."""
    state = hot.states(names, own)
    alone = mix(at.astype(U) * U(0xD1342543DE82EF95) + key.view(U) + doc.view(U) * U(BASE))
    return [pa.array(x) for x in (np.where(state > 0, alone, names).view(np.int64), more.view(np.int64), doc, key, at, state)]


def ranked(docs: DataFrame, hot: Hot) -> DataFrame:
    """rank, around, doc, key, at, state: the chosen positions of every text, of copies in one task only the earliest."""

    def run(batches):
        seen: dict[bytes, int] = {}
        for b in batches:
            ids, keys, texts = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist()
            for i, t in enumerate(texts):
                digest = hashlib.blake2b((t or "").encode(), digest_size=16).digest()
                if seen.get(digest, 1 << 63) <= ids[i]:
                    texts[i] = None
                else:
                    seen[digest] = int(ids[i])
            for block in blocks(texts, 1, False):
                r = Ranks(block)
                at = r.chosen()
                of = np.searchsorted(block.begin, at, "right") - 1
                doc, key, place = ids[block.lo + of], keys[block.lo + of], (at - block.begin[of]).astype(np.int32)
                around = r.around(at, of)
                own = again_here(doc, key, place, r.rank[at], around)
                yield pa.RecordBatch.from_arrays(columns(r.rank[at], doc, key, place, own, hot, around), ["rank", "around", "doc", "key", "at", "state"])

    find_code(docs.sparkSession)
    return docs.mapInArrow(run, "rank long, around long, doc long, key long, at int, state int")


def doubled(docs: DataFrame, hot: Hot) -> DataFrame:
    """rank, second, doc, key, at, state: at LENGTH bytes, for the windows of the positions in the column `open`."""

    def run(batches):
        for b in batches:
            ids, keys, opened = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3)
            for block in blocks(b.column(2).to_pylist(), 1, False):
                r = Ranks(block)
                part = opened.slice(block.lo, block.n)
                counts = np.diff(part.offsets.to_numpy())
                at = r.windows_of(np.sort(part.flatten().to_numpy() + np.repeat(block.begin, counts)))
                of = np.searchsorted(block.begin, at, "right") - 1
                doc, key, place = ids[block.lo + of], keys[block.lo + of], (at - block.begin[of]).astype(np.int32)
                rank, second = r.doubled(at)
                own = again_here(doc, key, place, rank, second)
                yield pa.RecordBatch.from_arrays(columns(rank, doc, key, place, own, hot, second), ["rank", "second", "doc", "key", "at", "state"])

    find_code(docs.sparkSession)
    return docs.mapInArrow(run, "rank long, second long, doc long, key long, at int, state int")


def later(rows: DataFrame, names: list[str]) -> DataFrame:
    """rows with again: whether an earlier row has the same names. Partial aggregates, and a join that Spark can split."""
    place = F.struct("doc", "key", "at")
    groups = rows.groupBy(*names).agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first != last").drop("last")
    return rows.join(groups.hint("merge"), names, "left").withColumn("again", F.coalesce(place != F.col("first"), F.lit(False))).drop("first")


def covers(docs: DataFrame) -> DataFrame:
    """doc, key, lo, hi: bytes that repeat earlier ones; hi may lie past the end of a text. docs: doc, key, text."""
    # equal (doc, key, at) come from repeated rows and share a place in the order
    by_place = ["doc", "key", "at"]
    rows = ranked(docs, hot_names(ranked(sampled(docs), Hot([])).filter("state = 0")))
    whole = Window.partitionBy("rank").orderBy("around", *by_place).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("open", F.first("around").over(whole) != F.last("around").over(whole))
    rows = rows.withColumn("again", (F.col("state") == SETTLED) | (F.rank().over(Window.partitionBy("rank", "around").orderBy(*by_place)) > 1))
    first = stored(rows.filter("again or open or state >= 2").select("doc", "key", "at", "again", "state", F.when(F.col("state") >= OPEN, F.col("around")).alias("around")), "ranked")
    hot = first.filter(F.col("state") >= OPEN)
    several = F.broadcast(hot.groupBy("state").agg((F.min("around") != F.max("around")).alias("open")))
    hot = later(hot.drop("again").join(several, "state"), ["state", "around"]).filter("again or open")
    first = stored(first.filter(F.col("state") < OPEN).select(*by_place, "again").unionByName(hot.select(*by_place, "again")), "settled-ranks")
    opened = first.filter("not again").groupBy("doc", "key").agg(F.collect_set("at").alias("open"))
    joined = lambda d: d.join(opened, ["doc", "key"]).select("doc", "key", "text", "open")
    windows = doubled(joined(docs), hot_names(doubled(joined(sampled(docs)), Hot([])).filter("state = 0")))
    windows = windows.withColumn("again", (F.col("state") == SETTLED) | (F.rank().over(Window.partitionBy("rank", "second").orderBy(*by_place)) > 1))
    found = stored(windows.filter("again or state >= 2").select(*by_place, "again", "state", F.when(F.col("state") >= OPEN, F.col("second")).alias("second")), "doubled")
    hot = later(found.filter(F.col("state") >= OPEN).drop("again"), ["state", "second"]).filter("again").select(*by_place)
    found = found.filter(F.col("state") < OPEN).select(*by_place).unionByName(hot).select("doc", "key", F.col("at").alias("lo"), (F.col("at") + LENGTH).alias("hi"))
    digests = docs.filter(F.octet_length("text") >= LENGTH).select("doc", "key", F.md5(F.col("text").cast("binary")).alias("digest"), F.octet_length("text").alias("n"))
    several = stored(digests.groupBy("digest", "n").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).filter("least != most"), "copied")
    copies = digests.join(several.hint("merge"), ["digest", "n"]).filter("doc > least")
    copies = stored(copies.select("doc", "key", F.lit(0).alias("lo"), F.col("n").alias("hi")), "copies")
    again = first.filter("again").select("doc", "key", F.greatest(F.col("at") - HALF, F.lit(0)).alias("lo"), (F.col("at") + LENGTH).alias("hi"))
    return copies.unionByName(again).unionByName(found)


def cut_out(raw: bytes, lo, hi) -> tuple[int, list[tuple[int, int]]]:
    """Bytes removed, and the maximal removed runs."""
    n = len(raw)
    hi = np.minimum(hi, n)
    keep = (hi - lo >= LENGTH) & (lo >= 0)
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, lo[keep], 1)
    np.add.at(d, hi[keep], -1)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(d[:n]) > 0).astype(np.int8), [0]])))
    runs = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
    return sum(e - s for s, e in runs), runs


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text", texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; with texts also `kept`, the bytes that remain."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    some = covers(docs.select("doc", "key", "text")).groupBy("doc", "key").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    joined = docs.join(some, ["doc", "key"], "left").select("doc_id", "text", "lo", "hi")

    def run(batches):
        none = np.zeros(0, np.int64)
        for b in batches:
            rows = []
            for t, lo, hi in zip(b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                raw = t.encode()
                n, runs = cut_out(raw, lo.values.to_numpy(), hi.values.to_numpy()) if lo.is_valid else cut_out(raw, none, none)
                at, out = 0, []
                for s, e in runs:
                    out.append(raw[at:s])
                    at = e
                kept = b"".join([*out, raw[at:]])
                rows.append((len(raw), n, len(runs), hashlib.sha256(kept).hexdigest(), *[kept] * texts))
            cols = list(zip(*rows, strict=True)) or [[]] * (4 + texts)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=False)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * texts])

    kind = df.schema[id_col].dataType.simpleString()
    find_code(df.sparkSession)
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))


#: Hexadecimal digits of the UTF-8 bytes, two a byte: DuckDB cuts strings, not bytes.
SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n from documents),
w as (select doc_id, n, p, substr(h, cast(2 * p + 1 as bigint), 200) as s from (select doc_id, n, h, unnest(range(0, n - 99)) as p from d where n >= 100)),
a as (select doc_id, n, p from (select doc_id, n, p, row_number() over (partition by s order by doc_id, p) as k from w) where k > 1),
b as (select *, lag(p) over (partition by doc_id order by p) as before from a),
i as (select *, sum(case when before is null or p > before + 100 then 1 else 0 end) over (partition by doc_id order by p rows unbounded preceding) as g from b),
r as (select doc_id, g, min(p) as lo, max(p) + 100 as hi from i group by doc_id, g),
k as (select doc_id, lo, hi, coalesce(lag(hi) over (partition by doc_id order by lo), 0) as done from r),
s as (select k.doc_id, sum(hi - lo) as n_removed, count(*) as n_spans, max(hi) as last, string_agg(substr(h, cast(2 * done + 1 as bigint), cast(2 * (lo - done) as bigint)), '' order by lo) as kept from k join d on d.doc_id = k.doc_id group by k.doc_id)
select d.doc_id, cast(n as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans,
  sha256(unhex(case when s.doc_id is null then h else kept || substr(h, cast(2 * last + 1 as bigint)) end)) as kept_sha256
from d left join s on s.doc_id = d.doc_id
"""
