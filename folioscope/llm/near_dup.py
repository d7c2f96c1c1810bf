"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct five-word shingles (64-bit hashes). Documents of equal sets are one class from
the start (128 bits tell sets apart); only one text of each class is indexed and compared. Shingles are put in one order for all documents:
first those that are not known to be frequent, by hash, then the frequent ones by rising frequency; frequencies come
from all documents, and the FREQUENT most frequent are kept. If two sets of sizes n share enough, then their
prefixes of n - ceil(0.8 n) + l shingles share l. The prefix is lengthened, and l raised, while the estimated
number of candidates (the frequencies in the prefix over l) falls by more than the longer prefix costs.

Prefix shingles are shuffled with their places in their sets. For a pair of sets both prefixes can be shorter than
for the worst partner, as the least intersection follows from the two sizes; a pair is counted once for each shingle
that both have within these shorter prefixes, and is a candidate only if it has l of them. Shingles that more than HOT classes
have in their prefixes don't make pairs at first: each class is compared with the one leader of the shingle, the class
with the largest part of frequent shingles. Every class is then verified, by its full sets, against its best
partner, and linked classes are joined. Only then come the pairs left between different components, hot shingles
included; all of them are verified, so no link is lost, and large groups of near copies are never paired off. In
verification a text is moved once as the first of its pair, and as the second once for every FOLLOWERS pairs.

Null texts and texts without words have empty sets, which are linked with nothing: each row is its own component.
Texts that share a doc_id are judged each by itself, repeated rows alike. Rows of a null id are not linked with others
(component null).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.bytescan import BASE, NOT_SPACE, Block, U, blocks, mix, rolling, scanned, span
from folioscope.llm.common import discard, documents, find_code, plain, sent, stored

WORDS = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Shingles whose frequency is broadcast (16 bytes each), and the least frequency that is worth it.
FREQUENT, OFTEN = 1 << 18, 8
#: Classes that may pair off at one prefix shingle; longest extension of a prefix; cost of a prefix shingle in candidates.
HOT, LONGEST, COST = 48, 16, 2.0
#: Pairs of one class that a task compares with the same copy of its text.
FOLLOWERS = 64
#: Shingles that a task counts together.
CHUNK = 2 << 20
#: The most frequent shingles, which are dealt out in SALTS parts each before facts of them are put together.
HOTTEST, SALTS = 256, 64


def shingles(block: Block) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of the block."""
    starts, ends, first = block.words(NOT_SPACE)
    h = span(block.sums(), starts, ends)
    r, out = rolling(h, WORDS), []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        k = hi - lo
        x = np.sort(r[lo : hi - WORDS + 1]) if k >= WORDS else mix(rolling(h[lo:hi], k) + U(k)) if k else h[:0]
        out.append(x[np.append(True, x[1:] != x[:-1])] if len(x) > 1 else x)
    return out


def names_of(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit names of a set."""
    sums = np.array([mix(s ^ U(k)).sum(dtype=U) + U(len(s)) for k in (BASE, 0xD6E8FEB86659FD93)], U)
    one, two = mix(sums).view(np.int64).tolist()
    return one, two


def class_of(s: np.ndarray, clashing: frozenset) -> int:
    """The first name, or where sets are known that share it, one made of both."""
    one, two = names_of(s)
    return int(mix(np.array([one, two], np.int64).view(U) * U(BASE) + U(1)).sum(dtype=U).view(np.int64)) if one in clashing else one


def needed(n: Column, m: Column) -> Column:
    """The least intersection that links sets of sizes n and m."""
    return F.ceil((n + m) * F.lit(PERCENT) / F.lit(100 + PERCENT))


class Order:
    """The frequent shingles, sorted, and their frequencies; and the class names that several sets share."""

    def __init__(self, found: list, clashing: frozenset = frozenset()):
        self.clashing = clashing
        self.token = np.array([r.token for r in found], np.int64).view(np.uint64)
        at = np.argsort(self.token)
        self.token, self.often = self.token[at], np.array([r.n for r in found], np.int64)[at]
        self.hottest = np.sort(self.token[np.argsort(-self.often, kind="stable")[:HOTTEST]])

    def frequency(self, s: np.ndarray) -> np.ndarray:
        if not len(self.token):
            return np.zeros(len(s), np.int64)
        at = np.minimum(np.searchsorted(self.token, s), len(self.token) - 1)
        return np.where(self.token[at] == s, self.often[at], 0)

    def salts(self, token: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Which part of its shingle's rows a row is dealt to; -1 for all but the hottest shingles."""
        if not len(self.hottest):
            return np.full(len(token), -1, np.int32)
        at = np.minimum(np.searchsorted(self.hottest, token), len(self.hottest) - 1)
        return np.where(self.hottest[at] == token, cls.view(U) % U(SALTS), -1).astype(np.int32)

    def prefix(self, s: np.ndarray) -> tuple[np.ndarray, int, int]:
        """Prefix shingles, l, and the frequent shingles' part of the set in 255ths."""
        f, n = self.frequency(s), len(s)
        t = -(-PERCENT * n // 100)
        order = np.argsort(f, kind="stable")  # s is sorted, so ties stand by hash
        ells = np.arange(1, min(LONGEST, t) + 1)
        total = np.cumsum(np.maximum(f[order], 1))[n - t + ells - 1]
        ell = int(ells[np.argmin(total / ells + COST * ells)])
        return s[order[: n - t + ell]], ell, int(255 * (f > 0).sum() // n)


def classes(df: DataFrame, id_col: str, text: str) -> tuple[DataFrame, frozenset]:
    """doc_id, text_hash, n_shingles and cls (null for the empty set) of every row; and names that sets share by chance."""

    def run(block: Block) -> dict:
        s = shingles(block)
        both = [names_of(x) if len(x) else (None, None) for x in s]
        return {"n_shingles": [len(x) for x in s], "cls": [a for a, _ in both], "second": [b for _, b in both]}

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    held = stored(scanned(rows, "text", ["doc_id", "text_hash"], run, "n_shingles long, cls long, second long"), "classes")
    clashing = frozenset(r.cls for r in held.filter("cls is not null").groupBy("cls").agg(F.min("second").alias("a"), F.max("second").alias("b")).filter("a != b").collect())
    if clashing:  # of 2^64 names: never more than a handful
        def renamed(block: Block) -> dict:
            return {"cls": [class_of(x, clashing) if len(x) else None for x in shingles(block)]}

        again = scanned(rows, "text", ["doc_id", "text_hash"], renamed, "cls long").distinct()
        held = stored(held.drop("cls").join(again, [held.doc_id.eqNullSafe(again.doc_id), held.text_hash.eqNullSafe(again.text_hash)]).select(held.doc_id, held.text_hash, "n_shingles", "cls"), "classes")
    return held, clashing


def fresh(texts: list, seen: set, clashing: frozenset = frozenset()):
    """Classes and sets of texts whose class this task has not seen."""
    for block in blocks(texts):
        for x in shingles(block):
            if len(x) and (c := class_of(x, clashing)) not in seen:
                seen.add(c)
                yield c, x


def frequent(texts: DataFrame, clashing: frozenset) -> Order:
    """The most frequent shingles. A task counts CHUNK shingles together and passes on those that it saw more than once."""

    def count(held: list[np.ndarray]):
        token, n = np.unique(np.concatenate(held), return_counts=True)
        more = n > 1
        return pa.RecordBatch.from_arrays([pa.array(token[more].view(np.int64)), pa.array(n[more].astype(np.int64))], ["token", "n"])

    def run(batches):
        held, size, seen = [], 0, set()
        for b in batches:
            for _, x in fresh(b.column(0).to_pylist(), seen):
                held.append(x)
                size += len(x)
                if size >= CHUNK:
                    yield count(held)
                    held, size = [], 0
        if held:
            yield count(held)

    find_code(texts.sparkSession)
    n = stored(texts.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= OFTEN), "shingle-counts")
    scale = F.floor(F.log2("n") * 8)
    least, room = 1 << 62, FREQUENT
    for r in sorted(n.groupBy(scale.alias("k")).count().collect(), reverse=True):
        if r["count"] > room:
            break
        room, least = room - r["count"], r.k
    out = Order(n.filter(scale >= least).collect(), clashing)
    discard(n)
    return out


def prefixes(texts: DataFrame, order: Order) -> DataFrame:
    """token, salt, cls, size (n in the high and the place in the low 32 bits) and traits (ell and common, 8 bits) of every prefix shingle of every class, once a task."""
    ready = sent(texts.sparkSession, order)

    def run(batches):
        seen: set = set()
        for b in batches:
            token, cls, size, traits = [], [], [], []
            for c, x in fresh(b.column(0).to_pylist(), seen, ready.value.clashing):
                t, ell, common = ready.value.prefix(x)
                token.append(t)
                cls.append(np.full(len(t), c, np.int64))
                size.append((np.int64(len(x)) << 32) | np.arange(len(t)))
                traits.append(np.full(len(t), (ell << 8) | common, np.int32))
            if token:
                token, cls = np.concatenate(token), np.concatenate(cls)
                cols = [token.view(np.int64), ready.value.salts(token, cls), cls, np.concatenate(size), np.concatenate(traits)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["token", "salt", "cls", "size", "traits"])

    find_code(texts.sparkSession)
    return texts.mapInArrow(run, "token long, salt int, cls long, size long, traits int")


def within(x: str, y: str) -> Column:
    """Whether a shared shingle stands in the prefixes that this pair needs, and their sizes allow a link."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    room = F.least(f"{x}.ell", f"{y}.ell") - needed(n, m)
    return (F.col(f"{x}.pos") < n + room) & (F.col(f"{y}.pos") < m + room) & (100 * F.least(n, m) >= PERCENT * F.greatest(n, m))


def verified(pairs: DataFrame, first: DataFrame, docs: DataFrame) -> DataFrame:
    """The linked ones of pairs (a, b) of classes. first: cls, and doc_id and text_hash of the text that stands for it; docs: doc_id, text_hash, text.

    b's of one a are dealt to tasks in groups of about FOLLOWERS; each group gets a's text once, and a task reads its groups one after another."""
    texts = docs.join(first, ["doc_id", "text_hash"]).select("cls", "text").groupBy("cls").agg(F.min("text").alias("text"))
    n = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(FOLLOWERS)).cast("int").alias("k"))
    dealt = pairs.join(n, "a").withColumn("deal", F.pmod(F.xxhash64("b"), F.col("k")).cast("int")).drop("k")
    firsts = n.select("a", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("deal"), F.lit(None).cast("long").alias("b"), F.col("a").alias("cls"))
    ends = firsts.unionByName(dealt.withColumn("cls", F.col("b"))).join(texts, "cls").select("a", "deal", "b", "text")
    sorted_ = ends.repartition("a", "deal").sortWithinPartitions("a", "deal", F.col("b").asc_nulls_first())

    def run(batches):
        key, x = None, np.zeros(0, U)
        for batch in batches:
            a, deal, b, texts = (batch.column(i).to_pylist() for i in range(4))
            keep, at = [], 0
            for block in blocks(texts):
                for s in shingles(block):
                    if b[at] is None:
                        key, x = (a[at], deal[at]), s
                        keep.append(False)
                    else:
                        shared = len(x) + len(s) - len(np.union1d(x, s)) if key == (a[at], deal[at]) else 0
                        keep.append(bool(shared) and 100 * shared >= PERCENT * (len(x) + len(s) - shared))
                    at += 1
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    find_code(pairs.sparkSession)
    return sorted_.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """cls and comp, the least class that links reach, for every class in edges (a, b): alternating large and small stars."""
    spark = edges.sparkSession
    least = F.least("a", "b")
    now = stored(edges.select(least.alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "links")

    def star(e: DataFrame, large: bool) -> DataFrame:
        # each vertex u hands its neighbours (large: those above it) to the least of them and itself
        both = e.select(F.col("b").alias("u"), F.col("a").alias("v"))
        both = both.unionByName(e.select(F.col("a").alias("u"), F.col("b").alias("v"))) if large else both
        m = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = both.join(m, "u")
        moved = out.filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")) if large else out.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(m.select(F.col("m").alias("a"), F.col("u").alias("b")))
        return moved.filter("a < b").distinct()

    before = None
    while True:
        after = stored(star(star(now, True), False), "links")
        discard(now)
        now = after
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    out = stored(now.select(F.col("b").alias("cls"), F.col("a").alias("comp")).unionByName(now.select(F.col("a").alias("cls"), F.col("a").alias("comp"))).distinct(), "components")
    discard(now)
    return out


def links(df: DataFrame, judged_: DataFrame, clashing: frozenset, id_col: str, text: str) -> DataFrame:
    """All components of classes. judged_ and clashing: classes(df)."""
    words = df.filter(F.col(text).isNotNull() & F.col(id_col).isNotNull()).select(F.col(text).alias("text"))
    rows = prefixes(words, frequent(words, clashing))
    # dealt by shingle and salt, all that follows needs no other shuffle; a class that several tasks saw has the same rows from each, and leaves one
    once = rows.repartition("token", "salt").groupBy("token", "salt", "cls").agg(F.max("size").alias("size"), F.max("traits").alias("traits"))
    once = once.select("token", "salt", "cls", F.shiftright("size", 32).alias("n"), F.col("size").bitwiseAND(F.lit((1 << 32) - 1)).alias("pos"), F.shiftright("traits", 8).alias("ell"), F.col("traits").bitwiseAND(F.lit(255)).alias("common"))
    group, top = Window.partitionBy("token", "salt"), lambda: F.max(F.struct("common", "n", "cls"))
    held = stored(once.withColumn("m", F.count("*").over(group)).filter("m > 1 or salt >= 0").withColumn("leader", top().over(group)["cls"]), "prefixes")
    salted = held.filter("salt >= 0").drop("m", "leader")
    whole = F.broadcast(salted.groupBy("token").agg(F.count("*").alias("m"), top()["cls"].alias("leader")))  # HOTTEST rows at most
    index = held.filter("salt < 0").unionByName(salted.join(whole, "token").filter("m > 1")).drop("salt")
    hot = index.filter(F.col("m") > HOT)
    facts = stored(index.groupBy("cls").agg(F.count_if(F.col("m") > HOT).alias("h"), F.count_if(F.col("m") <= HOT).alias("f")), "class-facts")
    few = index.filter(F.col("m") <= HOT).select("token", "cls", "n", "pos", "ell")

    def candidates(pairs: DataFrame, other: str) -> DataFrame:
        """a, b, s: the pairs that share l shingles, given how many of the other sort they can share at most."""
        counted = pairs.groupBy(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")).agg(F.count("*").alias("s"), F.max(F.least("x.ell", "y.ell")).alias("ell"))
        for e in "ab":
            counted = counted.join(facts.select(F.col("cls").alias(e), F.col(other).alias(f"{other}_{e}")), e)
        return counted.filter(F.col("s") + F.least(f"{other}_a", f"{other}_b") >= F.col("ell")).select("a", "b", "s")

    pairs = few.alias("x").join(few.alias("y"), "token").filter((F.col("x.cls") < F.col("y.cls")) & within("x", "y"))
    near = stored(candidates(pairs, "h"), "candidates")
    led = hot.filter("cls != leader").groupBy("cls", "leader").agg(F.count("*").alias("s")).select(F.col("cls").alias("a"), F.col("leader").alias("b"), "s")
    either = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "s")).unionByName(led)
    best = either.groupBy("a").agg(F.max(F.struct("s", "b")).alias("best")).select(F.least("a", "best.b").alias("a"), F.greatest("a", "best.b").alias("b")).distinct()
    first = judged_.filter("cls is not null and doc_id is not null").groupBy("cls").agg(F.min(F.struct("doc_id", "text_hash")).alias("f")).select("cls", "f.doc_id", "f.text_hash")
    docs = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    tried = stored(best, "tried")
    found = stored(verified(tried, first, docs), "links")
    comp = components(found)
    named = lambda e: F.coalesce(F.col(f"{e}.comp"), F.col(f"{e}.cls"))
    left = near.join(comp.select(F.col("cls").alias("a"), F.col("comp").alias("ca")), "a", "left").join(comp.select(F.col("cls").alias("b"), F.col("comp").alias("cb")), "b", "left")
    left = left.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    # Hot shingles: only rows outside a shingle's largest component meet the others. A pair that shares no other prefix
    # shingle has none in common among those that stand before a hot one and are not hot; more than n - needed can't be missed.
    own = hot.withColumn("missed", F.col("pos") - F.row_number().over(Window.partitionBy("cls").orderBy("pos")) + 1)
    own = own.select("token", "cls", "n", "pos", "ell", "missed").join(comp, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    per = own.groupBy("token", "comp").agg(F.count("*").alias("k")).groupBy("token").agg(F.max(F.struct("k", "comp"))["comp"].alias("top"), F.count("*").alias("kinds")).filter("kinds > 1").drop("kinds")
    own = own.join(per, "token")
    cross = own.filter("comp != top").alias("x").join(own.alias("y"), "token").filter((F.col("x.comp") != F.col("y.comp")) & ((F.col("y.comp") == F.col("y.top")) | (F.col("x.cls") < F.col("y.cls"))) & within("x", "y") & (F.col("x.missed") <= F.col("x.n") - needed(F.col("x.n"), F.col("y.n"))) & (F.col("y.missed") <= F.col("y.n") - needed(F.col("x.n"), F.col("y.n"))))
    cross = candidates(cross, "f").select("a", "b")
    rest = stored(left.unionByName(cross).distinct().join(tried, ["a", "b"], "left_anti"), "rest")
    if rest.count():
        late = stored(verified(rest, first, docs), "links")
        both = components(found.unionByName(late))
        discard(comp, late)
        comp = both
    discard(held, facts, near, tried, rest, found)
    return comp


def judged(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id (least doc_id that links reach) and comp (the component's own name) of every row."""
    held, clashing = classes(df, id_col, text)
    comp = links(df, held, clashing, id_col, text)
    by_class = held.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least")).join(comp, "cls", "left")
    by_class = by_class.withColumn("comp", F.coalesce("comp", "cls"))
    least = by_class.groupBy("comp").agg(F.min("least").alias("component_id"))
    by_class = by_class.join(least, "comp").select("cls", "comp", "component_id")
    out = held.join(by_class, "cls", "left")
    return out.select("doc_id", "text_hash", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), "comp")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    return judged(df, id_col, text).drop("text_hash", "comp")


def keep_first(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """df with one row of each group of near duplicates: one that has the least id. Of rows of that id and group one stays.

    Rows of a null id all stay. Columns of any name pass through."""
    rows = plain(df)
    key, words = f"c{df.columns.index(id_col)}", f"c{df.columns.index(text)}"
    names = [key, "_hash"]
    found = stored(judged(rows, key, words).filter("n_shingles > 0 and doc_id is not null").drop("n_shingles"), "judged")
    least = found.filter("doc_id = component_id").select("doc_id", "text_hash", "comp")  # nearly always one text a group
    others = least.join(least.groupBy("comp").agg(F.min("text_hash").alias("one")), "comp").filter("text_hash != one")
    dropped = stored(found.filter("doc_id != component_id").select("doc_id", "text_hash").unionByName(others.select("doc_id", "text_hash")).distinct().toDF(*names), "dropped")
    discard(found)
    marked = rows.withColumns({"_hash": F.xxhash64(words), "_own": F.xxhash64(*rows.columns)})
    # rows alike in id and text: the first by all they hold stays, and one of those that are alike in all
    each = marked.filter(F.col(key).isNotNull() & F.col(words).isNotNull()).groupBy(*names, "_own").agg(F.count("*").alias("n"))
    alike = each.groupBy(*names).agg(F.min(F.struct("_own", "n")).alias("first"), F.sum("n").alias("all")).filter("all > 1")
    alike = stored(alike.select(*names, F.col("first._own").alias("_first"), F.col("first.n").alias("_same")), "alike")
    left = lambda d, by=dropped: d.join(by, names, "left_anti")
    # merged at every size, as large tables must be: if a small one were broadcast, the rows would be shuffled at large sizes only
    single = left(marked, dropped.hint("merge")).join(alike, names, "left").filter("_first is null or (_first = _own and _same = 1)")
    same = left(marked.join(alike.filter("_same > 1"), names).filter("_first = _own")).dropDuplicates(names)
    return single.select(*rows.columns).unionByName(same.select(*rows.columns)).toDF(*df.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, g from (select doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from w)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
e as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * k >= 80 * (a.n + b.n - k)),
b as (select x, y from e union select y, x from e),
r(u, v) as (select x, y from b union select r.u, b.y from r join b on r.v = b.x),
c as (select u, min(v) as v from r group by u)
select w.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, cast(least(w.doc_id, coalesce(c.v, w.doc_id)) as bigint) as component_id from w left join n on n.doc_id = w.doc_id left join c on c.u = w.doc_id
"""
