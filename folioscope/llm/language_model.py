"""Language-model scoring by online logistic mixing of hashed-context bit predictors.

A text is its bytes after lower-casing A-Z and one end symbol, each coded in eight binary decisions. Predictors count
zeros and ones under a hash of their context and the bits so far, one for each order (2 to 6 bytes of context). The
counts are of all training texts, in tables whose sizes follow from the distinct contexts that these texts have, up to
BITS. A mixer adds the predictors' logits with weights that gates choose:
how much the longer contexts have been seen, and the bit and kind of the byte before. An adaptive probability map
refines the result. Mixer and map learn online, in small batches, from every place of all training texts, without the
place's own count: places of the same context and byte are the same lesson, so tasks learn from the distinct ones that
they have, as often as they occur, and what the tasks learned is averaged by the places they saw. Then all is fixed, so
a text's score doesn't depend on what else is scored; log10 probabilities are summed over the whole text.

The probability of a byte depends on the six before it only, so each worker keeps a table of what it has worked out.

Beside it stands the add-one unigram score of the contract. Counts of words (64-bit hashes) are of all training texts;
the COMMON most common words are broadcast, and the others reach the documents that have them by a shuffle.

Null text is empty: only the end symbol, and only the end token, are scored. Every row is scored by itself, whatever its id;
repeated rows get the same score. Words of equal hash count as one.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.bytescan import BASE, NOT_SPACE, Block, U, blocks, mix, mixed, scanned, span
from folioscope.llm.common import discard, documents, find_code, fold_of, sent, stored

#: Bytes of context of each predictor, and bits of the size of its table, at most.
ORDERS = (2, 3, 4, 5, 6)
PREDICTORS = len(ORDERS)
BITS = (18, 19, 20, 21, 21)
PART = 1 << 14
#: Distinct n-grams that one task spreads over tables of its own.
SHARE = 4 << 20
#: Decisions of a step at first, rate of learning, and decisions after which the rate falls and steps grow.
BATCH, RATE, SLOWER = 256, 0.006, 1 << 19
#: A lesson that occurs more than HEAVY times as often as they do on average is learned in several parts, and n-grams that a task looks at together.
HEAVY, LESSONS = 4, 1 << 13
#: n-grams that a task which learns shuffles together.
CHUNK = 1 << 20
#: Distinct n-grams that a task holds (about) before it passes them on, in how many parts, and those that a task which adds them up holds.
HELD, PARTS, MOST = 1 << 21, 1 << 10, 1 << 21
BATCH_ROWS = 1 << 17
COMMON = 1 << 17
PRIOR = 0.1
END = 0xFF
GAP = 8
STEPS = 32
CACHE = 22
END_TOKEN = mixed(0xE0F)


def keys(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The longest context and the byte, as one number, at every place that is coded; and each text's first and one-past-last place."""
    a = block.bytes.copy()
    a[block.end] = END
    x = a.astype(U)
    for j in (1, 2, 4):
        x[j:] |= x[:-j] << U(8 * j)
    x &= U((1 << (8 * ORDERS[-1] + 8)) - 1)
    room = np.zeros(len(a) + 1, np.int32)
    np.add.at(room, block.begin, 1)
    np.add.at(room, block.end + 1, -1)
    edge = np.concatenate([[0], np.cumsum(block.size + 1)])
    return x[np.cumsum(room[:-1]) > 0], edge[:-1], edge[1:]


def slot(context_: np.ndarray, byte: np.ndarray, bit: int, i: int, bits: int) -> np.ndarray:
    """Where predictor i counts this bit (0 the highest) of a byte after a context, in its own table."""
    node = (U(1) << U(bit)) | (byte >> U(8 - bit))
    return (mix(context_ * U(BASE) + (node << U(4)) + U(i + 1)) >> U(64 - bits)).astype(np.int64)


def bit_of(key: np.ndarray, bit: int) -> np.ndarray:
    return ((key >> U(7 - bit)) & U(1)).astype(bool)


class Tables:
    """Sizes of the predictors' tables, and where each begins among all slots."""

    def __init__(self, bits: tuple[int, ...] = BITS):
        self.bits = bits
        self.begin = np.concatenate([[0], np.cumsum([1 << b for b in bits])]).astype(np.int64)
        self.size = int(self.begin[-1])

    def slots(self, key: np.ndarray, bit: int) -> list[np.ndarray]:
        byte, before = key & U(0xFF), key >> U(8)
        return [slot(before & U((1 << (8 * o)) - 1), byte, bit, i, self.bits[i]) + self.begin[i] for i, o in enumerate(ORDERS)]

    def spread(self, key: np.ndarray, n: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> None:
        """Add counted keys to the tables."""
        byte = key & U(0xFF)
        for i, o in enumerate(ORDERS):
            before = (key >> U(8)) & U((1 << (8 * o)) - 1)
            lo, hi = self.begin[i], self.begin[i + 1]
            for bit in range(8):
                s, one = slot(before, byte, bit, i, self.bits[i]), bit_of(byte, bit)
                for counts, part in ((zeros, ~one), (ones, one)):
                    counts[lo:hi] += np.bincount(s[part], n[part], hi - lo).astype(np.int64)


LEVELS = np.array([1, 2, 3, 5, 9, 17, 65])


def seen(n: np.ndarray) -> np.ndarray:
    """How much a context has been seen, in eight steps."""
    return np.searchsorted(LEVELS, n, "right").astype(np.uint8)


def logit(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    return (np.log(ones + PRIOR) - np.log(zeros + PRIOR)).astype(np.float32)


#: seen() and the logarithm of logit() of small counts.
SEEN = seen(np.arange(LEVELS[-1] + 1))
LOGS = np.log(np.arange(1 << 16) + PRIOR).astype(np.float32)


def logs(n: np.ndarray) -> np.ndarray:
    out = LOGS[np.minimum(n, len(LOGS) - 1)]
    if (many := n >= len(LOGS)).any():
        out[many] = np.log(n[many] + PRIOR)
    return out


KIND = np.zeros(256, np.int64)
KIND[0x61:0x7B], KIND[0x30:0x3A], KIND[0x80:], KIND[[0x20, 0x0A]] = 1, 2, 3, 4


class Mixer:
    """The mixer's weights, and the refining map; and the places of texts that it learned from."""

    places = 0

    def __init__(self):
        self.by_seen = np.full((64, PREDICTORS), 0.3, np.float32)
        self.by_bit = np.zeros((40, PREDICTORS), np.float32)
        self.by_level = np.zeros((PREDICTORS, 8), np.float32)
        self.map = np.tile(np.linspace(-12, 12, STEPS + 1, dtype=np.float32), (64, 1))

    def parts(self) -> list[np.ndarray]:
        return [self.by_seen, self.by_bit, self.by_level, self.map]

    def packed(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def unpack(self, flat: np.ndarray) -> None:
        at = 0
        for p in self.parts():
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size

    @staticmethod
    def gates(confidence: list[np.ndarray], key: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray]:
        a, b, c = (x.astype(np.int64) >> 1 for x in confidence[-3:])
        return c * 16 + b * 4 + a, KIND[(key >> U(8)).astype(np.int64) & 255] * 8 + bit

    def mixed(self, x: np.ndarray, g: np.ndarray, b: np.ndarray, v: np.ndarray) -> np.ndarray:
        return np.clip(((self.by_seen[g] + self.by_bit[b] + self.by_level[np.arange(PREDICTORS), v]) * x).sum(1), -11.9, 11.9)

    def refined(self, z: np.ndarray, g: np.ndarray):
        """The map's logit, halfway to the mixer's, and where in the map it stands."""
        at = (z + 12) * (STEPS / 24)
        i = at.astype(np.int64)
        f = (at - i).astype(np.float32)
        return (z + (1 - f) * self.map[g, i] + f * self.map[g, i + 1]) / 2, i, f

    def learn(self, x: np.ndarray, g: np.ndarray, b: np.ndarray, v: np.ndarray, y: np.ndarray, w: np.ndarray, rate: float) -> None:
        """One online step over a few decisions: x logits, g, b and v (levels) gates, y the bits, w how much each counts."""

        def add(to: np.ndarray, at: np.ndarray, what: np.ndarray) -> None:
            to += np.bincount(at.ravel(), what.ravel(), to.size).astype(np.float32).reshape(to.shape)

        z = self.mixed(x, g, b, v)
        step, each = (rate * w * (y - 1 / (1 + np.exp(-z))))[:, None] * x, np.arange(PREDICTORS)
        add(self.by_seen, g[:, None] * PREDICTORS + each, step)
        add(self.by_bit, b[:, None] * PREDICTORS + each, 0.2 * step)
        add(self.by_level, each * 8 + v, 0.05 * step)
        r, i, f = self.refined(z, g)
        e, at = rate * 4 * w * (y - 1 / (1 + np.exp(-r))), g * (STEPS + 1) + i
        add(self.map, np.concatenate([at, at + 1]), np.concatenate([e * (1 - f), e * f]))


SCALE = 1024


class Model:
    """Every slot's logit (in SCALEths, in the low 16 bits) and confidence, and the mixer."""

    def __init__(self, tables: Tables, slots: np.ndarray, mixer: Mixer):
        self.tables, self.slots, self.mixer, self.token = tables, slots, mixer, uuid.uuid4().hex

    @staticmethod
    def packed(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
        x = np.clip(np.rint(logit(ones.astype(np.float32), zeros.astype(np.float32)) * SCALE), -32768, 32767).astype(np.int32)
        return (x + 32768) | seen(ones.astype(np.int64) + zeros).astype(np.int32) << 16

    def cost(self, key: np.ndarray) -> np.ndarray:
        """log10 of the probability of each key's byte after its context."""
        total, m = np.zeros(len(key)), self.mixer
        by_seen, by_bit = np.ascontiguousarray(m.by_seen.T), np.ascontiguousarray(m.by_bit.T)
        for bit in range(8):
            held = [self.slots[s] for s in self.tables.slots(key, bit)]
            c = [(h >> 16).astype(np.uint8) for h in held]
            g, b = Mixer.gates(c, key, bit)
            z = np.zeros(len(key), np.float32)
            for i, h in enumerate(held):
                x = ((h & 0xFFFF) - 32768).astype(np.float32) * np.float32(1 / SCALE)
                z += (by_seen[i][g] + by_bit[i][b] + m.by_level[i][c[i]]) * x
            z, _, _ = m.refined(np.clip(z, -11.9, 11.9), g)
            total -= np.logaddexp(0, np.where(bit_of(key, bit), -z, z))
        return total / np.log(10)


def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of some (keys, counts), sorted, and the sums of their counts. Empties the list."""
    k, n = (np.concatenate(x) for x in zip(*held, strict=True))
    held.clear()
    # the keys come in sorted runs, which a stable sort merges
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(len(k), 1), bool), k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(n, first) if len(first) else n


def narrow(n: np.ndarray) -> np.ndarray:
    """Counts in the fewest bytes that hold them all."""
    return n.astype(np.min_scalar_type(int(n.max())))


def grouped(texts: DataFrame, take, name: str) -> DataFrame:
    """(key, n) of what take(block) gives, counted in each task and then over all, stored.

    Keys travel by the thousand, as bytes, in PARTS parts by hash. A task that gets more than MOST distinct ones passes
    them on before it has seen all, and then they are grouped once more."""

    def run(batches):
        def out():
            k, n = held[0]
            part = (mix(k) >> U(64 - PARTS.bit_length() + 1)).astype(np.uint16)
            order = np.argsort(part, kind="stable")
            k, n, end = k[order], n[order], np.cumsum(np.bincount(part, minlength=PARTS))
            rows = [(i, k[a:b].tobytes(), narrow(n[a:b]).tobytes()) for i, (a, b) in enumerate(zip(np.append(0, end[:-1]), end, strict=True)) if a < b]
            i, k, n = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(k, pa.binary()), pa.array(n, pa.binary())], ["part", "keys", "counts"])

        held, size = [], 0
        for b in batches:
            for block in blocks(b.column(0).to_pylist(), GAP):
                held.append(np.unique(take(block), return_counts=True))
                size += len(held[-1][0])
                if size >= HELD + HELD // 2:
                    held = [summed(held)]
                    size = len(held[0][0])
                    if size >= HELD:
                        yield out()
                        held, size = [], 0
        if size:
            held = [summed(held)]
            yield out()

    def total(batches):
        def out():
            k, n = held[0]
            # in no order, since what learns from them does so one after another
            order = np.random.default_rng(0).permutation(len(k))
            for i in (order[at : at + BATCH_ROWS] for at in range(0, len(k), BATCH_ROWS)):
                yield pa.RecordBatch.from_arrays([pa.array(k[i].view(np.int64)), pa.array(n[i]), pa.array(np.full(len(i), whole))], ["key", "n", "whole"])

        held, size, whole = [], 0, True
        for b in batches:
            for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                k = np.frombuffer(k, U)
                held.append((k, np.frombuffer(n, f"u{len(n) // len(k)}").astype(np.int64)))
                size += len(held[-1][0])
                if size >= 2 * MOST:
                    held = [summed(held)]
                    size = len(held[0][0])
                    if size >= MOST:
                        whole = False
                        yield from out()
                        held, size = [], 0
        if size:
            held = [summed(held)]
            yield from out()

    find_code(texts.sparkSession)
    parts = texts.mapInArrow(run, "part int, keys binary, counts binary").repartition("part").select("keys", "counts")
    rows = stored(parts.mapInArrow(total, "key long, n long, whole boolean"), name)
    if rows.filter(~F.col("whole")).isEmpty():
        return rows
    again = stored(rows.groupBy("key").agg(F.sum("n").alias("n")), name)
    discard(rows)
    return again


def counted(texts: DataFrame) -> tuple[Tables, np.ndarray, np.ndarray]:
    """Tables of a fitting size, and zeros and ones of every slot, over all texts.

    As many tasks as there are SHAREs of distinct n-grams spread them, each over tables of its own; parts of these are summed up."""
    held = n_grams(texts)
    out = spread_out(held)
    discard(held)
    return out


def n_grams(texts: DataFrame) -> DataFrame:
    """key and n of every distinct n-gram of all texts."""
    return grouped(texts, lambda block: keys(block)[0], "n-grams")


def spread_out(held: DataFrame) -> tuple[Tables, np.ndarray, np.ndarray]:
    """counted() of the texts that have these n-grams."""
    n = held.count()
    # an n-gram touches eight slots at most
    tables = Tables(tuple(min(b, max(12, (8 * n).bit_length())) for b in BITS))

    def run(batches):
        zeros, ones = np.zeros(tables.size, np.int64), np.zeros(tables.size, np.int64)
        some, size = [], 0
        for b in batches:
            some.append((b.column(0).to_numpy().view(U), b.column(1).to_numpy()))
            size += b.num_rows
            if size >= 1 << 20:
                tables.spread(*map(np.concatenate, zip(*some, strict=True)), zeros, ones)
                some, size = [], 0
        if some:
            tables.spread(*map(np.concatenate, zip(*some, strict=True)), zeros, ones)
        for at in range(0, tables.size, PART):
            z, o = zeros[at : at + PART], ones[at : at + PART]
            if z.any() or o.any():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([z.tobytes()]), pa.array([o.tobytes()])], ["part", "zeros", "ones"])

    def total(t: pa.Table) -> pa.Table:
        z, o = (sum(np.frombuffer(x, np.int64) for x in t.column(c).to_pylist()) for c in ("zeros", "ones"))
        least = np.iinfo(np.uint32).max
        return pa.table({"part": t.column("part")[:1], "zeros": [np.minimum(z, least).astype(np.uint32).tobytes()], "ones": [np.minimum(o, least).astype(np.uint32).tobytes()]})

    kind = "part int, zeros binary, ones binary"
    tasks = max(1, -(-n // SHARE))
    parts = stored(held.select("key", "n").coalesce(tasks).mapInArrow(run, kind).groupBy("part").applyInArrow(total, kind), "count-tables")
    zeros, ones = np.zeros(tables.size, np.uint32), np.zeros(tables.size, np.uint32)
    for name, out in (("zeros", zeros), ("ones", ones)):
        for p in parts.select("part", name).collect():
            got = np.frombuffer(p[name], np.uint32)
            out[p.part : p.part + len(got)] = got
    discard(parts)
    return tables, zeros, ones


def decisions(tables: Tables, zeros: np.ndarray, ones: np.ndarray, key: np.ndarray):
    """Logits, gates and levels, and the bits, of all eight decisions of each key, each without its own count."""
    out = []
    for bit in range(8):
        s, one = np.stack(tables.slots(key, bit), 1), bit_of(key, bit)
        o, z = ones[s].astype(np.int64), zeros[s].astype(np.int64)
        o[one] -= 1
        z[~one] -= 1
        np.maximum(o, 0, out=o)
        np.maximum(z, 0, out=z)
        c = SEEN[np.minimum(o + z, len(SEEN) - 1)]
        g, b = Mixer.gates(list(c.T), key, bit)
        out.append((logs(o) - logs(z), g, b, c, one.astype(np.float32)))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def learned(held: DataFrame, tables: Tables, zeros: np.ndarray, ones: np.ndarray) -> Mixer:
    """The mixer that tasks learn online from their n-grams (key, n), averaged by how many places each saw."""
    usual = held.agg(F.avg("n")).first()[0]
    counts = held.sparkSession.sparkContext.broadcast((zeros, ones))

    def lessons(batches):
        """Keys and their weights, shuffled among CHUNK; and how many places they stand for."""

        def out():
            key, n = (np.concatenate(x) for x in zip(*some, strict=True))
            parts = -(-n // max(1, int(HEAVY * usual)))
            order = rng.permutation(int(parts.sum()))
            return np.repeat(key, parts)[order], np.repeat(n / parts / usual, parts).astype(np.float32)[order], int(n.sum())

        rng, some, size = np.random.default_rng(0), [], 0
        for b in batches:
            some.append((b.column(0).to_numpy().view(U), b.column(1).to_numpy()))
            size += b.num_rows
            if size >= CHUNK:
                yield out()
                some, size = [], 0
        if size:
            yield out()

    def run(batches):
        z, o = counts.value
        mixer, n, places = Mixer(), 0, 0
        rng = np.random.default_rng(0)
        for key, weight, more in lessons(batches):
            places += more
            for at in range(0, len(key), LESSONS):
                x, g, e, v, y = decisions(tables, z, o, key[at : at + LESSONS])
                w, order, k = np.tile(weight[at : at + LESSONS], 8), rng.permutation(len(y)), 0
                x, g, e, v, y, w = (a[order] for a in (x, g, e, v, y, w))
                while k < len(y):
                    slower = (1 + n / SLOWER) ** 0.5
                    i = slice(k, k + int(BATCH * slower))
                    mixer.learn(x[i], g[i], e[i], v[i], y[i], w[i], RATE / slower)
                    n += len(y[i])
                    k = i.stop
        yield pa.RecordBatch.from_arrays([pa.array([places], pa.int64()), pa.array([mixer.packed().astype(np.float32).tobytes()])], ["n", "weights"])

    def total(t: pa.Table) -> pa.Table:
        n = np.array(t.column("n").to_pylist(), np.float64)
        w = sum(k * np.frombuffer(x, np.float32).astype(np.float64) for k, x in zip(n, t.column("weights").to_pylist(), strict=True))
        return pa.table({"k": t.column("k")[:1], "n": pa.array([int(n.sum())], pa.int64()), "weights": [(w / max(n.sum(), 1)).astype(np.float32).tobytes()]})

    find_code(held.sparkSession)
    each = held.select("key", "n").mapInArrow(run, "n long, weights binary").filter("n > 0")
    # a few kilobytes a task: first some hundred groups, then one
    groups = each.withColumn("k", F.pmod(F.xxhash64("weights"), F.lit(256)).cast("int")).groupBy("k").applyInArrow(total, "k int, n long, weights binary")
    parts = groups.collect()
    counts.destroy()
    mixer = Mixer()
    if parts:
        mixer.places = n = sum(p.n for p in parts)
        mixer.unpack(sum(p.n / n * np.frombuffer(p.weights, np.float32).astype(np.float64) for p in parts))
    return mixer


def fit(train: DataFrame, id_col: str = "doc_id", text: str = "text") -> Model:
    texts = train.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    held = n_grams(texts)
    tables, zeros, ones = spread_out(held)
    mixer = learned(held, tables, zeros, ones)
    discard(held)
    slots = np.empty(tables.size, np.int32)
    for at in range(0, tables.size, PART):  # the driver holds the tables, and little besides
        slots[at : at + PART] = Model.packed(zeros[at : at + PART], ones[at : at + PART])
    return Model(tables, slots, mixer)


def tokens(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes, and the first word of each text."""
    starts, ends, first = block.words(NOT_SPACE)
    return span(block.sums(), starts, ends), first


def with_end(block: Block) -> np.ndarray:
    return np.concatenate([tokens(block)[0], np.full(block.n, END_TOKEN, U)])


class Common:
    def __init__(self, rows: list):
        token = np.array([r.key for r in rows], np.int64).view(U)
        at = np.argsort(token)
        self.token, self.log = token[at], np.log10(1.0 + np.array([r.n for r in rows], np.float64)[at])

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of count + 1 (0 for others), and whether the word is common."""
        if not len(self.token):
            return np.zeros(len(h)), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.token, h), len(self.token) - 1)
        got = self.token[at] == h
        return np.where(got, self.log[at], 0.0), got


def most_common(counts: DataFrame, room: int) -> tuple[DataFrame, DataFrame]:
    """The words of the highest counts, at most room of them, and the others."""
    scale, least = F.floor(F.log2("n") * 16), 1 << 62
    for r in sorted(counts.groupBy(scale.alias("k")).count().collect(), reverse=True):
        if r["count"] > room:
            break
        room, least = room - r["count"], r.k
    return counts.filter(scale >= least), counts.filter(scale < least)


SCORES = "score double, bits_per_byte double"


#: What this process has worked out, of the last model that it used: its tasks share it.
_worked_out: dict = {}


def scorer(spark: SparkSession, model: Model):
    """A function that scores the texts of a block."""
    ready, token = sent(spark, model), model.token

    def run(block: Block) -> dict:
        from folioscope.llm import language_model

        held = language_model._worked_out
        if held.get("token") != token:
            held.update(token=token, key=np.full((2, 1 << CACHE), U(2**64 - 1)), cost=np.zeros((2, 1 << CACHE), np.float32))
        (key1, key2), (cost1, cost2) = held["key"], held["cost"]
        key, lo, hi = keys(block)
        at = (mix(key) >> U(64 - CACHE)).astype(np.int64)
        cost, miss = cost1[at].astype(np.float64), np.flatnonzero(key1[at] != key)
        to = at[miss]
        there = key2[to] == key[miss]
        cost[miss[there]] = cost2[to[there]]
        miss = miss[~there]
        if len(miss):
            new, back = np.unique(key[miss], return_inverse=True)
            got = np.concatenate([ready.value.cost(new[i : i + (1 << 14)]) for i in range(0, len(new), 1 << 14)]).astype(np.float32)
            to = (mix(new) >> U(64 - CACHE)).astype(np.int64)
            # what stood first goes to the second place; of several new keys for one place the last wins in all arrays, and of the others the last goes there
            key2[to], cost2[to] = key1[to], cost1[to]
            key1[to], cost1[to] = new, got
            late = key1[to] != new
            key2[to[late]], cost2[to[late]] = new[late], got[late]
            cost[miss] = got[back]
        total = np.add.reduceat(cost, lo)
        return {"score": total, "bits_per_byte": -total / np.log10(2) / (hi - lo)}

    return run


def score(df: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """keep, score (log10 probability), bits_per_byte."""
    return scanned(df, text, keep, scorer(df.sparkSession, model), SCORES, GAP)


def unigram(df: DataFrame, train: DataFrame, keep: list[str], text: str = "text", model: Model | None = None) -> DataFrame:
    """keep, n_tokens, n_known, train_tokens, base_score: the add-one unigram model of the training words.

    With a model also score and bits_per_byte, from the same scan."""
    spark = df.sparkSession
    counts = grouped(train.select(F.coalesce(F.col(text), F.lit("")).alias("text")), with_end, "word-counts").select("key", "n")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    common, others = most_common(counts, COMMON)
    known = sent(spark, Common(common.collect()))
    also = scorer(spark, model) if model else lambda block: {}

    def run(block: Block) -> dict:
        h, first = tokens(block)
        log, got = known.value.find(h)
        end, has = known.value.find(np.array([END_TOKEN], U))
        c, k = np.concatenate([[0.0], np.cumsum(log)]), np.concatenate([[0], np.cumsum(got)])
        rare = [h[a:b][~got[a:b]] for a, b in zip(first[:-1], first[1:], strict=True)]
        if not has[0]:
            rare = [np.append(r, U(END_TOKEN)) for r in rare]
        return {"n_tokens": np.diff(first) + 1, "known": np.diff(k[first]) + int(has[0]), "logs": np.diff(c[first]) + end[0], "rare": [r.view(np.int64) for r in rare]} | also(block)

    rows = scanned(df, text, keep, run, "n_tokens long, known long, logs double, rare array<long>" + (f", {SCORES}" if model else ""), GAP)
    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "word-scores")
    found = rows.select("_row", F.explode("rare").alias("key")).join(others, "key")
    found = found.groupBy("_row").agg(F.sum(F.log10(F.col("n") + 1.0)).alias("more_logs"), F.count("*").alias("more"))
    out = rows.drop("rare").join(found, "_row", "left").fillna(0, ["more_logs", "more"])
    base = F.col("logs") + F.col("more_logs") - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))
    return out.select(*keep, "n_tokens", (F.col("known") + F.col("more")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), *(["score", "bits_per_byte"] if model else []))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(fold_of(F.col(id_col), 7) == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    train = docs.filter(~held_out())
    model = fit(train)
    both = unigram(docs, train, ["doc_id"], model=model)
    return both.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
