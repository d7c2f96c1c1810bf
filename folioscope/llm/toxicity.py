"""Toxic passages as maximum-scoring segments of token log-odds.

Tokens are the overlapping GRAM-byte strings of a text after lower-casing A-Z (hashed into BUCKETS), so a toxic word
is found in whatever form it stands. A token's weight is the log-odds, by the texts that have it, between toxic and clean labelled texts under a
Dirichlet prior in proportion to all labelled texts, drawn to zero by DOUBT standard errors, less a step that makes
clean text lose. One linear scan (Ruzzo and Tompa) then finds all maximal scoring segments: the best one, the best ones
of what lies before and after it, and so on. These are the passages. Scores of best passages in clean texts follow an extreme-value (Gumbel) law in the logarithm of
the text's length; a passage's surprise is -log of its probability under that law, passages beyond SIGNIFICANT are
kept, and a logistic curve over the best and the sum of the significant ones gives the document's score.

Weights, the law and the curve are learned from a bounded sample, LABELLED labelled rows in the order of a hash of
their id. Every text is scored whole. Null and empty texts have no passage and get the score of that. Rows are scored each by
its own text, repeated rows alike and whatever their ids; columns of any name pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.bytescan import Block, blocks, mix, scanned
from folioscope.llm.common import documents, find_code, fold_of, sent, table

GRAM, BITS = 5, 18
BUCKETS = 1 << BITS
LABELLED = 12_000
DOUBT, STEP, SIGNIFICANT = 2.0, 1.5, 3.0
#: The Dirichlet prior of a token: so much, and so much for each labelled text that has it.
HALF, PRIOR = 0.5, 0.001
FAR = 1e5


def grams(block: Block) -> np.ndarray:
    """The bucket of the token that starts at each byte of the block."""
    a = block.bytes.astype(np.uint64)
    n = len(a) - GRAM + 1
    x = a[:n].copy()
    for j in range(1, GRAM):
        x <<= np.uint64(8)
        x |= a[j : n + j]
    return (mix(x) >> np.uint64(64 - BITS)).astype(np.int64)


def inner(block: Block, pad: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last token of each text; the space before and after a text belongs to its tokens."""
    return block.begin - pad, np.maximum(block.end + pad - GRAM + 1, block.begin - pad)


def maximal(start: list[int], stop: list[int], low: list[float], high: list[float]) -> list[tuple[int, int, float]]:
    """All maximal segments: start, stop and score. Given are the runs of positive weights, in order, and the running sum before and after each."""
    out: list[tuple[int, int, float, float]] = []
    open_: list[int] = []  # those of out that may still grow to the right; their low sums ascend
    for s, e, l, r in zip(start, stop, low, high, strict=True):
        while open_ and out[open_[-1]][2] >= l:
            open_.pop()
        while open_ and out[open_[-1]][3] < r:
            i = open_.pop()
            s, l = out[i][0], out[i][2]
            del out[i:]
        open_.append(len(out))
        out.append((s, e, l, r))
    return [(s, e, r - l) for s, e, l, r in out]


class Model:
    def __init__(self, weights: np.ndarray, law: tuple[float, float] = (0.0, 1.0), curve: tuple[float, ...] = (0.0, 0.0, 0.0)):
        self.weights, self.law, self.curve = weights, law, curve

    def passages(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Every maximal segment: its first and one-past-last token, score, and the text it lies in."""
        g = grams(block)
        lo, hi = inner(block)
        w = np.full(len(g) + 1, 0.0)
        w[: len(g)] = self.weights[g]
        outside = np.zeros(len(w) + 1, np.int32)
        np.add.at(outside, lo, 1)
        np.add.at(outside, hi, -1)
        w[np.cumsum(outside[:-1]) == 0] = -FAR
        c = np.concatenate([[0.0], np.cumsum(w)])
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (w > 0).astype(np.int8), [0]])))
        begin, end = edge[::2], edge[1::2]
        found = maximal(begin.tolist(), end.tolist(), c[begin].tolist(), c[end].tolist())
        start, stop = (np.array([f[k] for f in found], np.int64) for k in (0, 1))
        return start, stop, np.array([f[2] for f in found], np.float64), np.searchsorted(lo, start, "right") - 1

    def surprise(self, peak: np.ndarray, length: np.ndarray) -> np.ndarray:
        """-log of the probability that clean text of this length has a passage as good."""
        scale, log_k = self.law
        z = scale * peak - log_k - np.log(np.maximum(length, 1))
        return np.where(z > 30, z, -np.log(np.maximum(-np.expm1(-np.exp(-np.clip(z, -30, 30))), 1e-300)))

    def features(self, block: Block):
        start, stop, peak, of = self.passages(block)
        s = self.surprise(peak, block.size[of]) if len(peak) else peak
        best, total = np.zeros(block.n), np.zeros(block.n)
        np.maximum.at(best, of, s)
        np.add.at(total, of, np.where(s >= SIGNIFICANT, s, 0.0))
        return best, total, (start, stop, peak, of, s)

    def score(self, best: np.ndarray, total: np.ndarray) -> np.ndarray:
        a, b, c = self.curve
        return 1 / (1 + np.exp(-np.clip(a + b * np.log1p(best) + c * np.log1p(total), -40, 40)))


def weigh(toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Log-odds under an informative Dirichlet prior, less DOUBT standard errors and the step."""
    n1, n0 = toxic.sum(), clean.sum()
    if not n1 or not n0:
        return np.full(len(toxic), -STEP, np.float32)
    prior = HALF + PRIOR * (toxic + clean)
    a0 = prior.sum()
    y1, y0 = toxic + prior, clean + prior
    odds = np.log(y1 / (n1 + a0 - y1)) - np.log(y0 / (n0 + a0 - y0))
    error = np.sqrt(1 / y1 + 1 / y0)
    return (np.sign(odds) * np.maximum(np.abs(odds) - DOUBT * error, 0) - STEP).astype(np.float32)


def fit_law(best: np.ndarray, length: np.ndarray) -> tuple[float, float]:
    """Gumbel scale and log K by moments of best passage scores in clean texts, after taking off log length."""
    if len(best) < 20 or best.std() < 1e-9:
        return 1.0, 0.0
    scale = 1.0
    for _ in range(20):  # best = (log n + log K + Gumbel noise) / scale
        scale = np.pi / np.sqrt(6) / max((best - np.log(length) / scale).std(), 1e-6)
    return float(scale), float((scale * best - np.log(length)).mean() - 0.5772)


def fit_curve(best: np.ndarray, total: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    x = np.stack([np.ones(len(y)), np.log1p(best), np.log1p(total)], 1)
    b = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        b += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 0.1 * np.eye(3), x.T @ (y - p) - 0.1 * b)
    return tuple(map(float, b))


def fit(df: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", most: int = LABELLED) -> Model:
    """The model of the first `most` labelled rows in the order of a hash of their id. A label above 0 is toxic, any other clean; of several of one id the highest counts."""
    spark = df.sparkSession
    rows = labelled.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.max(label) > 0).cast("int").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(most)
    pairs = [(r._id, r._y) for r in rows.collect()]
    sample = df.join(F.broadcast(spark.createDataFrame(pairs, f"_id {df.schema[id_col].dataType.simpleString()}, _y int")), F.col(id_col) == F.col("_id")) if pairs else df.limit(0).withColumn("_y", F.lit(0))
    sample = sample.select("_y", F.col(text).alias("_text"))

    def count(batches):
        for b in batches:
            n = np.zeros((2, BUCKETS), np.int64)
            y = np.array(b.column(0).to_pylist())
            for block in blocks(b.column(1).to_pylist(), GRAM + 3):
                g, (lo, hi) = grams(block), inner(block)
                for s, e, k in zip(lo, hi, y[block.lo : block.lo + block.n], strict=True):
                    n[k, np.unique(g[s:e])] += 1
            k, at = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(at, pa.int32()), pa.array(n[k, at], pa.int64())], ["k", "at", "n"])

    find_code(spark)
    table_ = sample.mapInArrow(count, "k int, at int, n long").groupBy("k", "at").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((2, BUCKETS))
    counts[table_["k"], table_["at"]] = table_["n"]
    model = Model(weigh(counts[1], counts[0]))
    raw = sent(spark, model)

    def best_of(block: Block) -> dict:
        _, _, peak, of = raw.value.passages(block)
        best = np.zeros(block.n)
        np.maximum.at(best, of, peak)
        return {"best": best, "size": block.size}

    held = scanned(sample, "_text", ["_y"], best_of, "best double, size long", GRAM + 3).toPandas()
    clean = held[(held["_y"] == 0) & (held["size"] > 0)]
    model.law = fit_law(clean["best"].to_numpy(), clean["size"].to_numpy())
    ready = sent(spark, model)

    def marks(block: Block) -> dict:
        best, total, _ = ready.value.features(block)
        return {"best": best, "total": total}

    held = scanned(sample, "_text", ["_y"], marks, "best double, total double", GRAM + 3).toPandas()
    if len(held):
        model.curve = fit_curve(held["best"].to_numpy(), held["total"].to_numpy(), held["_y"].to_numpy())
    return model


def score(df: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """keep, score, and passages: start, length (bytes) and surprise of every significant one."""
    ready = sent(df.sparkSession, model)

    def run(block: Block) -> dict:
        best, total, (start, stop, peak, of, s) = ready.value.features(block)
        out = [[] for _ in range(block.n)]
        for i in np.flatnonzero(s >= SIGNIFICANT):
            d = of[i]
            at = max(int(start[i] - block.begin[d]), 0)
            out[d].append({"start": at, "length": int(min(stop[i] - 1 + GRAM, block.end[d]) - block.begin[d]) - at, "surprise": float(s[i])})
        return {"score": ready.value.score(best, total), "passages": out}

    return scanned(df, text, keep, run, "score double, passages array<struct<start:long,length:long,surprise:double>>", GRAM + 3)


def learners(id_col: str = "doc_id") -> Column:
    """The rows that labels may be learned from."""
    return fold_of(F.col(id_col), 5) != 0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels")
    model = fit(docs, labels.filter(learners()))
    return score(docs, model, ["doc_id"]).select("doc_id", F.coalesce(fold_of(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def drop_toxic(df: DataFrame, model: Model, at: float = 0.5, text: str = "text") -> DataFrame:
    """df without the documents that score `at` or more, whatever its columns are called."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    out = score(plain, model, plain.columns, f"c{df.columns.index(text)}")
    return out.filter(F.col("score") < at).select(*plain.columns).toDF(*df.columns)
