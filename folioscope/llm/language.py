"""Language identification by nearest centroid.

A text's features are its byte bigrams and trigrams after lower-casing, with everything but letters as one space,
hashed into DIMS buckets; their square-rooted counts times inverse document frequency, at unit length, are its vector.
Each language has several centroids, found by spherical k-means on a bounded sample of its training texts (SAMPLE a
language, by a hash of the id); document frequencies are counted over all training texts. The prediction is the
language of the centroid with the greatest cosine. A text farther from it than nearly all that centroid's own
members (RADIUS quantile and MARGIN) is rejected: the general operator can name it `und`.

Null texts and texts without a letter are `und` with score 0. Without any training row every text is `und`. Of equally near
centroids the first counts, by language and then as k-means left them. Rows are judged each by its own text, repeated rows alike.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.bytescan import Block, blocks, scanned, table
from folioscope.llm.common import documents, find_code, fold_of, sent

DIMS = 4096
SAMPLE, CENTROIDS, ROUNDS = 500, 4, 15
RADIUS, MARGIN = 0.995, 1.25
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
LETTERS = table(lambda b: 0x61 <= b <= 0x7A or b >= 0x80)


def normalised(text: str | None) -> str:
    """Lower case; empty if there is no letter."""
    return text.lower() if text and LETTER.search(text) else ""


def counts(block: Block) -> np.ndarray:
    """Bucket counts of each text of the block."""
    a = np.where(LETTERS[block.bytes], block.bytes, np.uint8(32))
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != 32) | (a[:-1] != 32)
    begin = np.concatenate([[0], np.cumsum(keep)])[block.begin]
    a = np.append(a[keep], np.uint8(32)).astype(np.uint32)
    # a text's grams start at the space before it and end with its last byte; what follows a text is a space, whatever text comes next
    third = a[2:].copy()
    third[begin[begin >= 2] - 2] = 32
    two = (a[:-2] * np.uint32(0x9E3779B1) + a[1:-1] * np.uint32(0x85EBCA77)) >> np.uint32(20)
    three = (a[:-2] * np.uint32(0xC2B2AE3D) + a[1:-1] * np.uint32(0x27D4EB2F) + third * np.uint32(0x165667B1)) >> np.uint32(20)
    of = np.searchsorted(begin, np.arange(len(two)) + 1, "right") - 1
    at = np.maximum(of, 0) * DIMS
    n = np.bincount(at + two, minlength=block.n * DIMS) + np.bincount(at + three, minlength=block.n * DIMS)
    n = n.reshape(block.n, DIMS)
    n[block.size == 0] = 0
    return n


class Model:
    def __init__(self, idf: np.ndarray, centroids: np.ndarray, languages: list[str], radius: np.ndarray):
        self.idf, self.centroids, self.languages, self.radius = idf, centroids, languages, radius

    def vectors(self, n: np.ndarray) -> np.ndarray:
        x = np.sqrt(n.astype(np.float32)) * self.idf
        return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)

    def predict(self, n: np.ndarray):
        """Best centroid and cosine of each row of counts."""
        cosine = self.vectors(n) @ self.centroids.T
        best = cosine.argmax(1)
        return best, cosine[np.arange(len(best)), best]


def cluster(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Spherical k-means; every centroid has a member."""
    rng = np.random.default_rng(seed)
    c = x[[rng.integers(len(x))]]
    while len(c) < min(k, len(x)):
        far = np.maximum(1 - (x @ c.T).max(1), 0) ** 2
        if far.sum() < 1e-9:
            break
        c = np.vstack([c, x[rng.choice(len(x), p=far / far.sum())]])
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(1)
        c = np.stack([x[own == i].sum(0) for i in np.unique(own)])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(train: DataFrame, lang: str = "lang", id_col: str = "doc_id", text: str = "text") -> Model:
    """Learn from all rows of train that have a language and a letter."""
    spark = train.sparkSession
    rows = train.select(F.col(id_col).alias("_id"), F.col(lang).alias("_lang"), F.col(text).alias("_text")).filter("_lang is not null and _text is not null")
    chance = {r._lang: min(1.0, SAMPLE / r.n) for r in rows.groupBy("_lang").agg(F.count("*").alias("n")).collect()}

    def frequencies(batches):
        total = np.zeros(DIMS + 1, np.int64)
        for b in batches:
            for block in blocks(map(normalised, b.column(0).to_pylist()), 1, False):
                n = counts(block)
                total[:DIMS] += (n > 0).sum(0)
                total[DIMS] += (block.size > 0).sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(DIMS + 1), pa.int32()), pa.array(total)], ["at", "n"])

    def vectors(batches):
        for b in batches:
            for block in blocks(map(normalised, b.column(1).to_pylist()), 1, False):
                n = counts(block)
                got = [np.flatnonzero(r) for r in n]
                yield pa.RecordBatch.from_arrays([b.slice(block.lo, block.n).column(0), pa.array([g.astype(np.uint16).tobytes() for g in got]), pa.array([r[g].astype(np.uint32).tobytes() for r, g in zip(n, got, strict=True)])], ["lang", "at", "n"])

    find_code(spark)
    df = {r["at"]: r["n"] for r in rows.select("_text").mapInArrow(frequencies, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()}
    share = F.pmod(F.xxhash64("_id", "_text"), F.lit(1 << 30)) / float(1 << 30)
    rate = F.create_map(*[F.lit(x) for p in chance.items() for x in p]) if chance else F.create_map(F.lit(""), F.lit(0.0))
    sample = rows.filter(share < F.try_element_at(rate, F.col("_lang"))).select("_lang", "_text").mapInArrow(vectors, "lang string, at binary, n binary").collect()
    idf = np.log((1 + df.get(DIMS, 0)) / (1 + np.array([df.get(i, 0) for i in range(DIMS)]))).astype(np.float32) + np.float32(0.05)
    model = Model(idf, np.zeros((0, DIMS), np.float32), [], np.zeros(0))
    centroids, languages, radius = [], [], []
    by: dict[str, list] = {}
    for r in sorted(sample, key=lambda r: (r.lang, bytes(r["at"]), bytes(r["n"]))):
        if len(r["at"]):
            row = np.zeros(DIMS, np.uint32)
            row[np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["n"], np.uint32)
            by.setdefault(r.lang, []).append(row)
    for i, (name, n) in enumerate(sorted(by.items())):
        x = model.vectors(np.stack(n))
        c = cluster(x, CENTROIDS, i)
        near, own = (x @ c.T).max(1), (x @ c.T).argmax(1)
        for k in range(len(c)):
            d = 1 - near[own == k] if (own == k).any() else np.zeros(1)
            radius.append(min(1.0, MARGIN * float(np.quantile(d, RADIUS))))
        centroids.append(c)
        languages += [name] * len(c)
    if centroids:
        model = Model(idf, np.concatenate(centroids).astype(np.float32), languages, np.array(radius))
    return model


def identify(df: DataFrame, model: Model, keep: list[str], text: str = "text", reject: bool = True) -> DataFrame:
    """keep, lang_pred, score (cosine with the nearest centroid), rejected. With reject, rejected texts are `und`."""
    ready = sent(df.sparkSession, model)

    def run(block: Block) -> dict:
        m = ready.value
        # lower-casing needs characters, so the block is decoded and built anew
        block = next(iter(blocks([normalised(block.bytes[s:e].tobytes().decode("utf-8", "replace")) for s, e in zip(block.begin, block.end, strict=True)], 1, False, 1 << 62)))
        if not m.languages:
            return {"lang_pred": [UNKNOWN] * block.n, "score": np.zeros(block.n), "rejected": [True] * block.n}
        best, cosine = m.predict(counts(block))
        none = block.size == 0
        out = none | (1 - cosine > m.radius[best])
        names = [UNKNOWN if n or (reject and r) else m.languages[i] for i, n, r in zip(best, none, out, strict=True)]
        return {"lang_pred": names, "score": np.where(none, 0.0, np.clip(cosine, 0, 1)).astype(np.float64), "rejected": out}

    return scanned(df, text, keep, run, "lang_pred string, score double, rejected boolean", 1, False)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(fold_of(F.col(id_col), 3) == 1, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.filter(~held_out()))
    return identify(docs, model, ["doc_id"], reject=False).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
