"""Each corpus operator against a brute-force version, with nulls, empty and long texts, repeated rows, ties and clashing extra columns."""

import collections
import hashlib
import itertools
import math
import os
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import decontaminate, exact_dedup, language, language_model, mixing, near_dup, pii, repeats, sharding, toxicity

FOLD = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SCHEMA = "doc_id long, text string, lang string, size string, score string"


def texts():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeinorst") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, shared = make(120), make(40)
    out = [make(rng.randint(3, 90)) for _ in range(30)]
    out += [base, base.upper(), base, base.replace(" ", "  ", 3)]
    for i in range(6):  # near copies
        w = base.split()
        w[i * 9] = f"new{i}"
        out.append(" ".join(w))
    out += [f"{make(20)} {shared} {make(9)}" for _ in range(5)]
    out += [None, "", " \n", "one two", "One TWO", "...", make(4000), base + " " + shared, "é" * 150, "ab" * 200]
    return out


@pytest.fixture(scope="module")
def rows():
    got = [(i * 7 % 101, t, "xx", "clash", "clash") for i, t in enumerate(texts())]
    return [*got, got[30]]  # a repeated row


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, rows, empty):
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[(t or "").translate(FOLD)].append(i)
    want = sorted((i, max(groups[n]), len(groups[n]), i == max(groups[n]), hashlib.sha256(n.encode()).hexdigest()) for i, t, *_ in rows for n in [(t or "").translate(FOLD)])
    for bits in (64, 2):  # with two bits nearly all chunks collide
        assert sorted(map(tuple, exact_dedup.exact_dedup(docs, bits=bits).collect())) == want
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_chunks_join_to_the_text(docs):
    assert docs.filter("text is not null").filter(F.array_join(exact_dedup.chunks(F.col("text")), "") != F.col("text")).count() == 0


def test_sharding(docs, rows, empty):
    got = sharding.shard(docs, 5, keep=docs.columns).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"bytes"}
    assert all(r.size == len((t := r.text or "").encode()) + 8 and r.text_crc32 == zlib.crc32(t.encode()) for r in got)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    sizes = collections.Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r.size for r in got)
    assert sharding.shard(empty, 5).count() == 0


def test_sharding_splits_a_hot_text(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text again").otherwise(F.concat(F.lit("text number "), F.col("id").cast("string"))).alias("text"))
    got = sharding.shard(df).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    assert len(got) == 24 and all(r.m == r.n - 1 for r in got)
    assert max(r.b for r in got) <= 1.05 * min(r.b for r in got)


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.mark.parametrize("hot", [1, 48])
def test_near_duplicates(docs, rows, empty, hot, monkeypatch):
    monkeypatch.setattr(near_dup, "HOT", hot)
    sets = {i: shingle_set(t) for i, t, *_ in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            k = len(sets[i] & sets[j])
            if i < j and k and 100 * k >= 80 * len(sets[i] | sets[j]) and root(i) != root(j):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    got = near_dup.near_duplicates(docs).collect()
    assert sorted(map(tuple, got)) == sorted((i, len(sets[i]), root(i)) for i, *_ in rows)
    assert len({root(i) for i in sets}) < len(sets) - 8
    assert near_dup.near_duplicates(empty).count() == 0


def test_decontamination(spark, docs, rows, empty):
    all_texts = [t for _, t, *_ in rows if t]
    items = [(1, " ".join(all_texts[3].split()[:12]).upper()), (10, "one, two!"), (2, None), (3, ""), (4, " ".join(all_texts[30].split()[20:60])), (5, "never seen words in any text at all here now")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = []
    for i, t, *_ in rows:
        w, hit, found = word.findall((t or "").translate(FOLD)), set(), set()
        for item, b in items:
            v = word.findall((b or "").translate(FOLD))
            n = min(10, len(v))
            grams = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            for k in range(len(w) - n + 1 if n else 0):
                if tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    found.add(str(item))
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    assert sorted(map(tuple, decontaminate.report(docs, bench).collect())) == sorted(want)
    assert sorted(set(map(tuple, decontaminate.report(docs, bench, most=60).collect()))) == sorted(set(want))  # in blocks
    clean = sorted(i for i, *_, c in want if not c)
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()) == clean
    cut = decontaminate.decontaminate(docs, bench, remove="spans").collect()
    assert len(cut) == len(rows) and sum(len(r.text or "") for r in cut) < sum(len(t or "") for _, t, *_ in rows)
    assert decontaminate.report(empty, bench).count() == 0


def test_repeats(docs, rows, empty):
    seen, want = {}, []
    for i, t, *_ in sorted(set(rows), key=lambda r: r[0]):
        b = (t or "").encode()
        cover = bytearray(len(b))
        for p in range(len(b) - 99):
            if seen.setdefault(b[p : p + 100], (i, p)) != (i, p):
                cover[p : p + 100] = b"\1" * 100
        runs = len(re.findall(b"\1+", bytes(cover)))
        want.append((i, len(b), sum(cover), runs, hashlib.sha256(bytes(x for x, c in zip(b, cover) if not c)).hexdigest()))
    got = repeats.remove_repeats(docs).collect()
    assert sorted(set(map(tuple, got))) == sorted(want) and len(got) == len(rows)
    assert sum(w[2] for w in want) > 500
    assert repeats.remove_repeats(empty).count() == 0


def test_language(spark, empty):
    rng = random.Random(1)
    make = lambda syllables: " ".join("".join(rng.choice(syllables) for _ in range(3)) for _ in range(40))
    some = [(i, make("ka lo mi".split() if i % 2 else "eß ür schn".split()), "aa" if i % 2 else "bb", "", "") for i in range(120)]
    odd = [(1000, None, "aa", "", ""), (1001, "", "aa", "", ""), (1002, "123 !!", "bb", "", ""), (1003, "ka" * 30000, None, "", "")]
    df = spark.createDataFrame(some + odd, SCHEMA)
    model = language.fit(df.filter("doc_id < 80 or doc_id > 999"))
    got = {r.doc_id: r for r in language.identify(df, model, ["doc_id", "score"], reject=False).toDF("doc_id", "clash", "lang_pred", "score", "rejected").collect()}
    assert all(got[i].lang_pred == lang for i, _, lang, *_ in some) and all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    strange = spark.createDataFrame([(1, "zzq xxw qqj vvk " * 9, "", "", "")], SCHEMA)
    assert language.identify(strange, model, ["doc_id"]).first().lang_pred == "und"
    assert language.identify(df, language.fit(empty), ["doc_id"]).filter("lang_pred != 'und'").count() == 0


def test_language_model(docs, rows, empty):
    train, held = docs.filter("doc_id % 3 != 0"), docs
    model = language_model.fit(train)
    scored = language_model.score(held, model, ["doc_id", "text"])
    out = {r.doc_id: r for r in language_model.unigram(scored, train, ["doc_id", "score"]).collect()}
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD)), None] for i, t, *_ in rows}
    counts = collections.Counter(w for i, t, *_ in rows if i % 3 for w in tokens[i])
    n, v = sum(counts.values()), len(counts)
    for i, w in tokens.items():
        assert (out[i].n_tokens, out[i].n_known, out[i].train_tokens) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert math.isclose(out[i].base_score, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), abs_tol=1e-6)
        assert out[i].score < 0
    assert language_model.score(empty, model, ["doc_id"]).count() == 0


def test_language_model_is_a_distribution(docs):
    model = language_model.fit(docs)
    contexts = np.array([int.from_bytes(b"e the ", "big") << 8, int.from_bytes(b"\xff    x", "big") << 8], np.uint64)
    for c in contexts:
        keys = c | np.arange(256, dtype=np.uint64)
        assert math.isclose((10 ** model.cost(keys)).sum(), 1, abs_tol=1e-4)


def hash64(n):
    """bytescan.mix of one number, in plain integers."""
    m = (1 << 64) - 1
    n ^= n >> 31
    n = n * 0xBF58476D1CE4E5B9 & m
    n ^= n >> 29
    n = n * 0x94D049BB133111EB & m
    return n ^ (n >> 32)


def slow_places(text):
    """(six bytes of context, byte) of every place of a text, byte by byte."""
    b = (text or "").translate(FOLD).encode() + b"\xff"
    pad = b" " * 8 + b
    for i in range(len(b)):
        yield pad[i + 2 : i + 8], b[i]


def test_language_model_against_a_slow_one(spark, docs, rows):
    """Counts, decisions and scores worked out place by place, in plain Python."""
    train = [t for _, t, *_ in rows]
    tables, zeros, ones = language_model.counted(docs.select(F.coalesce("text", F.lit("")).alias("text")))
    assert (zeros.astype(int) + ones).sum() == 8 * language_model.PREDICTORS * sum(len((t or "").encode()) + 1 for t in train)
    texts_ = ["", None, "one two three", "é the", train[3][:300], train[30]]
    model = language_model.fit(docs)
    m, want = model.mixer, []
    for t in texts_:
        total = 0.0
        for six, byte in slow_places(t):
            for bit in range(8):
                node = 1 << bit | byte >> 8 - bit
                contexts = [int.from_bytes(six[6 - o :], "big") for o in language_model.ORDERS]
                at = [(hash64((c * language_model.BASE + (node << 4) + i + 1) & (1 << 64) - 1) >> 64 - model.tables.bits[i]) + int(model.tables.begin[i]) for i, c in enumerate(contexts)]
                x, v = [((int(model.slots[a]) & 0xFFFF) - 32768) / language_model.SCALE for a in at], [int(model.slots[a]) >> 16 for a in at]
                assert all(abs(b - (math.log(int(ones[a]) + 0.1) - math.log(int(zeros[a]) + 0.1))) < 1e-3 for a, b in zip(at, x, strict=True))
                g = (v[-1] >> 1) * 16 + (v[-2] >> 1) * 4 + (v[-3] >> 1)
                e = int(language_model.KIND[six[-1]]) * 8 + bit
                z = min(max(sum((m.by_seen[g, i] + m.by_bit[e, i] + m.by_level[i, v[i]]) * x[i] for i in range(len(x))), -11.9), 11.9)
                p = (z + 12) * language_model.STEPS / 24
                r = (z + (1 - (p - int(p))) * m.map[g, int(p)] + (p - int(p)) * m.map[g, int(p) + 1]) / 2
                total -= math.log1p(math.exp(-r if byte >> 7 - bit & 1 else r))
        want.append(total / math.log(10))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts_)], "doc_id long, text string")
    for r in language_model.score(df, model, ["doc_id"]).collect():
        assert math.isclose(r.score, want[r.doc_id], rel_tol=1e-4, abs_tol=1e-4)


def test_toxicity(spark, empty):
    rng = random.Random(5)
    make = lambda: " ".join("".join(rng.choice("abcdeinorst") for _ in range(4)) for _ in range(60))
    some = [(i, make() + (" you zorgling frump " if i % 4 == 0 else " ") + make(), "", "", "") for i in range(300)]
    df = spark.createDataFrame([*some, (900, None, "", "", ""), (901, "", "", "", ""), (902, "ab " * 40000, "", "", "")], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    got = {r._1: r for r in toxicity.score(df, model, ["doc_id"]).toDF("_1", "score", "passages").collect()}
    assert all((got[i].score >= 0.5) == (i % 4 == 0) for i in range(200, 300))
    assert all(0 <= r.score <= 1 for r in got.values()) and not got[900].passages and got[901].score < 0.5
    p = got[204].passages[0]
    assert "zorgling" in some[204][1][p.start - 8 : p.start + p.length + 8]
    assert toxicity.score(empty, toxicity.fit(empty, labels), ["doc_id"]).count() == 0
    assert sorted(r.doc_id for r in toxicity.drop_toxic(df, model).filter("doc_id >= 200").collect()) == sorted(i for i in [*range(200, 300), 900, 901, 902] if i % 4 or i >= 900)


def test_segments_against_a_plain_scan():
    rng = np.random.default_rng(0)
    block = next(iter(toxicity.blocks(["".join(map(chr, rng.integers(97, 100, 80))) for _ in range(9)], toxicity.GRAM + 3)))
    model = toxicity.Model(rng.normal(-0.2, 1, toxicity.BUCKETS))
    _, _, peak, of = model.passages(block)
    best = np.zeros(block.n)
    np.maximum.at(best, of, peak)
    g = toxicity.grams(block)
    for d, (lo, hi) in enumerate(zip(*toxicity.inner(block))):
        s = top = 0.0
        for w in model.weights[g[lo:hi]]:
            s = max(0.0, s + w)
            top = max(top, s)
        assert abs(top - best[d]) < 1e-3  # differences of sums that hold large numbers between texts


def test_personal_data(spark, empty):
    rng = random.Random(2)
    pieces = ["write to ann.b@mail1.example.com now", "from 10.20.30.40 came", "card 4111 1111 1111 1111 was", "call +1 (555) 123-4567 today", "not 999.1.1.1 nor 4111111111111112", "nothing here", 'token = "0a1b2c3d4e5f60718293a4b5c6d7e8f901234567" ends']
    some = [(i, "é " + rng.choice(pieces) + " and so on " + rng.choice(pieces) + f" {i}", "", "", "") for i in range(160)]
    df = spark.createDataFrame([*some, (900, None, "", "", ""), (901, "", "", "", ""), (None, some[0][1], "", "", ""), (3, some[5][1], "", "", "")], SCHEMA)
    network = pii.fit(df)
    out = pii.detect(df, network).collect()
    assert len(out) == 164
    for r in out:
        if r.doc_id is not None and r.doc_id < 160 and r.doc_id != 3 or r.doc_id in (900, 901):
            text = {i: t for i, t, *_ in some}.get(r.doc_id) or ""
            assert [(pii.KINDS.index(s.kind), s.start, s.finish) for s in r.base] == pii.base_spans(text)
        assert all(a.finish <= b.start or b.finish <= a.start for a in r.added for b in r.base)
    found = {r.doc_id: [s.kind for s in r.added] for r in out}
    assert sum("secret" in found[i] for i, t, *_ in some if "token" in t) >= 0.9 * sum("token" in t for _, t, *_ in some)
    # what it adds elsewhere is not in the patterns' reach, and plain text has none of it
    ways = [("to ann.b (at) mail1.example (dot) com now", 0), ("from 10 . 20 . 30 . 40 came", 1), ("card 4111.1111.1111.1111 was", 2), ("call (555) 123-4567 today", 3)]
    told = [f"é {t} and so on nothing here {i}" for i in range(8) for t, _ in ways]
    hits = [k in {x[0] for x in got} for got, (_, k) in zip(pii.decoded(network, told), ways * 8)]
    assert sum(hits) >= 0.5 * len(hits) and not any(pii.base_spans(t) for t in told)
    assert not any(pii.decoded(network, ["é nothing here and so on nothing here 7"] * 3))
    assert pii.detect(empty, pii.fit(empty)).count() == 0
    assert pii.redact("to a@b.c!", [("email", 3, 8)]) == "to <email>!"


def test_patterns_in_linear_time():
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    rng = random.Random(4)
    for _ in range(4000):
        t = "".join(rng.choice("ab12.@-9 .05+é") for _ in range(rng.randint(1, 40)))
        assert [m.span() for m in email.finditer(t)] == list(pii.emails(t))
        assert [m.span() for m in ip.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))] == list(pii.addresses(t))
    began = time.process_time()
    long = "1" * 1_000_000 + ".2.3.4 " + "a" * 1_000_000 + " a@b.c " + "1 " * 500_000 + "+1" + " " * 1_000_000 + "9." * 500_000
    assert [k for k, *_ in pii.base_spans(long)][:2] == [0, 1] and time.process_time() - began < 10


def small_network(seed):
    net, rng = pii.Network(seed), np.random.default_rng(seed)
    net.p["t"] = rng.normal(0, 2, (pii.TAGS, pii.TAGS)).astype(np.float32)
    net.p["ob"][0] = 1.5
    return net


def test_best_path_against_all_paths():
    rng = np.random.default_rng(3)
    for seed in range(3):
        net = small_network(seed)
        t = net.p["t"]
        for n in (1, 2, 4):
            e = rng.normal(0, 2, (n, pii.TAGS)).astype(np.float32)
            worth = lambda p: sum(e[i, k] for i, k in enumerate(p)) + t[0, p[0]] + sum(t[a, b] for a, b in itertools.pairwise(p)) + t[p[-1], 0]
            best = max(itertools.product(range(pii.TAGS), repeat=n), key=worth)
            assert abs(worth(net.path(e).tolist()) - worth(best)) < 1e-4
        # long texts: stretches between sure places come to what one pass over all comes to
        e = rng.normal(0, 1, (400, pii.TAGS)).astype(np.float32)
        e[:, 0] += 14
        e[rng.integers(0, 400, 30), 1:] += 16
        held = np.full((402, 1, pii.TAGS), -1e6, np.float32)
        held[:, :, 0] = 0
        held[1:-1, 0] = e
        assert (net.path(e) == net.viterbi(held)[1:-1, 0]).all() and 0 < net.sure(e).mean() < 1


def test_windows_are_reconciled():
    """Scores of whole texts against windows that are cut, run and weighted one by one."""
    net, rng = small_network(7), np.random.default_rng(5)
    texts_ = [rng.integers(1, pii.INPUTS, n).astype(np.uint8) for n in (0, 1, 255, 256, 257, 600, 1000)]
    got = pii.scores(net, texts_)
    for kinds, have in zip(texts_, got, strict=True):
        want, n, step = np.zeros((len(kinds), pii.TAGS)), len(kinds), pii.WINDOW - pii.OVERLAP
        starts = list(range(0, max(n - pii.OVERLAP, 1), step))
        for lo in starts:
            x = np.zeros((pii.WINDOW, 1), np.uint8)
            part = kinds[lo : lo + pii.WINDOW]
            x[: len(part), 0] = part
            e = net.emissions(x)[: len(part), 0]
            for i in range(len(part)):
                w = 1.0
                if lo > 0 and i < pii.OVERLAP:
                    w *= (i + 1) / (pii.OVERLAP + 1)
                if lo + pii.WINDOW < n and i >= step:
                    w *= (pii.WINDOW - i) / (pii.OVERLAP + 1)
                want[lo + i] += w * e[i]
        assert np.allclose(have, want, atol=1e-4)


def test_network_gradient():
    rng = np.random.default_rng(0)
    net = pii.Network(1)
    x, y = rng.integers(0, pii.INPUTS, (7, 3)), rng.integers(0, pii.TAGS, (7, 3))
    _, grad = net.learn(x, y)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
        i = tuple(rng.integers(0, s) for s in net.p[k].shape)
        for sign in (1,):
            old = net.p[k][i]
            net.p[k][i] = old + 1e-2
            up = net.learn(x, y)[0]
            net.p[k][i] = old - 1e-2
            down = net.learn(x, y)[0]
            net.p[k][i] = old
            assert abs((up - down) / 2e-2 - grad[k][i]) < 2e-2


def test_mixing(spark, empty):
    df = spark.createDataFrame([(i, ("red blue " if i % 4 else "cat dog ") * (5 + i % 7), "", "", "") for i in range(200)] + [(900, None, "", "", ""), (901, "", "", "", "")], SCHEMA)
    labels = spark.createDataFrame([(i, "a" if i % 4 else "b") for i in range(100)] + [(None, "a"), (7, None)], "doc_id long, domain string")
    c = mixing.fit_classifier(df, labels)
    out = mixing.mixed(df, c, {"a": 0.5, "b": 0.5}).collect()
    held = {d: sum(r.t * r.p[k] / mixing.GRID * r.rate for r in out) for k, d in enumerate(c.domains)}
    assert abs(held["a"] - held["b"]) < 0.01 * sum(held.values()) and all(r.rate >= 0 for r in out)
    more = mixing.repeated(df, c, {"a": 0.5, "b": 0.5}, floor=1.0, grow=True)
    assert more.columns == df.columns and more.select("doc_id").distinct().count() == 202
    assert mixing.mixed(empty, c, {"a": 1.0}).count() == 0
    assert mixing.mixed(df, mixing.fit_classifier(df, labels.limit(0)), {"all": 1.0}).count() == 202


def test_mixing_targets_ask_for_work(spark):
    """The registered targets are not the corpus's own mix: the query drops and repeats, and the totals come to the targets."""
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    c = mixing.fit_classifier(docs, mixing.qualities(spark.read.parquet(f"{sf}/labels.parquet")))
    for floor, grow in ((0.0, False), (1.0, True)):
        out = mixing.mixed(docs, c, mixing.TARGETS, floor, grow).cache()
        for r in mixing.achieved(out, c.domains, mixing.TARGETS, grow):
            assert abs(r["expected"] - r["target"]) < 0.002 * r["target"] and abs(r["kept"] - r["target"]) < 0.1 * r["target"]
            assert r["domain"] == "high" or r["target"] > 1.5 * r["before"]
        assert out.filter("copies = 0").isEmpty() == grow and not out.filter("copies > 1").isEmpty()
        out.unpersist()


def test_mixing_rates_stop_at_zero(spark):
    """A target of nothing drives pure documents to a rate of zero, not below."""
    df = spark.createDataFrame([([1000, 0], 50), ([500, 500], 30), ([0, 1000], 20)], "p array<int>, t int")
    steps = mixing.fit_rates(df, ["a", "b"], {"a": 1.0})
    rates = {tuple(r.p): r.rate for r in df.withColumn("rate", mixing.rate(steps, 0.0)).collect()}
    assert rates[0, 1000] == 0 and rates[500, 500] < rates[1000, 0]


def segments(w, lo, hi):
    """All maximal segments by their definition: the best one (the shortest of equals), then those before and after it."""
    c = np.concatenate([[0.0], np.cumsum(w)])
    best = max(((c[e] - c[s], s - e, -s, e) for s in range(lo, hi) for e in range(s + 1, hi + 1)), default=(0, 0, 0, 0))
    if best[0] <= 0:
        return []
    s, e = -best[2], best[3]
    return [*segments(w, lo, s), (s, e, best[0]), *segments(w, e, hi)]


def test_all_maximal_segments_are_passages():
    rng = np.random.default_rng(1)
    block = next(iter(toxicity.blocks(["".join(map(chr, rng.integers(97, 101, 60))) for _ in range(12)], toxicity.GRAM + 3)))
    g, (lo, hi) = toxicity.grams(block), toxicity.inner(block)
    for shift in (-0.8, -0.2, 0.2):
        model = toxicity.Model(rng.normal(shift, 1, toxicity.BUCKETS))
        start, stop, peak, of = model.passages(block)
        for d in range(block.n):
            want = [(s + lo[d], e + lo[d], x) for s, e, x in segments(model.weights[g[lo[d] : hi[d]]], 0, hi[d] - lo[d])]
            got = [(s, e, x) for s, e, x, o in zip(start, stop, peak, of, strict=True) if o == d]
            assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want], atol=1e-3)


def test_a_weaker_passage_after_a_strong_one_is_found():
    text = "x" * 40 + "y" * 300 + "z" * 20
    block = next(iter(toxicity.blocks([text], toxicity.GRAM + 3)))
    weights = np.full(toxicity.BUCKETS, -1.5)
    for c, x in (("x", 27.0), ("z", 25.0)):
        weights[toxicity.grams(next(iter(toxicity.blocks([c * 5], 0))))] = x
    model = toxicity.Model(weights, (1.0, 0.0))
    _, _, peak, _ = model.passages(block)
    assert np.allclose(peak, [36 * 27, 16 * 25])
    _, total, (*_, s) = model.features(block)
    assert (s >= toxicity.SIGNIFICANT).sum() == 2 and np.allclose(total, s.sum())


def test_repeats_of_texts_that_share_an_id(spark):
    """Null ids and repeated ids name several texts; each loses only its own repeats."""
    rng = random.Random(8)
    make = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    shared = make(180)
    some = [(None, make(400)), (None, make(50) + shared + make(90)), (None, make(300)), (None, make(20)), (None, None), (None, shared + make(5)), (7, make(70) + shared), (7, make(500)), (7, shared[:130] + make(300)), (8, shared), (9, make(260))]
    some += [(None, some[0][1]), (9, some[0][1])]
    df = spark.createDataFrame(some, "doc_id long, text string").repartition(3)
    seen, want = {}, []
    order = df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).distinct().collect()
    for i, t, h in sorted(order, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h)):
        b = (t or "").encode()
        cover = bytearray(len(b))
        for p in range(len(b) - 99):
            if seen.setdefault(b[p : p + 100], (i, h, p)) != (i, h, p):
                cover[p : p + 100] = b"\1" * 100
        want.append((i, len(b), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(bytes(x for x, c in zip(b, cover) if not c)).hexdigest()))
    got = repeats.remove_repeats(df).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(set(map(tuple, got)), key=key) == sorted(want, key=key) and len(got) == len(some)


def test_near_duplicates_of_texts_that_share_an_id(spark):
    """Two texts under one id are judged apart, repeated rows leave one, null ids stay; columns called as inner ones pass through."""
    rng = random.Random(6)
    make = lambda n: " ".join("".join(rng.choice("abcdeino") for _ in range(4)) for _ in range(n))
    a, b, c = make(60), make(60), make(60)
    near = " ".join(["other", *a.split()[1:]])
    some = [(1, a), (1, b), (2, near), (3, b), (4, c), (4, c), (None, c), (None, None), (5, None), (6, ""), (7, make(3))]
    df = spark.createDataFrame([(i, t, "x", k) for k, (i, t) in enumerate(some)], "doc_id long, text string, cls string, _hash int")
    df = df.unionByName(df.filter("doc_id = 4"))  # rows that are alike in all
    got = sorted((r.doc_id, r.component_id) for r in near_dup.near_duplicates(df).collect() if r.doc_id is not None)
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (4, 4), (4, 4), (5, 5), (6, 6), (7, 7)]
    kept = near_dup.keep_first(df)
    assert kept.columns == df.columns and sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted((i or 0, t or "") for i, t in [(1, a), (1, b), (4, c), (None, c), (None, None), (5, None), (6, ""), some[-1]])


def test_mixing_keeps_columns_called_as_its_own(spark):
    """Posteriors and copies worked out in plain Python; input columns of the same names come back as they were."""
    df = spark.createDataFrame([(i, ("red blue " if i % 4 else "cat dog ") * (3 + i % 5), 77.5, i, "t") for i in range(60)], "doc_id long, text string, rate double, copies long, p string")
    labels = spark.createDataFrame([(i, "a" if i % 4 else "b") for i in range(40)], "doc_id long, domain string")
    c = mixing.fit_classifier(df, labels)
    out = mixing.repeated(df, c, {"a": 0.5, "b": 0.5}, floor=1.0, grow=True)
    assert out.columns == df.columns and {(r.rate, r.p) for r in out.collect()} == {(77.5, "t")} and {r.copies for r in out.collect()} == set(range(60))
    buckets = {w: r.b for w in ("red", "blue", "cat", "dog") for r in [spark.range(1).select(mixing.bucket(F.lit(w)).alias("b")).first()]}
    for r in mixing.mixed(df, c, {"a": 0.5, "b": 0.5}).collect():
        words = r.c1.split()
        z = c.prior[1] - c.prior[0] + mixing.CAP / (mixing.CAP + len(words)) * sum(float(f"{c.ratios[1][buckets[w]]:.6g}") for w in words)
        p = 1 / (1 + math.exp(-z)) * mixing.GRID
        assert r.t == len(words) and abs(r.p[1] - p) <= 0.501 and sum(r.p) in (mixing.GRID - 1, mixing.GRID, mixing.GRID + 1) and r.copies in (math.floor(r.rate), math.floor(r.rate) + 1)


def test_unreachable_targets_are_told(spark):
    df = spark.createDataFrame([([1000, 0], 50), ([900, 100], 30)], "p array<int>, t int")
    with pytest.warns(UserWarning, match="out of reach"):
        mixing.fit_rates(df, ["a", "b"], {"b": 1.0})


def test_decontamination_with_null_ids(spark):
    words = [f"w{i}" for i in range(40)]
    some = [(None, " ".join(words[:15])), (None, "clean text of other words"), (None, " ".join(words[:15])), (5, " ".join(words[20:35])), (5, "nothing"), (6, None)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in some], "doc_id long, text string, n_words int, items string")
    bench = spark.createDataFrame([(None, " ".join(words[:12])), (None, " ".join(words[22:33])), (2, " ".join(words[22:33]))], "item_id long, text string")
    for most in (1 << 20, 30):
        got = sorted((r.n_words, r.n_hit, r.n_items) for r in decontaminate.report(df, bench, most=most).collect())
        assert got == sorted([(15, 12, 1), (5, 0, 0), (15, 12, 1), (15, 11, 2), (1, 0, 0), (0, 0, 0)])
        left = decontaminate.decontaminate(df, bench, most=most)
        assert left.columns == df.columns and sorted(r.text or "" for r in left.collect()) == ["", "clean text of other words", "nothing"]


def test_toxicity_labels_beyond_two(spark):
    rng = random.Random(5)
    make = lambda: " ".join("".join(rng.choice("abcdeinorst") for _ in range(4)) for _ in range(40))
    df = spark.createDataFrame([(i, make() + (" zorgling frump " if i % 3 == 0 else " ") + make(), "", "", "") for i in range(150)] + [(None, "zorgling frump", "", "", "")] * 2, SCHEMA)
    labels = spark.createDataFrame([(i, 3 if i % 3 == 0 else -1) for i in range(150)], "doc_id long, toxic int")
    got = toxicity.score(df, toxicity.fit(df, labels), ["doc_id"]).collect()
    assert sum((r[1] >= 0.5) == (r[0] % 3 == 0) for r in got if r[0] is not None) >= 148 and len({r[1] for r in got if r[0] is None}) == 1


def test_language_against_plain_python(spark):
    """Counts, vectors and the nearest centroid of the model, worked out byte by byte."""
    rng = random.Random(1)
    make = lambda syllables: " ".join("".join(rng.choice(syllables) for _ in range(3)) for _ in range(20))
    some = [(i, make("ka lo mi Ñu".split() if i % 2 else "eß ür schn 12".split()), "aa" if i % 2 else "bb", "", "") for i in range(60)]
    df = spark.createDataFrame(some, SCHEMA)
    model = language.fit(df)
    got = {r[0]: (r[1], r[2]) for r in language.identify(df, model, ["doc_id"], reject=False).collect()}
    m32 = (1 << 32) - 1
    for i, t, *_ in some:
        raw = re.sub(" +", " ", " " + bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in t.lower().encode()).decode("latin-1") + " ").encode("latin-1")
        n = np.zeros(language.DIMS)
        for k in range(len(raw) - 1):
            last = raw[k + 2] if k + 2 < len(raw) else 32
            n[((raw[k] * 0x9E3779B1 + raw[k + 1] * 0x85EBCA77) & m32) >> 20] += 1
            n[((raw[k] * 0xC2B2AE3D + raw[k + 1] * 0x27D4EB2F + last * 0x165667B1) & m32) >> 20] += 1
        v = np.sqrt(n) * model.idf
        cosine = model.centroids @ (v / np.linalg.norm(v))
        assert got[i][0] == model.languages[int(cosine.argmax())] and abs(got[i][1] - cosine.max()) < 1e-4
