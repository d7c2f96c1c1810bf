"""Mixing domains to target weights by soft membership, in DataFrame operations only.

A classifier learned from a labelled table (multinomial naive Bayes over hashed words, from at most LABELLED labelled
rows in the order of a hash of their id) gives every document a posterior over the domains, on a grid of 1/GRID. A
document's expected contribution to a domain's tokens is its words times its posterior times its rate. The rates are
nonnegative numbers, near one, whose expected totals meet the targets in the least-squares sense. They are found by
projected gradient steps: each step is one distributed sum over all documents, first summed by posterior, since
documents of one posterior have one rate. The domains' errors are weighted by the inverse of the matrix of second
moments of the posteriors; in that weighting a step of length one always converges, and without a bound in its way one
step meets the targets. Where rates are held at a bound, the moments of the others are tried first. fit_rates() warns
if targets are out of reach. A rate r keeps floor(r) copies and one more with probability r - floor(r), decided by a
hash of the row.

Null and empty texts have no words; they get their prior's rate. Without labelled rows there is one domain, `all`.
Repeated rows alike in all are decided alike. Columns of any name pass through: inside they are c0, c1, ... An empty
table gives an empty result.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import discard, documents, plain, stored, table

LABELLED, BUCKETS, SMOOTH, CAP, GRID = 12_000, 8192, 0.5, 40.0, 1000
ROUNDS, CLOSE = 40, 1e-4
#: Target weights of the registered query and the pipeline; the domains are the two qualities of the labels table.
#: The corpus itself is about 0.9 to 0.1, so both queries have to drop or repeat documents to get here.
TARGETS = {"high": 0.7, "low": 0.3}


def words(text: str) -> Column:
    flat = F.coalesce(F.col(text), F.lit(""))
    for c in "\n\t\r":
        flat = F.replace(flat, F.lit(c), F.lit(" "))
    return F.filter(F.split(flat, " "), lambda w: w != "")


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def constant(values: list[float]) -> Column:
    """A constant array; as one string it reaches the JVM in one call."""
    return F.split(F.lit(",".join(f"{v:.6g}" for v in values)), ",").cast("array<double>")


def summed(ratios: Column) -> Column:
    return F.aggregate("_w", F.lit(0.0), lambda a, w: a + F.element_at(ratios, w + 1))


class Classifier:
    """Domains, log priors, and log-likelihoods of each bucket against the first domain's."""

    def __init__(self, domains: list[str], prior: list[float], ratios: list[list[float]]):
        self.domains, self.prior, self.ratios = domains, prior, ratios

    def with_posteriors(self, df: DataFrame, text: str) -> DataFrame:
        """df, whose columns are called c0, c1, ..., with t (words) and p (posterior on the grid)."""
        df = df.withColumn("_w", F.transform(words(text), bucket))
        df = df.withColumn("t", F.size("_w").cast("long"))
        scale = F.lit(CAP) / (F.lit(CAP) + F.col("t"))
        logits = [F.lit(0.0)]
        for k in range(1, len(self.domains)):
            total = summed(constant(self.ratios[k]))
            logits.append(F.lit(self.prior[k] - self.prior[0]) + scale * total)
        df = df.withColumn("_z", F.array(*logits))
        df = df.withColumn("_e", F.transform("_z", lambda z: F.exp(z - F.array_max("_z"))))
        whole = F.aggregate("_e", F.lit(0.0), lambda a, e: a + e)
        return df.withColumn("p", F.transform("_e", lambda e: F.round(e / whole * GRID).cast("int"))).drop("_w", "_z", "_e")


def fit_classifier(df: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text: str = "text", domain: str = "domain", most: int = LABELLED) -> Classifier:
    """labelled: id_col and domain. Of several labels of one id the least counts."""
    rows = labelled.filter(F.col(domain).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(F.col(domain).cast("string")).alias("_d"))
    picked = rows.orderBy(F.xxhash64("_id"), "_id").limit(most)
    sample = df.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(picked), "_id")
    n = sample.groupBy("_d").count().collect()
    domains = sorted(r._d for r in n)
    if not domains:
        return Classifier(["all"], [0.0], [[]])
    counts = {d: [SMOOTH] * BUCKETS for d in domains}
    for r in sample.select("_d", F.explode(F.transform(words("_text"), bucket)).alias("b")).groupBy("_d", "b").count().collect():
        counts[r._d][r.b] += r["count"]
    logs = {d: [math.log(c / sum(counts[d])) for c in counts[d]] for d in domains}
    size = {r._d: r["count"] for r in n}
    first = logs[domains[0]]
    return Classifier(domains, [math.log(size[d] / sum(size.values())) for d in domains], [[a - b for a, b in zip(logs[d], first, strict=True)] for d in domains])


def rate(steps: list[list[float]], floor: float) -> Column:
    """The rate after all gradient steps, for a posterior in p. The steps are data, so the plan is alike for any of them."""
    if not steps:
        return F.lit(1.0)

    def after(p: Column) -> Column:
        moved = lambda g: F.aggregate(F.zip_with(p, g, lambda x, y: x * y / F.lit(GRID)), F.lit(0.0), lambda a, m: a + m)
        return F.aggregate(F.lit(steps), F.lit(1.0), lambda r, g: F.greatest(F.lit(floor), r - moved(g)))

    return F.transform(F.array("p"), after)[0]  # bound to a variable, p is worked out once and not once a step


def solved(matrix: list[list[float]], right: list[float]) -> list[float]:
    """x of matrix x = right, for a small positive semidefinite matrix, by elimination with a slight ridge."""
    n = len(right)
    ridge = 1e-9 * sum(matrix[i][i] for i in range(n)) + 1e-9
    rows = [[*matrix[i][:i], matrix[i][i] + ridge, *matrix[i][i + 1 :], right[i]] for i in range(n)]
    for i in range(n):
        for j in range(i + 1, n):
            f = rows[j][i] / rows[i][i]
            rows[j] = [a - f * b for a, b in zip(rows[j], rows[i], strict=True)]
    x = [0.0] * n
    for i in reversed(range(n)):
        x[i] = (rows[i][n] - sum(rows[i][j] * x[j] for j in range(i + 1, n))) / rows[i][i]
    return x


def goals(start: list[float], weights: list[float], grow: bool) -> list[float]:
    """Target totals by domain, for expected totals at rate one and weights that add up to one."""
    total = max((s / w for s, w in zip(start, weights, strict=True) if w), default=0) if grow else sum(start)
    return [w * total for w in weights]


def fit_rates(posteriors: DataFrame, domains: list[str], targets: dict[str, float], floor: float = 0.0, grow: bool = False) -> list[list[float]]:
    """Gradient steps that meet the targets. posteriors: t and p of all documents.

    The total is that of the documents or, with grow, the least at which no domain must shrink."""
    by = stored(posteriors.groupBy("p").agg(F.sum("t").alias("t")).filter("t > 0"), "posteriors")
    n = len(domains)
    p = [F.col("p")[k] / F.lit(GRID) for k in range(n)]
    pairs = [(i, j) for i in range(n) for j in range(i, n)]

    def summed_up(steps: list[list[float]], free: bool) -> tuple[list[float], list[list[float]]]:
        """Expected totals, and second moments (with free, of those above the floor)."""
        moved = F.col("r") > floor if free else F.lit(True)
        got = by.withColumn("r", rate(steps, floor)).agg(
            *[F.sum(F.col("t") * p[k] * F.col("r")).alias(f"s{k}") for k in range(n)],
            *[F.sum(F.when(moved, F.col("t") * p[i] * p[j]).otherwise(0.0)).alias(f"m{i}_{j}") for i, j in pairs],
        ).first()
        return [float(got[f"s{k}"] or 0) for k in range(n)], [[float(got[f"m{min(i, j)}_{max(i, j)}"] or 0) for j in range(n)] for i in range(n)]

    start, whole = summed_up([], False)
    weights = [max(0.0, targets.get(d, 0.0)) for d in domains]
    steps: list[list[float]] = []
    if sum(start) and sum(weights):
        goal = goals(start, [w / sum(weights) for w in weights], grow)

        def error(now: list[float]) -> float:
            miss = [s - g for s, g in zip(now, goal, strict=True)]
            return sum(m * x for m, x in zip(miss, solved(whole, miss), strict=True))

        now, matrix, size = start, whole, sum(goal)
        for _ in range(ROUNDS):
            miss = [s - g for s, g in zip(now, goal, strict=True)]
            if max(map(abs, miss)) <= CLOSE * size:
                break
            before = now
            for m in (matrix, whole):
                tried = [*steps, solved(m, miss)]
                now, free = summed_up(tried, True)
                if error(now) < error(before):
                    break
            steps, matrix = tried, free
            if max(abs(a - b) for a, b in zip(now, before, strict=True)) <= CLOSE * 0.01 * size:
                break
        left = {d: round(s - g) for d, s, g in zip(domains, now, goal, strict=True) if abs(s - g) > CLOSE * size}
        if left:
            warnings.warn(f"targets out of reach; expected tokens less the target: {left}", stacklevel=2)
    discard(by)
    return steps


def mixed(df: DataFrame, classifier: Classifier, targets: dict[str, float], floor: float = 0.0, grow: bool = False, text: str = "text") -> DataFrame:
    """The columns of df, called c0, c1, ... in their order, and t (words), p (posterior in GRIDths), rate and copies."""
    inner = plain(df)
    posteriors = classifier.with_posteriors(inner, f"c{df.columns.index(text)}")
    steps = fit_rates(posteriors.select("t", "p"), classifier.domains, targets, floor, grow)
    out = posteriors.withColumn("rate", rate(steps, floor))
    share = F.pmod(F.xxhash64(F.lit(7), *inner.columns), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return out.withColumn("copies", (F.floor("rate") + (share < F.col("rate") - F.floor("rate")).cast("long")).cast("int"))


def achieved(out: DataFrame, domains: list[str], targets: dict[str, float], grow: bool = False) -> list[dict]:
    """What mixed() came to: by domain the tokens before, the target, the expected ones after and those of the copies kept."""
    share = lambda k: F.col("t") * F.col("p")[k] / F.lit(GRID)
    kinds = {"before": F.lit(1), "rate": F.col("rate"), "copies": F.col("copies")}
    got = out.agg(*[F.sum(share(k) * x).alias(f"s{k}_{n}") for k in range(len(domains)) for n, x in kinds.items()]).first()
    before, rated, kept = ([float(got[f"s{k}_{n}"] or 0) for k in range(len(domains))] for n in kinds)
    weights = [max(0.0, targets.get(d, 0.0)) for d in domains]
    goal = goals(before, [w / sum(weights) for w in weights], grow) if sum(weights) else before
    return [dict(zip(("domain", "before", "target", "expected", "kept"), r, strict=True)) for r in zip(domains, before, goal, rated, kept, strict=True)]


def repeated(df: DataFrame, classifier: Classifier, targets: dict[str, float], floor: float = 0.0, grow: bool = False, text: str = "text") -> DataFrame:
    """The rows of df, each as many times as its rate says."""
    # no filter: it would be pushed below and work the posteriors out again; rows of no copy vanish in the explosion
    out = mixed(df, classifier, targets, floor, grow, text).withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
    return out.select(*plain(df).columns).toDF(*df.columns)


def qualities(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low").alias("domain"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    classifier = fit_classifier(docs, qualities(table(spark, sf_dir, "labels")))
    out = mixed(docs, classifier, TARGETS)
    return out.select(F.col("c0").alias("doc_id"), F.col("t").alias("n_tokens"), *[(F.col("p")[k] / GRID).alias(f"p_{d}") for k, d in enumerate(classifier.domains)], "rate", "copies")
