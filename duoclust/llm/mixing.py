"""Document rates whose expected tokens by domain meet target weights, in DataFrame operations only.

A multinomial classifier over hashed words is fitted on labelled rows and gives every document posteriors p[k] of
its domains. With n tokens in a document and rate r, domain k expects sum(r * n * p[k]) tokens. The rates minimise
the weighted least squares |D (A r - b)|^2 over r >= 0, where A holds n * p[k] of every document, b the target
tokens and D whitens the domains (the inverse square root of A A', ridged); under that weighting the step length is
one. The rates nearest to one that do so are max(0, 1 + A' u) with a number u for each domain: Newton steps on u need
sums over all documents of which the rate is positive, a few numbers, which the driver holds. Rates start at one.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, table, written

#: Buckets of hashed words; labelled rows that fit the classifier, at most; its smoothing; words that a posterior
#: is worth at most, so that long documents do not become certain of a domain by length alone.
BUCKETS, FIT_ROWS, SMOOTHING, WORTH = 4096, 20_000, 1.0, 40.0
#: Newton steps, at most; relative residual that ends them; ridge of the weighting; weight of nearness to one.
STEPS, TOLERANCE, RIDGE, SOFT = 200, 1e-4, 1e-5, 1e-8


def _words(text: str = "text") -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s"), lambda w: w != "")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def classifier(docs: DataFrame, labelled: DataFrame, domains: list[str]) -> DataFrame:
    """(bucket, w): for each bucket of words the log probabilities in each domain, less those of the first. The
    rows of `labelled` (doc_id, domain) count, FIT_ROWS at most by hash of doc_id, and of several domains of one id
    the first by name; bucket -1 has the log priors."""
    rows = labelled.where(F.col("domain").isin(domains)).groupBy("doc_id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    train = docs.select("doc_id", "text").join(rows, "doc_id")
    each = train.select("domain", F.explode(_words()).alias("word")).groupBy("domain", _bucket(F.col("word")).alias("bucket")).count()
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    counts = each.groupBy("bucket").agg(*(F.sum(F.when(F.col("domain") == d, F.col("count"))).alias(f"c{k}") for k, d in enumerate(domains)))
    counts = every.join(counts, "bucket", "left").select("bucket", *(F.coalesce(f"c{k}", F.lit(0)).alias(f"c{k}") for k in range(len(domains))))
    totals = each.groupBy().agg(*(F.coalesce(F.sum(F.when(F.col("domain") == d, F.col("count"))), F.lit(0)).alias(f"t{k}") for k, d in enumerate(domains)))
    log = [F.log((F.col(f"c{k}") + SMOOTHING) / (F.col(f"t{k}") + SMOOTHING * BUCKETS)) for k in range(len(domains))]
    weights = counts.crossJoin(F.broadcast(totals)).select("bucket", F.array(*(x - log[0] for x in log)).alias("w"))  # one row
    seen = rows.groupBy().agg(F.count("*").alias("n"), *(F.count(F.when(F.col("domain") == d, 1)).alias(f"n{k}") for k, d in enumerate(domains)))
    priors = seen.select(F.lit(-1).alias("bucket"), F.array(*(F.log((F.col(f"n{k}") + SMOOTHING) / (F.col("n") + SMOOTHING * len(domains))) for k in range(len(domains)))).alias("w"))
    return weights.unionByName(priors)


def _key(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def posteriors(docs: DataFrame, model: DataFrame, domains: list[str]) -> DataFrame:
    """(doc_id, row, key, n, p): words of every row of docs and its posteriors; a text without words has the priors.
    `row` tells rows with equal ids apart, `key` those with different texts."""
    k = len(domains)
    w = written(model, "classifier")
    prior = w.where("bucket = -1").select(*(F.col("w")[i].alias(f"prior{i}") for i in range(k)))
    weights = w.where("bucket >= 0").select("bucket", *(F.col("w")[i].alias(f"w{i}") for i in range(1, k)))
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), _key("text").alias("key"), "text")
    each = rows.select("doc_id", "row", "key", F.explode_outer(_words()).alias("word"))
    scored = each.join(F.broadcast(weights), _bucket(F.col("word")) == F.col("bucket"), "left")  # BUCKETS rows
    sums = scored.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("key").alias("key"), F.count("word").alias("n"), *(F.coalesce(F.sum(f"w{i}"), F.lit(0.0)).alias(f"s{i}") for i in range(1, k)))
    worth = F.least(F.lit(1.0), WORTH / F.greatest("n", F.lit(1)))
    logits = [F.col("prior0"), *(F.col(f"prior{i}") + worth * F.col(f"s{i}") for i in range(1, k))]
    shown = sums.crossJoin(F.broadcast(prior)).select("doc_id", "row", "key", "n", F.array(*logits).alias("z"))  # one row
    powers = F.transform("z", lambda x: F.exp(x - F.array_max("z")))
    shown = shown.select("doc_id", "row", "key", "n", powers.alias("e"))
    return shown.select("doc_id", "row", "key", "n", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, b: a + b)).alias("p"))


def rates(soft: DataFrame, weights: list[float], total: float | None = None) -> DataFrame:
    """soft (n, p and any more) with `rate`. The target of domain k is weights[k] / sum(weights) of `total` tokens, by
    default as many as there are. Rows without tokens keep the rate 1, and so do all if there are no tokens.
    Targets that no rates meet (a domain that no document is in) are met as nearly as the least squares go, ridged;
    a warning then tells the residual. RuntimeError if the steps end neither at the targets nor at such a place."""
    k = len(weights)
    a = soft.select("*", *((F.col("n") * F.col("p")[i]).alias(f"a{i}") for i in range(k)))
    a = written(a, "mixing")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = a.agg(F.sum("n"), *(F.sum(F.col(f"a{i}") * F.col(f"a{j}")) for i, j in pairs)).first()
    tokens = float(row[0] or 0)
    if not tokens:
        return a.select(*soft.columns, F.lit(1.0).alias("rate"))
    gram = np.zeros((k, k))
    for (i, j), x in zip(pairs, row[1:], strict=True):
        gram[i, j] = gram[j, i] = x
    metric = gram + RIDGE * np.trace(gram) / k * np.eye(k)
    target = np.array(weights, float) / sum(weights) * (tokens if total is None else total)

    def rate(u: np.ndarray) -> Column:
        return F.greatest(F.lit(0.0), sum((F.col(f"a{i}") * float(u[i]) for i in range(k)), F.lit(1.0)))

    def sums(u: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Half the sum of squared rates, the expected tokens, and the gram of the documents with a rate."""
        r = rate(u)
        got = a.agg(F.sum(r * r) / 2, *(F.sum(r * F.col(f"a{i}")) for i in range(k)), *(F.sum(F.when(r > 0, F.col(f"a{i}") * F.col(f"a{j}")).otherwise(0.0)) for i, j in pairs)).first()
        active = np.zeros((k, k))
        for (i, j), x in zip(pairs, got[1 + k :], strict=True):
            active[i, j] = active[j, i] = x
        return float(got[0]), np.array(got[1 : 1 + k], float), active

    # the dual of |r - 1|^2 / 2 + |D (A r - b)|^2 / (2 soft) is convex in u, with the gradient below
    soft_metric = SOFT * metric
    u = np.zeros(k)
    value, expected, active = sums(u)
    value += u @ soft_metric @ u / 2 - target @ u
    for _ in range(STEPS):
        gradient = expected + soft_metric @ u - target
        if np.abs(expected - target).max() <= TOLERANCE * target.max() or np.abs(gradient).max() <= 1e-2 * TOLERANCE * target.max():
            break
        move = np.linalg.solve(active + soft_metric, gradient)
        size = 1.0
        while True:  # halve the step until the dual falls enough
            v = u - size * move
            new, expected_v, active_v = sums(v)
            new += v @ soft_metric @ v / 2 - target @ v
            if new <= value - 1e-4 * size * (gradient @ move) or size < 1e-9:
                break
            size /= 2
        u, value, expected, active = v, new, expected_v, active_v
    residual, slope = np.abs(expected - target).max() / target.max(), np.abs(expected + soft_metric @ u - target).max() / target.max()
    if residual > TOLERANCE:
        if slope > TOLERANCE:
            raise RuntimeError(f"rates miss their targets by {residual:.3g} of the largest after {STEPS} steps")
        warnings.warn(f"no rates meet the targets: the nearest miss them by {residual:.3g} of the largest", stacklevel=2)
    return a.select(*soft.columns, rate(u).alias("rate"))


def _mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float]) -> DataFrame:
    domains = sorted(targets)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    soft = posteriors(d, classifier(d, labelled.select(F.col("doc_id").cast("long").alias("doc_id"), "domain"), domains), domains)
    out = rates(soft, [targets[x] for x in domains])
    return out.select("doc_id", "key", F.col("n").alias("n_tokens"), *(F.col("p")[i].alias(f"p_{x}") for i, x in enumerate(domains)), "rate")


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float]) -> DataFrame:
    """(doc_id, n_tokens, p_<domain>..., rate) for every row of docs. Tokens are words between white space; null and
    empty texts have none, the priors as posteriors and the rate 1. `labelled` has doc_id and domain; `targets`
    the weight of each domain. An empty table gives an empty result; other columns are not read."""
    return _mixed(docs, labelled, targets).drop("key")


def weighted(docs: DataFrame, labelled: DataFrame, targets: dict[str, float]) -> DataFrame:
    """docs, all rows and columns, with what mix() says of each: n_tokens, p_<domain>... and rate. Rows that repeat a text
    under its id have the same rate. A name that docs has already goes to its own column; the new one has underscores
    behind it."""
    found = _mixed(docs, labelled, targets)
    new = {c: fresh(c, docs.columns) for c in found.columns if c not in ("doc_id", "key")}
    found = found.dropDuplicates(["doc_id", "key"]).select(F.struct("doc_id", "key").alias("k"), F.struct(*(F.col(c).alias(n) for c, n in new.items())).alias("of"))
    k, of = fresh("k", docs.columns), fresh("of", docs.columns)
    found = found.withColumnsRenamed({"k": k, "of": of})
    same = _key("text").eqNullSafe(F.col(k)["key"]) & F.col("doc_id").cast("long").eqNullSafe(F.col(k)["doc_id"])
    return docs.join(found, same).select(*docs.columns, *(F.col(of)[n].alias(n) for n in new.values()))


def quality_domains(spark, sf_dir: str) -> DataFrame:
    """The labels table's rows with domains: by quality, and toxic ones apart."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    return table(spark, sf_dir, "labels").select("doc_id", domain.alias("domain")).where("doc_id is not null and domain is not null")


#: Production weights of those domains.
TARGETS = {"high": 0.9, "low": 0.09, "toxic": 0.01}
