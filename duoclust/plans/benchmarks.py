"""Synthetic benchmarks and text sweeps: a task in a row, a grouped Spark task for each, results that can be resumed."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.scalar import at_least, score_model
from ..operators import blocks, evaluate, text
from ..operators.order import dealt
from ..sources import io

#: Panels (dimensions, p, p_form), fractions of formulaic features, and panels (dimension, coefficient) with noise levels.
CATEGORICAL = [(200, 0.10, 0.20), (200, 0.05, 0.15), (200, 0.01, 0.11), (50, 0.10, 0.20), (50, 0.05, 0.15), (50, 0.01, 0.11), (20, 0.5, 0.6), (20, 0.5, 0.8), (20, 0.5, 1.0)]
FRACTIONS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
GAUSSIAN, NOISE = [(50, 20), (50, 5), (50, 2), (10, 20), (10, 10), (10, 2)], [0.0, 0.1, 0.2, 0.5, 0.7, 0.9]
NGRAMS, WINDOWS, FEATURES = [1, 2, 3, 4, 5], [2, 3, 4, 6, 8, 10, 12, 14, 18, 22, 24, 26, 28], [100, 300, 500, None]
ATTEMPTS, GOLDEN = 5, 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Config:
    simulations: int = 100
    rows_per_cluster: int = 50
    seed: int = 20260728
    restarts: int = 6
    iterations: int = 200

    def __post_init__(self):
        if min(self.simulations, self.rows_per_cluster, self.restarts, self.iterations) < 1:
            raise ValueError("counts must be at least 1")

    def digest(self) -> str:
        """Of the configuration: part of the resume key, so that different runs do not mix."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:12]


def sparse_bernoulli(dimensions: int, p: float, p_form: float, fraction: float, rows: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two clusters, the formulaic one first: a fraction of its features has p_form, each probability with a
    little noise, and in half of its rows a formulaic feature is copied to another."""
    chosen = rng.choice(dimensions, max(2, int(dimensions * fraction)), replace=False)
    base = np.clip(p + rng.normal(0, 0.01, dimensions), 0, 1)
    biased = base.copy()
    biased[chosen] = np.clip(p_form + rng.normal(0, 0.01, len(chosen)), 0, 1)
    one, zero = (rng.random((rows, dimensions)) < biased).astype(float), (rng.random((rows, dimensions)) < base).astype(float)
    for k in np.flatnonzero(rng.random(rows) < 0.5):
        a, b = rng.choice(chosen, 2, replace=False)
        one[k, b] = one[k, a]
    return np.vstack([one, zero]), np.r_[np.ones(rows, int), np.zeros(rows, int)]


def two_gaussians(dimension: int, rows: int, noise: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Class 1 has variance 10, and 30 in the share of coordinates that is noise; class 0 has variance 30."""
    variance = np.full(dimension, 10.0)
    variance[: int(dimension * noise)] = 30.0
    return np.vstack([rng.normal(size=(rows, dimension)) * np.sqrt(variance), rng.normal(size=(rows, dimension)) * np.sqrt(30.0)]), np.r_[np.ones(rows, int), np.zeros(rows, int)]


def categorical_tasks(spark: SparkSession, config: Config) -> DataFrame:
    """One row for each panel, fraction and simulation, with its seed."""
    panels = spark.createDataFrame([(k, *v) for k, v in enumerate(CATEGORICAL)], "panel int, dimensions int, p double, p_form double")
    fractions = spark.createDataFrame([(f,) for f in FRACTIONS], "fraction double")
    simulations = spark.range(config.simulations).select(F.col("id").cast("int").alias("simulation"))
    seed = F.pmod(F.xxhash64(F.lit(config.seed), "panel", "fraction", "simulation"), F.lit(1 << 62)).cast("decimal(20,0)")
    return evaluate.grid(panels, fractions, simulations).withColumn("seed", seed)


def gaussian_tasks(spark: SparkSession, config: Config) -> DataFrame:
    panels = spark.createDataFrame(GAUSSIAN, "dimension int, coefficient int")
    noise = spark.createDataFrame([(x,) for x in NOISE], "noise double")
    simulations = spark.range(config.simulations).select(F.col("id").cast("int").alias("simulation"))
    seed = F.pmod(F.xxhash64(F.lit(config.seed), "dimension", "coefficient", "noise", "simulation"), F.lit(1 << 62)).cast("decimal(20,0)")
    return evaluate.grid(panels, noise, simulations).withColumn("samples_per_class", F.col("dimension") * F.col("coefficient")).withColumn("seed", seed)


def attempted(run: Callable[[int], float], seed: int) -> tuple[float, str | None]:
    """The first score that an attempt gives; each attempt has a seed of its own. NaN and the last reason if none does."""
    reason = None
    for k in range(ATTEMPTS):
        try:
            return run((seed + k * GOLDEN) % (1 << 64)), None
        except (FloatingPointError, ValueError, np.linalg.LinAlgError) as e:
            reason = f"{type(e).__name__}: {e}"
    return float("nan"), reason


def _best(ends: DataFrame, schema: str) -> DataFrame:
    """Of each task and method the end of least loss, the first start in a tie, with the columns of `schema`."""
    names = [c.split()[0] for c in schema.split(", ")]
    own = [c for c in names if c not in OUTCOME]
    kept = [c for c in names if c in OUTCOME]
    order = F.struct(F.coalesce("loss", F.lit(float("inf"))), "start")
    best = ends.groupBy(*own).agg(F.min_by(F.struct(*kept), order).alias("best"))
    return best.select(*(F.col(f"best.{c}") if c in kept else F.col(c) for c in names))


#: Columns of a trial that its start decides.
OUTCOME = {"mcc", "information_loss", "optimizer_success", "failure"}


def _started(tasks: DataFrame, keys: list[str], starts: dict[str, tuple[int, float]], size: Column, run: Callable, schema: str) -> DataFrame:
    """`run` for a row of every task, method and start. `starts` names the starts of a method and what one costs beside the
    others; rows go to tasks of equal cost, so no method and no large dataset decides how long all of it takes."""
    methods = F.array(*(F.struct(F.lit(m).alias("method"), F.lit(k).alias("start"), F.lit(float(cost)).alias("weight")) for m, (n, cost) in starts.items() for k in range(n)))
    rows = tasks.withColumn("m", F.explode(methods)).select(*tasks.columns, "m.*").withColumn("cost", F.col("weight") * size)
    names = [c.split()[0] for c in schema.split(", ")] + ["start", "loss"]

    def of_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([run(t) for t in batch.itertuples(index=False)], columns=names)

    return _best(dealt(rows, F.col("cost"), *keys, "method", "start").mapInPandas(of_rows, f"{schema}, start int, loss double"), schema)


def categorical_trials(tasks: DataFrame, config: Config) -> DataFrame:
    """Four rows for each task: the information partition and three comparators on one matrix."""
    digest = config.digest()

    def trial(t) -> tuple:
        seed, loss, fine = int(t.seed), None, None
        x, truth = sparse_bernoulli(int(t.dimensions), t.p, t.p_form, t.fraction, config.rows_per_cluster, np.random.default_rng(seed))
        if t.method == "Cross-Entropy":
            found = kernels.partition_start(x, "bernoulli", int(t.start), config.iterations, seed=seed)
            score, loss, fine = (float("nan"), None, False) if found is None else (kernels.normalized_mcc(truth, found["labels"]), found["loss"], bool(found["success"]))
        elif t.method == "DBSCAN":
            score = kernels.normalized_mcc(truth, kernels.dbscan_binary(x))
        else:
            fit = kernels.kmeans if t.method == "K-means" else kernels.gmm
            score = attempted(lambda s: kernels.normalized_mcc(truth, fit(x, s)), seed)[0]
        return (int(t.panel), int(t.dimensions), t.p, t.p_form, round(t.fraction, 1), int(t.simulation), t.seed, t.method, score, loss, fine, digest, int(t.start), loss)

    starts = {"Cross-Entropy": (config.restarts, 1), "K-means": (1, 30), "GMM": (1, 3), "DBSCAN": (1, 1)}
    return _started(tasks, ["panel", "fraction", "simulation"], starts, F.col("dimensions").cast("double"), trial, io.TRIALS)


def gaussian_trials(tasks: DataFrame, config: Config, starts: int = 2, iterations: int = 180, differential_entropy: bool = False) -> DataFrame:
    """Six rows for each task; a method that fails on every attempt has NaN and the reason, and differential entropy has
    NaN unless it is asked for."""
    digest = config.digest()
    objectives = {"Self-Information": kernels.gaussian_objective, "$L_2$ Norm": kernels.radius_objective}

    def trial(t) -> tuple:
        seed, loss = int(t.seed), []
        x, truth = two_gaussians(int(t.dimension), int(t.samples_per_class), t.noise, np.random.default_rng(seed))

        def score(s: int) -> float:
            if t.method in objectives:
                labels, value = kernels.weighted_start(x, objectives[t.method], int(t.start), s, iterations)
                loss.append(value)
            elif t.method == "Gaussian Mixture":
                labels = kernels.gmm(x, s)
            elif t.method == "Reg. EM":
                labels = kernels.regularized_em(x, s)
            else:
                labels = kernels.cross_entropy_clusters(x, s, log_space=t.method == "CEC")
            return kernels.normalized_mcc(truth, labels)

        asked = differential_entropy or t.method != "Differential Entropy"
        mcc, failure = attempted(score, seed) if asked else (float("nan"), None)
        return (int(t.dimension), int(t.coefficient), int(t.samples_per_class), t.noise, t.seed, t.method, mcc, failure, digest, int(t.start), loss[-1] if loss else None)

    methods = {"Self-Information": (starts, 4), "$L_2$ Norm": (starts, 1), "Differential Entropy": (1, 6 if differential_entropy else 0), "Gaussian Mixture": (1, 2), "Reg. EM": (1, 11), "CEC": (1, 6)}
    size = F.col("samples_per_class").cast("double") * F.col("dimension") * F.col("dimension")
    return _started(tasks, ["dimension", "coefficient", "noise", "simulation"], methods, size, trial, io.GAUSSIAN_TRIALS)


def resumed(tasks: DataFrame, trials: Callable[[DataFrame], DataFrame], keys: list[str], schema: str, path: str, config: Config, batches: int = 1) -> DataFrame:
    """Runs the tasks that `path` does not hold for this configuration, adds their rows and returns all of them. Rows are
    committed batch by batch (by a hash of the keys), each once or not at all, so that a run that ends early keeps those
    that are done, and one that is repeated adds nothing."""
    spark, digest = tasks.sparkSession, config.digest()
    done = lambda: io.batches(spark, path, schema).where(F.col("config") == digest)
    for k in range(batches):
        left = io.still_to_run(tasks.where(F.pmod(F.xxhash64(*keys), F.lit(batches)) == k), done(), keys)
        if not left.isEmpty():
            io.commit_batch(trials(left), path, schema, f"{digest}-{k}-of-{batches}")
    return done()


def sweep_counts(docs: DataFrame, ngrams: list[int], widths: list[int], top: int) -> DataFrame:
    """(ngram, width, feature, cnt, rank, n_features, total): the `top` features of every n and width of one sequence,
    with how many features there are and their counts in all; its n-grams are read once for each n."""
    at_least(1, top=top, **{f"width {k}": w for k, w in enumerate(widths)})
    spark, found = docs.sparkSession, []
    with io.scratch():
        placed = docs if "before" in docs.columns else text._placed(docs)
        placed = io.materialised(placed.select("key", "seq", "n_docs", "before", "toks"), "sweep-docs")
        mark = "\0" if placed.where(F.exists("toks", lambda t: t.isNull() | F.contains(t, F.lit("\0")))).isEmpty() else None
        for n in ngrams:
            with io.scratch():
                found += [(n, *row) for row in _width_counts(placed, n, sorted(set(widths)), top, mark)]
    kind = "ngram int, width int, feature array<string>, cnt long, rank int, n_features long, total long"
    return spark.createDataFrame(found, kind)  # `top` rows at most for each n and width


def _width_counts(docs: DataFrame, n: int, widths: list[int], top: int, mark: str | None) -> list[tuple]:
    """(width, feature, cnt, rank, n_features, total) of one n. Features are grouped as strings, with `mark` between their
    tokens, if there is one that is in no token.

    Nearly all n-grams lie in one document that no window's end cuts: each counts 2 * width, whatever the width. A feature
    that has only those is one number, and of such features the first `top` of one width are those of all. The others are
    counted for each width; of them only those go on that count as much as the last of the first."""
    named = lambda df: df if mark is None else df.withColumn("feature", F.array_join("feature", mark))
    odd = io.materialised(named(text.ngram_spans(docs, n, near=max(widths))), "sweep-odd")
    lengths = {w: text.range_length(w, max(widths)) for w in widths}
    each = odd.groupBy("feature").agg(*(a for w, k in lengths.items() for a in (F.sum(F.greatest(k, F.lit(0))).alias(f"c{w}"), F.min(F.when(k > 0, F.col("place"))).alias(f"p{w}"))))
    each = io.materialised(each, "sweep-odd", odd)
    every = named(text.inner_ngrams(docs, n, max(widths))).unionByName(each.select("feature", F.lit(None).cast("long").alias("place")))
    met = every.groupBy("feature").agg(F.count("place").alias("n"), F.min("place").alias("p"), F.bool_or(F.col("place").isNull()).alias("odd"))
    for least in (2, 1):  # features that occur once are many, and seldom among the first
        seen, alone = Observation(), ~F.col("odd")
        counted = met.observe(seen, F.count_if(alone).alias("features"), F.coalesce(F.sum(F.when(alone, F.col("n"))), F.lit(0)).alias("n"), F.count_if(alone & (F.col("n") >= least)).alias("kept"))
        kept = io.materialised(counted.where(f"odd or n >= {least}"), "sweep-counts")
        whole = seen.get
        if least == 1 or whole["kept"] >= top or whole["kept"] == whole["features"]:
            break
        io.dropped(kept)
    first = kept.where("not odd").orderBy(F.desc("n"), "p").limit(top).collect()  # `top` rows
    last = first[-1]["n"] if len(first) == top else 0
    both = each.join(kept.where("odd").select("feature", "n", "p"), "feature")
    both = both.select("feature", *(a for w in widths for a in ((F.col(f"c{w}") + 2 * w * F.col("n")).alias(f"c{w}"), F.least(f"p{w}", "p").alias(f"p{w}"))))
    both = io.materialised(both, "sweep-odd")
    totals = both.agg(*(a for w in widths for a in (F.count_if(F.col(f"c{w}") > 0), F.coalesce(F.sum(f"c{w}"), F.lit(0))))).first()
    spread = F.explode(F.array(*(F.struct(F.lit(w).alias("width"), F.col(f"c{w}").alias("cnt"), F.col(f"p{w}").alias("first"), F.lit(2 * w * last).alias("least")) for w in widths)))
    rivals = both.select("feature", spread.alias("c")).select("feature", "c.*").where("cnt > 0 and cnt >= least")
    odd_first: dict[int, list[tuple]] = {w: [] for w in widths}
    for r in text.ranked_by_width(rivals, top).collect():  # `top` rows at most for each width
        odd_first[r["width"]].append((-r["cnt"], r["first"], r["feature"]))
    out = []
    for k, w in enumerate(widths):
        ranks = sorted([*odd_first[w], *((-2 * w * r["n"], r["p"], r["feature"]) for r in first)])[:top]
        out += [(w, feature if mark is None else feature.split(mark), -cnt, rank, whole["features"] + totals[2 * k], 2 * w * whole["n"] + totals[2 * k + 1]) for rank, (cnt, _, feature) in enumerate(ranks, 1)]
    return out


def _groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Rows that come sorted by key, a key at a time."""
    held = None
    for batch in batches:
        held = batch if held is None else pd.concat([held, batch])
        last = held[key].iloc[-1] if len(held) else None
        if len(held) and held[key].iloc[0] != last:
            whole = held[held[key] != last]
            held = held[held[key] == last]
            for _, group in whole.groupby(key):
                yield group
    if held is not None and len(held):
        yield held


def text_sweep(docs: DataFrame, labels: DataFrame, ngrams: list[int], windows: list[int], features: list[int | None], restarts: int = 6, iterations: int = 200, model: str = "multinomial", config: str = "", kmeans_starts: int = 100) -> DataFrame:
    """One row for each combination of one sequence: the partition of its windows against expert labels (row, label).

    The n-grams of each n are written once, and counts for every width come from one pass over them. The matrices of all
    combinations with a number of features are built and fitted together in blocks of windows (operators.blocks), so no
    task holds one. A combination of all features (None) is a sparse matrix in one task."""
    combos = [(n, w, f) for n in ngrams for w in windows for f in features if f is not None]
    out = []
    if None in features:
        out.append(_sweep_of_all_features(docs, labels, ngrams, windows, restarts, iterations, model, config, kmeans_starts))
    if combos:
        with io.scratch():
            rows = _sweep_in_blocks(docs, labels, combos, max(windows), restarts, iterations, score_model(model), kmeans_starts)
        known = [(f"n-{n}_l-{w}_f-{f}", n, w, str(f), *rows[c][:2], model, "count", *rows[c][2:], config) for c, (n, w, f) in enumerate(combos) if c in rows]
        out.append(docs.sparkSession.createDataFrame(known, io.SWEEP))  # a row for each combination
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def _sweep_in_blocks(docs: DataFrame, labels: DataFrame, combos: list[tuple[int, int, int]], widest: int, restarts: int, iterations: int, model: str, kmeans_starts: int) -> dict[int, tuple]:
    """(samples, features, mcc of the partition and of k-means, loss, success, steps) of each combination that has rows."""
    spark, nan, parts = docs.sparkSession, float("nan"), []
    marked = labels.select(F.floor(F.col("row") / blocks.ROWS).cast("int").alias("block"), F.col("row").cast("long").alias("ds"), F.col("label").cast("long").alias("label"))
    for n in sorted({n for n, _, _ in combos}):
        mine = [(c, w, f) for c, (m, w, f) in enumerate(combos) if m == n]
        spans = io.materialised(text.ngram_spans(docs, n), "sweep-spans")
        ranked = text.ranked_by_width(text.counts_by_width(spans, sorted({w for _, w, _ in mine})), max(f for _, _, f in mine))
        top = ranked.select("width", "rank", "feature", F.xxhash64("feature").alias("hash")).collect()  # as many as are asked for of each width
        place, fits = {}, []
        for k, (c, w, f) in enumerate(mine):
            chosen = sorted((r for r in top if r["width"] == w and r["rank"] <= f), key=lambda r: r["hash"])
            fits.append((c, w, len(chosen)))
            for at, r in enumerate(chosen):
                place.setdefault(tuple(r["feature"]), [-1] * len(mine))[k] = at
        columns = spark.createDataFrame([(list(g), at) for g, at in place.items()], "feature array<string>, cols array<int>")
        lo, hi = F.greatest(F.lit(0), F.col("de") - widest + 1), F.least(F.col("n_docs") - 1, F.col("ds") + widest)
        met = spans.join(F.broadcast(columns), "feature").where(hi >= lo)
        into = F.explode(F.sequence(F.floor(lo / blocks.ROWS).cast("int"), F.floor(hi / blocks.ROWS).cast("int"))).alias("block")
        entries = met.select(into, *(F.col(c).cast("long").alias(c) for c in ("ds", "de", "n_docs")), "cols").unionByName(marked, allowMissingColumns=True)
        if place:
            parts.append(io.materialised(blocks.counted(entries, fits), "sweep-blocks"))
        io.dropped(spans)
    if not parts:
        return {}
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.unionByName(more)
    whole = blocks.written(whole, *parts)
    size = blocks.sizes(whole, list(range(len(combos))))
    whole, best = blocks.partitions(whole, size, model, restarts, iterations)
    near = blocks.kmeans(whole, {c: size[c] for c in best}, kmeans_starts)
    tail = {c: (b["mcc"], near[c], b["loss"], b["success"], b["n_iter"]) for c, b in best.items()}
    return {c: (s["n"], int((s["f"] > 0).sum()), *tail.get(c, (nan, nan, nan, False, 0))) for c, s in size.items()}


def _sweep_of_all_features(docs: DataFrame, labels: DataFrame, ngrams: list[int], windows: list[int], restarts: int, iterations: int, model: str, config: str, kmeans_starts: int) -> DataFrame:
    """text_sweep() of all features: the n-grams of each n go, with the documents they span, to the combinations of their
    n, where they are spread over their windows; a combination is fitted in one task, that of its share of the whole cost."""
    widest, combos = max(windows), [(n, w) for n in ngrams for w in windows]
    by_cost = sorted(range(len(combos)), key=lambda c: -combos[c][1])
    tasks = min(len(combos), 4 * docs.sparkSession.sparkContext.defaultParallelism)
    task = {c: place % tasks for place, c in enumerate(by_cost)}
    parts = []
    for n in ngrams:
        spans = io.materialised(text.ngram_spans(docs, n), "sweep-spans")
        met = spans.select(F.xxhash64("feature").alias("feature"), "ds", "de", "n_docs")
        asked = []
        for c, (m, w) in enumerate(combos):
            if m == n:
                inside = text.range_length(w, widest) > 0
                lo, hi = F.greatest(F.lit(0), F.col("de") - w + 1), F.least(F.col("n_docs") - 1, F.col("ds") + w)
                asked.append(F.when(inside, F.struct(F.lit(c).alias("combo"), F.lit(task[c]).alias("task"), lo.alias("lo"), hi.alias("hi"))))
        parts.append(met.select("feature", F.explode(F.filter(F.array(*asked), lambda x: x.isNotNull())).alias("x")).select("x.*", "feature", F.lit(None).cast("int").alias("label")))
    every = F.explode(F.array(*(F.struct(F.lit(c).alias("combo"), F.lit(t).alias("task")) for c, t in task.items())))
    entries = labels.select(every.alias("x"), F.col("row").cast("long").alias("lo"), F.col("label").cast("int").alias("label")).select("x.*", "lo", F.col("lo").alias("hi"), F.lit(None).cast("long").alias("feature"), "label")
    for p in parts:
        entries = entries.unionByName(p)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(batches, "combo"):
            n, w = combos[int(group["combo"].iloc[0])]
            marked, found = group[group["label"].notna()], group[group["feature"].notna()]
            lo, size = found["lo"].to_numpy(np.int64), (found["hi"] - found["lo"] + 1).to_numpy(np.int64)
            at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
            truth_of = pd.Series(marked["label"].to_numpy(int), index=marked["lo"].to_numpy(np.int64))
            known = np.isin(at, truth_of.index)
            names, col = np.unique(found["feature"].to_numpy(np.int64), return_inverse=True)
            rows, r = np.unique(at[known], return_inverse=True)
            cols, c = np.unique(np.repeat(col, size)[known], return_inverse=True)
            base = [f"n-{n}_l-{w}_f-all", n, w, "all", len(rows), len(cols), model, "count"]
            tail = [float("nan"), float("nan"), float("nan"), False, 0, config]
            if len(rows) > 1:
                x, truth = kernels.Sparse(r, c, np.ones(len(r)), (len(rows), len(cols))), truth_of.loc[rows].to_numpy()
                try:
                    best = kernels.partition(x, model, restarts, iterations)
                    tail = [kernels.normalized_mcc(truth, best["labels"]), kernels.normalized_mcc(truth, kernels.sparse_kmeans(x, 0, kmeans_starts)), best["loss"], bool(best["success"]), int(best["n_iter"]), config]
                except ValueError:  # every start collapsed
                    pass
            if len(rows):
                yield pd.DataFrame([base + tail], columns=[k.split()[0] for k in io.SWEEP.split(", ")])

    return entries.repartitionById(tasks, "task").sortWithinPartitions("combo").mapInPandas(run, io.SWEEP)


def _spread(df: DataFrame, by: str) -> DataFrame:
    """Groups over a stated number of tasks: small rows of long fits would be coalesced into few otherwise."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, by)


def partitions(matrix: DataFrame, by: str, model: str, restarts: int = 6, iterations: int = 200) -> DataFrame:
    """(by, row, membership, label, loss): the best partition of each group's matrix (by, row, feature, value)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows, r = np.unique(group["row"], return_inverse=True)
        cols, c = np.unique(group["feature"], return_inverse=True)
        x = np.zeros((len(rows), len(cols)))
        x[r, c] = group["value"]
        try:
            best = kernels.partition(x, model, restarts, iterations)
        except ValueError:
            best = {"membership": np.full(len(rows), np.nan), "labels": np.zeros(len(rows), int), "loss": float("nan")}
        return pd.DataFrame({by: group[by].iloc[0], "row": rows, "membership": best["membership"], "label": best["labels"], "loss": best["loss"]})

    kind = dict(matrix.dtypes)
    return _spread(matrix, by).groupBy(by).applyInPandas(run, f"{by} {kind[by]}, row {kind['row']}, membership double, label int, loss double")


def objectives(df: DataFrame, by: str, vector: str, objective: Callable) -> DataFrame:
    """(by, n, objective): the value of a weighted objective of each group's vectors, all weights one half."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([np.asarray(v, float) for v in group[vector]])
        return pd.DataFrame({by: [group[by].iloc[0]], "n": [len(x)], "objective": [float(objective(x, np.full(len(x), 0.5))[0])]})

    return _spread(df, by).groupBy(by).applyInPandas(run, f"{by} {dict(df.dtypes)[by]}, n long, objective double")
