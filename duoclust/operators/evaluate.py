"""Scores, summaries, histograms and comparisons of trial tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import without_nan
from .order import numbered

#: Closed intervals of a score; values between two of them are in none.
INTERVALS = [(50, 74), (75, 84), (85, 89), (90, 95), (96, 100)]


def contingency(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))


def mcc(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """50 + 50 |MCC| from a contingency table (t, p, n), for any number of classes; 50 if either side has one class.
    With `by`, one row for each group."""
    keys = by or []
    a = table.groupBy(*keys, "t").agg(F.sum("n").alias("x")).groupBy(*keys).agg(F.sum(F.col("x").cast("double") * F.col("x")).alias("aa"))
    b = table.groupBy(*keys, "p").agg(F.sum("n").alias("x")).groupBy(*keys).agg(F.sum(F.col("x").cast("double") * F.col("x")).alias("bb"))
    left, right = table.groupBy(*keys, F.col("t").alias("k")).agg(F.sum("n").alias("x")), table.groupBy(*keys, F.col("p").alias("k")).agg(F.sum("n").alias("y"))
    both = left.join(right, [*keys, "k"]).groupBy(*keys).agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("ab"))
    whole = table.groupBy(*keys).agg(F.sum("n").cast("double").alias("s"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).cast("double").alias("c"))
    if keys:
        whole = whole.join(a, keys).join(b, keys).join(both, keys, "left")
    else:  # single rows
        whole = whole.crossJoin(a).crossJoin(b).crossJoin(both)
    below = F.sqrt((F.col("s") * F.col("s") - F.col("bb")) * (F.col("s") * F.col("s") - F.col("aa")))
    above = F.col("c") * F.col("s") - F.coalesce("ab", F.lit(0.0))
    return whole.select(*keys, F.when(below > 0, 50 + 50 * F.abs(above / below)).otherwise(F.lit(50.0)).alias("mcc"))


def summary(trials: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, population standard deviation and count of each group; NaN counts as missing."""
    v = without_nan(value)
    return trials.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.count(v).alias("count"))


def curve(summarised: DataFrame, levels: DataFrame, on: list[str]) -> DataFrame:
    """The summary at every level, null where it has no row."""
    return levels.join(summarised, on, "left")


def interval_histogram(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Counts in the closed INTERVALS, a column for each."""
    counts = [F.count(F.when(F.col(value).between(a, b), 1)).alias(f"n_{a}_{b}") for a, b in INTERVALS]
    return df.groupBy(*(keys or [])).agg(*counts)


def equal_width_histogram(df: DataFrame, value: str, cluster: str, bins: int = 24) -> DataFrame:
    """(cluster, bin, n, share): bins of equal width over the pooled range; shares of the cluster's size."""
    limits = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))  # one row
    sizes = df.groupBy(cluster).agg(F.count("*").alias("size"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
    counts = df.crossJoin(F.broadcast(limits)).groupBy(cluster, at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return counts.join(sizes, cluster).select(cluster, "bin", "n", (F.col("n") / F.col("size")).alias("share"))


def top_combinations(df: DataFrame, keys: list[str], score: str, ties: list[str], k: int = 20) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(score), *ties)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by `order`."""
    last = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("k", F.row_number().over(last)).where("k = 1").drop("k")


def unpivot_scores(df: DataFrame, ids: list[str], methods: list[str]) -> DataFrame:
    return df.unpivot(ids, methods, "method", "mcc")


def without_empty_methods(df: DataFrame, method: str, value: str) -> DataFrame:
    """Rows of methods that have a value at all."""
    kept = df.groupBy(method).agg(F.count(without_nan(value)).alias("__values")).where("__values > 0").select(method)
    return df.join(kept, method, "left_semi")


def label_shares(df: DataFrame, cluster: str, labels: list[str]) -> DataFrame:
    return df.groupBy(cluster).agg(*(F.avg(x).alias(f"share_{x}") for x in labels))


def cluster_sizes(df: DataFrame, label: str, least: float = 0.02) -> DataFrame:
    """(label, n, collapsed) for both labels of a partition, also one that is empty."""
    both = df.sparkSession.createDataFrame([(0,), (1,)], f"{label} int")
    counts = df.groupBy(label).agg(F.count("*").alias("m"))
    sized = both.join(counts, label, "left").select(label, F.coalesce("m", F.lit(0)).alias("n"))
    total = sized.agg(F.sum("n").alias("total"), F.min("n").alias("smaller"))  # one row
    return sized.crossJoin(F.broadcast(total)).select(label, "n", (F.col("smaller") < least * F.col("total")).alias("collapsed"))


def compare(expected: DataFrame, observed: DataFrame, keys: list[str], values: list[str], atol: float = 1e-8, rtol: float = 1e-9) -> DataFrame:
    """One row: rows, keys on one side only, largest differences and whether all is within the tolerances; NaN equals NaN."""
    e = expected.select(*keys, F.lit(1).alias("in_e"), *(F.col(v).alias(f"e_{v}") for v in values))
    o = observed.select(*keys, F.lit(1).alias("in_o"), *(F.col(v).alias(f"o_{v}") for v in values))
    both = e.join(o, keys, "full")

    def near(v: str) -> Column:
        a, b = F.col(f"e_{v}"), F.col(f"o_{v}")
        return a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= atol + rtol * F.abs(a), F.lit(False))

    fine = F.col("in_e").isNotNull() & F.col("in_o").isNotNull()
    for v in values:
        fine = fine & near(v)
    return both.agg(
        F.count("*").alias("rows"), F.count(F.when(F.col("in_e").isNull() | F.col("in_o").isNull(), 1)).alias("unmatched"),
        *(F.max(F.abs(F.col(f"e_{v}") - F.col(f"o_{v}"))).alias(f"max_{v}") for v in values), F.coalesce(F.bool_and(fine), F.lit(True)).alias("passed"),
    )


def validated(expected: DataFrame, observed: DataFrame, keys: list[str], values: list[str], atol: float = 1e-8, rtol: float = 1e-9) -> DataFrame:
    """(keys..., column, expected, observed, problem) of every cell that is not as expected: "missing" and "unexpected" keys,
    and values that "differ" by more than the tolerances. NaN and null equal themselves; no rows mean that all is well."""
    cells = lambda v: F.struct(F.lit(v).alias("column"), F.col(f"e_{v}").cast("double").alias("expected"), F.col(f"o_{v}").cast("double").alias("observed"))
    e = expected.select(*keys, F.lit(1).alias("in_e"), *(F.col(v).alias(f"e_{v}") for v in values))
    o = observed.select(*keys, F.lit(1).alias("in_o"), *(F.col(v).alias(f"o_{v}") for v in values))
    each = e.join(o, keys, "full").select(*keys, "in_e", "in_o", F.explode(F.array(*map(cells, values))).alias("c")).select(*keys, "in_e", "in_o", "c.*")
    near = F.col("expected").eqNullSafe(F.col("observed")) | F.coalesce(F.abs(F.col("expected") - F.col("observed")) <= atol + rtol * F.abs("expected"), F.lit(False))
    problem = F.when(F.col("in_o").isNull(), "missing").when(F.col("in_e").isNull(), "unexpected").when(~near, "differs")
    return each.withColumn("problem", problem).where("problem is not null").drop("in_e", "in_o")


def incomplete(summarised: DataFrame, wanted: int) -> DataFrame:
    """Conditions of summary() with another number of values than they should have."""
    return summarised.where(F.coalesce("count", F.lit(0)) != wanted)


def grid(*frames: DataFrame) -> DataFrame:
    """All combinations of small parameter tables."""
    out = frames[0]
    for f in frames[1:]:
        out = out.crossJoin(F.broadcast(f))
    return out


def missing(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Expected keys that are not observed: tasks still to run, conditions still to report."""
    return expected.join(observed.select(*keys).distinct(), keys, "left_anti")


def reused(tasks: DataFrame, known: DataFrame, keys: list[str], value: str) -> DataFrame:
    """tasks with the known value and whether it is still to be computed."""
    found = tasks.join(known.select(*keys, F.col(value).alias(value)), keys, "left")
    return found.withColumn("to_compute", F.col(value).isNull())


def duplicate_clusters(df: DataFrame, vector: str, least: int = 5) -> DataFrame:
    """DBSCAN with a radius under 1 on 0/1 rows: groups of `least` equal rows are clusters, by their vector; other
    rows are noise, -1. Cluster numbers follow the vectors' order."""
    sizes = df.groupBy(vector).agg(F.count("*").alias("size"))
    dense = sizes.where(F.col("size") >= least)
    placed = numbered(dense, vector, name="cluster")
    return df.join(placed.select(vector, F.col("cluster").cast("int").alias("cluster")), vector, "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1)))


def oriented(df: DataFrame, label: str, chosen: int) -> DataFrame:
    return df.withColumn("oriented", (F.col(label) == chosen).cast("int"))


def lower_mean_cluster(df: DataFrame, cluster: str, value: str) -> DataFrame:
    """The cluster with the lower mean, ties to the smaller number."""
    return df.groupBy(cluster).agg(F.avg(value).alias("mean")).orderBy("mean", cluster).limit(1)


def differences(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Rows on one side only, counted as often as they are more there, and which side."""
    return expected.exceptAll(observed).withColumn("side", F.lit("expected")).unionByName(observed.exceptAll(expected).withColumn("side", F.lit("observed")))
