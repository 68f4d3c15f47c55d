"""Information losses of a soft two-way partition, their gradients, and self-information, over sparse tables.

A matrix is (row, feature, value), without zeros; `members` is (row, m) with every row of the matrix, all-zero rows
too, and m its membership in cluster 1. Sums over features are aggregated once and meet the entries again by a join;
sums over all features are single rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import score_model
from .order import numbered

#: Fixed value: added inside logarithms.
EPS = 1e-10
LN2 = 0.6931471805599453


def checked(matrix: DataFrame, model: str = "") -> DataFrame:
    """The matrix; reading it fails if a value is missing, not finite or negative, or over 1 for bernoulli."""
    v = F.col("value").cast("double")
    wrong = v.isNull() | F.isnan(v) | (v < 0) | (v == float("inf")) | ((v > 1) if model and score_model(model) == "bernoulli" else F.lit(False))
    return matrix.withColumn("value", F.when(wrong, F.raise_error(F.lit("a value of the matrix is out of range")).cast("double")).otherwise(v))


def matrix_report(matrix: DataFrame, members: DataFrame) -> DataFrame:
    """One row of what a fit asks of a matrix: rows (two at least), columns (one at least), values out of range, values
    that are not 0 or 1, memberships outside (0, 1), and whether all is sound."""
    v = F.col("value").cast("double")
    off = v.isNull() | F.isnan(v) | (v < 0) | (v == float("inf"))
    x = matrix.agg(F.count_distinct("feature").alias("columns"), F.count_if(off).alias("bad_values"), F.count_if(~off & ~v.isin(0.0, 1.0)).alias("not_binary"))
    m = members.agg(F.count("*").alias("rows"), F.count_if(F.col("m").isNull() | (F.col("m") <= 0) | (F.col("m") >= 1)).alias("bad_memberships"))
    return x.crossJoin(F.broadcast(m)).withColumn("sound", (F.col("rows") >= 2) & (F.col("columns") >= 1) & (F.col("bad_values") == 0) & (F.col("bad_memberships") == 0))


def _weights(c: int) -> Column:
    return F.col("m") if c else 1 - F.col("m")


def _parts(matrix: DataFrame, members: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """(per feature: f0, f1, p, lp, lq, d of each cluster), (one row: W, T, sums over features)."""
    x = matrix.join(members, "row")
    f = x.groupBy("feature").agg(*(F.sum(_weights(c) * F.col("value")).alias(f"f{c}") for c in (0, 1)))
    w = members.agg(*(F.sum(_weights(c)).alias(f"w{c}") for c in (0, 1)))
    t = f.agg(*(F.sum(f"f{c}").alias(f"t{c}") for c in (0, 1)))
    f = f.crossJoin(F.broadcast(w.crossJoin(t)))  # one row
    for c in (0, 1):
        size = F.col(f"w{c}" if model == "bernoulli" else f"t{c}")
        f = f.withColumn(f"p{c}", F.col(f"f{c}") / size)
        f = f.withColumn(f"lp{c}", F.ln(F.col(f"p{c}") + EPS)).withColumn(f"lq{c}", F.ln(1 - F.col(f"p{c}") + EPS) if model != "multinomial" else F.lit(0.0))
        rest = (size - F.col(f"f{c}")) / (1 - F.col(f"p{c}") + EPS) if model != "multinomial" else F.lit(0.0)
        f = f.withColumn(f"d{c}", F.col(f"f{c}") / (F.col(f"p{c}") + EPS) - rest)
        f = f.withColumn(f"s{c}", F.col(f"f{c}") * F.col(f"lp{c}") + ((size - F.col(f"f{c}")) * F.col(f"lq{c}") if model != "multinomial" else 0))
    one = f.agg(*(F.first(k + str(c)).alias(k + str(c)) for k in "wt" for c in (0, 1)), *(F.sum(f"s{c}").alias(f"score{c}") for c in (0, 1)), *(F.sum(f"lq{c}").alias(f"sumlq{c}") for c in (0, 1)), *(F.sum(F.col(f"p{c}") * F.col(f"d{c}")).alias(f"pd{c}") for c in (0, 1)))
    return f, one


def loss(matrix: DataFrame, members: DataFrame, model: str) -> DataFrame:
    """One row: minus the clusters' log scores; bits for bernoulli, nats for the count models."""
    model = score_model(model)
    _, one = _parts(matrix, members, model)
    total = -(F.col("score0") + F.col("score1"))
    return one.select((total / LN2 if model == "bernoulli" else total).alias("loss"))


def gradient(matrix: DataFrame, members: DataFrame, model: str) -> DataFrame:
    """(row, g): the derivative of the loss by each row's membership."""
    model = score_model(model)
    f, one = _parts(matrix, members, model)
    f = f.select("feature", *(k + str(c) for k in ("lp", "lq", "d") for c in (0, 1)))
    x = matrix.join(f, "feature")
    lean = "(lp{c} - lq{c})" if model != "multinomial" else "lp{c}"
    sums = x.groupBy("row").agg(F.sum("value").alias("r"), *(F.sum(F.expr(f"value * {lean.format(c=c)}")).alias(f"v{c}") for c in (0, 1)), *(F.sum(F.expr(f"value * d{c}")).alias(f"vd{c}") for c in (0, 1)))
    rows = members.select("row").join(sums, "row", "left").na.fill(0.0).crossJoin(F.broadcast(one))  # one row
    g = {}
    for c in (0, 1):
        if model == "bernoulli":
            g[c] = (F.col(f"v{c}") + F.col(f"sumlq{c}") + (F.col(f"vd{c}") - F.col(f"pd{c}")) / F.col(f"w{c}")) / LN2
        else:
            g[c] = F.col(f"v{c}") + (F.col("r") * F.col(f"sumlq{c}") if model == "binomial" else 0) + (F.col(f"vd{c}") - F.col("r") * F.col(f"pd{c}")) / F.col(f"t{c}")
    return rows.select("row", (g[0] - g[1]).alias("g"))


def slope_audit(matrix: DataFrame, members: DataFrame, step: float = 1e-4) -> DataFrame:
    """(row, g, slope): each row's derivative of the bernoulli loss, and the central difference of the loss when that one
    membership moves by `step` either way. Nothing is fitted again: a move changes the sizes of the clusters alike for all
    rows, which is one sum over features, and the totals of the row's own features, a sum over its entries."""
    f, _ = _parts(matrix, members, "bernoulli")
    f = f.select("feature", "f0", "f1", "w0", "w1")

    def score_at(c: int, sign: float, moved: bool) -> Column:
        turn = sign * step if c else -sign * step
        size, at = F.col(f"w{c}") + turn, F.col(f"f{c}") + (turn * F.col("value") if moved else F.lit(0.0))
        return at * F.ln(at / size + EPS) + (size - at) * F.ln(1 - at / size + EPS)

    def change(moved: bool) -> Column:
        return sum((score_at(c, 1.0, moved) - score_at(c, -1.0, moved) for c in (0, 1)), F.lit(0.0))

    base = f.agg(F.sum(change(False)).alias("base"))
    own = matrix.join(f, "feature").groupBy("row").agg(F.sum(change(True) - change(False)).alias("own"))
    rows = gradient(matrix, members, "bernoulli").join(own, "row", "left").crossJoin(F.broadcast(base))  # one row
    return rows.select("row", "g", (-(F.col("base") + F.coalesce("own", F.lit(0.0))) / (2 * step) / LN2).alias("slope"))


def loo_self_information(matrix: DataFrame, labels: DataFrame, smoothing: float = 0.5, features: int | None = None) -> DataFrame:
    """(row, label, bits): mean bits a token of each row has under its own cluster without the row. `features` is the
    number of columns of the matrix, those that occur by default."""
    x = matrix.join(labels, "row")
    f = x.groupBy("label", "feature").agg(F.sum("value").alias("f"))
    t = f.groupBy("label").agg(F.sum("f").alias("t"))
    n = matrix.agg((F.countDistinct("feature") if features is None else F.lit(features)).alias("columns"))  # one row
    r = matrix.groupBy("row").agg(F.sum("value").alias("r"))
    each = x.join(f, ["label", "feature"]).join(F.broadcast(t), "label").join(r, "row").crossJoin(F.broadcast(n))
    share = (F.col("f") - F.col("value") + smoothing) / (F.col("t") - F.col("r") + smoothing * F.col("columns"))
    return each.groupBy("row", "label").agg((-F.sum(F.col("value") * F.log2(share)) / F.first("r")).alias("bits"))


def soft_loo_mean(matrix: DataFrame, members: DataFrame, smoothing: float = 0.5) -> DataFrame:
    """One row (mean0, mean1): the weighted mean self-information of each soft cluster, a row's own share left out."""
    x = matrix.join(members, "row")
    f = x.groupBy("feature").agg(*(F.sum(_weights(c) * F.col("value")).alias(f"f{c}") for c in (0, 1)))
    t = f.agg(F.sum("f0").alias("t0"), F.sum("f1").alias("t1"), F.count("*").alias("columns"))
    r = matrix.groupBy("row").agg(F.sum("value").alias("r"))
    each = x.join(f, "feature").join(r, "row").crossJoin(F.broadcast(t))  # one row
    bits = []
    for c in (0, 1):
        share = (F.col(f"f{c}") - _weights(c) * F.col("value") + smoothing) / (F.col(f"t{c}") - _weights(c) * F.col("r") + smoothing * F.col("columns"))
        bits.append((-F.sum(F.col("value") * F.log2(share)) / F.first("r")).alias(f"b{c}"))
    rows = each.groupBy("row", "m").agg(*bits)
    return rows.agg(*((F.sum(_weights(c) * F.col(f"b{c}")) / F.sum(_weights(c))).alias(f"mean{c}") for c in (0, 1)))


def penalised_loss(matrix: DataFrame, members: DataFrame, model: str, weight: float, target: float, smoothing: float = 0.5) -> DataFrame:
    """One row (loss, model_loss, penalty, gap): the loss times 1 + weight * max(0, target - gap) ** 2, where the gap
    is the difference of the clusters' soft means in bits."""
    gap = F.abs(F.col("mean0") - F.col("mean1"))
    both = loss(matrix, members, model).withColumnRenamed("loss", "model_loss").crossJoin(soft_loo_mean(matrix, members, smoothing))  # single rows
    short = F.greatest(F.lit(0.0), F.lit(float(target)) - gap)
    return both.select((F.col("model_loss") * (1 + weight * short * short)).alias("loss"), "model_loss", (weight * short * short).alias("penalty"), gap.alias("gap"))


def soft_loo_gradient(matrix: DataFrame, members: DataFrame, smoothing: float = 0.5) -> DataFrame:
    """(row, mean0, mean1, g0, g1): the soft means and their derivatives by each row's membership. Rows without entries
    take no part in the means: their derivatives are 0."""
    x = matrix.join(members, "row")
    f = x.groupBy("feature").agg(*(F.sum(_weights(c) * F.col("value")).alias(f"f{c}") for c in (0, 1)))
    t = f.agg(F.sum("f0").alias("t0"), F.sum("f1").alias("t1"), F.count("*").alias("columns"))
    r = matrix.groupBy("row").agg(F.sum("value").alias("r"))
    each = x.join(f, "feature").join(r, "row").crossJoin(F.broadcast(t))  # one row
    for c in (0, 1):
        top = F.col(f"f{c}") - _weights(c) * F.col("value") + smoothing
        below = F.col(f"t{c}") - _weights(c) * F.col("r") + smoothing * F.col("columns")
        each = each.withColumns({f"l{c}": F.col("value") * F.log2(top / below), f"a{c}": _weights(c) * F.col("value") / F.col("r") / top, f"q{c}": _weights(c) / below})
    share = each.groupBy("feature").agg(F.sum("a0").alias("s0"), F.sum("a1").alias("s1"))
    own = [(-F.sum(f"l{c}") / F.first("r")).alias(f"b{c}") for c in (0, 1)] + [F.sum(F.col("value") * (F.col(f"s{c}") - F.col(f"a{c}"))).alias(f"h{c}") for c in (0, 1)]
    rows = each.join(share, "feature").groupBy("row", "m").agg(F.first("r").alias("r"), F.first("q0").alias("q0"), F.first("q1").alias("q1"), *own)
    one = rows.agg(*(F.sum(_weights(c)).alias(f"w{c}") for c in (0, 1)), *(F.sum(f"q{c}").alias(f"all_q{c}") for c in (0, 1)), *((F.sum(_weights(c) * F.col(f"b{c}")) / F.sum(_weights(c))).alias(f"mean{c}") for c in (0, 1)))
    out = members.select("row").join(rows, "row", "left").crossJoin(F.broadcast(one))  # one row
    g = {}
    for c in (0, 1):
        through = (F.col(f"h{c}") - F.col("r") * (F.col(f"all_q{c}") - F.col(f"q{c}"))) / LN2
        by_weight = (F.col(f"b{c}") - F.col(f"mean{c}") - through) / F.col(f"w{c}")
        g[c] = F.coalesce(by_weight if c else -by_weight, F.lit(0.0)).alias(f"g{c}")
    return out.select("row", "mean0", "mean1", g[0], g[1])


def penalised_gradient(matrix: DataFrame, members: DataFrame, model: str, weight: float, target: float, smoothing: float = 0.5) -> DataFrame:
    """(row, g): the derivative of the penalised loss by each row's membership."""
    model_g = gradient(matrix, members, model)
    if not weight or not target:
        return model_g
    both = model_g.join(soft_loo_gradient(matrix, members, smoothing), "row").crossJoin(F.broadcast(loss(matrix, members, model)))  # one row
    apart = F.col("mean1") - F.col("mean0")
    short = F.greatest(F.lit(0.0), F.lit(float(target)) - F.abs(apart))
    wider = F.signum(apart) * (F.col("g1") - F.col("g0"))
    return both.select("row", (F.col("g") * (1 + weight * short * short) - F.col("loss") * 2 * weight * short * wider).alias("g"))


def cluster_stats(matrix: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each cluster: rows, tokens, vocabulary, entropy in bits, its share of the possible, repetition and
    the shares of the 10 and 100 most frequent features."""
    f = matrix.join(labels, "row").groupBy("label", "feature").agg(F.sum("value").alias("f")).where("f > 0")
    order = Window.partitionBy("label").orderBy(F.desc("f"), "feature")
    f = f.withColumn("k", F.row_number().over(order))
    t = f.groupBy("label").agg(F.sum("f").alias("t"))
    f = f.join(F.broadcast(t), "label").withColumn("p", F.col("f") / F.col("t"))
    out = f.groupBy("label").agg(F.first("t").cast("double").alias("tokens"), F.count("*").alias("vocabulary"), (-F.sum(F.col("p") * F.log2("p"))).alias("entropy"), *(F.sum(F.when(F.col("k") <= k, F.col("p")).otherwise(0.0)).alias(f"top{k}_share") for k in (10, 100)))
    sizes = labels.groupBy("label").agg(F.count("*").alias("rows"))
    return out.join(sizes, "label").select("label", "rows", "tokens", "vocabulary", "entropy", F.when(F.col("vocabulary") > 1, F.col("entropy") / F.log2(F.col("vocabulary").cast("double"))).otherwise(0.0).alias("normalized_entropy"), (1 - F.col("vocabulary") / F.col("tokens")).alias("repetition"), "top10_share", "top100_share")


def orientation(matrix: DataFrame, labels: DataFrame, smoothing: float = 0.5, tie: float = 1e-9) -> DataFrame:
    """One row: the formulaic cluster, of lower mean self-information or, in a tie, of higher repetition; and whether
    both diagnostics agree."""
    bits = loo_self_information(matrix, labels, smoothing).groupBy("label").agg(F.avg("bits").alias("bits"))
    both = bits.join(cluster_stats(matrix, labels).select("label", "repetition"), "label")
    one = both.agg(*(F.max(F.when(F.col("label") == c, F.col(v))).alias(f"{v}{c}") for v in ("bits", "repetition") for c in (0, 1)))
    by_bits, by_repeats = F.when(F.col("bits1") < F.col("bits0"), 1).otherwise(0), F.when(F.col("repetition1") > F.col("repetition0"), 1).otherwise(0)
    tied = F.abs(F.col("bits0") - F.col("bits1")) <= tie
    return one.select(F.when(tied, by_repeats).otherwise(by_bits).alias("formulaic_cluster"), tied.alias("tied"), (by_bits == by_repeats).alias("diagnostics_agree"), "bits0", "bits1", "repetition0", "repetition1")


def row_totals(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("row").agg(F.sum("value").alias("total"), F.count(F.when(F.col("value") != 0, 1)).alias("types"))


def median_split(projection: DataFrame, value: str) -> DataFrame:
    """(row, m): 0.9 for the upper half of the rows by value, ties by row, and 0.1 for the rest."""
    p = projection.select("row", F.col(value).alias("v"))
    total = p.agg(F.count("*").alias("total"))
    placed = numbered(p, "v", "row").crossJoin(F.broadcast(total))  # one row
    return placed.select("row", F.when(F.col("place") >= F.floor(F.col("total") / 2), 0.9).otherwise(0.1).alias("m"))
