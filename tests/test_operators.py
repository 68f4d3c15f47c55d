from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from duoclust.functions import scalar
from duoclust.operators import evaluate, inference, score, text
from duoclust.plans import benchmarks
from duoclust.sources import io


def sequence(spark, docs, key=0):
    rows = [(key, i, len(docs), list(d)) for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, "key int, seq long, n_docs long, toks array<string>")


def windows(docs, w):
    n = len(docs)
    return [[t for d in docs[i - min(i, w) : i + min(n - i - 1, w)] for t in d] for i in range(n)]


def test_window_membership(spark):
    docs = [["0"], ["1"], ["2"], ["3"], ["4"]]
    got = {r["seq"]: r["toks"] for r in text.running_windows(sequence(spark, docs), 2).collect()}
    assert got == {0: ["0", "1"], 1: ["0", "1", "2"], 2: ["0", "1", "2", "3"], 3: ["1", "2", "3"], 4: ["2", "3"]}


@pytest.mark.parametrize("seed", range(4))
def test_counts_equal_counts_of_built_windows(spark, seed):
    rng = random.Random(seed)
    docs = [[rng.choice("abc") for _ in range(rng.randint(0, 4))] for _ in range(rng.randint(1, 9))]
    n, w = rng.randint(1, 3), rng.randint(1, 4)
    order, first = {}, {}
    for i, t in enumerate(windows(docs, w)):
        for k in range(len(t) - n + 1):
            g = " ".join(t[k : k + n])
            order[g] = order.get(g, 0) + 1
            first.setdefault(g, len(first))
    found = text.occurrences(sequence(spark, docs), n, w)
    ranked = text.ranked(text.feature_counts(found), 100).select(scalar.display("feature").alias("g"), "cnt", "rank").orderBy("rank").collect()
    assert [(r["g"], r["cnt"]) for r in ranked] == sorted(order.items(), key=lambda x: (-x[1], first[x[0]]))


def test_one_sequence_over_many_ranges(spark):
    """Numbering, places, windows and n-grams of one sequence that no task holds equal those of plain Python."""
    rng = random.Random(5)
    docs = [[rng.choice("abcd") for _ in range(rng.choice([0, 0, 1, 2, 5]))] for _ in range(400)]
    df = spark.createDataFrame([(7, i, d) for i, d in enumerate(docs)] + [(None, 1, ["x"]), (None, 0, ["y", "y"])], "k int, t int, toks array<string>")
    placed = text.sequences(df.repartition(5), "k", ["t"], ranges=8, toks=F.col("toks")).cache()
    one = placed.where("key = 7").orderBy("seq").collect()
    assert [r["toks"] for r in one] == docs and [r["seq"] for r in one] == list(range(400)) and {r["n_docs"] for r in one} == {400}
    assert [r["before"] for r in one] == [sum(map(len, docs[:i])) for i in range(400)]
    assert sorted((r["seq"], r["before"], r["toks"][0]) for r in placed.where("key IS NULL").collect()) == [(0, 0, "y"), (1, 2, "x")]
    ranged = df.repartitionByRange(8, "k", "t").select("k", F.spark_partition_id().alias("p")).where("k = 7").distinct()
    assert ranged.count() >= 7  # one sequence, many tasks
    wide = {r["seq"]: r["toks"] for r in text.running_windows(placed.where("key = 7"), 3, block=16).collect()}
    assert [wide[i] for i in range(400)] == windows(docs, 3)
    flat = [(t, i) for i, d in enumerate(docs) for t in d]
    for n in (1, 2, 4):
        got = sorted((r["place"], r["feature"], r["ds"], r["de"]) for r in text.ngram_spans(placed.where("key = 7"), n, block=8).collect())
        want = [(k + 1, [t for t, _ in flat[k : k + n]], flat[k][1], flat[k + n - 1][1]) for k in range(len(flat) - n + 1) if flat[k + n - 1][1] <= 398]
        assert got == want


def test_ngrams_and_ties(spark):
    df = spark.createDataFrame([(["a", "b", "c"],)], "t array<string>")
    assert df.select(scalar.ngrams("t", 2)).first()[0] == [["a", "b"], ["b", "c"]]
    assert df.select(scalar.ngrams("t", 4)).first()[0] == []


def test_interval_histogram_has_holes(spark):
    df = spark.createDataFrame([(float(v),) for v in (50, 74, 74.5, 75, 89.5, 96, 100)], "v double")
    assert tuple(evaluate.interval_histogram(df, "v").first()) == (2, 1, 0, 0, 2)


def test_summary_skips_nan(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("b", float("nan"))], "k string, v double")
    got = {r["k"]: (r["mean"], r["std"], r["count"]) for r in evaluate.summary(df, ["k"], "v").collect()}
    assert got == {"a": (1.0, 0.0, 1), "b": (None, None, 0)}
    assert [r["k"] for r in evaluate.without_empty_methods(df, "k", "v").select("k").distinct().collect()] == ["a"]


def test_mcc_by_group_and_golden(spark):
    rows = [("a", t, p, n) for t, p, n in ((1, 1, 447), (0, 1, 28), (1, 0, 27), (0, 0, 356))] + [("b", 1, 1, 93), ("b", 0, 1, 363), ("b", 1, 0, 381), ("b", 0, 0, 8), ("c", 1, 1, 3)]
    got = {r["g"]: r["mcc"] for r in evaluate.mcc(spark.createDataFrame(rows, "g string, t int, p int, n long"), ["g"]).collect()}
    assert got["a"] == pytest.approx(93.51694504077723, rel=1e-12) and got["b"] == pytest.approx(88.94266482278707, rel=1e-12) and got["c"] == 50.0


def test_tails(spark):
    df = spark.createDataFrame([(6.261164371350848, 9.99990000099999e-06), (19.73236787455156, None)], "z double, p double")
    a, b = df.select(inference.two_sided_p("z").alias("q"), inference.z_of_p("p").alias("y")).collect()
    assert a["q"] == pytest.approx(3.8211348939828046e-10, rel=1e-9) and b["q"] == pytest.approx(1.1371707271331186e-86, rel=1e-9)
    assert a["y"] == pytest.approx(4.417175575733926, rel=1e-9) and b["y"] is None


def test_permutation_test(spark):
    far = inference.permutation_test([0.0] * 10 + [5.0] * 10, [True] * 10 + [False] * 10, spark, 3000).first()
    assert far["is_lower_bound"] and far["p"] == pytest.approx(1 / 3001)
    near = inference.permutation_test([0.0, 1.0] * 10, [True] * 10 + [False] * 10, spark, 1000).first()
    assert near["p"] == 1.0


def test_scalars(spark):
    df = spark.createDataFrame([(1.0, 10, 2, None), (0.5, 3, 1, 100)], "p double, n int, w int, f int")
    assert [r[0] for r in df.select(scalar.probability_label("p")).collect()] == ["1", "0.5"]
    assert [r[0] for r in df.select(scalar.result_key("n", "w", "f")).collect()] == ["n-10_l-2_f-all", "n-3_l-1_f-100"]
    seed = df.select(scalar.wrapped_seed(F.lit(str((1 << 64) - 1)).cast("decimal(20,0)"), F.lit(3)).alias("s")).first()["s"]
    assert int(seed) == ((1 << 64) - 1 + 3 * 0x9E3779B97F4A7C15) % (1 << 64)
    assert scalar.score_model("Binary") == "bernoulli"
    with pytest.raises(ValueError, match="unknown"):
        scalar.score_model("poisson")


def test_matrix_values_are_checked(spark):
    good = spark.createDataFrame([(1, "a", 1.0)], "row long, feature string, value double")
    assert score.checked(good, "bernoulli").count() == 1
    with pytest.raises(Exception, match="out of range"):
        score.checked(good.withColumn("value", F.lit(2.0)), "bernoulli").collect()


def test_median_split_breaks_ties_by_row(spark):
    df = spark.createDataFrame([(4, 1.0), (1, 1.0), (2, 1.0), (3, 0.0), (5, 9.0)], "row long, v double")
    assert {r["row"]: r["m"] for r in score.median_split(df, "v").collect()} == {3: 0.1, 1: 0.1, 2: 0.9, 4: 0.9, 5: 0.9}


def test_annotations_keep_repeated_keys(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("Book,Chapter,Verse,P,H\r\nLev,4,30,1,0\r\n\r\nLev,4,31,1,0\r\nLev,4,31,0,1\r\n")
    rows = io.annotations(spark, str(p), "P").orderBy("seq").collect()
    assert [(r["verse"], r["label"], r["seq"]) for r in rows] == [(30, 1, 0), (31, 1, 1), (31, 0, 2)]
    texts = spark.createDataFrame([("Lev", 4, 31, ["a"], ["A"])], io.CORPUS)
    ann = io.annotations(spark, str(p), "P")
    assert io.annotated_documents(ann.where("verse = 31"), texts).count() == 2
    with pytest.raises(Exception, match="no text for"):
        io.annotated_documents(ann, texts).select("morph").collect()


def test_resume(spark, tmp_path):
    config = benchmarks.Config(simulations=1, rows_per_cluster=10, restarts=1, iterations=10)
    tasks = benchmarks.categorical_tasks(spark, config).where("panel = 2 and fraction > 0.75")
    calls = []

    def run(t):
        calls.append(t.count())
        return benchmarks.categorical_trials(t, config)

    keys, path = ["panel", "fraction", "simulation"], str(tmp_path / "trials")
    first = benchmarks.resumed(tasks.where("fraction < 0.85"), run, keys, io.TRIALS, path, config)
    assert first.count() == 4
    assert benchmarks.resumed(tasks, run, keys, io.TRIALS, path, config).count() == 8
    assert calls == [1, 1]
    with pytest.raises(ValueError, match="columns differ"):
        io.append(first.drop("mcc"), path, io.TRIALS)


def test_batches_count_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    """A run that ends between its rows and its manifest adds nothing; the next one adds each row once."""
    path, config, keys = str(tmp_path / "trials"), benchmarks.Config(simulations=1), ["panel", "fraction", "simulation"]
    tasks = benchmarks.categorical_tasks(spark, config).where("panel = 8")

    def run(left):
        names = [c.split()[0] for c in io.TRIALS.split(", ")]
        made = left.withColumns({"method": F.lit("x"), "mcc": F.lit(1.0), "information_loss": F.lit(None).cast("double"), "optimizer_success": F.lit(None).cast("boolean"), "config": F.lit(config.digest())})
        return made.select(*names)

    whole = io._publish
    calls = []

    def killed(*args):
        calls.append(1)
        if len(calls) == 2:
            raise KeyboardInterrupt
        return whole(*args)

    monkeypatch.setattr(io, "_publish", killed)
    with pytest.raises(KeyboardInterrupt):
        benchmarks.resumed(tasks, run, keys, io.TRIALS, path, config, batches=3)
    kept = io.batches(spark, path, io.TRIALS).count()
    assert 0 < kept < 9  # the first batch; rows of the second are written, and nobody reads them
    for _ in range(2):
        got = benchmarks.resumed(tasks, run, keys, io.TRIALS, path, config, batches=3)
        assert got.count() == got.select(*keys).distinct().count() == 9
    assert io.batches(spark, str(tmp_path / "none"), io.TRIALS).count() == 0


def test_expected_tables_are_checked(spark, tmp_path):
    io.write_csv(spark.createDataFrame([("a", 1, 0.5), ("b", 2, None)], "k string, n int, v double"), f"{tmp_path}/e")
    table = io.expected(spark, f"{tmp_path}/e", "v double, k string, n int")
    assert {r["k"]: (r["n"], r["v"]) for r in table.collect()} == {"a": (1, 0.5), "b": (2, None)}
    with pytest.raises(ValueError, match="columns differ"):
        io.expected(spark, f"{tmp_path}/e", "k string, n int")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        io.expected(spark, f"{tmp_path}/e", "k int, n int, v double").collect()
    seen = spark.createDataFrame([("a", 1, 0.5 + 1e-10), ("c", 3, 1.0)], "k string, n int, v double")
    got = {(r["k"], r["column"]): r["problem"] for r in evaluate.validated(table, seen, ["k"], ["n", "v"]).collect()}
    assert got == {("b", "n"): "missing", ("b", "v"): "missing", ("c", "n"): "unexpected", ("c", "v"): "unexpected"}
    assert evaluate.validated(table, seen.withColumn("v", F.col("v") + 1), ["k"], ["v"]).where("k = 'a'").first()["problem"] == "differs"
    assert [r["count"] for r in evaluate.incomplete(evaluate.summary(seen, ["k"], "v"), 2).collect()] == [1, 1]


@pytest.mark.parametrize("call", [
    lambda s: text.running_windows(s, 0), lambda s: text.occurrences(s, 0, 2), lambda s: text.occurrences(s, 1, -1), lambda s: text.counts_by_width(s, [0]), lambda s: inference.thresholds(s, 0, 1), lambda s: inference.thresholds(s, 5, True),
])
def test_arguments_out_of_range(spark, call):
    with pytest.raises(ValueError):
        call(sequence(spark, [["a"]]))


def test_retries_change_the_seed():
    seen = []

    def run(seed):
        seen.append(seed)
        raise FloatingPointError

    score, reason = benchmarks.attempted(run, 5)
    assert math.isnan(score) and reason and len(set(seen)) == 5


def test_sweep(spark):
    docs = sequence(spark, [["a", "b"], ["a", "c"], ["d", "e"], ["d", "d"], ["a", "b"], ["e", "d"]])
    labels = spark.createDataFrame([(i, int(i in (0, 1, 4))) for i in range(6)], "row long, label int")
    out = benchmarks.text_sweep(docs, labels, [1, 2], [2], [2, None], restarts=1, iterations=20)
    assert sorted(r["combination"] for r in out.collect()) == ["n-1_l-2_f-2", "n-1_l-2_f-all", "n-2_l-2_f-2", "n-2_l-2_f-all"]


def test_lock_file_and_json(spark, tmp_path):
    p = tmp_path / "lock"
    p.write_text("# pins\n\nnumpy==0.0.1\nnot-there==1\n")
    locked = io.lock_file(spark, str(p))
    assert [tuple(r) for r in locked.collect()] == [("numpy", "0.0.1"), ("not-there", "1")]
    assert len(io.environment_differences(locked)) == 2
    assert io.compare_json({"a": [1.0, True]}, {"a": [1.0 + 1e-12, True]}) == []
    assert len(io.compare_json({"a": 1, "b": True}, {"a": 2, "c": 1})) == 3


def test_entry_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def _panel(spark, rows, values):
    one = [k % 3 == 0 for k in range(len(rows))]
    df = spark.createDataFrame(list(zip(rows, values, one, strict=True)), "row long, v double, one boolean")
    return df, one


def _counter_exceedances(rows, v, one, replicates):
    n1, n2, hits = sum(one), len(one) - sum(one), 0
    seen = abs(v[one].mean() - v[~one].mean())
    for k in range(replicates):
        h = inference._drawn(pa.array(rows), np.array([k]), "counter")[:, 0]
        s = v[h <= np.sort(h)[n1 - 1]].sum()
        hits += abs(s * (1 / n1 + 1 / n2) - v.sum() / n2) >= seen - 1e-9
    return hits


@pytest.mark.parametrize("rows", [list(range(6)), [3 * k + 7 for k in range(3000)], [k << 40 for k in range(70)], [-k for k in range(500)]])
def test_permutations_are_those_of_sorted_numbers(spark, rows):
    """Few rows, many, rows whose numbers agree in their upper halves, and rows under zero."""
    v = np.random.default_rng(len(rows)).normal(0, 1, len(rows))
    df, one = _panel(spark, rows, v.tolist())
    got = inference.permutation_by_hash(df, "v", "one", 1500, draw="counter").first()
    assert got["exceedances"] == _counter_exceedances(rows, v, np.array(one), 1500)


def test_few_rows_have_many_tasks_in_a_permutation_test(spark, monkeypatch):
    """One partition of rows is not one task of all replicates, and blocks of rows add up."""
    rows = list(range(2000))
    v = np.random.default_rng(1).normal(0, 1, len(rows))
    df, one = _panel(spark, rows, v.tolist())
    seen = []
    plain = type(df).repartitionById
    monkeypatch.setattr(type(df), "repartitionById", lambda self, n, c: seen.append(n) or plain(self, n, c))
    monkeypatch.setattr(inference, "ROWS", 300)
    got = inference.permutation_by_hash(df.coalesce(1), "v", "one", 3000, draw="counter").first()
    assert got["exceedances"] == _counter_exceedances(rows, v, np.array(one), 3000) and seen[0] >= 14


@pytest.mark.parametrize("odd", [None, "\0", "a b"])
def test_sweep_counts_are_those_of_all_spans(spark, odd):
    """Windows wider and narrower than the sequence, empty documents, n-grams over several documents, any tokens."""
    rng = random.Random(5)
    docs = [[rng.choice(["a", "b", "c", odd or "d"]) for _ in range(rng.choice([0, 1, 1, 2, 5, 9]))] for _ in range(70)]
    df = sequence(spark, docs)
    for widths, top in (([2, 3], 6), ([4, 1, 9], 1000), ([80], 3)):
        got = sorted(tuple(r) for r in benchmarks.sweep_counts(df, [1, 2, 4], widths, top).collect())
        want = []
        for n in (1, 2, 4):
            counts = text.counts_by_width(text.ngram_spans(df, n), widths).collect()
            for w in widths:
                mine = sorted((-r["cnt"], r["first"], r["feature"]) for r in counts if r["width"] == w)
                want += [(n, w, f, -c, k, len(mine), -sum(m[0] for m in mine)) for k, (c, _, f) in enumerate(mine[:top], 1)]
        assert got == sorted(want)


def test_inner_ngrams_and_the_others_are_all_spans(spark):
    df = sequence(spark, [list("abcab"), [], list("b"), list("ca"), list("abcabcab"), list("c"), list("ab"), list("cc")] * 3)
    for n in (1, 2, 3):
        parts = text.ngram_spans(df, n, near=3, block=4).select("feature", "place").union(text.inner_ngrams(df, n, 3))
        assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, text.ngram_spans(df, n).select("feature", "place").collect()))
        assert text.ngram_spans(df, n, near=3).count() < text.ngram_spans(df, n).count()
