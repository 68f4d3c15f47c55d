"""The pipeline's stages, each on what its predecessor kept of the driver's documents, against brute force."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from duoclust.llm import decontaminate, toxicity
from duoclust.llm.common import table, written

from ..conftest import SF
from .test_pairs_and_strings import edit_distance, jaccard_reference, repeats_reference


def rows_of(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def words_of(texts):
    row, hashes, _, _ = decontaminate._trimmed(pa.array(texts, pa.string()))
    bounds = np.searchsorted(row, np.arange(len(texts) + 1))
    return [hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def leaks(docs, items):
    """Pairs (doc_id, item_id) within the edits of an item, by whole edit distances."""
    out = set()
    for (item, _), w in zip(items, words_of([t for _, t in items]), strict=True):
        most = int((1 - decontaminate.SIMILARITY) * len(w) + 1e-9)
        for (doc, _), d in zip(docs, words_of([t for _, t in docs]), strict=True):
            if len(w) and len(d) and np.isin(w, d).sum() >= len(w) - most and decontaminate.edits_within(w, d)[0] <= most:
                out.add((doc, item))
    return out


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, SF), name)
        out.append((docs, after))
        docs = after
    return out


def test_toxic_documents_go(spark, stages):
    before, after = stages[0]
    model = toxicity.fitted(spark, before, SF)
    scorer, w = toxicity.Scorer(model["words"], model["stems"]), np.array(model["weights"])
    score = lambda t: 1 / (1 + np.exp(-np.clip(np.array(scorer.features(t)) @ w + model["bias"], -30, 30)))
    assert rows_of(after) == [(i, t) for i, t in rows_of(before) if score(t) < corpus_pipeline.TOXIC]


def test_one_of_each_group_stays(stages):
    before, after = map(rows_of, stages[1])
    kept = {i for i, _, c in jaccard_reference(before, 5, 80) if i == c}
    assert after == [(i, t) for i, t in before if i in kept] and len(after) < len(before)


def test_repeats_are_cut(stages):
    before, after = map(rows_of, stages[2])
    left = dict(after)
    for doc, n, removed, _, _ in repeats_reference(before, 100):
        assert (doc not in left and removed) or len(left[doc].encode()) <= n - removed and (removed or left[doc] == dict(before)[doc])
    assert sum(len(t.encode()) for t in left.values()) >= sum(n - r for _, n, r, _, _ in repeats_reference(before, 100)) - 4 * len(before)


def test_benchmark_passages_go(spark, stages):
    before, after = map(rows_of, stages[3])
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    truth = {i for i, _ in leaks(before, items)}
    gone = {i for i, _ in before} - {i for i, _ in after}
    assert gone <= truth and len(gone) >= decontaminate.RECALL * len(truth) and after == [(i, t) for i, t in before if i not in gone]


def test_recall_over_whole_documents(spark):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    truth = leaks(rows_of(docs), [(r["item_id"], r["text"]) for r in items.collect()])
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, items).collect()}
    assert found <= truth and truth and len(found) >= decontaminate.RECALL * len(truth)


def test_rates_meet_the_targets(stages):
    before, after = stages[4]
    got = after.collect()
    assert sorted(r["doc_id"] for r in got) == [i for i, _ in rows_of(before)] and all(r["rate"] >= 0 for r in got)
    assert rows_of(after) == rows_of(before) and set(before.columns) < set(after.columns)  # the corpus, with its rates
    total = sum(r["n_tokens"] for r in got)
    for name, share in corpus_pipeline.TARGETS.items():
        assert sum(r["rate"] * r["n_tokens"] * r[f"p_{name}"] for r in got) == pytest.approx(share * total, rel=2e-3)


def test_edit_distances_agree():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 9, 20).astype(np.uint64), rng.integers(0, 9, 60).astype(np.uint64)
    assert decontaminate.edits_within(a, b)[0] == edit_distance(a.tolist(), b.tolist())


CLASH = ["score", "__sig", "__of", "__left", "__first_doc", "__copy_id", "__text_hash", "__leaks", "rate", "n_tokens", "key", "row", "k", "of"]


def piped(spark, tmp_path, rows):
    """The pipeline over these documents, with labels and benchmark of the driver and columns whose names clash."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.withColumns({c: F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in CLASH}).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, SF, name).write.parquet(f"{tmp_path}/{name}.parquet")
    return corpus_pipeline.run(spark, str(tmp_path))


def test_pipeline_on_hard_rows(spark, tmp_path):
    given = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in table(spark, SF, "documents").limit(60).collect()]
    rows = [*given, (1000, None, None, None, None), (1001, "", None, None, 0), (None, "no id and a few words", "en", "x", 21), given[0], (1002, "word " * 30_000, "en", "x", 150_000)]
    got = piped(spark, tmp_path, rows).collect()
    assert all(r[c] == f"{c}-{'none' if r['doc_id'] is None else r['doc_id']}" for r in got for c in CLASH)
    assert all(r["rate_"] >= 0 and r["n_tokens_"] == len((r["text"] or "").split()) for r in got)
    ids = [r["doc_id"] for r in got]
    assert len(ids) == len(set(ids)) and {None, 1002} <= set(ids) <= {r[0] for r in rows}
    long = next(r for r in got if r["doc_id"] == 1002)
    assert set(long["text"].split()) == {"word"} and long["n_chars"] == len(long["text"])


def test_pipeline_on_no_rows(spark, tmp_path):
    assert piped(spark, tmp_path, []).count() == 0
