"""Joins, repeated strings, benchmark passages and top-k against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from duoclust.llm import decontaminate, exact_topk, ngram_join, suffix_dedup
from duoclust.llm.common import text_bytes, words_of
from duoclust.llm.induced_sort import suffix_array

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed, n=60):
    """Copies, near copies, shared passages, short and empty texts, nulls and repeated rows."""
    rng = random.Random(seed)
    out, passage = [], " ".join(words(rng, 40))
    base = words(rng, 120)
    for i in range(n):
        kind = i % 8
        if kind == 0:
            t = " ".join(base)
        elif kind in (1, 2):
            w = list(base)
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            t = ("\n" if kind == 2 else " ").join(w)
        elif kind == 3:
            t = " ".join(words(rng, 30)) + "\t" + passage + " " + " ".join(words(rng, 5))
        elif kind == 4:
            t = " ".join(words(rng, rng.randint(1, 5)))
        elif kind == 5:
            t = rng.choice(["", "   ", None, "É" * 130, "ab " * 90])
        else:
            t = " ".join(words(rng, rng.randint(20, 200)))
        out.append((i, t))
    return [*out, (1000, "z " * 40_000), out[0], out[3], (1001, None)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t)) for i, t in rows], DOC)


def jaccard_reference(rows, width, percent):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(low))
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(i, least.get(root(k), i))
    return sorted((i, len(sets[k]), least[root(k)]) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize(("seed", "width", "percent"), [(1, 4, 85), (2, 5, 80)])
def test_jaccard_components(spark, seed, width, percent):
    rows = corpus(seed)
    got = ngram_join.jaccard_components(frame(spark, rows), width, percent).collect()
    assert sorted(map(tuple, got)) == jaccard_reference(rows, width, percent)


def test_large_regions_join_recursively(spark, monkeypatch):
    """With tiny bounds every level of the recursion has work to do."""
    rng = random.Random(5)
    base = words(rng, 60, 10**6)
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(ngram_join, "SMALL", 2)
    monkeypatch.setattr(ngram_join, "PIVOTS", 2)
    got = ngram_join.jaccard_components(frame(spark, rows), 4, 85).collect()
    assert sorted(map(tuple, got)) == jaccard_reference(rows, 4, 85)


@pytest.mark.parametrize("percent", [85, 80, 100])
def test_a_passage_most_of_many_texts_links_some(spark, monkeypatch, percent):
    """A region whose members share a passage and differ in how much else they hold; the last level meets by sizes."""
    rng, passage = random.Random(7), words(random.Random(8), 100, 10**6)
    rows = [(i, " ".join(words(rng, rng.randint(0, 25), 10**6) + passage)) for i in range(80)]
    for name, value in (("SMALL", 2), ("PIVOTS", 1), ("LEVELS", 1)):
        monkeypatch.setattr(ngram_join, name, value)
    got = ngram_join.jaccard_components(frame(spark, rows), 4, percent).collect()
    assert sorted(map(tuple, got)) == jaccard_reference(rows, 4, percent)


def test_one_of_each_keeps_columns(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, ""), (None, "a b c d e f")]
    kept = ngram_join.one_of_each(frame(spark, rows).selectExpr("*", "1 as sig", "2 as component_id"))
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 3, 4]
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "sig", "component_id"]


def repeats_reference(rows, length):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: r[0]):
        data = (t or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        kept = bytes(np.frombuffer(data, np.uint8)[~gone[:-1]])
        spans = int((gone[:-1] & ~np.concatenate(([False], gone[:-2] if len(data) else gone[:0]))[: len(data)]).sum())
        out.append((i, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed", [3, 4])
def test_repeats(spark, seed):
    rows = corpus(seed)
    got = suffix_dedup.repeats(frame(spark, rows).withColumnRenamed("lang", "sig").withColumnRenamed("source", "hash"), 100).collect()
    assert sorted(map(tuple, got)) == repeats_reference(rows, 100)


def test_clean_cuts_the_later_copy(spark):
    passage = " ".join(f"word{k}" for k in range(40)) + " "
    rows = [(1, "first " + passage), (2, passage + " second"), (3, passage.strip() + "   "), (4, "short"), (5, ""), (6, None)]
    kept = {r["doc_id"]: r["text"] for r in suffix_dedup.clean(frame(spark, rows)).collect()}
    assert kept[1] == rows[0][1] and kept[4] == "short" and kept[5] == "" and kept[6] is None
    assert "second" in kept[2] and passage not in kept[2]


def test_suffix_array_is_right():
    rng = random.Random(1)
    for _ in range(150):
        t = np.array([rng.randint(1, rng.choice([1, 2, 5])) for _ in range(rng.randint(1, 120))] + [0], np.uint16)
        b = bytes(t.astype(np.uint8))
        assert suffix_array(t, 300).tolist() == sorted(range(len(t)), key=lambda i: b[i:])


def test_empty_tables(spark):
    none = frame(spark, [])
    assert ngram_join.jaccard_components(none).count() == 0
    assert suffix_dedup.repeats(none).count() == 0
    assert decontaminate.matches(none, spark.createDataFrame([(1, "a b c")], "item_id long, text string")).count() == 0
    assert decontaminate.matches(frame(spark, [(1, "a b c")]), spark.createDataFrame([], "item_id long, text string")).count() == 0
    vectors = exact_topk.integer_vectors(spark.createDataFrame([], "id long, v array<float>"), "id", "v")
    assert exact_topk.top_k(vectors, F.col("vec_id") == 1).count() == 0


def edit_distance(a, b):
    """Least edits of a to any run of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_edits_within_is_exact():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 12)).astype(np.uint64), rng.integers(0, 4, rng.integers(0, 20)).astype(np.uint64)
        edits, x, y = decontaminate.edits_within(a, b)
        assert edits == edit_distance(a.tolist(), b.tolist())
        assert edit_distance(a.tolist(), b[x:y].tolist()) == edits


def test_walks_agree_as_assumed():
    rng = random.Random(3)
    agree, reps = [], decontaminate.repetitions()
    for _ in range(60):
        m = rng.randint(14, 60)
        a = [rng.randrange(1, 1 << 60) for _ in range(m)]
        b = list(a)
        for _ in range(int(0.2 * m)):
            i = rng.randrange(len(b))
            b[i : i + rng.randrange(2)] = [rng.randrange(1, 1 << 60)] * rng.randrange(2)
        x, y = np.array([a], np.uint64), np.zeros((1, m), np.uint64)
        y[0, : min(m, len(b))] = b[:m]
        same = decontaminate._buckets(x, np.array([m]), m, reps) == decontaminate._buckets(y, np.array([min(m, len(b))]), m, reps)
        agree.append(same.any())
    assert np.mean(agree) >= decontaminate.RECALL


def test_benchmark_passages_are_found(spark):
    rng = random.Random(4)
    items = [(k, " ".join(words(rng, rng.randint(12, 50), 5000))) for k in range(12)] + [(50, None), (51, ""), (52, "?!"), (53, "One item")]
    docs, truth = [], set()
    for i in range(60):
        w = words(rng, 150, 5000)
        if i % 2:
            k = rng.randrange(12)
            item = items[k][1].split()
            for _ in range(int(0.2 * len(item) * rng.random())):
                item[rng.randrange(len(item))] = "edited"
            at = rng.randrange(100)
            w[at:at] = [x.upper() + rng.choice(["", ",", "!"]) for x in item]
        docs.append((i, " ".join(w)))
    docs += [(100, None), (101, ""), (102, "x" * 200_000), (103, 'He said: "one, ITEM!"'), docs[1]]
    plain = lambda t: [x for x in (re.sub(r"^[^\w]+|[^\w]+$", "", y).lower() for y in (t or "").split()) if x]
    for i, t in docs:
        for k, x in items:
            if (a := plain(x)) and edit_distance(a, plain(t)) <= int(0.2 * len(a) + 1e-9):
                truth.add((i, k))
    got = decontaminate.matches(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r["doc_id"], r["item_id"]) for r in got}
    assert found <= truth and len(found) >= decontaminate.RECALL * len(truth) and (103, 53) in found
    kept = {r["doc_id"] for r in decontaminate.clean(frame(spark, [*docs, (None, "free")]), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in found} | {None}


def test_top_k_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=8).round(1).tolist()) for i in range(120)] + [(200 + i, [0.5] * 8) for i in range(30)]
    rows += [(300, None), (301, [1.0, None] * 4), (302, [float("nan")] * 8), (303, [float("inf")] + [0.0] * 7), (304, [1.0, 2.0]), (350, [2.0, 2.0]), (305, [])]
    monkeypatch.setattr(exact_topk, "VECTOR_BLOCK", 40)
    monkeypatch.setattr(exact_topk, "QUERY_BLOCK", 2)
    df = spark.createDataFrame(rows, "id long, v array<double>")
    reads = []
    got = exact_topk.top_k(exact_topk.integer_vectors(df, "id", "v"), F.col("vec_id") % 10 == 0, 5, reads).collect()
    assert sum(reads) < 12 * 121 / 2  # far fewer exact vectors than pairs of queries and distinct vectors
    fine = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)}
    expected = []
    for q in fine:
        if q % 10 == 0:
            scores = sorted((-sum(a * b for a, b in zip(fine[q], fine[c], strict=True)), c) for c in fine if c != q and len(fine[c]) == len(fine[q]))
            expected += [(q, k, c, -s) for k, (s, c) in enumerate(scores[:5], 1)]
    assert sorted(map(tuple, got)) == sorted(expected)


def test_words_and_hashes_of_batches():
    texts = ["Ab  cd", None, "", "ab\tCD e", "É x"]
    data, offsets = text_bytes(pa.array(texts))
    starts, ends, row, hashes = words_of(data, offsets)
    assert [bytes(data[a:b]).decode() for a, b in zip(starts, ends, strict=True)] == ["Ab", "cd", "ab", "CD", "e", "É", "x"]
    assert row.tolist() == [0, 0, 3, 3, 3, 4, 4]
    assert hashes[0] == hashes[2] and hashes[1] == hashes[3] and len(set(hashes.tolist())) == 5


@pytest.mark.parametrize("share", [4, 0])
def test_hot_anchors_are_split(spark, monkeypatch, share):
    """A short line in changing surroundings and a long one in equal ones; every anchor is split, or those that two pieces have."""
    rng = random.Random(9)
    line, block = "the same line of forty letters or so, ok", " ".join(words(rng, 60))
    rows = [(i, f"{rng.random()} " * 3 + line + f" {rng.random()}" * 3 + rng.choice(["", block, line * 5])) for i in range(80)]
    rows += [(i + 200, rows[i][1]) for i in range(0, 80, 3)] + [(2, rows[40][1]), (None, rows[41][1]), (None, block)]
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES" if share else "SHARE", 300 if share else 10**6)
    got = suffix_dedup.repeats(frame(spark, rows), 100).collect()
    sig = lambda t: spark.createDataFrame([(t,)], "t string").select(F.xxhash64("t")).first()[0]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, sig(r[1])))
    expected = repeats_reference([(k, t) for k, (_, t) in enumerate(order)], 100)
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((order[k][0], *rest)) for k, *rest in expected)


def test_rows_without_an_id_link_others(spark):
    a = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(a)), (None, " ".join(["x", *a[1:]])), (2, " ".join(["x", *a[1:-3], "u", "y", "z"])), (None, "q r s t u"), (None, "q r s t u")]
    one, mid, two = (set(zip(*(t.split()[k:] for k in range(4)), strict=False)) for _, t in rows[:3])
    assert 100 * len(one & two) < 90 * len(one | two) and min(100 * len(one & mid) / len(one | mid), 100 * len(mid & two) / len(mid | two)) >= 90
    got = ngram_join.jaccard_components(frame(spark, rows), 4, 90).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(1, 57, 1), (None, 57, 1), (2, 57, 1), (None, 2, None), (None, 2, None)]))
