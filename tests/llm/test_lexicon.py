"""The lexicon of toxicity is whole."""

from __future__ import annotations

import random

from duoclust.llm import toxicity


def test_every_term_and_short_stems_are_learned(spark):
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    terms = sorted({"".join(rng.choices(letters, k=9)) for _ in range(600)})
    rows = []
    for i in range(600):
        clean = [f"fine{rng.choice(letters)}{rng.choice(letters)}" for _ in range(20)]
        bad = [*terms[i % 100 :: 100], "zorp" + "".join(rng.choices(letters, k=5))] if i % 2 or i < 100 else []
        rows.append((" ".join([*clean, *bad]), int(bool(bad))))
    words, stems = toxicity.lexicon(spark.createDataFrame(rows, "text string, label int"))
    scorer = toxicity.Scorer(words, stems)
    seen = {t: sum(t in text.split() for text, _ in rows) for t in terms}
    assert sum(n >= toxicity.SEEN for n in seen.values()) > 290
    assert all(scorer.distance(t) == 0 for t, n in seen.items() if n >= toxicity.SEEN)
    assert "zorp" in stems and scorer.distance("zorpqqqqq") == 0


def test_distances_kept_are_those_found():
    rng = random.Random(8)
    terms = ["idiot", "moron", "worthless", "scum"]
    words = ["".join(rng.choices("idotmrnwhles", k=rng.randint(3, 7))) for _ in range(300)] + ["idioot", "moran", "worthles", "scum", "scam", "clownish"]
    scorer, alone = toxicity.Scorer(terms, ["clow"]), toxicity.Scorer(terms, ["clow"])
    expected = {w: d for w in words if (d := alone.distance(w)) is not None}
    assert expected["clownish"] == 0 and expected["idioot"] == 1 and "scam" not in expected
    for _ in range(3):
        assert scorer.hits(set(words)) == expected
