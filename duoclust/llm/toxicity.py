"""Toxicity scores from misspelled lexicon terms in their contexts.

The lexicon (words, and stems that take any ending) is learned from labelled rows. Its words form a trie; a
Levenshtein automaton of each distinct word walks the trie, so one walk compares the word with all terms at once.
Each hit is placed in its context: inside quotation marks or after a word that reports speech it counts as
quoted, near a second-person word as addressed. A logistic model over such counts gives the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import in_steps, table

#: Labelled rows that fit the lexicon and the model, at most; words whose distances a task keeps, about.
FIT_ROWS, KEPT = 40_000, 200_000
#: Letters of stems; documents and share of toxic ones that admit a term; shorter terms match without edits only.
STEMS, SEEN, SHARE, SHORT = (4, 5, 6), 5, 0.9, 5
#: Words on either side of a hit that are its context.
WINDOW = 6
#: Fixed word lists: reported speech and the second person.
REPORTS = frozenset("said says say wrote writes called calls quoted quote quotes term word words slur phrase dijo dice palabra sagte sagt wort dit mot".split())
YOU = frozenset("you your yours u ur du dich dir dein ihr euch tu te toi vous votre tú usted ustedes vosotros".split())
_WORD = re.compile(r"[\w@$*]+|[\"“”«»„]")
_QUOTES = frozenset("\"“”«»„")
_FEATURES = ("exact", "near", "quoted", "addressed", "any", "share")
#: The model's weights before any labels: more hits are worse, quoted ones much less so.
_PRIOR = np.array([1.5, 0.5, -1.0, 0.5, 1.0, 0.5])


class Trie:
    """Terms as nested dictionaries, "" marking the end of a term with its length."""

    def __init__(self, words):
        self.root: dict = {}
        for term in words:
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = len(term)

    def nearest(self, word: str) -> int | None:
        """The least edit distance (insertion, deletion, substitution) from the word to a term: 0, 1 or None.

        The automaton's state is two bit sets: bit i of r0 (r1) says that the path in the trie is the word's first
        i letters with no (at most one) edit. Terms under SHORT letters match without edits only."""
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i
        end, best = 1 << len(word), None
        full = 2 * end - 1
        stack = [(self.root, 1, 3 & full)]
        while stack:
            node, r0, r1 = stack.pop()
            if "" in node:
                if r0 & end:
                    return 0
                if r1 & end and node[""] >= SHORT:
                    best = 1
            for c, child in node.items():
                if c:
                    m = masks.get(c, 0)
                    s0 = (r0 & m) << 1
                    s1 = ((r1 & m) << 1 | r0 | r0 << 1 | s0 << 1) & full
                    if s1:
                        stack.append((child, s0, s1))
        return best


class Scorer:
    """Counts of one text. A word within one edit of a term of n letters starts with the term's first n // 2 letters or
    ends with the others, as one edit leaves one of the two whole, and is at most one letter longer or shorter; only
    such words walk the trie, once for all texts: distances found and words without one are kept, up to a bound."""

    def __init__(self, words, stems):
        self.trie, self.known, self.dull = Trie(words), {}, set()
        self.whole, self.stems = frozenset(w for w in words if len(w) < SHORT), frozenset(stems)
        self.fronts = frozenset(w[: STEMS[0]] for w in stems)
        halves: dict[int, tuple[set, set]] = {}
        for w in words:
            if len(w) >= SHORT:
                heads, tails = halves.setdefault(len(w), (set(), set()))
                heads.add(w[: len(w) // 2])
                tails.add(w[len(w) // 2 :])
        #: for each length of a word the halves of terms that it can be near to: (letters, heads, letters, tails)
        self.halves = {k: [(n // 2, halves[n][0], n // 2 - n, halves[n][1]) for n in (k - 1, k, k + 1) if n in halves] for n0 in halves for k in (n0 - 1, n0, n0 + 1)}

    def distance(self, word: str) -> int | None:
        if word[: STEMS[0]] in self.fronts and any(word[:n] in self.stems for n in STEMS):
            return 0
        if word in self.whole or any(word[:i] in heads or word[j:] in tails for i, heads, j, tails in self.halves.get(len(word), ())):
            return self.trie.nearest(word)
        return None

    def hits(self, words: set[str]) -> dict[str, int]:
        """The distances of those words that have one."""
        known, dull = self.known, self.dull
        if len(known) > KEPT:
            known.clear()
        if len(dull) > KEPT:
            dull.clear()
        out = {}
        for w in words - dull:
            d = known[w] if w in known else self.distance(w)
            if d is None:
                dull.add(w)
            else:
                out[w] = known[w] = d
        return out

    def features(self, text: str | None) -> list[float]:
        tokens = _WORD.findall((text or "").lower())
        hits = self.hits(set(tokens))
        if not hits:
            return [0.0] * len(_FEATURES)
        exact = near = quoted = addressed = 0
        inside, last_open = False, 0
        for i, w in enumerate(tokens):
            if w in _QUOTES:
                inside, last_open = not inside, i
            elif w in hits:
                around = tokens[max(0, i - WINDOW) : i + WINDOW + 1]
                closes = inside and i - last_open <= 40 and any(x in _QUOTES for x in tokens[i + 1 : i + 41])
                if closes or not REPORTS.isdisjoint(tokens[max(0, i - 3) : i]):
                    quoted += 1
                elif hits[w] == 0:
                    exact += 1
                else:
                    near += 1
                addressed += not YOU.isdisjoint(around)
        return [np.log1p(exact), np.log1p(near), np.log1p(quoted), np.log1p(addressed), float(exact > 0), 10.0 * exact / max(10, len(tokens))]


def fitting_rows(docs: DataFrame, labels: DataFrame, usable: Column, label: str, most: int = FIT_ROWS) -> DataFrame:
    """(text, label) of up to `most` labelled rows that `usable` admits, in an order by hash of doc_id. Of several labels
    of one id the largest counts."""
    ids = labels.where(F.col(label).isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    ids = ids.where(usable).orderBy(F.xxhash64("id"), "id").limit(most)
    return docs.select(F.col("doc_id").alias("id"), "text").where(F.col("id").isNotNull()).join(ids, "id").select("text", "label")


def lexicon(rows: DataFrame) -> tuple[list[str], list[str]]:
    """Words and stems that labelled rows mark as toxic: all that are in SEEN documents at least and SHARE of them toxic.
    A stem has no single word that makes up half of it, and covers all its words and longer stems."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}]+"), 0))
    each = rows.select("label", F.explode(words).alias("w")).where(F.length("w").between(3, 64))
    counts = each.groupBy("w").agg(F.sum("label").alias("toxic"), F.count("*").alias("docs"))
    fine = (F.col("toxic") >= SEEN) & (F.col("toxic") >= SHARE * F.col("docs"))
    cuts = F.array(*(F.substring("w", 1, n) for n in STEMS))
    fronts = F.explode(F.slice(cuts, 1, F.least(F.lit(len(STEMS)), F.greatest(F.lit(0), F.length("w") - STEMS[0] + 1)))).alias("w")
    alone = counts.select("toxic", fronts).groupBy("w").agg(F.max("toxic").alias("one"))
    stems = each.select("label", fronts).groupBy("w").agg(F.sum("label").alias("toxic"), F.count("*").alias("docs"))
    stems = stems.where(fine).join(alone, "w").where(2 * F.col("one") < F.col("toxic"))
    every = {r["w"] for r in stems.select("w").collect()}  # at most the words of FIT_ROWS texts over SEEN
    stems = {w for w in every if not any(w[:n] in every for n in STEMS if n < len(w))}
    found = [r["w"] for r in counts.where(fine).select("w").collect()]  # likewise
    return sorted(w for w in found if not any(w[:n] in stems for n in STEMS)), sorted(stems)


def fit(rows: DataFrame) -> dict:
    """The lexicon and the weights. Without rows the lexicon is empty and every score is low."""
    words, stems = lexicon(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, counts = Scorer(words, stems), {}
        for batch in in_steps(batches):
            for text, y in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                k = (y, *(round(v, 3) for v in scorer.features(text)))
                counts[k] = counts.get(k, 0) + 1
        columns = list(zip(*counts, strict=True)) or [[] for _ in range(1 + len(_FEATURES))]
        yield pa.RecordBatch.from_arrays([pa.array(list(columns[0]), pa.int32()), *(pa.array(list(c), pa.float64()) for c in columns[1:]), pa.array(list(counts.values()), pa.int64())], ["label", *_FEATURES, "n"])

    schema = "label int, " + ", ".join(f"{c} double" for c in _FEATURES) + ", n long"
    got = np.array([list(r) for r in rows.mapInArrow(run, schema).groupBy("label", *_FEATURES).agg(F.sum("n").alias("n")).collect()], float)  # FIT_ROWS at most
    weights, bias = _PRIOR.copy(), -4.0
    if len(got):
        y, x, n = got[:, 0], got[:, 1:-1], got[:, -1]
        z, theta = np.hstack([x, np.ones((len(x), 1))]), np.append(weights, bias)
        prior, hold = theta.copy(), np.append(np.full(len(weights), 1.0), 0.01)
        for _ in range(50):  # Newton steps towards the most likely weights under the prior
            p = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
            step = np.linalg.solve((z * (n * p * (1 - p))[:, None]).T @ z + np.diag(hold), z.T @ (n * (y - p)) - hold * (theta - prior))
            theta += step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        weights, bias = theta[:-1], float(theta[-1])
    return {"words": words, "stems": stems, "weights": weights.tolist(), "bias": bias}


def score(docs: DataFrame, model: dict, name: str = "score") -> DataFrame:
    """docs with `name`, a score in 0 to 1 (0 to 1 also for null and empty texts), in place of a column of that name.
    Every whole text is read; no other column of docs is, and all others stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, w = Scorer(model["words"], model["stems"]), np.array(model["weights"])
        for batch in in_steps(batches):
            x = np.array([scorer.features(t) for t in batch.column("text").to_pylist()], float).reshape(-1, len(_FEATURES))
            s = 1 / (1 + np.exp(-np.clip(x @ w + model["bias"], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], [*batch.schema.names, name])

    kept = docs.drop(name)
    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField(name, DoubleType())]))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fitted(spark, docs: DataFrame, sf_dir: str) -> dict:
    """The model of the labels table's `toxic`, from rows that are not held out, over the given documents."""
    rows = fitting_rows(docs, table(spark, sf_dir, "labels"), ~held_out("id"), "toxic").persist()
    try:
        return fit(rows)
    finally:
        rows.unpersist()
