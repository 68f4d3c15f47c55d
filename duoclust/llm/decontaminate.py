"""Benchmark passages in documents, by CGK embedding and bit-sampling LSH, verified by exact edit distance.

Texts are words in lower case without punctuation at their ends; the distance of an item of m words to a passage
is the edit distance on words, and a match has at most (1 - similarity) * m edits. Windows of an item's size are
embedded by the CGK random walk: at each step the current word is written out and the walk moves on or stays, as a
hash of step and word says, so that texts a few edits apart fall into step again and their walks agree at most
places. Several repetitions, each a walk of its own, sample a few places as a bucket; the number of repetitions
follows from the recall that is wanted. Windows and items that share a bucket are candidates, and an exact edit
distance with free ends in the document decides.

Windows are embedded where they can match at all: k edits leave one of k + 1 pieces of the item whole, so every
match holds some run of words of its item, and a run's place in the item gives the start of the window. This loses
nothing, and text that shares no run with a benchmark item is never embedded.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, hash_between, in_steps, mix, prefix_hash, shingles_of, text_bytes, words_of, written

#: Least similarity; recall that the repetitions are set for at that similarity; places in a bucket.
SIMILARITY, RECALL, PLACES = 0.8, 0.95, 3
#: Items, and bytes of them, that one pass over the documents compares with, about; larger tables take more passes.
ITEMS, ITEM_BYTES = 20_000, 16 << 20
#: Places of a walk that two texts SIMILARITY apart share, at least (measured on random edits; tests hold it).
AGREE = 0.35

_PUNCT = np.zeros(256, bool)
_PUNCT[[*b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = True


def repetitions(recall: float = RECALL) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - AGREE**PLACES))


def _trimmed(column: pa.Array):
    """(row, hash, start, end) of the words of every row: punctuation is cut from both ends, words of nothing else drop."""
    data, offsets = text_bytes(column)
    starts, ends, row, _ = words_of(data, offsets)
    if not len(starts):
        return row, np.zeros(0, np.uint64), starts, ends
    solid = np.flatnonzero(~_PUNCT[data])
    a = np.searchsorted(solid, starts)
    b = np.searchsorted(solid, ends) - 1
    keep = a <= b
    a, b, row, starts, ends = a[keep], b[keep], row[keep], starts[keep], ends[keep]
    return row, hash_between(prefix_hash(data, lower=True), solid[a], solid[b] + 1), starts, ends


def _buckets(words: np.ndarray, lengths: np.ndarray, size: int, reps: int) -> np.ndarray:
    """Bucket of every text (a row of `words`, `size` of them or so) in each repetition, as (texts, reps). All
    repetitions walk at once; a walk writes 0 beyond the end of its text."""
    steps = max(PLACES, 2 * size)
    places = np.random.default_rng(size).integers(0, steps, (reps, PLACES))
    seeds = mix(np.arange(1, reps + 1, dtype=np.uint64))
    padded = np.concatenate([words, np.zeros((len(words), 1), np.uint64)], axis=1)
    at, rows = np.zeros((len(words), reps), np.int64), np.arange(len(words))[:, None]
    seen = np.zeros((len(words), reps, PLACES), np.uint64)
    for k in range(int(places.max()) + 1):
        w = padded[rows, np.minimum(at, lengths[:, None])]
        for r, j in np.argwhere(places == k):
            seen[:, r, j] = w[:, r]
        at += ((mix(w + seeds * np.uint64(2 * k + 1)) >> np.uint64(13)) & np.uint64(1)).astype(np.int64)
    key = np.broadcast_to(seeds ^ np.uint64(size), (len(words), reps)).copy()
    for j in range(PLACES):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + seen[:, :, j])
    return key


def edits_within(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end): the least edit distance of the item to any run of words text[start:end]; the first best end."""
    m, n = len(item), len(text)
    cost, since = np.zeros(n + 1, np.int64), np.arange(n + 1)
    for i in range(m):
        new, start = np.empty(n + 1, np.int64), np.empty(n + 1, np.int64)
        new[0], start[0] = i + 1, 0
        swap = cost[:-1] + (text != item[i])
        drop = cost[1:] + 1
        take = swap <= drop
        new[1:], start[1:] = np.where(take, swap, drop), np.where(take, since[:-1], since[1:])
        # an insertion costs one more than the cell to the left: running minimum of new[j] - j
        shifted = new - np.arange(n + 1)
        run = np.minimum.accumulate(shifted)
        better = run < shifted
        source = np.maximum.accumulate(np.where(shifted == run, np.arange(n + 1), 0))
        new = run + np.arange(n + 1)
        start = np.where(better, start[source], start)
        cost, since = new, start
    end = int(np.argmin(cost))
    return int(cost[end]), int(since[end]), end


class Index:
    """Items of one pass: runs of words that find windows, and buckets that find items."""

    def __init__(self, ids: list[int], texts: list[str | None], similarity: float, recall: float):
        self.reps = repetitions(recall)
        row, hashes, _, _ = _trimmed(pa.array(texts, pa.string()))
        bounds = np.searchsorted(row, np.arange(len(ids) + 1))
        self.ids, self.words, self.most = [], [], []
        runs: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        buckets: list[tuple[np.ndarray, int]] = []
        for k, item in enumerate(ids):
            w = hashes[bounds[k] : bounds[k + 1]]
            if not len(w):
                continue
            number, m = len(self.ids), len(w)
            most = int((1 - similarity) * m + 1e-9)
            self.ids.append(item)
            self.words.append(w)
            self.most.append(most)
            run = min(4, -(-(m - most) // (most + 1)))
            s = shingles_of(w, run)
            runs.setdefault(run, []).append((s, np.full(len(s), number), np.arange(len(s))))
            buckets.append((_buckets(w[None, :], np.array([m]), m, self.reps)[0], number))
        self.runs = {}
        for run, parts in runs.items():
            s, number, place = (np.concatenate([p[i] for p in parts]) for i in range(3))
            order = np.argsort(s, kind="stable")
            bitmap = np.zeros(1 << 20, bool)
            bitmap[(s & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.runs[run] = (s[order], number[order], place[order], bitmap)
        self.table: dict[int, list[int]] = {}
        for keys, number in buckets:
            for key in keys.tolist():
                self.table.setdefault(key, []).append(number)

    def windows(self, hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Distinct (start, size) of the windows that a shared run points to."""
        found = []
        for run, (s, number, place, bitmap) in self.runs.items():
            of = shingles_of(hashes, run)
            if not len(of):
                continue
            at = np.flatnonzero(bitmap[(of & np.uint64((1 << 20) - 1)).astype(np.int64)] & (row[: len(of)] == row[run - 1 :][: len(of)]))
            low, high = np.searchsorted(s, of[at], "left"), np.searchsorted(s, of[at], "right")
            n = high - low
            at, low, n = at[n > 0], low[n > 0], n[n > 0]
            each = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start = np.repeat(at, n) - place[each]
            size = np.array([len(self.words[k]) for k in number[each]], np.int64)
            found.append(np.stack([start, size, np.repeat(row[at], n)], axis=1).reshape(-1, 3))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)

    def matches(self, row: np.ndarray, hashes: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item number, edits, first word, end) of every candidate that holds, best for each row and item."""
        first = np.searchsorted(row, np.arange((row[-1] if len(row) else -1) + 2))
        windows = self.windows(hashes, row)
        candidates: set[tuple[int, int, int]] = set()
        for size in np.unique(windows[:, 1]).tolist():
            group = windows[windows[:, 1] == size]
            for at in range(0, len(group), 1024):
                part = group[at : at + 1024]
                start = np.maximum(part[:, 0], first[part[:, 2]])
                length = np.minimum(start + size, first[part[:, 2] + 1]) - start
                index = start[:, None] + np.arange(size)
                words = np.where(np.arange(size) < length[:, None], hashes[np.minimum(index, len(hashes) - 1)], np.uint64(0))
                for i, keys in enumerate(_buckets(words, length, size, self.reps).tolist()):
                    for key in keys:
                        for number in self.table.get(key, ()):
                            candidates.add((int(part[i, 2]), number, int(start[i])))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for r, number, start in sorted(candidates):
            item, most = self.words[number], self.most[number]
            a, b = max(start - most, first[r]), min(start + len(item) + most, first[r + 1])
            if len(item) - sum(map(set(hashes[a:b].tolist()).__contains__, item.tolist())) > most:
                continue  # each word of the item that is not there costs an edit
            edits, x, y = edits_within(item, hashes[a:b])
            if edits <= most and edits < best.get((r, number), (most + 1,))[0]:
                best[r, number] = (edits, int(a + x), int(a + y))
        return [(r, number, *v) for (r, number), v in sorted(best.items())]


#: The index that this worker has built, by the name of its pass: tasks of one pass build it once.
_BUILT: dict[str, Index] = {}


def _index(name: str, *what) -> Index:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Index(*what)
    return _BUILT[name]


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """(doc_id, item_id, edits, similarity, first_byte, end_byte): every item found in every row of docs, at its
    best place (bytes of the UTF-8 text). Items and texts that are null, empty or have no words match nothing;
    repeated rows give repeated results; copies of an item are items of their own; an empty table on either side
    gives none. The items are read in passes of ITEMS and ITEM_BYTES, whatever their number."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    rows, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    passes, name = max(1, -(-rows // ITEMS), -(-size // ITEM_BYTES)), uuid.uuid4().hex
    schema = "doc_id long, item_id long, edits int, similarity double, first_byte long, end_byte long"
    out = None
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).orderBy("item_id", "text").collect()  # about ITEMS and ITEM_BYTES at most, unless one item is longer
        index = spark.sparkContext.broadcast(([r["item_id"] for r in part], [r["text"] for r in part]))

        def run(batches: Iterator[pa.RecordBatch], index=index, k=k) -> Iterator[pa.RecordBatch]:
            of = _index(f"{name}-{k}", *index.value, similarity, recall)
            for step in in_steps(batches):
                _, offsets = text_bytes(step.column("text"))
                row, hashes, starts, ends = _trimmed(step.column("text"))
                got = of.matches(row, hashes)
                if got:
                    ids = step.column("doc_id").to_pylist()
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array([ids[g[0]] for g in got], pa.int64()), "item_id": pa.array([of.ids[g[1]] for g in got], pa.int64()), "edits": pa.array([g[2] for g in got], pa.int32()),
                        "similarity": pa.array([round(1 - g[2] / len(of.words[g[1]]), 6) for g in got]),
                        "first_byte": pa.array([int(starts[g[3]] - offsets[g[0]]) for g in got], pa.int64()), "end_byte": pa.array([int(ends[max(g[3], g[4] - 1)] - offsets[g[0]]) for g in got], pa.int64()),
                    })

        found = d.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs without the documents that hold a benchmark passage, all columns and other rows as they are. Rows
    without a doc_id stay."""
    leaks = fresh("__leaks", docs.columns)
    found = written(matches(docs, benchmark, **how).select(F.col("doc_id").alias(leaks)).distinct(), "leaks")
    return docs.join(found, F.col("doc_id").cast("long") == F.col(leaks), "left_anti")
