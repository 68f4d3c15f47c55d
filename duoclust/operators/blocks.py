"""Fits of many count matrices together, from blocks of their rows: no task holds a matrix, and the driver no row.

A row of the table of blocks is a block of one fit's matrix (`fit`, `block`): its rows that have entries, as a dense array of
the fit's columns, with their labels. A scan reads every block once and hands on sums for each fit, for all its starts.

What a descent has done is known by a few numbers and one vector over columns for each step: the coefficients of the
direction over the last steps and changes of gradient, the step's length, and what a count adds to the gradient. So tasks
replay the steps of a block in place of reading its memberships, gradients and pairs, until there are KEEP of them;
then these are written with the blocks. Values and steps are those of kernels.partition() and kernels.sparse_kmeans(),
but for the order of sums.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..sources.io import dropped, materialised
from .optimize import _two_loops

#: Rows of a block, steps that are replayed at most, step lengths that one scan tries, halvings, bytes of a row group.
ROWS, KEEP, TRIED, HALVINGS, GROUP = 1024, 5, 2, 50, 1 << 24
#: Pairs that a descent remembers.
MEMORY = 8
SCHEMA = "fit int, block int, truth binary, kind string, x binary, state binary"


def counted(entries: DataFrame, fits: list[tuple[int, int, int]]) -> DataFrame:
    """SCHEMA, without state, of fits (fit, width, columns): entries has, for each block, n-grams (ds, de, n_docs, cols)
    with their column in each fit, or -1, and labelled windows (ds, label). Unlabelled windows have no rows."""

    def block_of(at: int, sums: list[np.ndarray], truth: np.ndarray, known: np.ndarray) -> Iterator[tuple]:
        for (fit, _, columns), s in zip(fits, sums, strict=True):
            x = np.cumsum(s.reshape(ROWS + 1, columns)[:ROWS], axis=0)
            rows = known & x.any(axis=1)
            if rows.any():
                x = x[rows]
                kind = np.min_scalar_type(int(x.max()))
                yield fit, at, truth[rows].tobytes(), kind.str, x.astype(kind).tobytes(), b""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums, truth, known = None, [], None, None
        for batch in batches:
            block, ds, de, last, label = (np.asarray(batch.column(c).fill_null(-1)) for c in ("block", "ds", "de", "n_docs", "label"))
            word = np.asarray(batch.column("cols").is_valid())
            cols = np.asarray(batch.column("cols").drop_null().flatten()).reshape(-1, len(fits))
            place = np.cumsum(word) - 1
            edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for start, end in zip(edges, edges[1:], strict=False):
                if start == end:
                    continue
                if block[start] != at:
                    if at is not None:
                        yield _batch(block_of(at, sums, truth, known))
                    at = int(block[start])
                    sums = [np.zeros((ROWS + 1) * columns, np.int64) for _, _, columns in fits]
                    truth, known = np.zeros(ROWS, np.int64), np.zeros(ROWS, bool)
                part = slice(start, end)
                w, low = word[part], at * ROWS
                truth[ds[part][~w] - low], known[ds[part][~w] - low] = label[part][~w], True
                d, e, n, c = ds[part][w], de[part][w], last[part][w], cols[place[part][w]]
                for k, (_, width, columns) in enumerate(fits):
                    lo, hi = np.maximum(np.maximum(0, e - width + 1), low), np.minimum(np.minimum(n - 1, d + width), low + ROWS - 1)
                    inside = (c[:, k] >= 0) & (hi >= lo)
                    for sign, to in ((1, lo - low), (-1, hi + 1 - low)):
                        sums[k] += sign * np.bincount(to[inside] * columns + c[inside, k], minlength=len(sums[k]))
        if at is not None:
            yield _batch(block_of(at, sums, truth, known))

    return entries.repartition("block").sortWithinPartitions("block").mapInArrow(build, SCHEMA)


def _batch(rows) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.binary(), pa.binary()]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])


def written(blocks: DataFrame, *then_drop: DataFrame) -> DataFrame:
    """Blocks of all fits, spread over tasks."""
    tasks = 4 * blocks.sparkSession.sparkContext.defaultParallelism
    spread = blocks.repartitionById(tasks, F.pmod(F.col("block") + 7 * F.col("fit"), F.lit(tasks)).cast("int")).sortWithinPartitions("fit", "block")
    return materialised(spread, "blocks", *then_drop, **{"parquet.block.size": str(GROUP)})


class _Block:
    def __init__(self, batch: pa.RecordBatch, k: int):
        get = lambda c: batch.column(c)[k].as_buffer()
        self.block, self.truth = batch.column("block")[k].as_py(), np.frombuffer(get("truth"), np.int64)
        self.x = np.frombuffer(get("x"), batch.column("kind")[k].as_py()).reshape(len(self.truth), -1).astype(np.float64)
        self.r = self.x.sum(axis=1)
        state = get("state") if "state" in batch.schema.names else b""
        self.state = np.frombuffer(state, np.float64).reshape(-1, len(self.truth))


def _added(a: dict | None, b: dict) -> dict:
    """Sums of arrays and counts; dictionaries are joined, and arrays named "most" take the larger values."""
    if a is None:
        return b
    return {k: np.maximum(a[k], b[k]) if k == "most" else a[k] | b[k] if type(b[k]) is dict else a[k] + b[k] for k in b}


def scanned(blocks: DataFrame, told: dict[int, dict], each: Callable[[_Block, dict], dict], state: bool = False) -> dict[int, dict]:
    """For each fit that `told` has something for, what `each` finds in its blocks, added up."""
    shared = blocks.sparkSession.sparkContext.broadcast(told)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, first = {}, {}
        with np.errstate(all="ignore"):
            for batch in batches:
                for k, fit in enumerate(batch.column("fit").to_pylist()):
                    b = _Block(batch, k)
                    first.setdefault(fit, b.block)
                    sums[fit] = _added(sums.get(fit), each(b, shared.value[fit]))
        for fit, found in sums.items():
            yield pa.RecordBatch.from_pydict({"fit": [fit], "first": [first[fit]], "found": [pickle.dumps(found)]}, pa.schema([("fit", pa.int32()), ("first", pa.int32()), ("found", pa.binary())]))

    columns = ["fit", "block", "truth", "kind", "x", *(["state"] if state else [])]
    rows = blocks.where(F.col("fit").isin(sorted(told))).select(*columns).mapInArrow(run, "fit int, first int, found binary").collect()  # one for each task and fit
    out: dict[int, dict] = {}
    for r in sorted(rows, key=lambda r: (r["fit"], r["first"])):
        out[r["fit"]] = _added(out.get(r["fit"]), pickle.loads(r["found"]))
    shared.destroy()
    return out


def sizes(blocks: DataFrame, fits: list[int]) -> dict[int, dict]:
    """Of each fit that has rows: how many (n, by block), sums of columns, of squares, and how often each label occurs."""

    def each(b: _Block, _: dict) -> dict:
        return {"n": len(b.x), "by": {b.block: len(b.x)}, "f": b.x.sum(axis=0), "squares": float((b.x**2).sum()), "truth": Counter(b.truth.tolist())}

    return scanned(blocks, {fit: {} for fit in fits}, each)


def _loss(f1: np.ndarray, w1: float, size: dict, model: str) -> tuple[float, np.ndarray, float]:
    """Loss at the weighted column sums f1 and weight w1 of cluster 1; what a count adds to the derivative, and a row's own
    share (its total, or one if rows count)."""
    loss, a, own, here = 0.0, 0.0, 0.0, size["f"] > 0
    scale = math.log(2) if model == "bernoulli" else 1.0
    for f, w, sign in ((f1, w1, 1.0), (size["f"] - f1, size["n"] - w1, -1.0)):
        whole = w if model == "bernoulli" else f.sum()
        p = f / whole
        lp, d = np.log(p + kernels.EPS), f / (p + kernels.EPS)
        lq = np.zeros(len(f)) if model == "multinomial" else np.where(here, np.log(1 - p + kernels.EPS), 0)
        if model != "multinomial":
            d = d - np.where(here, (whole - f) / (1 - p + kernels.EPS), 0)
        loss -= float(np.where(here, f * lp, 0).sum() + ((whole - f) @ lq if model != "multinomial" else 0)) / scale
        a = a - sign * np.where(here, lp - lq + d / whole, 0) / scale
        own -= sign * (lq.sum() - p @ d / whole) / scale
    return loss, a, own


class _Start:
    """What the driver keeps of one descent. steps: (names, coefficients, length, what a count adds to the new gradient, a
    row's own share, number), of those that are replayed."""

    def __init__(self, k: int, low: float):
        self.k, self.low, self.first, self.base, self.begun, self.steps = k, low, None, None, None, []
        self.value, self.tags, self.dots, self.most, self.done, self.fine, self.taken, self.halved = math.inf, [], {}, 0.0, False, False, 0, 0
        self.trials, self.names, self.delta = [], [], None

    def basis(self) -> list[tuple]:
        return [("s", t) for t in self.tags] + [("y", t) for t in self.tags] + [("g", 0)]

    def told(self) -> dict:
        return {c: getattr(self, c) for c in ("k", "low", "first", "base", "begun", "steps", "trials", "names", "delta", "tags")}


def _free(m: np.ndarray, g: np.ndarray, low: float) -> np.ndarray:
    return ~(((m <= low) & (g > 0)) | ((m >= 1 - low) & (g < 0)))


def _direction(m: np.ndarray, g: np.ndarray, pairs: dict, names: list, delta: np.ndarray, low: float) -> np.ndarray:
    whole = delta @ np.array([g if name[0] == "g" else pairs[name] for name in names])
    return np.where(_free(m, g, low), whole, 0.0)


def _projected(b: _Block, signs: np.ndarray | None) -> np.ndarray:
    return b.r if signs is None else b.x @ signs


def _replayed(b: _Block, starts: list[dict], model: str) -> Iterator[tuple[dict, np.ndarray, np.ndarray | None, dict]]:
    """(start, memberships, gradient, pairs) of each start where its steps so far end."""
    slopes = [a for s in starts for a in ([s["begun"][0]] if s["begun"] and not s["base"] else []) + [t[3] for t in s["steps"]]]
    gradients = b.x @ np.array(slopes).T if slopes else None
    at, own = 0, np.ones(len(b.x)) if model == "bernoulli" else b.r
    for s in starts:
        g, pairs, low = None, {}, s["low"]
        if s["base"]:
            saved = {name: b.state[k] for name, k in s["base"].items()}
            m, g, pairs = saved["m", 0], saved.get(("g", 0)), {n: v for n, v in saved.items() if n[0] in "sy"}
        else:
            signs, cut, ties = s["first"]
            p = _projected(b, signs)
            tied = p == cut
            lower = (p < cut) | (tied & (np.cumsum(tied) <= ties.get(b.block, 0)))
            m = np.clip(np.where(lower, 0.1, 0.9), low, 1 - low)
            if s["begun"]:
                g, at = gradients[:, at] + own * s["begun"][1], at + 1
        for names, delta, length, _, share, tag in s["steps"]:
            new = np.clip(m + length * _direction(m, g, pairs, names, delta, low), low, 1 - low)
            h, at = gradients[:, at] + own * share, at + 1
            pairs = {n: v for n, v in pairs.items() if n in names} | {("s", tag): new - m, ("y", tag): h - g}
            m, g = new, h
        yield s, m, g, pairs


def partitions(blocks: DataFrame, size: dict[int, dict], model: str, restarts: int, iterations: int, tolerance: float = 1e-8, least: float = 0.02, logit: float = 10.0) -> tuple[DataFrame, dict[int, dict]]:
    """The blocks, which have been written anew, and what kernels.partition() finds for each fit of at least two rows: mcc,
    loss, n_iter and success; a fit whose starts all collapse is left out."""
    low = 1 / (1 + math.exp(logit))
    fits = {c: [_Start(k, low) for k in range(restarts)] for c in size if size[c]["n"] > 1}
    told = lambda chosen: {c: {"starts": [s.told() for s in starts]} for c, starts in chosen.items() if starts}

    for c, starts in fits.items():
        rng, here = np.random.default_rng(0), size[c]["f"] > 0
        for s in starts:
            signs = None
            if s.k:
                signs = np.zeros(len(here))
                signs[here] = rng.choice([-1.0, 1.0], int(here.sum()))
            s.first = (signs, None, {})

    def values(b: _Block, t: dict) -> dict:
        return {s["k"]: Counter(dict(zip(*(v.tolist() for v in np.unique(_projected(b, s["first"][0]), return_counts=True)), strict=True))) for s in t["starts"]}

    def ties(b: _Block, t: dict) -> dict:
        return {"by": {b.block: [int((_projected(b, s["first"][0]) == s["first"][1]).sum()) for s in t["starts"]]}}

    def points(b: _Block, t: dict) -> dict:
        out = {}
        for s, m, g, pairs in _replayed(b, t["starts"], model):
            at = [m]
            if s["trials"]:
                d = _direction(m, g, pairs, s["names"], s["delta"], low)
                at = [np.clip(m + length * d, low, 1 - low) for length in s["trials"]]
            w = np.array(at)
            out[s["k"]] = np.column_stack([w @ b.x, w.sum(axis=1), (w - m) @ g if g is not None else np.zeros(len(w))])
        return out

    def products(b: _Block, t: dict) -> dict:
        out, most = {}, np.zeros(restarts)
        for s, m, g, pairs in _replayed(b, t["starts"], model):
            g = np.where(_free(m, g, low), g, 0.0)
            every = np.array([g if n[0] == "g" else pairs[n] for n in s["names"]])
            out[s["k"]] = every @ every.T
            most[s["k"]] = np.abs(g).max(initial=0.0)
        return out | {"most": most}

    def measured(chosen: dict[int, list[_Start]]) -> None:
        """Inner products of what the next direction is made of."""
        for starts in chosen.values():
            for s in starts:
                s.names = [*s.basis(), *((x, s.steps[-1][5]) for x in "sy" if s.steps and s.steps[-1][5] not in s.tags)]
        for c, found in scanned(blocks, told(chosen), products, True).items():
            for s in chosen[c]:
                s.dots, s.most = {(a, b): found[s.k][i, j] for i, a in enumerate(s.names) for j, b in enumerate(s.names)}, float(found["most"][s.k])
                tag = s.steps[-1][5] if s.steps else None
                if tag is not None and tag not in s.tags and s.dots[("s", tag), ("y", tag)] > 1e-12:
                    s.tags = [*s.tags[-MEMORY + 1 :], tag]

    for c, found in scanned(blocks, told(fits), values).items():
        for s in fits[c]:
            v, n = (np.array(a) for a in zip(*sorted(found[s.k].items()), strict=True))
            half, upto = size[c]["n"] // 2, np.cumsum(n)
            k = int(np.searchsorted(upto, half, side="right"))
            s.first = (s.first[0], v[k], {"left": int(half - (upto[k] - n[k]))})
    for c, found in scanned(blocks, told(fits), ties).items():
        for k, s in enumerate(fits[c]):
            left, share = s.first[2]["left"], {}
            for block in sorted(found["by"]):
                share[block] = min(left, found["by"][block][k])
                left -= share[block]
            s.first = (*s.first[:2], share)
    for c, found in scanned(blocks, told(fits), points).items():
        for s in fits[c]:
            s.value, *begun = _loss(found[s.k][0, :-2], found[s.k][0, -2], size[c], model)
            s.begun = tuple(begun)
    measured(fits)

    for step in range(1, iterations + 1):
        active = {}
        for c, starts in fits.items():
            for s in starts:
                if not s.done and not s.most > tolerance:
                    s.done, s.fine, s.taken = True, True, step - 1
            active[c] = [s for s in starts if not s.done]
        moving = {c: list(starts) for c, starts in active.items() if starts}
        if not moving:
            break
        for starts in moving.values():
            for s in starts:
                s.names, s.halved, s.taken = s.basis(), 0, step
                gram = np.array([[s.dots[a, b] for b in s.names] for a in s.names])
                s.delta = _two_loops(gram, len(s.tags), s.most)
                if s.tags and not s.delta[:-1].any():  # no descent: the gradient itself, and no pairs
                    s.tags, s.names, s.delta = [], [("g", 0)], s.delta[-1:]
        while moving:
            for starts in moving.values():
                for s in starts:
                    s.trials = [0.5**k for k in range(s.halved, min(HALVINGS, s.halved + TRIED))]
            for c, found in scanned(blocks, told(moving), points, True).items():
                for s in list(moving[c]):
                    for length, f in zip(s.trials, found[s.k], strict=True):
                        new, a, own = _loss(f[:-2], f[-2], size[c], model)
                        if math.isfinite(new) and new <= s.value + 1e-4 * f[-1]:
                            s.steps.append((s.names, s.delta, length, a, own, step))
                            s.done = s.fine = s.value - new <= tolerance * max(abs(s.value), abs(new), 1.0)
                            s.value = new
                            moving[c].remove(s)
                            break
                    else:
                        s.halved += TRIED
                        if s.halved >= HALVINGS:
                            s.done = s.fine = True
                            moving[c].remove(s)
            moving = {c: starts for c, starts in moving.items() if starts}
        for starts in fits.values():
            for s in starts:
                s.trials = []
        left = {c: going for c, starts in active.items() if (going := [s for s in starts if not s.done])}
        if left:
            measured(left)
        if step % KEEP == 0:
            blocks = _saved(blocks, fits, model)

    def ends(b: _Block, t: dict) -> dict:
        return {s["k"]: np.array([(m >= 0.5).sum(), ((m >= 0.5) == b.truth).sum()]) for s, m, _, _ in _replayed(b, t["starts"], model)}

    best = {}
    for c, found in scanned(blocks, told(fits), ends, True).items():
        n = size[c]["n"]
        kept = [s for s in fits[c] if math.isfinite(s.value) and min(found[s.k][0], n - found[s.k][0]) / n >= least]
        if kept:
            s = min(kept, key=lambda s: s.value)
            ones, same = found[s.k].tolist()
            best[c] = {"mcc": kernels.counted_mcc(size[c]["truth"], {0: n - ones, 1: ones}, same), "loss": s.value, "n_iter": s.taken, "success": s.fine}
    return blocks, best


def _saved(blocks: DataFrame, fits: dict[int, list[_Start]], model: str) -> DataFrame:
    """The blocks with where every start stands; steps before are forgotten."""
    told, kept = {}, {}
    for c, starts in fits.items():
        at = 0
        for s in starts:
            names = [("m", 0), *([] if s.done else [("g", 0), *((x, t) for t in s.tags for x in "sy")])]
            kept[c, s.k] = {name: at + k for k, name in enumerate(names)}
            at += len(names)
        told[c] = [(s.told(), list(kept[c, s.k])) for s in starts]
    shared = blocks.sparkSession.sparkContext.broadcast(told)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row, state = batch.slice(k, 1).drop_columns(["state"]).to_pylist()[0], b""
                if row["fit"] in shared.value:
                    both = shared.value[row["fit"]]
                    ends = _replayed(_Block(batch, k), [s for s, _ in both], model)
                    state = np.array([{("m", 0): m, ("g", 0): g, **pairs}[n] for (_, m, g, pairs), (_, names) in zip(ends, both, strict=True) for n in names]).tobytes()
                yield _batch([(*row.values(), state)])

    out = materialised(blocks.mapInArrow(run, SCHEMA), "blocks", **{"parquet.block.size": str(GROUP)})
    dropped(blocks)
    for c, starts in fits.items():
        for s in starts:
            s.base, s.steps = kept[c, s.k], []
    return out


def kmeans(blocks: DataFrame, size: dict[int, dict], starts: int, seed: int = 0, most: int = 100_000, tolerance: float = 1e-3) -> dict[int, float]:
    """The mcc of the labels that kernels.sparse_kmeans() finds for each fit."""
    told, centres, stop = {}, {}, {}
    for c, s in size.items():
        rng = np.random.default_rng(seed)
        drawn = [(int(rng.integers(s["n"])), rng.random()) for _ in range(starts)]  # as rng.choice() draws the second row
        order = sorted(s["by"])
        before = np.cumsum([0, *(s["by"][b] for b in order)])
        want: dict[int, list] = {}
        for k, (row, _) in enumerate(drawn):
            b = int(np.searchsorted(before, row, side="right")) - 1
            want.setdefault(order[b], []).append((k, row - int(before[b])))
        told[c], s["drawn"], s["order"] = {"want": want}, [u for _, u in drawn], order
        mean = s["f"] / s["n"]
        stop[c] = tolerance * (s["squares"] / s["n"] - mean @ mean) / int((s["f"] > 0).sum())

    def picked(b: _Block, t: dict) -> dict:
        return {"rows": {k: b.x[row] for k, row in t["want"].get(b.block, [])}}

    def distances(b: _Block, c: np.ndarray) -> np.ndarray:
        return np.maximum((b.x**2).sum(axis=1)[:, None] - 2 * (b.x @ c.T) + (c * c).sum(axis=1), 0)

    def weights(b: _Block, t: dict) -> dict:
        return {"by": {b.block: distances(b, t["first"]).sum(axis=0)}}

    def second(b: _Block, t: dict) -> dict:
        asked = t["want"].get(b.block, [])
        if not asked:
            return {"rows": {}}
        d = np.cumsum(distances(b, t["first"][[k for k, _ in asked]]), axis=0)
        return {"rows": {k: b.x[min(int(np.searchsorted(d[:, i], left, side="right")), len(b.x) - 1)] for i, (k, left) in enumerate(asked)}}

    first = {c: np.array([found["rows"][k] for k in range(starts)]) for c, found in scanned(blocks, told, picked).items()}
    told = {c: {"first": v} for c, v in first.items()}
    for c, found in scanned(blocks, told, weights).items():
        d = np.array([found["by"][b] for b in size[c]["order"]])
        upto, want = np.cumsum(d, axis=0), {}
        for k, u in enumerate(size[c]["drawn"]):
            if upto[-1, k] > 0:
                left = u * upto[-1, k]
                b = min(int(np.searchsorted(upto[:, k], left, side="right")), int(np.flatnonzero(d[:, k])[-1]))
                want.setdefault(size[c]["order"][b], []).append((k, left - (upto[b, k] - d[b, k])))
        told[c]["want"] = want
    for c, found in scanned(blocks, told, second).items():
        centres[c] = np.array([[v, found["rows"].get(k, v)] for k, v in enumerate(first[c])])

    def step(b: _Block, t: dict) -> dict:
        near = (distances(b, t["c"][:, 1]) < distances(b, t["c"][:, 0])).astype(np.float64)
        return {"n": near.sum(axis=0), "s": near.T @ b.x}

    def labelled(b: _Block, t: dict) -> dict:
        zero, one = distances(b, t["c"][:, 0]), distances(b, t["c"][:, 1])
        return {"cost": np.minimum(zero, one).sum(axis=0), "ones": (one < zero).sum(axis=0), "same": ((one < zero) == b.truth[:, None]).sum(axis=0)}

    moving = {c: list(range(starts)) for c in centres}
    for _ in range(most):
        if not moving:
            break
        for c, found in scanned(blocks, {c: {"c": centres[c][ks]} for c, ks in moving.items()}, step).items():
            still = []
            for i, k in enumerate(moving[c]):
                n, s = np.array([size[c]["n"] - found["n"][i], found["n"][i]]), np.array([size[c]["f"] - found["s"][i], found["s"][i]])
                new = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], centres[c][k])
                if ((new - centres[c][k]) ** 2).sum() > stop[c]:
                    still.append(k)
                centres[c][k] = new
            moving[c] = still
        moving = {c: ks for c, ks in moving.items() if ks}
    out = {}
    for c, found in scanned(blocks, {c: {"c": v} for c, v in centres.items()}, labelled).items():
        k, n = int(np.argmin(found["cost"])), size[c]["n"]
        ones = int(found["ones"][k])
        out[c] = kernels.counted_mcc(size[c]["truth"], {0: n - ones, 1: ones}, int(found["same"][k]))
    return out
