"""Significance and importance: resampling keyed by hashes, so that any engine draws the same subsets."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StructField, StructType

from ..functions.scalar import at_least
from ..sources.io import materialised, scratch


#: Values of a permutation test, at most: they go to every task.
PANEL = 100_000


@F.pandas_udf(DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """erfc(|z| / sqrt 2): the normal two-sided p of a Z score."""
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)) if pd.notna(v) else None).astype("float64")


@F.pandas_udf(DoubleType())
def z_of_p(p: pd.Series) -> pd.Series:
    """The Z score whose two-sided p this is."""
    return p.map(lambda v: -NormalDist().inv_cdf(v / 2) if pd.notna(v) and 0 < v < 2 else None).astype("float64")


def null_z(df: DataFrame, cluster: str, value: str) -> DataFrame:
    """One row: |difference of means| over its standard error under random labels (pooled sample deviation)."""
    mean = lambda c: F.avg(F.when(F.col(cluster) == c, F.col(value)))
    n = lambda c: F.count(F.when(F.col(cluster) == c, F.col(value)))
    return df.agg((F.abs(mean(0) - mean(1)) / (F.stddev_samp(value) * F.sqrt(1 / n(0) + 1 / n(1)))).alias("z"))


def feature_contrast(matrix: DataFrame, labels: DataFrame) -> DataFrame:
    """(feature, mean0, mean1, diff): column means of each side; absent entries are zeros, so sums are divided by rows."""
    sizes = labels.agg(*(F.count(F.when(F.col("label") == c, 1)).alias(f"n{c}") for c in (0, 1)))  # one row
    sums = matrix.join(labels, "row").groupBy("feature").agg(*(F.sum(F.when(F.col("label") == c, F.col("value")).otherwise(0)).alias(f"s{c}") for c in (0, 1)))
    means = sums.crossJoin(F.broadcast(sizes)).select("feature", *((F.col(f"s{c}") / F.col(f"n{c}")).alias(f"mean{c}") for c in (0, 1)))
    return means.withColumn("diff", F.col("mean1") - F.col("mean0"))


#: Bits of a hash that one pass settles; rows of a block, about; shares that a group of one feature is dealt to.
BITS, BLOCK_CELLS, SALTS = 4, 1 << 22, 16
#: Of a permutation test: rows of a block, about, and replicates that its task takes at a time; cells of one step; cells
#: around the ends of subsets that a task hands on for those replicates, at most.
ROWS, REPS, STEP, CELLS = 1 << 16, 1 << 10, 1 << 17, 1 << 21
#: How far from its expected place a subset may end: standard deviations, and rows.
SIGMAS, SLACK = 6, 8
_M32 = np.uint64(0xFFFFFFFF)


def _fmix(x: np.ndarray) -> np.ndarray:
    """Murmur3's last step on 32 bits, a bijection."""
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        x = ((x ^ (x >> np.uint64(shift))) * np.uint64(factor)) & _M32
    return x ^ (x >> np.uint64(16))


def _drawn(rows: pa.Array, reps: np.ndarray, draw: str) -> np.ndarray:
    """A number for each row and replicate. "md5": the first 64 bits of md5 of "rep-row". "counter": two rounds of mixing
    of a whole number row, distinct in each replicate for rows below 2 ** 32."""
    if draw == "md5":
        names = [str(r).encode() for r in rows.to_pylist()]
        heads = [f"{r}-".encode() for r in reps.tolist()]
        return np.frombuffer(b"".join([hashlib.md5(h + n).digest()[:8] for n in names for h in heads]), ">u8").astype(np.uint64).reshape(len(names), len(heads))
    whole = np.asarray(rows.cast(pa.int64())).view(np.uint64)
    low, high = whole & _M32, whole >> np.uint64(32)
    top = _fmix(_fmix(low)[:, None] ^ _fmix(reps.astype(np.uint64) + np.uint64(1))[None])
    return (top << np.uint64(32)) | _fmix(high[:, None] ^ top)


def _blocks(rows: pa.Array, replicates: np.ndarray, draw: str) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """(rows, replicates, numbers) of bounded blocks."""
    reps = max(1, min(len(replicates), 4096))
    step = max(1, BLOCK_CELLS // reps)
    for i in range(0, len(rows), step):
        for j in range(0, len(replicates), reps):
            yield slice(i, i + step), slice(j, j + reps), _drawn(rows[i : i + step], replicates[j : j + reps], draw)


def thresholds(rows: DataFrame, replicates: int, size: int, draw: str = "md5") -> np.ndarray:
    """For each replicate the number of which `size` rows (at least one and no more than there are) have no larger one:
    BITS of it from each pass, which counts the rows below every value they can take; a task hands on one row for each
    replicate, however many rows it has."""
    at_least(1, replicates=replicates, size=size)
    return _thresholds(rows, np.arange(replicates), size, draw)


def _thresholds(rows: DataFrame, every: np.ndarray, size: int, draw: str) -> np.ndarray:
    width, n = 1 << BITS, len(every)
    prefix, below, settled = np.zeros(n, np.uint64), np.zeros(n, np.int64), np.zeros(n, bool)
    spark, last, at = rows.sparkSession, np.zeros(n, np.uint64), {r: k for k, r in enumerate(every.tolist())}
    for bits in range(0, 64, BITS):
        shared, shift = spark.sparkContext.broadcast((every[~settled], prefix[~settled])), np.uint64(64 - bits - BITS)

        def count(batches: Iterator[pa.RecordBatch], shared=shared, shift=shift, bits=bits) -> Iterator[pa.RecordBatch]:
            reps, known = shared.value
            total = np.zeros((len(reps), width), np.int64)
            for batch in batches:
                for _, at, h in _blocks(batch.column("row"), reps, draw):
                    head = h >> shift
                    inside = (head >> np.uint64(BITS)) == known[at] if bits else np.ones(h.shape, bool)
                    cell = (head & np.uint64(width - 1)).astype(np.int64) + width * np.arange(h.shape[1])
                    total[at] += np.bincount(cell[inside], minlength=h.shape[1] * width).reshape(-1, width)
            yield pa.RecordBatch.from_pydict({"rep": reps, **{f"c{k}": total[:, k] for k in range(width)}})

        counted = rows.select("row").mapInArrow(count, ", ".join(["rep long", *(f"c{k} long" for k in range(width))]))
        for r in counted.groupBy("rep").agg(*(F.sum(f"c{k}") for k in range(width))).toLocalIterator():
            i, counts = at[r[0]], np.array(r[1:], np.int64)
            upto = below[i] + np.cumsum(counts)
            k = int(np.searchsorted(upto, size))
            prefix[i] = (prefix[i] << np.uint64(BITS)) | np.uint64(k)
            below[i] = upto[k - 1] if k else below[i]
            settled[i] = upto[k] == size
            last[i] = (prefix[i] << shift) | np.uint64((1 << int(shift)) - 1)
        if settled.all():
            break
    return last


def subset_masks(rows: DataFrame, replicates: int, size: int, draw: str = "md5") -> DataFrame:
    """rows with `mask`, a bit for each replicate, the first in the highest bit: whether the row is among the `size` of
    least number there. Rows that agree in all 64 bits of it share a side. `row` tells rows apart; no row is repeated."""
    if size <= 0:
        return rows.withColumn("mask", F.lit(bytes(-(-replicates // 8))))
    shared, every = rows.sparkSession.sparkContext.broadcast(thresholds(rows, replicates, size, draw)), np.arange(replicates)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = np.zeros((batch.num_rows, replicates), bool)
            for i, j, h in _blocks(batch.column("row"), every, draw):
                chosen[i, j] = h <= shared.value[j]
            packed = np.packbits(chosen, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([m.tobytes() for m in packed], pa.binary())], [*batch.schema.names, "mask"])

    return rows.mapInArrow(mark, StructType([*rows.schema.fields, StructField("mask", BinaryType())]))


def _bits(masks: pa.Array, replicates: int) -> np.ndarray:
    packed = np.frombuffer(b"".join(masks.to_pylist()), np.uint8).reshape(len(masks), -1)
    return np.unpackbits(packed, axis=1, count=replicates)


def random_subsets(rows: DataFrame, replicates: int, size: int) -> DataFrame:
    """(rep, row): in each replicate the `size` rows with the least md5 of "rep-row"."""
    size = min(size, rows.count())

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rep = np.nonzero(_bits(batch.column("mask"), replicates))
            yield pa.RecordBatch.from_arrays([pa.array(rep.astype(np.int32)), batch.column("row").take(pa.array(at))], ["rep", "row"])

    marked = subset_masks(rows.select("row"), replicates, size)
    return marked.mapInArrow(spread, StructType([StructField("rep", IntegerType()), marked.schema["row"]]))


def _words(rows: pa.Array, replicates: np.ndarray, draw: str) -> Iterator[tuple[slice, slice, np.ndarray, Callable[[np.ndarray, np.ndarray], np.ndarray]]]:
    """(replicates, rows, words, numbers) of steps that a core's cache holds. words, a line for each replicate: numbers of
    _drawn() by their upper 32 bits, but for the last mixing step of "counter", which leaves the upper 16 as they are;
    numbers() gives those of some cells (line, column) whole."""
    across = min(len(rows), 1 << 13)
    down = max(1, STEP // across)
    if draw == "counter":
        whole = np.asarray(rows.cast(pa.int64())).view(np.uint64)
        first = [(x ^ (x >> np.uint64(16))).astype(np.uint32) for x in (_fmix(whole & _M32), _fmix(replicates.astype(np.uint64) + np.uint64(1)))]
        word, spare = np.empty((2, down, across), np.uint32)
    for i in range(0, len(rows), across):
        for j in range(0, len(replicates), down):
            at, of = slice(j, j + down), slice(i, i + across)
            if draw == "counter":
                a, b = first[0][of], first[1][at, None]
                y, z = word[: len(b), : len(a)], spare[: len(b), : len(a)]
                np.bitwise_xor(a, b, out=y)
                np.multiply(y, np.uint32(0x85EBCA6B), out=y)
                np.right_shift(y, np.uint32(13), out=z)
                np.bitwise_xor(y, z, out=y)
                np.multiply(y, np.uint32(0xC2B2AE35), out=y)

                def numbers(line: np.ndarray, column: np.ndarray, y=y, high=whole[of] >> np.uint64(32)) -> np.ndarray:
                    top = y[line, column].astype(np.uint64)
                    top ^= top >> np.uint64(16)
                    return (top << np.uint64(32)) | _fmix(high[column] ^ top)
            else:
                h = _drawn(rows[of], replicates[at], draw).T
                y, numbers = np.ascontiguousarray((h >> np.uint64(32)).astype(np.uint32)), lambda line, column, h=h: h[line, column]
            yield at, of, y, numbers


def _below(words: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words are under the bound of their line, and how many in each."""
    less = np.zeros((len(words), -(-words.shape[1] // 64) * 64), bool)
    np.less(words, bound[:, None], out=less[:, : words.shape[1]])
    return less[:, : words.shape[1]], np.bitwise_count(np.packbits(less, axis=1).view(np.uint64)).sum(axis=1, dtype=np.int64)


def _least_sums(x: DataFrame, n: int, replicates: int, size: int, draw: str) -> DataFrame:
    """(rep, s): the sum of v over the `size` rows (fewer than the n there are) of least number in each replicate, in two
    passes; null where a replicate's numbers are not spread evenly enough for that.

    The first pass counts the numbers under one bound that is the same for all. So it is known within a few rows where
    each replicate's subset ends: the second pass adds up what is safely inside, and hands on the cells around the end,
    which are settled by their order. Blocks of rows meet ranges of replicates, so that few rows have many tasks, too."""
    spark, blocks = x.sparkSession, -(-n // ROWS)
    parts = -(-replicates // REPS)
    groups = min(parts, -(-4 * spark.sparkContext.defaultParallelism // blocks))
    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block")
    packed = materialised(x.groupBy(block).agg(F.collect_list(F.struct("row", "v")).alias("x")), "blocks")
    task = (F.col("block") * groups + F.col("group")).cast("int").alias("task")
    cells = packed.crossJoin(F.broadcast(spark.range(groups).select(F.col("id").alias("group")))).select(task, "group", "x").repartitionById(blocks * groups, "task")
    even = np.uint64(min(int(size / n * 65536), 65535) << 16)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, int, np.ndarray]]:
        """(rows, values, part, replicates) of a task, rows in their order."""
        for batch in batches:
            for k, group in enumerate(batch.column("group").to_pylist()):
                both = batch.column("x")[k].values
                row, v = both.field("row"), both.field("v")
                order = pc.sort_indices(row)
                for part in range(group, parts, groups):
                    yield row.take(order), np.asarray(v.take(order)), part, np.arange(part * REPS, min(replicates, (part + 1) * REPS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, part, reps in held(batches):
            found = np.zeros(len(reps), np.int64)
            for at, _, words, _ in _words(rows, reps, draw):
                found[at] += _below(words, np.full(len(words), even, np.uint32))[1]
            yield pa.RecordBatch.from_pydict({"part": [part], "n": [found.tolist()]}, pa.schema([("part", pa.int32()), ("n", pa.list_(pa.int64()))]))

    each = cells.mapInArrow(count, "part int, n array<long>").select("part", F.posexplode("n").alias("k", "n")).groupBy("part", "k").agg(F.sum("n").alias("n"))
    found = each.select((F.col("part") * REPS + F.col("k")).alias("rep"), "n").toArrow()  # a row for each replicate
    off = np.zeros(replicates)
    off[np.asarray(found["rep"])] = size - np.asarray(found["n"])
    slack = SIGMAS * np.sqrt(np.abs(off) + 1) + SLACK
    edges = [np.clip(np.floor((int(even) + (off + side * slack) / n * 2**32) / 65536) + (side > 0), 0, 65536).astype(np.int64) << 16 for side in (-1, 1)]
    low = np.minimum(edges[0], (1 << 32) - (1 << 16))
    shared = spark.sparkContext.broadcast((low.astype(np.uint32), (np.maximum(edges[1], low + (1 << 16)) - 1 - low).astype(np.uint32)))
    kind = pa.schema([("part", pa.int32()), ("whole", pa.bool_()), *((c, pa.binary()) for c in ("n", "s", "rep", "number", "v"))])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, v, part, reps in held(batches):
            n, s, cells, whole = np.zeros(len(reps), np.int64), np.zeros(len(reps)), [], 0
            low, width = (b[reps[0] : reps[-1] + 1] for b in shared.value)
            for at, of, words, numbers in _words(rows, reps, draw):
                less, more = _below(words, low[at])
                n[at] += more
                s[at] += less.astype(np.float64) @ v[of]
                if whole <= CELLS:
                    line, column = np.divmod(np.flatnonzero(words - low[at, None] <= width[at, None]), words.shape[1])
                    cells.append(((line + at.start).astype(np.int32), numbers(line, column), v[of][column]))
                    whole += len(line)
            cells = cells if whole <= CELLS else cells[:0]
            rep, number, value = (np.concatenate([c[k] for c in cells] or [np.zeros(0, t)]) for k, t in enumerate((np.int32, np.uint64, np.float64)))
            yield pa.RecordBatch.from_pydict({"part": [part], "whole": [whole <= CELLS], "n": [n.tobytes()], "s": [s.tobytes()], "rep": [rep.tobytes()], "number": [number.tobytes()], "v": [value.tobytes()]}, kind)

    def settled(part: int, rows: list[dict]) -> pa.RecordBatch:
        joined = lambda c, t: np.concatenate([np.frombuffer(r[c], t) for r in rows])
        n, s = (np.sum([np.frombuffer(r[c], t) for r in rows], axis=0) for c, t in (("n", np.int64), ("s", np.float64)))
        rep, number, v = joined("rep", np.int32), joined("number", np.uint64), joined("v", np.float64)
        order = np.lexsort((number, rep))
        rep, number, v = rep[order], number[order], v[order]
        have = np.bincount(rep, minlength=len(n))
        left, end = size - n, np.cumsum(have)
        fine = (left >= 1) & (left <= have) & all(r["whole"] for r in rows)
        last = np.zeros(len(n), np.uint64)
        last[fine] = number[(end - have + left - 1)[fine]]
        inside = fine[rep] & (number <= last[rep])
        s = s + np.bincount(rep[inside], v[inside], len(n))
        return pa.RecordBatch.from_arrays([pa.array(part * REPS + np.arange(len(n))), pa.array(s, mask=~fine)], ["rep", "s"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["part"] != part and rows:
                    yield settled(part, rows)
                    rows = []
                part = r["part"]
                rows.append(r)
        if rows:
            yield settled(part, rows)

    ends = cells.mapInArrow(gather, "part int, whole boolean, n binary, s binary, rep binary, number binary, v binary")
    tasks = min(parts, 4 * spark.sparkContext.defaultParallelism)
    return ends.repartitionById(tasks, F.pmod("part", F.lit(tasks)).cast("int")).sortWithinPartitions("part", "n", "s").mapInArrow(settle, "rep long, s double")


def permutation_by_hash(df: DataFrame, value: str, first: str, replicates: int, draw: str = "md5") -> DataFrame:
    """One row (observed, exceedances, permutations, p, is_lower_bound) for the difference of two means, for any number of
    rows and replicates: replicates draw the first side as subset_masks() does. p is (exceedances + 1) / (permutations +
    1). df has (row, value, first), first a boolean. ValueError without values on a side."""
    at_least(1, replicates=replicates)
    with scratch():
        x = materialised(df.select("row", F.col(value).cast("double").alias("v"), F.col(first).alias("one")), "panel")
        n1, n, s1, total = x.agg(F.count_if("one"), F.count("*"), F.sum(F.when(F.col("one"), F.col("v"))), F.sum("v")).first()
        if not n1 or n1 == n:
            raise ValueError("both sides need values")
        n2 = n - n1
        observed = abs(s1 / n1 - (total - s1) / n2)
        hit = F.abs(F.col("s") * (1 / n1 + 1 / n2) - total / n2) >= observed - 1e-9
        summed = _least_sums(x.select("row", "v"), n, replicates, n1, draw)
        exceedances, left = summed.agg(F.count_if(hit), F.collect_list(F.when(F.col("s").isNull(), F.col("rep")))).first()
        if left:
            exceedances += _sums_by_threshold(x, np.array(sorted(left)), n1, draw).agg(F.count_if(hit)).first()[0]
    p = (exceedances + 1) / (replicates + 1)
    return df.sparkSession.range(1).select(F.lit(observed).alias("observed"), F.lit(exceedances).cast("long").alias("exceedances"), F.lit(replicates).alias("permutations"), F.lit(p).alias("p"), F.lit(exceedances == 0).alias("is_lower_bound"))


def _sums_by_threshold(x: DataFrame, every: np.ndarray, size: int, draw: str) -> DataFrame:
    """(rep, s) of _least_sums() for any numbers, for the replicates of `every`; a task hands on one sum for each."""
    shared = x.sparkSession.sparkContext.broadcast(_thresholds(x, every, size, draw))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(len(every))
        for batch in batches:
            v = np.asarray(batch.column("v"))
            for i, j, h in _blocks(batch.column("row"), every, draw):
                out[j] += v[i] @ (h <= shared.value[j])
        yield pa.RecordBatch.from_pydict({"rep": every, "s": out})

    return x.select("row", "v").mapInArrow(sums, "rep long, s double").groupBy("rep").agg(F.sum("s").alias("s"))


def half_sample_importance(matrix: DataFrame, labels: DataFrame, replicates: int) -> DataFrame:
    """(feature, mean, std): the difference of column means over random halves of the rows, sample deviation. A row carries
    its halves as a mask of bits; sums of all replicates are products of values and bits, in shares of a feature first, so
    what is shuffled are entries and, for each feature, SALTS vectors. Halves without a row of some side do not count."""
    kind = matrix.schema["feature"]
    masked = materialised(subset_masks(labels.select("row", "label"), replicates, labels.count() // 2), "masks")

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((2, replicates), np.int64)
        for batch in batches:
            bits, label = _bits(batch.column("mask"), replicates), np.asarray(batch.column("label"))
            for c in (0, 1):
                out[c] += bits[label == c].sum(axis=0, dtype=np.int64)
        yield pa.RecordBatch.from_pydict({"rep": np.arange(replicates), "n0": out[0], "n1": out[1]})

    counted = masked.mapInArrow(sizes, "rep long, n0 long, n1 long").groupBy("rep").agg(F.sum("n0"), F.sum("n1")).collect()  # a row for each replicate
    n = np.zeros((2, replicates))
    for rep, n0, n1 in counted:
        n[:, rep] = n0, n1

    def by_feature(batches: Iterator[pa.RecordBatch], vectors) -> Iterator[tuple]:
        """(feature, sums of both sides) of rows that come sorted by feature."""
        name, held = None, None
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                v = vectors(part)
                names = part.column("feature").to_pylist()
                ends = [k for k in range(1, len(names)) if names[k] != names[k - 1]] + [len(names)]
                at = 0
                for end in ends:
                    if held is not None and names[at] == name:
                        held = held + v(at, end)
                    else:
                        if held is not None:
                            yield name, held
                        name, held = names[at], v(at, end)
                    at = end
        if held is not None:
            yield name, held

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def vectors(part: pa.RecordBatch):
            bits, label = _bits(part.column("mask"), replicates).astype(np.float64), np.asarray(part.column("label"))
            value = np.asarray(part.column("value"))
            sides = [np.where(label == c, value, 0.0) for c in (0, 1)]
            return lambda a, b: np.stack([s[a:b] @ bits[a:b] for s in sides])

        for name, s in by_feature(batches, vectors):
            yield pa.RecordBatch.from_arrays([pa.array([name], to_arrow_type(kind.dataType)), pa.array([s.ravel().tolist()], pa.list_(pa.float64()))], ["feature", "s"])

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def vectors(part: pa.RecordBatch):
            s = np.asarray(part.column("s").flatten()).reshape(part.num_rows, 2, replicates)
            return lambda a, b: s[a:b].sum(axis=0)

        fine = (n > 0).all(axis=0)
        for name, s in by_feature(batches, vectors):
            d = s[1, fine] / n[1, fine] - s[0, fine] / n[0, fine]
            yield pa.RecordBatch.from_arrays([pa.array([name], to_arrow_type(kind.dataType)), pa.array([d.mean() if len(d) else None], pa.float64()), pa.array([d.std(ddof=1) if len(d) > 1 else None], pa.float64())], ["feature", "mean", "std"])

    tasks = int(matrix.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = matrix.select("row", "feature", F.col("value").cast("double").alias("value")).join(masked, "row")
    salted = entries.repartition(tasks, "feature", F.pmod(F.xxhash64("row"), F.lit(SALTS))).sortWithinPartitions("feature").select("feature", "value", "label", "mask")
    shares = salted.mapInArrow(partial, StructType([kind, StructField("s", ArrayType(DoubleType()))]))
    return shares.repartition(tasks, "feature").sortWithinPartitions("feature").mapInArrow(final, StructType([kind, StructField("mean", DoubleType()), StructField("std", DoubleType())]))


def top_importances(importance: DataFrame, value: str = "mean", k: int = 12) -> DataFrame:
    """Positive importances, the largest first, as shares of the largest."""
    best = importance.where(F.col(value) > 0).orderBy(F.desc(value), "feature").limit(k)
    return best.withColumn("normalized", F.col(value) / F.first_value(value).over(Window.orderBy(F.desc(value), "feature")))


def permutation_test(values: list[float], first: list[bool], spark, permutations: int, seed: int = 0, batch: int = 2000) -> DataFrame:
    """One row (observed, exceedances, permutations, p, is_lower_bound) for the difference of two means; p is
    (exceedances + 1) / (permutations + 1). The replicates are dealt to tasks in batches with seeds of their own; the
    values go to each task, so they are the summaries of one panel: ValueError beyond PANEL of them (null_z takes any
    number of rows)."""
    v, side = np.asarray(values, float), np.asarray(first, bool)
    n1, total = int(side.sum()), float(v.sum())
    n2 = len(v) - n1
    if len(v) > PANEL:
        raise ValueError(f"{len(v)} values are more than the {PANEL} of a panel")
    if not n1 or not n2:
        raise ValueError("both sides need values")
    shared = spark.sparkContext.broadcast(v)
    observed = abs(v[side].mean() - v[~side].mean())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in b["id"]:
                rng, x = np.random.default_rng([seed, int(k)]), shared.value
                size = min(batch, permutations - int(k) * batch)
                picked = np.argpartition(rng.random((size, len(x))), n1 - 1, axis=1)[:, :n1]
                sums = x[picked].sum(axis=1)
                yield pd.DataFrame({"hits": [int((np.abs(sums * (1 / n1 + 1 / n2) - total / n2) >= observed - 1e-15).sum())]})

    hits = spark.range(-(-permutations // batch)).mapInPandas(run, "hits long").agg(F.sum("hits").alias("exceedances"))
    return hits.select(F.lit(float(observed)).alias("observed"), "exceedances", F.lit(permutations).alias("permutations"), ((F.col("exceedances") + 1) / (permutations + 1)).alias("p"), (F.col("exceedances") == 0).alias("is_lower_bound"))
