"""Whitening of vectors by the principal components of their covariance.

Entries become integers, so counts, sums and centred rows are exact; only then does double arithmetic start. The
covariance is the Gramian of the centred rows, as a RowMatrix of MLlib computes it in parts merged as a tree, over n.
What the driver holds is a matrix of dimension x dimension; the projection is broadcast, and rows are whitened where they
are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: |scale * entry| is held within this, far above any use, so that sums and shifts stay in 64 bits.
MOST = 1 << 60
#: Sums of a batch are kept in two parts of that many low bits and the rest.
LOW = 30
_LONG = (1 << 63) - 1


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """(vec_id, x): floor(scale * c) + shift of each entry c as double. Rows whose vector is null or holds null, NaN or
    infinite entries are left out; rows without an id stay."""
    v = F.col(vec_col)
    fine = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    x = F.transform(v, lambda e: F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), e.cast("double") * scale))).cast("long") + shift)
    return df.where(v.isNotNull() & fine).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column("x"))
            low, high = (x & ((1 << LOW) - 1)).sum(axis=0), (x >> LOW).sum(axis=0)
            yield pa.RecordBatch.from_pydict({"at": np.arange(x.shape[1], dtype=np.int32), "n": np.full(x.shape[1], len(x)), "low": low, "high": high})


def sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """(n, exact sum of each dimension) of vectors of one length."""
    parts = vectors.select("x").mapInArrow(_partial_sums, "at int, n long, low long, high long")
    whole = F.sum(F.col("low").cast("decimal(20,0)")), F.sum(F.col("high").cast("decimal(20,0)"))
    rows = parts.groupBy("at").agg(F.sum("n").alias("n"), whole[0].alias("low"), whole[1].alias("high")).orderBy("at").collect()
    return (rows[0]["n"] if rows else 0), [int(r["low"]) + (int(r["high"]) << LOW) for r in rows]


def centred(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """n * x - S in integers: of 64 bits where they suffice, of any size elsewhere."""
    if n * max(int(np.abs(x).max(initial=0)), 1) + max(map(abs, s), default=0) < 1 << 62:
        return n * x - np.array(s, np.int64)
    return n * x.astype(object) - np.array(s, object)


def deviations(d: np.ndarray) -> list[int | None]:
    """The sum of squares of each row, exact; null where it is over a long."""
    if d.dtype != object and int(np.abs(d).max(initial=0)) ** 2 * max(1, d.shape[1]) < 1 << 62:
        return (d * d).sum(axis=1).tolist()
    exact = (d.astype(object) ** 2).sum(axis=1)
    return [int(e) if e <= _LONG else None for e in exact]


def _rows(d: np.ndarray, n: int) -> np.ndarray:
    return d.astype(np.float64) / n


def _centred_rows(n: int, s: list[int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"v": list(_rows(centred(np.stack(batch["x"].to_numpy()), n, s), n))})

    return run


def _row_matrix(rows: DataFrame, n: int, width: int) -> RowMatrix:
    """Of a table whose one column v is an array of doubles."""
    return RowMatrix(MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector("v").alias("v")), "v"), n, width)


def covariance(rows: DataFrame, n: int, width: int) -> np.ndarray:
    """Gramian over n of rows that are centred already."""
    return _row_matrix(rows, n, width).computeGramianMatrix().toArray() / n


def components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(directions as columns, their eigenvalues, shares of the trace), largest first, k at most."""
    e, u = np.linalg.eigh((v + v.T) / 2)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    trace = np.trace(v)
    return u, e, e / trace if trace > 0 else np.full(len(e), np.nan)


def _whitened(n: int, s: list[int], projection: Broadcast):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                d = centred(np.stack(batch["x"].to_numpy()), n, s)
                yield pd.DataFrame({"vec_id": batch["vec_id"], "deviation": pd.array(deviations(d), "Int64"), "v": list(_rows(d, n) @ projection.value)})

    return run


def whiten(vectors: DataFrame, k: int = 32) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row and each of the k largest
    components. `vectors` is what integer_vectors() gives.

    Vectors of one length make one space: if lengths differ, the most frequent one (then the longest) is whitened, and
    rows of other lengths, which have no place in it, are left out; so are empty vectors. Repeated rows count row by
    row. A component along which the rows do not vary (eigenvalue within rounding of 0) has a null `whitened` and takes
    no part in identity_error; explained is null if nothing varies. A deviation over a long is null. An empty table gives
    an empty result."""
    spark = vectors.sparkSession
    lengths = vectors.where(F.size("x") > 0).groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not lengths:
        return spark.createDataFrame([], schema)
    width = lengths[0]["d"]
    vectors = vectors.where(F.size("x") == width)
    n, s = sums(vectors)
    u, e, explained = components(covariance(vectors.select("x").mapInPandas(_centred_rows(n, s), "v array<double>"), n, width), k)
    varies = e > max(e.max(), 0) * width * np.finfo(float).eps
    projection = spark.sparkContext.broadcast(np.where(varies, u / np.sqrt(np.where(varies, e, 1.0)), 0.0))  # length of a vector x k
    out = written(vectors.mapInPandas(_whitened(n, s, projection), "vec_id long, deviation long, v array<double>"), "whitened")
    error = None
    if varies.any():
        mean = _row_matrix(out, n, len(e)).computeColumnSummaryStatistics().mean()
        around = F.array(*[F.lit(float(m)) for m in mean])
        gap = covariance(out.select(F.zip_with("v", around, lambda a, b: a - b).alias("v")), n, len(e)) - np.eye(len(e))
        error = float(np.abs(gap[np.ix_(varies, varies)]).max())
    share = F.array(*[F.lit(None if np.isnan(x) else float(x)).cast("double") for x in explained])
    known = F.array(*[F.lit(bool(x)) for x in varies])
    rows = out.select("vec_id", "deviation", F.posexplode("v").alias("at", "w"))
    return rows.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.when(known[F.col("at")], F.col("w")).alias("whitened"), share[F.col("at")].alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
