"""Exact top-k inner-product search over a vector-approximation file.

Each vector is kept twice: as one cell number of a byte per dimension (the approximation) and exactly. A scan of the
cells bounds every score from both sides. The k-th largest lower bound of a query is a floor; a second scan of the cells
writes the vectors whose upper bounds reach it, as (query, vector, bound). Only then are exact vectors read, by a
join of those rows, in the order of their bounds, highest first, in rounds, until the k-th exact score of a query is at
least the next bound.

Vectors that are equal are searched once and stand for their smallest ids. Queries and cells meet block by block;
nothing is sent whole to a task or to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, tasks_wanted, written

#: Cells of a component's range.
CELLS = 64
#: Distinct vectors and distinct queries in a block, about; queries whose bounds are held at once.
VECTOR_BLOCK, QUERY_BLOCK, HELD = 16384, 4096, 256
#: Exact vectors that the first round reads for a query, times k.
FIRST = 2


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component as double. Rows whose vector is null, empty or holds
    null, NaN or infinite components are left out; so are rows without an id."""
    x = F.col(vec_col)
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    v = F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long"))
    return df.where(x.isNotNull() & (F.size(x) > 0) & fine & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def _table(column: pa.ListArray, values: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix) of one block, a list of structs of vec_id and a list."""
    rows = column.flatten()
    flat = rows.field(values).flatten()
    return np.asarray(rows.field("vec_id")), np.asarray(flat).reshape(len(rows), -1)


def _bounds(q: np.ndarray, cells: np.ndarray, least: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of q @ v for every v of the cells; exact for values below 2**53."""
    base = q.astype(np.float64) @ (cells.T.astype(np.float64) * width + least)
    high = np.maximum(q, 0).sum(axis=1, keepdims=True) * (width - 1)
    low = np.minimum(q, 0).sum(axis=1, keepdims=True) * (width - 1)
    return base + low, base + high


def _blocks(batches: Iterator[pa.RecordBatch]):
    """(query ids, queries, their floors, vector ids, cells, least, width), some queries of a block at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            one = batch.slice(k, 1)
            ids, cells = _table(one.column("cells"), "c")
            queries, q = _table(one.column("queries"), "v")
            floors = np.asarray(one.column("queries").flatten().field("floor"))
            least, width = one.column("least")[0].as_py(), one.column("width")[0].as_py()
            for at in range(0, len(q), HELD):
                part = slice(at, at + HELD)
                yield queries[part], q[part], floors[part], ids, cells, least, width


def _floors(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for queries, q, _, _, cells, least, width in _blocks(batches):
            low, _ = _bounds(q, cells, least, width)
            m = min(k, low.shape[1])
            best = np.partition(low, low.shape[1] - m, axis=1)[:, low.shape[1] - m :]
            yield pa.RecordBatch.from_pydict({"query": np.repeat(queries, m), "low": best.ravel()})

    return run


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for queries, q, floors, ids, cells, least, width in _blocks(batches):
        _, high = _bounds(q, cells, least, width)
        i, j = np.nonzero(high >= floors[:, None])
        yield pa.RecordBatch.from_pydict({"query": queries[i], "vec": ids[j], "high": high[i, j]})


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, reads: list[int] | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query row with all other rows,
    ties to the smaller vec_id; all of them if there are fewer. `vectors` is what integer_vectors() gives and
    `is_query` a condition on its vec_id. Vectors of different lengths are never compared. An empty table
    gives an empty result; equal vectors and repeated rows count row by row. `reads` is given the number of
    exact vectors that each round reads."""
    spark, want = vectors.sparkSession, k + 1
    first = Window.partitionBy("v").orderBy("vec_id")
    kept = vectors.withColumn("n", F.row_number().over(first)).where(F.col("n") <= want)
    distinct = written(kept.groupBy("v").agg(F.min("vec_id").alias("vec_id"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "topk-distinct")
    asked = written(vectors.where(is_query).select("v", F.col("vec_id").alias("query_id")).join(distinct.select("v", F.col("vec_id").alias("query")), "v"), "topk-asked")
    searched = asked.select("query", "v").distinct().select(F.col("query").alias("vec_id"), "v")
    width = F.greatest(F.lit(1), F.ceil((F.max(F.array_max("v")) - F.min(F.array_min("v")) + 1) / CELLS)).cast("long")
    sizes = distinct.groupBy(F.size("v").alias("dim")).agg(F.ceil(F.count("*") / VECTOR_BLOCK).cast("int").alias("vector_blocks"), F.min(F.array_min("v")).alias("least"), width.alias("width"))
    query_sizes = searched.groupBy(F.size("v").alias("dim")).agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("query_blocks"))
    sizes = written(sizes.join(query_sizes, "dim"), "topk-sizes")  # a row for each length of vector that has queries

    def blocks(df: DataFrame, n: str, name: str) -> DataFrame:
        return df.withColumn("dim", F.size("v")).join(F.broadcast(sizes), "dim").withColumn(name, F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int"))

    v = blocks(distinct.select("vec_id", "v"), "vector_blocks", "vb")
    cells = F.transform("v", lambda e: F.floor((e - F.col("least")) / F.col("width")).cast("tinyint"))
    v = v.select("dim", "vb", "least", "width", "query_blocks", F.struct("vec_id", cells.alias("c")).alias("cell"))
    packed = written(v.groupBy("dim", "vb", "least", "width", "query_blocks").agg(F.collect_list("cell").alias("cells")), "topk-cells")
    q = blocks(searched, "query_blocks", "qb").select("dim", "qb", "vec_id", "v")

    def met(queries: DataFrame) -> DataFrame:
        """Every block of cells beside every block of queries of its length."""
        groups = queries.groupBy("dim", "qb").agg(F.collect_list(F.struct("vec_id", "v", "floor")).alias("queries"))
        spread = packed.withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)))
        return spread.join(groups, ["dim", "qb"]).repartition(tasks_wanted(spark), "dim", "vb", "qb").select("queries", "cells", "least", "width")

    lows = met(q.withColumn("floor", F.lit(0.0))).mapInArrow(_floors(want), "query long, low double")
    by_low = Window.partitionBy("query").orderBy(F.desc("low"))
    floor = lows.withColumn("n", F.row_number().over(by_low)).where(F.col("n") <= want).groupBy("query").agg(F.when(F.count("*") >= want, F.min("low")).otherwise(F.lit(float("-inf"))).alias("floor"))
    floor = written(floor, "topk-floors")
    likely = met(q.join(floor, q["vec_id"] == floor["query"]).drop("query")).mapInArrow(_candidates, "query long, vec long, high double")
    by_high = Window.partitionBy("query").orderBy(F.desc("high"), "vec")
    likely = written(likely.withColumn("turn", F.row_number().over(by_high)), "topk-candidates", floor, packed)

    exact, of_query = distinct.select(F.col("vec_id").alias("vec"), "v"), searched.select(F.col("vec_id").alias("query"), F.col("v").alias("q"))
    product = F.aggregate(F.zip_with("q", "v", lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec")
    scored, left, last, step = None, likely, 0, FIRST * want
    while True:
        near = left.where(F.col("turn") <= last + step).select("query", "vec")
        got = written(near.join(exact, "vec").join(of_query, "query").select("query", "vec", product.alias("score")), "topk-read")
        if reads is not None:
            reads.append(got.count())
        top = got if scored is None else scored.unionByName(got)
        scored = written(top.withColumn("n", F.row_number().over(best)).where(F.col("n") <= want).drop("n"), "topk-scored", got, *([] if scored is None else [scored]))
        kth = scored.groupBy("query").agg(F.when(F.count("*") >= want, F.min("score")).alias("kth"))
        open_ = left.where(F.col("turn") > last + step).join(kth, "query").where(F.col("kth").isNull() | (F.col("high") >= F.col("kth"))).drop("kth")
        left, last, step = written(open_, "topk-left", left), last + step, 4 * step
        if left.isEmpty():
            break
    dropped(left)
    named = scored.join(distinct.select(F.col("vec_id").alias("vec"), "ids"), "vec").select("query", "score", F.explode("ids").alias("vec_id"))
    by_id = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    named = named.withColumn("n", F.row_number().over(by_id)).where(F.col("n") <= want).drop("n")
    ranks = Window.partitionBy("row", "query_id").orderBy(F.desc("score"), "vec_id")
    out = asked.select("query", "query_id", F.monotonically_increasing_id().alias("row")).join(named, "query").where(F.col("vec_id") != F.col("query_id"))
    out = out.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
