"""Places in a global order without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import materialised

#: Bits of monotonically_increasing_id() that count the rows of a partition.
_ROWS = 33


def numbered(df: DataFrame, *keys: Column | str, name: str = "place") -> DataFrame:
    """df with each row's place, from 0, in the order of the keys; add columns that tell rows apart, so that ties do not
    share a range. Rows are dealt to ranges of the keys and numbered in each; the rows before a range come from one
    count for each range."""
    spark = df.sparkSession
    ranged = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    at = materialised(ranged.withColumn("__at", F.monotonically_increasing_id()), "numbered").withColumn("__range", F.shiftright("__at", _ROWS))
    sizes = at.groupBy("__range").agg(F.count("*").alias("n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = sizes.select("__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    inside = F.col("__at").bitwiseAND(F.lit((1 << _ROWS) - 1))
    return at.join(F.broadcast(offsets), "__range").withColumn(name, F.col("__before") + inside).drop("__range", "__at", "__before")


def dealt(df: DataFrame, cost: Column, *ties: str, tasks: int | None = None) -> DataFrame:
    """df in `tasks` partitions (4 a core by default) of about the same cost: rows in the order of cost, ties told apart
    by the given columns, go to the partitions in turn."""
    tasks = tasks or 4 * df.sparkSession.sparkContext.defaultParallelism
    placed = numbered(df, cost.desc(), *ties, name="__task")
    return placed.withColumn("__task", F.pmod("__task", F.lit(tasks)).cast("int")).repartitionById(tasks, "__task").drop("__task")
