"""Ordered token sequences to windowed n-gram counts, rankings and sparse matrices.

A table of documents has `key` (which sequence), `seq` (dense place in it, from 0), `n_docs`, `before` (tokens of the
sequence before the document) and `toks`. Window i of a sequence of N documents holds documents max(0, i - w) to
min(i + w - 1, N - 2): the last document is in none. n-grams cross documents inside a window.

Windows are not built to count. An n-gram whose first token is in document ds and whose last is in de lies in just
the windows max(0, de - w + 1) to min(N - 1, ds + w), if de <= N - 2; counts add the lengths of those ranges, and
only the occurrences of selected features are spread over their windows.

No task holds a sequence. Documents are dealt to ranges of (key, order) and numbered there, with the rows and tokens
before a range added from one row for each range and key. Tokens then meet in blocks of their places, and each block
also gets the first n - 1 tokens of the next; documents meet in blocks of theirs, with `width` of them to either side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import at_least, ngrams
from ..sources.io import materialised
from .order import numbered

#: Tokens and documents of a sequence that one task takes at a time.
TOKENS, DOCS = 1 << 16, 1 << 12


def sequences(df: DataFrame, key: str, order: list[str], ranges: int | None = None, **arrays) -> DataFrame:
    """(key, seq, n_docs, before, arrays...): rows numbered from 0 in the given order, null keys as a sequence of their
    own. `before` counts the elements of the first array. Written once, in `ranges` ranges (shuffle partitions by default);
    in an io.scratch() scope that table goes with the scope."""
    places = [f"__{k}" for k in range(len(order))]
    rows = df.select(F.col(key).alias("key"), *(F.col(c).alias(p) for c, p in zip(order, places, strict=True)), *(c.alias(k) for k, c in arrays.items()))
    size = F.coalesce(F.size(next(iter(arrays))), F.lit(0)).cast("long") if arrays else F.lit(0).cast("long")
    ranged = rows.repartitionByRange(ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", *places)
    at = materialised(ranged.withColumn("range", F.spark_partition_id()), "sequences")
    parts = at.groupBy("range", "key").agg(F.count("*").alias("n"), F.sum(size).alias("t"))
    whole = Window.partitionBy("key")  # of counts: a row for each range
    earlier = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("range", "key", F.sum("n").over(whole).alias("n_docs"), *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("n", "t")))
    line = Window.partitionBy("range", "key").orderBy(*places)
    inside = at.withColumns({"row": F.row_number().over(line), "t": F.sum(size).over(line.rowsBetween(Window.unboundedPreceding, 0)) - size})
    both = inside.alias("l").join(offsets.alias("r"), F.expr("l.range = r.range AND l.key <=> r.key"))
    return both.select("l.key", (F.col("n_before") + F.col("row") - 1).alias("seq"), "n_docs", (F.col("t_before") + F.col("l.t")).alias("before"), *(F.col(f"l.{k}") for k in arrays))


def _placed(docs: DataFrame) -> DataFrame:
    """docs with `before`, for tables that sequences() has not made."""
    size = F.coalesce(F.size("toks"), F.lit(0)).cast("long")
    rows = docs.withColumn("part", F.floor(F.col("seq") / DOCS))
    parts = rows.groupBy("key", "part").agg(F.sum(size).alias("t"))
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # of counts: a row for DOCS documents
    offsets = parts.select("key", "part", F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("t"))
    line = Window.partitionBy("key", "part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumn("before", F.sum(size).over(line) - size)
    both = inside.alias("l").join(offsets.alias("r"), F.expr("l.part = r.part AND l.key <=> r.key"))
    return both.select("l.*", "r.t").withColumn("before", F.col("before") + F.col("t")).drop("part", "t")


def running_windows(docs: DataFrame, width: int, block: int = DOCS) -> DataFrame:
    """(key, seq, toks): the tokens of each window, in order; for use where a window itself is asked for."""
    at_least(1, width=width, block=block)
    own = F.floor(F.col("seq") / block)
    # document s is in windows s - width + 1 to s + width
    spread = F.sequence(F.floor(F.greatest(F.lit(0), F.col("seq") - width + 1) / block), F.floor((F.col("seq") + width) / block))
    inside = F.when(F.col("seq") < F.col("n_docs") - 1, F.col("toks"))
    placed = docs.select("key", "seq", inside.alias("toks"), own.alias("own"), F.explode(spread).alias("block"))
    frame = Window.partitionBy("key", "block").orderBy("seq").rowsBetween(-width, width - 1)
    return placed.withColumn("toks", F.flatten(F.collect_list("toks").over(frame))).where("block = own").select("key", "seq", "toks")


def occurrences(docs: DataFrame, n: int, width: int, more: str | None = None, block: int = TOKENS) -> DataFrame:
    """(key, feature, lo, hi, place): every n-gram that is in a window, with its first and last window and the
    place of its first token, from 1; with `more`, the n-gram of that second channel too."""
    at_least(1, n=n, width=width)
    found = ngram_spans(docs, n, more, block)
    ranged = found.withColumns({"lo": F.greatest(F.lit(0), F.col("de") - width + 1), "hi": F.least(F.col("n_docs") - 1, F.col("ds") + width)})
    return ranged.where("hi >= lo").select("key", "feature", *(["other"] if more else []), "lo", "hi", "place")


def ngram_spans(docs: DataFrame, n: int, more: str | None = None, block: int = TOKENS, near: int | None = None) -> DataFrame:
    """(key, feature, ds, de, n_docs, place): every n-gram with the documents of its first and last token, those that
    reach the last document of their sequence left out. Single tokens need no neighbours and no shuffle. With `near`,
    inner_ngrams() of it are left out, and only the tokens at the ends of documents are sorted for that."""
    at_least(1, n=n, block=block)
    channels, block = {"toks": "feature"} | ({more: "other"} if more else {}), max(block, n)
    docs = docs if "before" in docs.columns else _placed(docs)
    size = [] if near is None else [F.size("toks").alias("size")]
    axis = docs.select("key", "seq", "n_docs", "before", *size, F.posexplode(F.arrays_zip(*channels)).alias("pos", "z"))
    axis = axis.withColumn("place", F.col("before") + F.col("pos"))
    if near is not None:
        axis = axis.where(~_inner("seq", near) | (F.col("pos") < n - 1) | (F.col("pos") > F.col("size") - n))
    if n == 1:
        own, last, columns = axis, F.col("seq"), [F.array(F.col(f"z.{c}")).alias(name) for c, name in channels.items()]
    else:
        at = F.floor(F.col("place") / block)
        halo = (at > 0) & (F.col("place") % block < n - 1)
        own = axis.withColumn("block", F.explode(F.when(halo, F.array(at, at - 1)).otherwise(F.array(at))))
        line = Window.partitionBy("key", "block").orderBy("place")
        columns = [F.array(*(F.lead(F.col(f"z.{c}"), k).over(line) if k else F.col(f"z.{c}") for k in range(n))).alias(name) for c, name in channels.items()]
        last = F.lead("seq", n - 1).over(line)
        if near is not None:  # tokens between may be missing
            last = F.when(F.lead("place", n - 1).over(line) == F.col("place") + n - 1, last)
    rows = own.select("key", "n_docs", F.col("seq").alias("ds"), last.alias("de"), F.col("place"), *(["block"] if n > 1 else []), *columns)
    rows = rows.where(F.col("de") <= F.col("n_docs") - 2)
    if n > 1:
        rows = rows.where(F.col("block") == F.floor(F.col("place") / block)).drop("block")
    if near is not None:
        rows = rows.where((F.col("de") > F.col("ds")) | ~_inner("ds", near))
    return rows.withColumn("place", F.col("place") + 1)


def _inner(seq: str, near: int) -> Column:
    return (F.col(seq) >= near - 1) & (F.col(seq) <= F.col("n_docs") - 1 - near)


def inner_ngrams(docs: DataFrame, n: int, near: int) -> DataFrame:
    """(feature, place) of the n-grams of ngram_spans() inside one document that no window of up to `near` documents is cut
    by an end of the sequence for: each lies in 2 * width windows. They need no neighbours."""
    docs = docs if "before" in docs.columns else _placed(docs)
    found = docs.where(_inner("seq", near)).select("before", F.posexplode(ngrams("toks", n)).alias("pos", "feature"))
    return found.select("feature", (F.col("before") + F.col("pos") + 1).alias("place"))


def feature_counts(found: DataFrame, by_key: bool = False) -> DataFrame:
    """(feature, cnt, first): occurrences over all windows and the first of them; with by_key for each sequence."""
    keys = ["key", "feature"] if by_key else ["feature"]
    first = F.struct("lo", "place") if by_key else F.struct("key", "lo", "place")
    return found.groupBy(*keys).agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("cnt"), F.min(first).alias("first"))


def range_length(width: int, widest: int) -> Column:
    """In how many windows of `width` an n-gram of ngram_spans() lies, 0 or less if in none: what the widest window sees
    of either end of the sequence serves all narrower ones."""
    left, right = F.least(F.col("de") + 1, F.lit(widest)), F.least(F.col("n_docs") - 1 - F.col("ds"), F.lit(widest))
    return F.least(left, F.lit(width)) + F.least(right, F.lit(width)) - (F.col("de") - F.col("ds"))


def counts_by_width(spans: DataFrame, widths: list[int]) -> DataFrame:
    """(feature, width, cnt, first): feature_counts() of one sequence for every width, from one pass over its n-grams.
    An n-gram's windows are as many as the documents at its sides allow, less those it spans; its first place comes before
    all others in any of them."""
    at_least(1, **{f"width {k}": w for k, w in enumerate(widths)})
    lengths = {w: range_length(w, max(widths)) for w in widths}
    totals = [a for w, n in lengths.items() for a in (F.sum(F.greatest(n, F.lit(0))).alias(f"c{w}"), F.min(F.when(n > 0, F.col("place"))).alias(f"p{w}"))]
    wide = spans.groupBy("feature").agg(*totals)
    each = F.explode(F.array(*(F.struct(F.lit(w).alias("width"), F.col(f"c{w}").alias("cnt"), F.col(f"p{w}").alias("first")) for w in widths)))
    return wide.select("feature", each.alias("c")).select("feature", "c.*").where("cnt > 0")


def ranked_by_width(counts: DataFrame, top: int) -> DataFrame:
    """counts_by_width() with `rank` from 1 in each width, up to `top`; each task hands on its first `top` rows only."""
    order = Window.partitionBy("width").orderBy(F.desc("cnt"), "first")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def ranked(counts: DataFrame, top: int | None, by_key: bool = False) -> DataFrame:
    """counts with `rank` from 1, the most frequent first, ties by first appearance; ranks up to `top`,
    or of all if it is None."""
    if by_key:
        order = Window.partitionBy("key").orderBy(F.desc("cnt"), "first")
        placed = counts.withColumn("rank", F.row_number().over(order))
        return placed if top is None else placed.where(F.col("rank") <= top)
    if top is None:
        return numbered(counts, F.desc("cnt"), "first", name="rank").withColumn("rank", (F.col("rank") + 1).cast("int"))
    best = counts.orderBy(F.desc("cnt"), "first").limit(top)  # top rows of each task, then of those
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("cnt"), "first")))


def count_matrix(found: DataFrame, features: DataFrame) -> DataFrame:
    """(key, row, feature_id, value): selected features in each window. Windows without any have no rows."""
    chosen = features.select("feature", F.col("rank").alias("feature_id"))
    hits = found.join(chosen, "feature").select("key", "feature_id", F.explode(F.sequence("lo", "hi")).alias("row"))
    return hits.groupBy("key", "row", "feature_id").agg(F.count("*").alias("value"))


def binary(matrix: DataFrame) -> DataFrame:
    return matrix.withColumn("value", (F.col("value") > 0).cast("double"))


def dropped_rows(docs: DataFrame, matrix: DataFrame) -> DataFrame:
    """(key, row) of windows in which no selected feature occurs."""
    return docs.select("key", F.col("seq").alias("row")).join(matrix.select("key", "row").distinct(), ["key", "row"], "left_anti")


def surface_realizations(found: DataFrame) -> DataFrame:
    """(feature, other, cnt, total, first): how often each n-gram of the second channel stands for one of the first."""
    counts = found.groupBy("feature", "other").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("cnt"), F.min(F.struct("key", "lo", "place")).alias("first"))
    totals = counts.groupBy("feature").agg(F.sum("cnt").alias("total"))
    return counts.join(totals, "feature")


def top_realization(realizations: DataFrame) -> DataFrame:
    """The most frequent realization of each feature, ties by first appearance."""
    best = Window.partitionBy("feature").orderBy(F.desc("cnt"), "first")
    return realizations.withColumn("k", F.row_number().over(best)).where("k = 1").drop("k")


def misaligned(docs: DataFrame, one: str, other: str) -> DataFrame:
    """Documents whose two channels differ in length: none, in a sound corpus."""
    return docs.where(F.size(one) != F.size(other))
