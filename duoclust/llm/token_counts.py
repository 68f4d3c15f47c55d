"""Exact length histogram of encoded documents, and what its suffix sums answer.

One pass encodes every whole text and keeps a count for each length. With S(L) = documents of at least L tokens
and T(L) = their tokens, a context limit L leaves sum(min(n, L)) = (T(0) - T(L)) + L * S(L) tokens; totals and
quantiles come from the same sums. The histogram is small whatever the corpus: it has a row for each length.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lengths that share a bucket of the two-level suffix sums.
BUCKET = 1024


def _encoder(vocabulary: str):
    import public_tokenizers
    import tiktoken

    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("lengths", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def length_histogram(df: DataFrame, text: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(n_tokens, n_docs) over every row; a null or empty text has 0 tokens, equal texts count each time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = _encoder(vocabulary), Counter()
        for batch in batches:
            seen.update(len(encoder.encode_ordinary(t)) if t else 0 for t in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_pydict({"n_tokens": pa.array(list(seen), pa.int64()), "n_docs": pa.array(list(seen.values()), pa.int64())})

    return df.select(text).mapInArrow(run, "n_tokens long, n_docs long").groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length L of the histogram: documents and tokens at or above it, documents at or below it, and
    the tokens left when every document is cut to L. Empty for an empty histogram."""
    h = histogram.withColumn("b", F.floor(F.col("n_tokens") / BUCKET)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    above = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    sums = h.groupBy("b").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    sums = sums.select("b", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d_above"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t_above"))
    total = h.agg(F.sum("n_docs").alias("all_docs"), F.sum("tokens").alias("all_tokens"))
    inside = Window.partitionBy("b").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    out = h.select("b", "n_tokens", "n_docs", F.sum("n_docs").over(inside).alias("d"), F.sum("tokens").over(inside).alias("t"))
    out = out.join(sums, "b").crossJoin(F.broadcast(total))  # one row
    docs, tokens = F.col("d") + F.col("d_above"), F.col("t") + F.col("t_above")
    return out.select(
        "n_tokens", "n_docs", docs.alias("docs_at_least"), tokens.alias("tokens_at_least"), (F.col("all_docs") - docs + F.col("n_docs")).alias("docs_at_most"),
        (F.col("all_tokens") - tokens + F.col("n_tokens") * docs).alias("tokens_cut_here"), "all_docs", "all_tokens",
    )


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """One row: the tokens that remain when every document is cut to `limit` tokens (0 for no documents)."""
    low = F.when(F.col("n_tokens") < limit, F.col("n_tokens") * F.col("n_docs")).otherwise(F.col("n_docs") * limit)
    return sums.agg(F.coalesce(F.sum(low), F.lit(0)).alias("tokens"))


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """One row: the least length that at least q of the documents do not exceed (null for no documents)."""
    return sums.where(F.col("docs_at_most") >= F.col("all_docs") * q).agg(F.min("n_tokens").alias("n_tokens"))
