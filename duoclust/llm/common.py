"""Shared helpers: tables, written intermediate results, words and hashes of whole batches."""

from __future__ import annotations

import tempfile
import uuid
import weakref

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one vectorised step takes at most, unless one document alone is longer.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where the session names none and runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="duoclust-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Drops the shuffle files of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PLACES: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def written(df: DataFrame, name: str, *then_drop: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder and read back: lineage ends there. Shuffle files go with the
    write, and so do the tables of then_drop, which this function has returned before and nothing else needs."""
    spark = df.sparkSession
    path, before = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _PLACES[out] = path
    dropped(*then_drop)
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for table in tables:
        if (at := _PLACES.pop(table, None)) is not None:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fresh(name: str, *taken: list[str]) -> str:
    """The name, with underscores behind it until no column of `taken` has it (names do not tell case apart)."""
    used = {c.lower() for columns in taken for c in columns}
    while name.lower() in used:
        name += "_"
    return name


def tasks_wanted(spark: SparkSession, per_core: int = 2) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), per_core * spark.sparkContext.defaultParallelism)


# ---------------------------------------------------------------- text of a batch as bytes

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as far as they were asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        return self.up, self.down


POWERS = _Powers()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offset of each row in them; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    if column.buffers()[2] is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def in_steps(batches, text: str = "text", step: int = STEP_BYTES):
    """Slices of Arrow batches whose texts hold about `step` bytes; a longer text comes alone."""
    for batch in batches:
        _, offsets = text_bytes(batch.column(text))
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + step, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def prefix_hash(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """c with c[i] = sum of (byte + 1) * base**j over j < i: differences hash substrings."""
    up, _ = POWERS.upto(len(data) + 1)
    c = np.empty(len(data) + 1, np.uint64)
    c[0] = 0
    np.cumsum(((_LOWER[data] if lower else data).astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=c[1:])
    return c


def hash_between(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of substrings [starts, ends), wherever they lie."""
    _, down = POWERS.upto(len(c))
    return mix((c[ends] - c[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words_of(data: np.ndarray, offsets: np.ndarray):
    """(starts, ends, row, hash) of the words `[^\\x20\\x09-\\x0D]+` of every row, A-Z as a-z."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    first[heads] = word[heads]
    last = word.copy()
    last[:-1] &= ~word[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    last[tails] = word[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, row, hash_between(prefix_hash(data, lower=True), starts, ends)


_STEPS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingles_of(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of `width` successive word hashes, without regard to rows."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = mix(out * _STEPS[0] + hashes[k : k + n] * _STEPS[1 + k % 4])
    return out
