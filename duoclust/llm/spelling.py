"""Spelling variants: frequent words one edit apart, and the form that each stands for.

Words meet in a positional q-gram index. A word of m code points, padded at both ends, has m + q - 1 grams; one edit
changes at most q of them and moves the others by at most one place. Two words one edit apart therefore share at least
max(m1, m2) - 1 grams whose places differ by at most one, and the first j of these, in any order of all grams, are among
the first q + j grams of both. Each word is posted under its rarest grams only, with place and length; a list of
postings that is too long for a task is posted again under pairs of grams, then triples, and what is still long meets
block by block. In a list, the postings of its words' grams are merged through a heap under the limits of length and
place, and pairs that can reach the bound are verified.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, in_steps, mix, tasks_wanted, written

Q = 4
#: Words in a list that one task merges; grams that a list is split by at most (words of 5 code points share 4).
LIST, DEPTH = 64, 4
#: Words in a list that are compared without an index.
SMALL = 8
#: Bits of the buckets in which the frequency of grams is counted.
BUCKETS = 17
_ODD = 0x9E3779B97F4A7C15
#: Distinct words that a task counts before it hands them on.
HELD = 200_000
#: Fixed values of the words' contract: what a word is made of, and which occurrence loses a code point.
LETTERS = "[A-Za-z\u00C0-\u00FF]+"
DROPPED = 97
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def frequent_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, least_n: int = 3) -> DataFrame:
    """(word, n): the words of at least least_length code points with at least least_n occurrences in all texts. A word
    is a maximal run of LETTERS with A-Z in lower case; where DROPPED divides the unsigned crc32 h of `<id>:<run>`, it
    lacks the code point h % length. Null texts have no words, a null id is empty."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    counted = rows.mapInArrow(_counted(least_length), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def _counted(least_length: int):
    """Words of some texts at a time, counted."""
    find = re.compile(LETTERS).findall

    def words_of(ident: str, text: str) -> Iterator[tuple[str, int]]:
        start = zlib.crc32(f"{ident}:".encode())
        for run, n in Counter(find(text.encode().translate(_LOWER).decode())).items():
            if (h := zlib.crc32(run.encode(), start)) % DROPPED == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least_length:
                yield run, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = defaultdict(int)
        for batch in in_steps(batches):
            for ident, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                for word, n in words_of(ident, text):
                    held[word] += n
            if len(held) > HELD:
                yield pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())})
                held.clear()
        if held:
            yield pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())})

    return run


def _grams(word: str) -> list[str]:
    padded = "\x01" * (Q - 1) + word + "\x02" * (Q - 1)
    return [padded[k : k + Q] for k in range(len(word) + Q - 1)]


def _hashed(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, place, hash) of every gram, in order. Grams of one hash, as rare as they are, share their lists."""
    head, tail = "\x01" * (Q - 1), "\x02" * (Q - 1)
    codes = np.frombuffer("".join([head + w + tail for w in words]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = np.array([len(w) + Q - 1 for w in words], np.int64)
    word = np.repeat(np.arange(len(words)), n)
    place = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
    start = np.arange(len(word)) + (Q - 1) * word
    h = np.zeros(len(word), np.uint64)
    for k in range(Q):
        h = mix(h * np.uint64(_ODD) + codes[start + k] + np.uint64(1))
    return word, place, h


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKETS)).astype(np.int64)


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << BUCKETS, np.int64)
    for batch in batches:
        total += np.bincount(_bucket(_hashed(batch.column("word").to_pylist())[2]), minlength=len(total))
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"bucket": some.astype(np.int32), "n": total[some]})


def _posted(counts: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, place, h = _hashed(batch.column("word").to_pylist())
            order = np.lexsort((place, h, counts.value[_bucket(h)], word))
            first = np.arange(len(word)) - np.searchsorted(word, word, "left") < Q + DEPTH
            order = order[first]
            offsets = np.searchsorted(word[order], np.arange(batch.num_rows + 1)).astype(np.int32)
            grams = pa.StructArray.from_arrays([pa.array(h[order].view(np.int64)), pa.array(place[order].astype(np.int32))], ["gram", "place"])
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.ListArray.from_arrays(pa.array(offsets), grams)], ["word", "n", "grams"])

    return run


def _postings(words: DataFrame) -> DataFrame:
    """(word, n, grams): of each word its first Q + DEPTH grams as structs of (gram, place), rarest first. Rarity is
    counted in 2 ** BUCKETS buckets of hashes, which bounds what is broadcast: any order of grams serves, one that begins
    with rare grams makes short lists."""
    words = words.select("word", "n")
    counts = np.zeros(1 << BUCKETS, np.int64)
    for r in words.mapInArrow(_bucket_counts, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["bucket"]] = r["n"]
    return words.mapInArrow(_posted(words.sparkSession.sparkContext.broadcast(counts)), "word string, n long, grams array<struct<gram:long,place:int>>")


def _listed(posted: DataFrame, longer: DataFrame | None, depth: int) -> DataFrame:
    """A row (key, top, word, n, short, last) for each list of `depth` grams that a word is in. A list has one first gram,
    one place of it and one length `top`. Words of that length are in it with their places; words one shorter, `short`,
    with the same place or the next, where an insertion moves the gram: they lose a gram less, so one less is posted."""
    if longer is None:
        rows = posted.select("word", "n", F.posexplode(F.slice("grams", 1, Q + 1)).alias("last", "g"))
        copies = F.array(*[F.struct(F.lit(short).alias("short"), F.lit(step).alias("step")) for short, step in ((False, 0), (True, 0), (True, 1))])
        rows = rows.withColumn("c", F.explode(F.when(F.col("last") < Q, copies).otherwise(F.slice(copies, 1, 1))))
        top = F.length("word") + F.col("c.short").cast("int")
        return rows.select(F.xxhash64("g.gram", F.col("g.place") + F.col("c.step"), top).alias("key"), top.alias("top"), "word", "n", F.col("c.short").alias("short"), "last")
    most = F.lit(Q + depth) - F.col("short").cast("int")
    later = F.slice("grams", F.col("last") + 2, F.greatest(F.lit(0), most - F.col("last") - 1))
    rows = longer.join(posted.select("word", "grams"), "word").select("key", "top", "word", "n", "short", "last", F.posexplode(later).alias("step", "g"))
    return rows.select(F.xxhash64("key", "g.gram").alias("key"), "top", "word", "n", "short", (F.col("last") + 1 + F.col("step")).alias("last"))


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one code point is inserted, deleted or replaced."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k, least = 0, min(len(a), len(b))
    while k < least and a[k] == b[k]:
        k += 1
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def near_in_list(words: list[tuple], top: int) -> Iterator[tuple]:
    """(a, n of a, b, n of b), a before b, of all pairs one edit apart whose longer word has `top` code points. `words`
    are (word, n, side), of `top` code points or one less; two of one side that is not None are left to another list."""
    words = sorted(set(words), key=lambda w: (len(w[0]) != top, w[0]))
    if len(words) <= SMALL:  # verified as they are: an index would cost more
        for k, (word, n, side) in enumerate(words):
            for other, m, far in words[:k]:
                if len(other) == top and (side is None or side != far) and one_edit(word, other):
                    yield (other, m, word, n) if other < word else (word, n, other, m)
        return
    index = defaultdict(list)  # gram -> (rank, place) of words of `top` code points, in the order of ranks
    for rank, (word, n, side) in enumerate(words):
        own = _grams(word)
        lists = [[r for r, place in index[gram] if -2 < place - at < 2] if gram in index else () for at, gram in enumerate(own)]
        # at most Q grams of a word are not shared: of the Q + 2 shortest lists a near word is in two, equal ranks of
        # their merge come together, and long lists need no merge
        lists.sort(key=len)
        before, done = -1, -1
        for r in heapq.merge(*lists[: Q + 2]) if lists[Q] else ():
            if r == before and r != done:
                done = r
                other, m, far = words[r]
                if (side is None or side != far) and one_edit(word, other):
                    yield (other, m, word, n) if other < word else (word, n, other, m)
            before = r
        if len(word) == top:
            for at, gram in enumerate(own):
                index[gram].append((rank, at))


_MERGED = pa.schema([("a", pa.string()), ("na", pa.int64()), ("b", pa.string()), ("nb", pa.int64()), ("key", pa.int64()), ("top", pa.int32()), ("short", pa.bool_()), ("last", pa.int32())])
_LISTS = ["key", "top", "word", "n", "short", "last", "side"]


def _merge(most: int | None):
    """Lists come sorted. Near pairs of those of at most `most` words; rows of longer lists as they are, with b null."""

    def pairs(rows: pa.Table) -> list[tuple]:
        out = []
        key, top = np.asarray(rows["key"]), np.asarray(rows["top"])
        ends = [*np.flatnonzero((key[1:] != key[:-1]) | (top[1:] != top[:-1])) + 1, len(key)]
        values = list(zip(*[rows[c].to_pylist() for c in ("word", "n", "side")]))
        at = 0
        for end in ends:
            out.extend(near_in_list(values[at:end], int(top[at])))
            at = end
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, long_key = None, None
        for batch in _with_end(batches):
            rows = held if batch is None else pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if rows is None or not len(rows):
                continue
            key, top = np.asarray(rows["key"]), np.asarray(rows["top"])
            start = np.r_[0, np.flatnonzero((key[1:] != key[:-1]) | (top[1:] != top[:-1])) + 1]
            size = np.diff(np.r_[start, len(key)])
            of = np.repeat(np.arange(len(start)), size)
            long = size > most if most is not None else np.zeros(len(size), bool)
            if long_key is not None and (int(key[0]), int(top[0])) == long_key:
                long[0] = True
            # the last list may go on in the next batch: it waits, unless it is long already
            waits = np.zeros(len(size), bool)
            waits[-1] = batch is not None and not long[-1]
            long_key = (int(key[-1]), int(top[-1])) if long[-1] else None
            if (kept := long[of]).any():
                some = rows.filter(pa.array(kept)).combine_chunks()
                none = pa.nulls(len(some))
                yield from pa.Table.from_arrays([some["word"], some["n"], none.cast(pa.string()), none.cast(pa.int64()), some["key"], some["top"], some["short"], some["last"]], schema=_MERGED).to_batches()
            if (short := (~long & ~waits & (size > 1))[of]).any() and (found := pairs(rows.filter(pa.array(short)))):
                none = [None] * len(found)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((*zip(*found), none, none, none, none), _MERGED, strict=True)], schema=_MERGED)
            held = rows.filter(pa.array(waits[of])) if waits[-1] else None

    return run


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, na, b, nb), a before b, once for each two of `words` (word, n; words of 5 code points or more, distinct) that
    are one edit apart; written."""
    posted, merged, longer = _postings(words), [], None

    def met(lists: DataFrame, most: int | None, name: str, *then_drop: DataFrame) -> DataFrame:
        ordered = lists.select(*_LISTS).repartition(tasks_wanted(words.sparkSession), "key").sortWithinPartitions("key", "top")
        schema = "a string, na long, b string, nb long, key long, top int, short boolean, last int"
        merged.append(written(ordered.mapInArrow(_merge(most), schema), name, *then_drop))
        return merged[-1].where("b IS NULL").drop("b", "nb").withColumnsRenamed({"a": "word", "na": "n"})

    for depth in range(1, DEPTH + 1):
        longer = met(_listed(posted, longer, depth).withColumn("side", F.lit(None).cast("int")), LIST, f"spelling-lists-{depth}")
        if longer.isEmpty():
            break
    else:
        # every two blocks of a list that shares DEPTH grams meet in a task of their own
        sizes = longer.groupBy("key").agg(F.ceil(2 * F.count("*") / LIST).cast("int").alias("blocks"))
        rows = longer.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        pair = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
        met(rows.withColumn("side", F.when(F.col("other") != F.col("block"), F.col("block"))).withColumn("key", pair), None, "spelling-blocks")
    found = merged[0]
    for more in merged[1:]:
        found = found.unionByName(more)
    return written(found.where("b IS NOT NULL").select("a", "na", "b", "nb").distinct(), "spelling-pairs", *merged)


def variants(words: DataFrame, times: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of `words`, what frequent_words() gives. form: the near word of
    largest n (ties: the smallest in code-point order) if its n is at least `times` the word's, else null; form_n its n;
    n_near: how many words are near. root: where the forms lead from word, itself if it has none. An empty table gives an
    empty result."""
    words = written(words, "spelling-words")
    pairs = near_pairs(words)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("nb").alias("na"), F.col("a").alias("b"), F.col("na").alias("nb")))
    best = F.min(F.struct((-F.col("nb")).alias("less"), F.col("b").alias("form"))).alias("best")
    near = both.groupBy(F.col("a").alias("word"), F.col("na").alias("n")).agg(F.count("*").alias("n_near"), best)
    near = near.withColumn("is_form", -F.col("best.less") >= times * F.col("n"))
    near = written(near.select("word", "n_near", F.when(F.col("is_form"), F.col("best.form")).alias("form"), F.when(F.col("is_form"), -F.col("best.less")).alias("form_n")), "spelling-near", pairs)
    roots = written(near.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots")
    # n grows at every step, so paths end; each round doubles the steps taken
    while True:
        further = roots.alias("l").join(roots.alias("r"), F.expr("l.root = r.word")).select("l.word", F.col("r.root").alias("further"))
        further = written(further, "spelling-further")
        if further.isEmpty():
            break
        moved = roots.join(further, "word", "left").select("word", F.coalesce("further", "root").alias("root"))
        roots = written(moved, "spelling-roots", roots, further)
    dropped(further)
    out = words.join(near, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
