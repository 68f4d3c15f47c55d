"""Removal of repeated byte strings by suffix arrays of shards.

A byte goes if a string of `length` bytes that covers it also starts earlier in the corpus. Documents with the
same text as an earlier one are settled first. In the others every string of `length` bytes has an anchor: the
position of the least hash of its short substrings. Neighbouring strings with one anchor are a piece of the text. Equal
strings have equal anchors at the same place, so the hash of the anchor says in which shard all copies of a string
meet, and only anchors that stand in two different pieces need their bytes: of equal pieces all but the earliest are
repeats as a whole, which hashes of pieces tell, first inside each step of a task and then in the cluster's sort.
The pieces that are left are sorted by induced suffix sorting, shard by shard; neighbours in the suffix array that
share `length` bytes form groups, and all but the earliest of a group are repeats.

A shard never holds more than a bounded number of bytes at a time: the cluster's disk-backed sort brings it the
pieces around equal anchors one group after another, and a step takes as many whole groups as fit. Anchors that are
too frequent for that, in the corpus (a bounded summary of all anchors tells) or in distinct pieces, are split: each
of their strings is an anchor of its own, known by the hash of all its bytes. Removed strings are merged into spans of
their documents at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, hash_between, in_steps, mix, prefix_hash, tasks_wanted, text_bytes, written
from .induced_sort import same_prefix, suffix_array

#: Bytes of an anchor's substring, bytes of pieces that one sort takes, about, and bytes of text in a step.
GRAM, SHARD_BYTES, STEP = 32, 2 << 20, 2 << 20
#: Anchors with more than one in so many of a task's share of all rows are split in the first place.
SHARE = 4


def _runs(data: np.ndarray, offsets: np.ndarray, length: int):
    """(row, start, n, hash, prefix hashes): runs of n strings of a row, the first at byte `start` of data, with one anchor."""
    window = length - GRAM + 1
    c = prefix_hash(data)
    grams = np.arange(len(data) - GRAM + 1)
    h = hash_between(c, grams, grams + GRAM)
    low = (h & ~np.uint64(0xFFFFFF)) | (grams.astype(np.uint64) & np.uint64(0xFFFFFF))  # ties to the left
    width = 1
    while 2 * width <= window:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(data) - length + 1], low[window - width :][: len(data) - length + 1])
    strings = np.maximum(np.diff(offsets) - length + 1, 0)
    row = np.repeat(np.arange(len(strings)), strings)
    at = offsets[row] + np.arange(len(row)) - (np.cumsum(strings) - strings)[row]
    low = low[at]
    begins = np.flatnonzero(np.concatenate(([True], (low[1:] != low[:-1]) | (row[1:] != row[:-1])))[: len(row)])
    s = at[begins]
    anchor = s + ((low[begins].astype(np.int64) - s) & 0xFFFFFF)
    return row[begins], s, np.diff(np.append(begins, len(low))), h[anchor], c


def _places(batches: Iterator[pa.RecordBatch], length: int, split: np.ndarray) -> Iterator[dict]:
    """For each step the pieces of its texts as columns: hash of the anchor, hash of the piece, doc_id (an Arrow
    column), sig, start and n, and whether the piece is known to repeat (`again`; such pieces are merged into runs). A
    text that the task has met under a smaller doc_id is not read. Strings of anchors in `split` are pieces of one."""
    seen: dict[int, int] = {}
    for step in in_steps(batches, step=STEP):
        fresh = []
        for sig, doc in zip(step.column("sig").to_pylist(), step.column("doc_id").to_pylist(), strict=True):
            doc = -(1 << 63) if doc is None else doc
            fresh.append(doc < seen.get(sig, 1 << 63))
            if fresh[-1]:
                seen[sig] = doc
        if len(seen) > 1_000_000:
            seen.clear()  # a text met again is read again, which costs only its rows
        step = step.filter(pa.array(fresh, pa.bool_()))
        docs, sigs = step.column("doc_id").fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), np.asarray(step.column("sig"))
        order = np.lexsort((sigs, docs))
        if (order[1:] < order[:-1]).any():
            step, sigs = step.take(pa.array(order)), sigs[order]
        data, offsets = text_bytes(step.column("text"))
        if len(data) < length:
            continue
        row, s, n, h, c = _runs(data, offsets, length)
        if not len(row):
            continue
        if len(split):
            hot = split[np.minimum(np.searchsorted(split, h), len(split) - 1)] == h
            if hot.any():
                times = np.where(hot, n, 1)
                each = np.repeat(np.arange(len(h)), times)
                s = s[each] + np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
                row, n, hot = row[each], np.where(hot, 1, n)[each], hot[each]
                h = np.where(hot, hash_between(c, s, s + length), h[each])
        piece = hash_between(c, s, s + n - 1 + length)
        by = np.argsort(piece, kind="stable")
        again = np.zeros(len(piece), bool)
        again[by[1:][(piece[by[1:]] == piece[by[:-1]]) & (h[by[1:]] == h[by[:-1]])]] = True
        k = np.flatnonzero(again)
        joins = np.concatenate(([False], (row[k[1:]] == row[k[:-1]]) & (s[k[1:]] <= s[k[:-1]] + n[k[:-1]] - 1 + length)))[: len(k)]
        heads = np.flatnonzero(~joins)
        ends = np.maximum.reduceat(s[k] + n[k], heads) if len(k) else k
        k, first = k[heads], np.flatnonzero(~again)
        row, start = np.concatenate([row[first], row[k]]), np.concatenate([s[first], s[k]])
        start = start - offsets[row]
        # runs that are known to repeat need no meeting: any hash will do
        yield {
            "hash": np.concatenate([h[first], mix(sigs[row[len(first) :]].view(np.uint64) + start[len(first) :].astype(np.uint64))]).view(np.int64), "piece": np.concatenate([piece[first], piece[k]]).view(np.int64),
            "doc_id": step.column("doc_id").take(pa.array(row)), "sig": sigs[row], "start": start, "n": np.concatenate([n[first], ends - s[k]]).astype(np.int32), "again": np.arange(len(row)) >= len(first),
        }


def _frequent(length: int, k: int):
    """(hash, n): anchors that may be in more than 1 of k of a task's pieces, counted from below by a summary of fixed
    size, and (null, pieces) of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, count, total = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for found in _places(batches, length, np.zeros(0, np.uint64)):
            fresh = found["hash"][~found["again"]]
            total += len(fresh)
            new, times = np.unique(fresh, return_counts=True)
            key, back = np.unique(np.concatenate([key, new]), return_inverse=True)
            count = np.bincount(back, np.concatenate([count, times]), len(key)).astype(np.int64)
            if len(key) > 4 * k:
                count -= np.partition(count, len(count) - 4 * k - 1)[len(count) - 4 * k - 1]
                key, count = key[count > 0], count[count > 0]
        many = count * 2 * k >= total
        yield pa.RecordBatch.from_arrays([pa.array([None, *key[many].tolist()], pa.int64()), pa.array([total, *count[many].tolist()], pa.int64())], ["hash", "n"])

    return run


def _anchors(length: int, split):
    """(hash, piece, doc_id, sig, start, n, again): the pieces of every distinct text of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _places(batches, length, split.value):
            yield pa.RecordBatch.from_pydict(found)

    return run


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by hash, piece, document, text and start -> those that repeat an earlier piece or run (`again`), and the
    earliest of each piece of an anchor that has different pieces. Anchors are read as a stream."""
    held: pa.RecordBatch | None = None  # the first row of the last anchor, if it has one piece so far
    last = None  # hash and piece of the last row, text and start of the piece's first row
    for batch in batches:
        if not batch.num_rows:
            continue
        h, p, sig, start, again = (np.asarray(batch.column(c)) if c != "again" else batch.column(c).to_numpy(zero_copy_only=False) for c in ("hash", "piece", "sig", "start", "again"))
        new = np.concatenate(([last is None or h[0] != last[0]], h[1:] != h[:-1]))
        piece = new | np.concatenate(([last is None or p[0] != last[1]], p[1:] != p[:-1]))
        head = np.maximum.accumulate(np.where(piece, np.arange(len(h)), -1))
        of_sig, of_start = (np.where(head >= 0, x[head], 0 if last is None else y) for x, y in ((sig, last and last[2]), (start, last and last[3])))
        repeat = again | (~piece & ~((sig == of_sig) & (start == of_start)))  # the same place of the same text is a copy of a document
        later = piece & ~new & ~again
        anchor = np.cumsum(new)
        open_ = np.zeros(anchor[-1] + 1, bool)
        open_[anchor[later]] = True
        out = repeat | later | (new & open_[anchor] & ~again)
        parts = [held] if held is not None and open_[0] else []
        if anchor[-1]:
            at = int(np.flatnonzero(new)[-1])
            held = batch.slice(at, 1) if not open_[-1] and not again[at] else None
        elif open_[0]:
            held = None
        last = (h[-1], p[-1], of_sig[-1], of_start[-1])
        parts.append(batch.filter(pa.array(out)))
        done = pa.Table.from_batches([parts[0], parts[1].set_column(6, "again", pa.array(repeat[out]))] if len(parts) > 1 else [parts[0].set_column(6, "again", pa.array(repeat[out]))]).combine_chunks()
        yield from done.drop_columns(["piece"]).to_batches()


def _segments(length: int):
    """The bytes of pieces that wait (hash, doc_id, sig, start, n, bytes); those of split anchors string by string, by
    their hashes and without bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for doc, sig, text, spots in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "sig", "text", "spots")), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for x in spots:
                    if x["again"]:
                        continue
                    start, n = x["start"], x["n"]
                    piece = data[start : start + n - 1 + length]
                    if x["split"]:
                        at = np.arange(n)
                        rows += [(h, doc, sig, start + i, 1, b"") for i, h in enumerate(hash_between(prefix_hash(np.frombuffer(piece, np.uint8)), at, at + length).view(np.int64).tolist())]
                    else:
                        rows.append((x["hash"], doc, sig, start, n, piece))
                    size += len(piece)
                    if size > SHARD_BYTES:
                        yield _segment_rows(rows)
                        rows, size = [], 0
            if rows:
                yield _segment_rows(rows)

    return run


def _segment_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["hash", "doc_id", "sig", "start", "n", "bytes"])


def _repeats(pieces: list[bytes], ns: list[int], length: int) -> np.ndarray:
    """For the strings that start in the first n bytes of each piece, all together: does one equal an earlier one?"""
    joined = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces])
    ends = np.cumsum(sizes)
    places = np.arange(len(joined)) + np.repeat(np.arange(len(pieces)), sizes)
    t = np.ones(len(joined) + len(pieces) + 1, np.uint16)  # 1 stands between pieces, 0 at the end
    t[places] = joined.astype(np.uint16) + 2
    t[-1] = 0
    n = np.array(ns)
    first = ends - sizes + np.arange(len(pieces))
    starts = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    number = np.full(len(t), -1, np.int64)
    number[starts] = np.arange(len(starts))
    order = number[suffix_array(t, length)]
    order = order[order >= 0]
    flat = starts[order] - np.repeat(np.arange(len(pieces)), n)[order]  # where they lie in `joined`
    equal = same_prefix(joined, flat[:-1], flat[1:], length)
    group = np.concatenate(([0], np.cumsum(~equal)))
    earliest = np.minimum.reduceat(order, np.flatnonzero(np.concatenate(([True], ~equal))))
    out = np.zeros(len(starts), bool)
    out[order] = order != earliest[group]
    return out


def _removed(length: int):
    """Segments sorted by anchor, document, text and start -> spans (sig, first, end) to remove."""

    def settle(held: list[tuple]) -> Iterator[tuple]:
        """held: (sig, start, n, piece) in order; pieces are distinct within their anchor."""
        repeat = _repeats([x[3] for x in held], [x[2] for x in held], length)
        at = 0
        for sig, start, n, _ in held:
            own = np.concatenate(([False], repeat[at : at + n], [False]))
            at += n
            edge = np.flatnonzero(own[1:] != own[:-1])
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                yield sig, start + a, start + b - 1 + length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before, held, group, size, out = None, None, [], [], 0, []
        for batch in batches:
            for h, sig, start, n, piece in zip(*(batch.column(c).to_pylist() for c in ("hash", "sig", "start", "n", "bytes")), strict=True):
                key = (h, not piece)
                if key != last:
                    if len(group) > 1:  # strings with one anchor, at different places of one piece, differ
                        held += group
                        size += sum(len(x[3]) for x in group)
                    if size > SHARD_BYTES:
                        out += settle(held)
                        held, size = [], 0
                    last, group, before = key, [], None
                if (sig, start) == before:  # a row of docs that is there twice
                    continue
                if piece:
                    group.append((sig, start, n, piece))
                elif before is not None:
                    out.append((sig, start, start + length))
                before = (sig, start)
            if out:
                yield _span_rows(out)
                out = []
        held += group if len(group) > 1 else []
        if held:
            out = list(settle(held))
            if out:
                yield _span_rows(out)

    return run


def _span_rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], ["sig", "first", "end"])


def _merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _cut(length: int, with_text: bool):
    """(of, removed, spans, sha, left) of texts with anything to remove."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _cut_rows(batch, length, with_text)

    return run


def _cut_rows(batch: pa.RecordBatch, length: int, with_text: bool) -> pa.RecordBatch:
    rows = []
    for sig, text, spots, spans in zip(*(batch.column(c).to_pylist() for c in ("sig", "text", "spots", "spans")), strict=True):
        if merged := _merged([(x["start"], x["start"] + x["n"] - 1 + length) for x in spots if x["again"]] + [(x["first"], x["end"]) for x in spans or ()]):
            data = text.encode("utf-8", "surrogatepass")
            kept = b"".join(data[a:b] for a, b in zip([0, *(x[1] for x in merged)], [*(x[0] for x in merged), len(data)], strict=True))
            rows.append((sig, sum(b - a for a, b in merged), len(merged), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None))
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["of", "removed", "spans", "sha", "left"])


def _cut_texts(d: DataFrame, first: DataFrame, length: int, with_text: bool) -> DataFrame:
    """(of, removed, spans, sha, left) for each text (by its hash) of d (doc_id, text, sig) that loses anything; `first`
    (of, first_doc) has the document under which a text counts."""
    spark = d.sparkSession
    long, parts = d.where(F.octet_length("text") >= length), 2 * tasks_wanted(spark)
    share = SHARE * parts
    counted = long.mapInArrow(_frequent(length, share), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    counted = written(counted, "counted")
    pieces = counted.where("hash is null").agg(F.sum("n")).first()[0] or 0
    often = counted.where(F.col("hash").isNotNull() & (F.col("n") * 4 * share >= pieces)).select("hash").collect()  # 4 * share at most
    split = spark.sparkContext.broadcast(np.sort(np.array([r["hash"] for r in often], np.int64).view(np.uint64)))
    anchors = long.mapInArrow(_anchors(length, split), "hash long, piece long, doc_id long, sig long, start long, n int, again boolean")
    told = anchors.repartition(parts, "hash").sortWithinPartitions("hash", "piece", "doc_id", "sig", "start").mapInArrow(_told, "hash long, doc_id long, sig long, start long, n int, again boolean")
    told = written(told, "told", counted)
    # anchors with more different pieces than a sort takes
    large = told.where("not again").groupBy("hash").agg(F.count("*").alias("pieces")).where(F.col("pieces") > SHARD_BYTES // (2 * length)).select("hash", F.lit(True).alias("split"))
    large = written(large, "large")
    spots = told.withColumn("split", F.lit(None).cast("boolean")) if large.isEmpty() else told.join(large, "hash", "left")
    spots = spots.groupBy("sig", "doc_id").agg(F.collect_list(F.struct("hash", "start", "n", "again", "split")).alias("spots"))
    # each text that has such pieces, once, under its first document
    known = spots.join(first, (F.col("sig") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("first_doc"))).select("sig", "first_doc", "spots")
    known = written(known, "known", told, large)
    texts = d.select("doc_id", F.col("sig").alias("of"), "text").join(known.hint("merge"), (F.col("of") == F.col("sig")) & F.col("doc_id").eqNullSafe(F.col("first_doc")))
    texts = written(texts.select("doc_id", "sig", "text", "spots"), "texts", known)
    segments = texts.mapInArrow(_segments(length), "hash long, doc_id long, sig long, start long, n int, bytes binary")
    dealt = segments.repartition(parts, "hash").sortWithinPartitions("hash", F.length("bytes") == 0, "doc_id", "sig", "start")
    spans = dealt.mapInArrow(_removed(length), "sig long, first long, end long")
    spans = written(spans.groupBy("sig").agg(F.collect_list(F.struct("first", "end")).alias("spans")), "spans")
    cut = texts.select("sig", "text", "spots").join(spans, "sig", "left").mapInArrow(_cut(length, with_text), "of long, removed long, spans long, sha string, left string")
    return written(cut.dropDuplicates(["of"]), "cut", texts, spans)


def repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256. Earlier means a smaller doc_id, in
    one document an earlier start; rows with one doc_id are ordered by a hash of their text, equal rows by place. A null
    text counts as empty; texts of fewer bytes than `length` stay whole; an empty table gives none."""
    d = _texts_of(docs)
    rows = d.select("doc_id", F.monotonically_increasing_id().alias("row"), "sig", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    rows = written(rows, "rows")
    first = rows.groupBy("sig").agg(F.min(F.struct("doc_id", "row")).alias("m")).select(F.col("sig").alias("of"), F.col("m.doc_id").alias("first_doc"), F.col("m.row").alias("first_row"))
    first = written(first, "first")
    cut = _cut_texts(d, first, length, False)
    place = written(first.join(cut.select("of", "removed", "spans", F.col("sha").alias("cut_sha")), "of", "left"), "place", cut, first)
    out = rows.join(place.withColumnRenamed("of", "sig"), "sig")
    copy = (F.col("row") != F.col("first_row")) & (F.col("n_bytes") >= length)
    none = F.sha2(F.lit("").cast("binary"), 256)
    return out.select(
        "doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"), F.when(copy, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, none).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
    )


def _texts_of(docs: DataFrame) -> DataFrame:
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return d.withColumn("sig", F.xxhash64("text"))


def clean(docs: DataFrame, length: int = 100) -> DataFrame:
    """docs with repeated strings cut from their texts and n_chars counted again; a document of which nothing but
    white space is left goes, and so do those with the text of an earlier one, if it has `length` bytes. Of a character
    of which only some bytes stay, these go too. Documents without repeats are as they were; rows that are equal in
    doc_id and text stay or go together. Other columns stay as they are."""
    d = _texts_of(docs)
    first = written(d.groupBy("sig").agg(F.min("doc_id").alias("first_doc"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).select(F.col("sig").alias("of"), F.when(F.col("nulls") == 0, F.col("first_doc")).alias("first_doc")), "first")
    cut = _cut_texts(d, first, length, True)
    sig, of, of_first, left = (fresh(c, docs.columns) for c in ("__sig", "__of", "__first_doc", "__left"))
    place = first.join(cut.select("of", "left"), "of", "left").select(F.col("of").alias(of), F.col("first_doc").alias(of_first), F.col("left").alias(left))
    place = written(place, "place", cut, first)
    both = docs.withColumn(sig, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))).join(place, F.col(sig) == F.col(of))
    copy = ~F.col("doc_id").cast("long").eqNullSafe(F.col(of_first)) & (F.octet_length("text") >= length)
    both = both.where(~F.coalesce(copy, F.lit(False)) & (F.col(left).isNull() | (F.trim(left) != ""))).withColumn("text", F.coalesce(left, "text"))
    if "n_chars" in docs.columns:
        both = both.withColumn("n_chars", F.when(F.col(left).isNull(), F.col("n_chars")).otherwise(F.length(left).cast("long")))
    return both.select(*docs.columns)
