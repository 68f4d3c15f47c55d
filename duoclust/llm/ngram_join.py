"""Exact Jaccard join of documents on word n-grams, as a join in a metric space.

1 - Jaccard is a metric. Pivots that are documents do not help here: nearly all documents are at distance 1 from
nearly all others. So the pivots are the one-element sets {s}: a set A of n shingles is at distance 1 - 1/n from
each of its own and at 1 from all others, which makes its first shingle, in one fixed order, the pivot of its
Voronoi region. If B is within 1 - t of A, the triangle inequality and the sizes leave at most n - ceil(t n)
shingles of A outside B; so A is copied to the regions of its first n - ceil(t n) + 1 shingles, and a linked
pair meets in the region of its first common one. Rare shingles come first (by a sketch of fixed size that counts
the whole corpus), which keeps the regions of frequent passages for documents that hold little else.

Inside a region the sizes and positions prune, and after it the parities of hashed elements, which differ in no more
places than the sets do. Small regions test every pair that is left. A larger one is joined
recursively: on each level some pivot documents are tested against all members, members within the radius join the
pivot's component, and only pairs of different components are left for the next level. The pivots of the first level
are the members that hold least besides the region's passage, which reach most others. The last level tests all pairs
that are left; a member meets there only windows of sizes that its own size and position admit.
Every test counts whole sets. Sets with the same elements are one vertex, known by a 64-bit signature.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, fresh, in_steps, mix, shingles_of, tasks_wanted, text_bytes, words_of, written
from .components import components

#: Counters of the frequency sketch and of one of its blocks; members up to which a region tests all pairs;
#: members of one pivot that are tested in a task.
SKETCH_BITS, BLOCK_BITS, SMALL, TESTED = 22, 16, 24, 256
#: Levels of recursion on pivots of larger regions, and pivots of a region on each; windows of size of the last level
#: between a set and its smallest partner.
LEVELS, PIVOTS, WINDOWS = 2, 64, 8
#: Shares of a region in which its pivots are ranked first.
SALTS = 32


def _sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text. Fewer words than `width` make one shingle; none, none."""
    data, offsets = text_bytes(column)
    _, _, row, hashes = words_of(data, offsets)
    first = np.searchsorted(row, np.arange(len(offsets)))
    all_shingles, out = shingles_of(hashes, width), []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            s = np.sort(all_shingles[a : b - width + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        else:
            out.append(shingles_of(hashes[a:b], int(b - a)) if b > a else np.zeros(0, np.uint64))
    return out


def _signature(s: np.ndarray) -> int:
    both = mix(np.array([len(s) + int(s.sum(dtype=np.uint64)) % (1 << 63), int(np.bitwise_xor.reduce(mix(s), initial=np.uint64(0)))], np.uint64))
    return int(mix(both[:1] + both[1:] * np.uint64(3)).view(np.int64)[0])


def _parities(s: np.ndarray) -> bytes:
    """Bit i says whether an odd number of elements hash to i; as many bits as a power of two of about 0.6 to 1.2 n."""
    size = max(64, 1 << int(np.ceil(np.log2(max(1, 0.6 * len(s))))))
    odd = np.bincount((s >> np.uint64(24)).astype(np.int64) & (size - 1), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(x: int, size: int, to: int) -> int:
    while size > to:
        size //= 2
        x = (x >> size) ^ (x & ((1 << size) - 1))
    return x


def _plausible(t: int):
    """Pairs whose parities leave room for the link: two sets differ in as many elements as parities, at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, nb, x, y in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "xbits", "ybits")), strict=True):
                to = 8 * min(len(x), len(y))
                differ = _folded(int.from_bytes(x, "little"), 8 * len(x), to) ^ _folded(int.from_bytes(y, "little"), 8 * len(y), to)
                keep.append(differ.bit_count() <= na + nb - 2 * (-(-t * (na + nb) // (100 + t))))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _least(n, t: int):
    """Shingles that a partner of a set of n shares with it, at least."""
    return -(-t * n // 100)


def _profile(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        for part in in_steps(batches):
            sets = _sets(part.column("text"), width)
            if any(len(s) for s in sets):
                np.add(counts, np.bincount((np.concatenate(sets) & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64), minlength=len(counts)).astype(np.uint32), out=counts)
            n = [len(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("hash"), pa.array(n, pa.int64()), pa.array([_signature(s) if len(s) else None for s in sets], pa.int64()), pa.nulls(len(n), pa.int32()), pa.array([_parities(s) for s in sets], pa.binary())],
                ["doc_id", "hash", "n", "sig", "block", "counts"],
            )
        blocks = [(k, zlib.compress(np.minimum(x, 65535).astype(np.uint16).tobytes(), 1)) for k, x in enumerate(np.split(counts, 1 << (SKETCH_BITS - BLOCK_BITS))) if x.any()]
        none = pa.nulls(len(blocks), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array([k for k, _ in blocks], pa.int32()), pa.array([x for _, x in blocks], pa.binary())], ["doc_id", "hash", "n", "sig", "block", "counts"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of bits of each counter's sum, a block in a row."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, x in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            sums.setdefault(k, np.zeros(1 << BLOCK_BITS, np.uint64))
            sums[k] += np.frombuffer(zlib.decompress(x), np.uint16)
    bits = [np.frexp(x.astype(np.float64))[1].astype(np.uint8).tobytes() for x in sums.values()]
    yield pa.RecordBatch.from_pydict({"block": pa.array(list(sums), pa.int32()), "bits": pa.array(bits, pa.binary())})


def _keys(s: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The shingles in the fixed order: by frequency class, then by hash."""
    rank = ranks[(s & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)].astype(np.uint64)
    return np.sort((rank << np.uint64(60)) | (s >> np.uint64(4)))


def _prefixes(width: int, t: int, ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in in_steps(batches):
            keys, sigs, sizes, at = [], [], [], []
            for s in _sets(part.column("text"), width):
                if len(s) and (sig := _signature(s)) not in seen:
                    seen.add(sig)
                    head = _keys(s, ranks.value)[: len(s) - _least(len(s), t) + 1]
                    keys.append(head)
                    sigs.append(np.full(len(head), sig, np.int64))
                    sizes.append(np.full(len(head), len(s), np.int32))
                    at.append(np.arange(len(head), dtype=np.int32))
            if len(seen) > 1_000_000:
                seen.clear()  # a set met again is then sent again, which costs only its rows
            if keys:
                yield pa.RecordBatch.from_pydict({"key": np.concatenate(keys).view(np.int64), "sig": np.concatenate(sigs), "n": np.concatenate(sizes), "pos": np.concatenate(at)})

    return run


_PAIR = ["key", "a", "na", "pa", "b", "nb", "pb"]


def _regions(t: int):
    """Rows sorted by key, position and signature, so that the members with the fewest rarer shingles are the pivots
    -> candidate pairs (b not null) and members of larger regions (b null). A region is read as a stream; no more
    than SMALL of its members are held."""

    def passes(x, y) -> np.ndarray:
        (na, pa_), (nb, pb) = x, y
        need = -(-t * (na + nb) // (100 + t))
        return (100 * np.minimum(na, nb) >= t * np.maximum(na, nb)) & (np.minimum(na - pa_, nb - pb) >= need)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the region that the last batch ended in: key, first members, rows in all, last row's signature
        for batch in batches:
            key, sig, n, pos = (np.asarray(batch.column(c)) for c in ("key", "sig", "n", "pos"))
            n, pos = n.astype(np.int64), pos.astype(np.int64)
            if held is not None:
                keep = slice(None) if not (held[0] == key[0] and held[3] == sig[0]) else slice(1, None)
                key, sig, n, pos = (x[keep] for x in (key, sig, n, pos))
            if not len(key):
                continue
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (sig[1:] != sig[:-1])))
            key, sig, n, pos = (x[new] for x in (key, sig, n, pos))
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            ends = np.append(starts[1:], len(key))
            out = []
            carried = held is not None and held[0] == key[0]
            wanted = np.flatnonzero(ends - starts > 1).tolist()
            wanted += [0] if carried and (not wanted or wanted[0] != 0) else []
            for g in wanted:
                a, b = starts[g], ends[g]
                first = held[1] if g == 0 and carried else np.zeros((3, 0), np.int64)
                before = held[2] if g == 0 and carried else 0
                rows = np.stack([sig[a:b], n[a:b], pos[a:b]])
                total = before + rows.shape[1]
                everyone = np.concatenate([first, rows], axis=1)
                small = everyone[:, :SMALL]
                done = first.shape[1]
                i, j = np.triu_indices(small.shape[1], 1)
                fresh = j >= done
                i, j = i[fresh], j[fresh]
                x, y = small[:, i], small[:, j]
                if everyone.shape[1] > SMALL:  # two pivots against all that do not fit
                    rest = everyone[:, max(SMALL, done) :]
                    x = np.concatenate([x, np.repeat(small[:, :2], rest.shape[1], axis=1)], axis=1)
                    y = np.concatenate([y, np.tile(rest, 2)], axis=1)
                ok = passes(x[1:], y[1:])
                x, y = x[:, ok], y[:, ok]
                out.append((np.full(x.shape[1], key[a]), x, y, None))
                if total > SMALL:
                    late = rows if before > SMALL else everyone
                    out.append((np.full(late.shape[1], key[a]), late, np.zeros_like(late), np.ones(late.shape[1], bool)))
            last = ends[-1] - starts[-1]
            again = carried and len(starts) == 1
            first = np.stack([sig[starts[-1] :], n[starts[-1] :], pos[starts[-1] :]])
            first = (np.concatenate([held[1], first], axis=1) if again else first)[:, :SMALL]
            held = (key[-1], first, (held[2] if again else 0) + last, sig[-1])
            if out:
                k, x, y = np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out], axis=1), np.concatenate([o[2] for o in out], axis=1)
                member = np.concatenate([np.zeros(len(o[0]), bool) if o[3] is None else o[3] for o in out])
                yield pa.RecordBatch.from_arrays([pa.array(k), *(pa.array(v) for v in x), *(pa.array(v, mask=member) for v in y)], _PAIR)

    return run


def _tested(width: int, t: int):
    """Texts sorted by group with the pivot's first -> links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, pivot = None, None
        for part in in_steps(batches):
            a, b = [], []
            rows = zip(part.column("grp").to_pylist(), part.column("member").to_pylist(), part.column("salt").to_pylist(), _sets(part.column("text"), width), strict=True)
            for grp, member, salt, s in rows:
                if (grp, salt) != group:
                    if member != grp:
                        raise RuntimeError(f"the text of pivot {grp} is missing")
                    group, pivot = (grp, salt), s
                elif member != grp:
                    at = np.searchsorted(pivot, s)
                    at[at == len(pivot)] = 0
                    shared = int(np.count_nonzero(pivot[at] == s))
                    if 100 * shared >= t * (len(pivot) + len(s) - shared):
                        a.append(grp)
                        b.append(member)
            if a:
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _links(pairs: DataFrame, texts: DataFrame, width: int, t: int) -> DataFrame:
    """Which pairs (a, b) of signatures have a Jaccard of t percent or more, by the whole sets of their texts."""
    spark = pairs.sparkSession
    sizes = pairs.groupBy("a").count()
    salts = written(sizes.select(F.col("a").alias("grp"), F.ceil(F.col("count") / TESTED).cast("int").alias("salts")), "salts")
    members = pairs.select(F.col("a").alias("grp"), F.col("b").alias("member")).join(salts, "grp")
    members = members.select("grp", "member", F.pmod(F.xxhash64("member"), "salts").cast("int").alias("salt"))
    pivots = salts.select("grp", F.col("grp").alias("member"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    need = written(members.unionByName(pivots), "need", salts)
    each = need.join(texts, need["member"] == texts["sig"]).select("grp", "salt", "member", "text")
    dealt = each.repartition(tasks_wanted(spark), "grp", "salt").sortWithinPartitions("grp", "salt", F.col("member") != F.col("grp"))
    return written(dealt.mapInArrow(_tested(width, t), "a long, b long"), "links", need)


def _window(n, t: int):
    """The window of sizes that n falls into: a partner of a set is at most WINDOWS windows below it."""
    return F.floor(F.ln(n) * (WINDOWS / math.log(100 / t)) + 1e-9) if t < 100 else n.cast("long")


def _within(t: int):
    """The windows of the sizes that a smaller partner can have: t percent of n at least, n at most, and no more than
    the n - pos shingles from the region's pivot on can make a link with."""
    low, most = F.expr(f"(xn * {t} + 99) div 100"), F.expr(f"least(xn, ((xn - xpos) * {100 + t}) div {t} - xn)")
    return F.when(low <= most, F.sequence(_window(low, t), _window(most, t)))


def _grown(joined: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, component) with further links (a, b), which are taken between components."""
    found = links
    for c in ("a", "b"):
        of = joined.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
        found = found.join(of, c, "left").withColumn(c, F.coalesce(f"of_{c}", c)).drop(f"of_{c}")
    more = components(found)
    moved = joined.join(more.select(F.col("node").alias("component"), F.col("component").alias("new")), "component", "left").select("node", F.coalesce("new", "component").alias("component"))
    fresh = more.join(joined.select("node"), "node", "left_anti")
    return written(moved.unionByName(fresh), "components", joined, more)


def jaccard_components(docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row. Two documents are linked when 100 * |A and B| >= percent *
    |A or B| over their sets of `width`-word shingles; component_id is the smallest id reachable by links. A text
    of fewer words is one shingle; a null, empty or blank text has none and is linked with nothing. Repeated rows
    and copies share a component. Rows without an id are linked like others, but give a component no id: one of such
    rows only has none. An empty table gives an empty result; other columns are not read."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("hash", F.xxhash64("text"))
    profile = written(d.mapInArrow(_profile(width), "doc_id long, hash long, n long, sig long, block int, counts binary"), "profile")
    sketch = profile.where("block is not null").select("block", "counts").repartition(1 << (SKETCH_BITS - BLOCK_BITS), "block").mapInArrow(_added, "block int, bits binary")
    bits = np.zeros((1 << (SKETCH_BITS - BLOCK_BITS), 1 << BLOCK_BITS), np.uint8)
    for row in sketch.collect():  # of fixed size: 2**SKETCH_BITS bytes
        bits[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    whole, profile = profile, profile.where("block is null").select("doc_id", "hash", "n", "sig", F.col("counts").alias("bits"))
    total = profile.agg(F.sum("n")).first()[0] or 0
    usual = int(2 * total >> SKETCH_BITS).bit_length()
    ranks = spark.sparkContext.broadcast(np.clip(bits.ravel().astype(np.int16) - usual, 0, 15).astype(np.uint8))

    one = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "hash")).alias("one")
    named = profile.where("n > 0").groupBy("sig").agg(one, F.first("n").alias("n"), F.first("bits").alias("bits"))
    named = written(named.select("sig", F.col("one.doc_id").alias("first"), F.col("one.hash").alias("hash"), "n", "bits"), "named")
    profile = written(profile.drop("bits"), "sizes", whole)
    tuples = d.mapInArrow(_prefixes(width, percent, ranks), "key long, sig long, n int, pos int")
    dealt = tuples.repartition(2 * tasks_wanted(spark), "key").sortWithinPartitions("key", "sig")
    met = written(dealt.mapInArrow(_regions(percent), ", ".join(f"{c} long" for c in _PAIR)), "regions")
    pairs = written(met.where("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    x, y = (named.select(F.col("sig").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"{p}bits")) for c, p in (("a", "x"), ("b", "y")))

    def plausible(found: DataFrame) -> DataFrame:
        return found.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "xbits", "ybits").mapInArrow(_plausible(percent), "a long, b long")

    likely = written(plausible(pairs), "likely")
    # the texts of all sets that any level can test, read once
    tested = likely.select(F.col("a").alias("sig")).union(likely.select("b")).union(met.where("b is null").select("a")).distinct()
    tested = written(tested.join(named.select("sig", "first", "hash"), "sig").select("sig", F.col("first").alias("of_doc"), F.col("hash").alias("of_hash")), "tested")
    texts = d.join(tested.hint("merge"), (F.col("hash") == F.col("of_hash")) & F.col("doc_id").eqNullSafe(F.col("of_doc"))).select("sig", "text")
    texts = written(texts, "texts", tested)
    links = _links(likely, texts, width, percent)
    dropped(likely)
    joined = components(links)
    dropped(links)

    # the next levels: regions with members of more than one component
    member, kept = met.where("b is null").select("key", F.col("a").alias("sig"), F.col("na").alias("n"), F.col("pa").alias("pos")), met
    for level in range(LEVELS + 1):
        placed = member.join(joined, member["sig"] == joined["node"], "left").select("key", "sig", "n", "pos", F.coalesce("component", "sig").alias("c"))
        placed = written(placed, "members", kept)
        open_ = written(placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key"), "open")
        if open_.isEmpty():
            dropped(placed, open_)
            break
        placed = written(placed.join(open_, "key"), "left-open", placed, open_)
        member, kept = placed.select("key", "sig", "n", "pos"), placed
        met_in = placed
        if level < LEVELS:  # some pivots against all members, in each member's largest region; the last level tests every pair that is left
            sizes = placed.groupBy("key").agg(F.count("*").alias("size"))
            largest = Window.partitionBy("sig").orderBy(F.desc("size"), "key")
            met_in = written(placed.join(sizes, "key").withColumn("turn", F.row_number().over(largest)).where("turn = 1").drop("turn", "size"), "largest")
        xs, ys = (met_in.select("key", *(F.col(c).alias(p + c) for c in ("sig", "n", "pos", "c"))) for p in ("x", "y"))
        need = F.expr(f"((xn + yn) * {percent} + {99 + percent}) div {100 + percent}")
        near = (100 * F.least("xn", "yn") >= percent * F.greatest("xn", "yn")) & (F.least(F.col("xn") - F.col("xpos"), F.col("yn") - F.col("ypos")) >= need)
        if level < LEVELS:
            reach = [F.col("xpos") / F.col("xn")] if level == 0 else []
            order = [*reach, F.xxhash64("xsig", F.lit(level)), "xsig"]
            few = xs.withColumn("salt", F.pmod(F.xxhash64("xsig"), F.lit(SALTS)))  # the first of each share, then of all shares
            for by in (["key", "salt"], ["key"]):
                few = few.withColumn("turn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("turn") <= PIVOTS).drop("turn")
            both = few.drop("salt").join(ys, "key")
        else:
            near &= (F.col("xn") > F.col("yn")) | ((F.col("xn") == F.col("yn")) & (F.col("xsig") < F.col("ysig")))
            both = xs.withColumn("window", F.explode(_within(percent))).join(ys.withColumn("window", _window(F.col("yn"), percent)), ["key", "window"])
        more = both.where((F.col("xc") != F.col("yc")) & near).select(F.least("xsig", "ysig").alias("a"), F.greatest("xsig", "ysig").alias("b")).distinct()
        more = written(more.join(pairs, ["a", "b"], "left_anti"), "more-pairs", *([met_in] if level < LEVELS else [placed]))
        if more.isEmpty():
            continue
        likely = written(plausible(more), "likely")
        links = _links(likely, texts, width, percent)
        joined = _grown(joined, links)
        dropped(likely, links)
        pairs = written(pairs.unionByName(more), "pairs", pairs, more) if level < LEVELS else pairs

    at = named.select("sig", "first").join(joined, F.col("sig") == F.col("node"), "left").select("sig", "first", F.coalesce("component", "sig").alias("c"))
    at = written(at, "placed", named, joined, texts, pairs)
    least = at.groupBy("c").agg(F.min("first").alias("component_id"))
    place = written(at.join(least, "c").select(F.col("sig").alias("of"), "component_id"), "placed", at)
    # rows without shingles get a key of their own, so that they do not meet in one task
    keyed = profile.withColumn("of", F.coalesce("sig", F.xxhash64("doc_id")))
    out = keyed.join(place, "of", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group of near duplicates, the one with the smallest doc_id; of rows with one
    doc_id and text, one. Documents without words and rows without a doc_id stay. All columns stay."""
    found = jaccard_components(docs, width, percent)
    copy, text_hash = fresh("__copy_id", docs.columns), fresh("__text_hash", docs.columns)
    copies = written(found.where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias(copy)).distinct(), "copies")
    kept = docs.join(copies, F.col("doc_id").cast("long") == F.col(copy), "left_anti")
    return kept.withColumn(text_hash, F.xxhash64("text")).dropDuplicates(["doc_id", text_hash]).drop(text_hash)
