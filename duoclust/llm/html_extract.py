"""Main text of web pages by wrappers that are inferred for each host.

A page is a stream of blocks, each with the path of its block elements. The streams of one host are aligned one
after another into a union-free regular expression: runs that repeat become groups with "+" and parts that some
pages lack become optional. Every stream is then matched to its host's expression, which gives each of its blocks a
place there. The text of a place is a constant of the template if all pages that reach it agree on it, and a slot
otherwise. Blocks of the article, but for menus and notices by their names and constants that are links, make up the main
text; without an article the slots of the container that is richest among the places the page reaches.

Pages are never gathered by host. Distinct streams are aligned in groups, as many as the host's streams need, then the
expressions of groups in groups again until one is left; texts are counted by place.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tasks_wanted, written

#: Elements that bound blocks, that never hold main text, and names that mark what is not the article.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
NEVER = frozenset("head nav footer aside form menu dialog".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol blockquote pre td th tr tbody table dl dt dd figure figcaption".split())
SAME = frozenset("p li dt dd tr td th".split())
NAMES = frozenset(
    "nav navbar navigation menu header footer sidebar aside ad ads advert adverts advertisement advertising promo promotion banner cookie cookies consent gdpr notice notices alert popup modal "
    "newsletter subscribe subscription share sharing social related recommended recommendations breadcrumb breadcrumbs comment comments reply replies respond disqus login signup signin search "
    "form widget toolbar pager pagination copyright legal sponsor sponsored masthead skip".split()
)
#: Words that stand beside those in the name of a whole part: inside an article no other name of a part counts
#: ("comment-style", "share-price"), and on a leaf it only counts if the wrapper finds a constant or links there.
PLAIN = frozenset("area articles author bar block body box button buttons container content group icon icons inline inner item items label link links list more outer panel posts reading row section site slot stories text thread top unit widget wrap wrapper".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|title|select|button|object|canvas)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)([^>]*)>|<[!?][^>]*>", re.S | re.I
)
_ATTR = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_NAME = re.compile(r"[a-z]+")
#: Words at the start or the end of a name that make it speak of the page and not of its element ("has-sidebar").
ABOUT, KINDS = frozenset("has with without no".split()), frozenset("page layout".split())
#: Pages that must agree on a text before it counts as a constant; streams that one group aligns, about; cells of an
#: alignment's table that are held at once; tasks that share the pages of a frequent stream.
AGREE, FAN, CELLS, SALTS = 5, 32, 4 << 20, 32
#: Share of the richest container's text from which its siblings stay beside it.
SIBLING = 0.2


def _element(tag: str, attrs: str, inside: bool) -> tuple[str, bool, int, bool]:
    """(label, is it never main text, is it other than the article by name, is it the article) of an element, which
    stands inside an article or not. By name: 2 for sure, 1 if its place decides."""
    names: list[str] = []
    article, never, named = tag in ("article", "main"), tag in NEVER, 0
    for key, value in _ATTR.findall(attrs) if attrs else ():
        value = value.strip("\"'")
        if key.lower() in ("hidden", "aria-hidden"):
            never |= key.lower() == "hidden" or value.lower() == "true"
        else:
            article |= value == "articleBody" or (key.lower() == "role" and value == "main")
            for name in value.split():
                split = _NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
                if split and split[0] not in ABOUT and split[-1] not in KINDS:
                    hits = NAMES.intersection(split)
                    if hits and (not inside or set(split) - hits <= PLAIN):
                        named = max(named, 1 if inside and tag in LEAVES else 2)
                names += split
    return ".".join([tag, *names]), never and not article, named, article


def blocks(page: str | None) -> list[tuple[str, str, int]]:
    """(signature, text, characters inside links) of each block with text, in page order. A signature is "a" (in an
    article), "n" (there, with the name of something else), "x" (something else) or "o", and the path."""
    out: list[tuple[str, str, int]] = []
    stack: list[tuple[str, str, bool, int, bool]] = []  # tag, label, never, named, article
    text: list[str] = []
    links = 0
    in_link = 0
    at = 0

    def end() -> None:
        nonlocal links
        if text:
            whole = " ".join(entities.unescape("".join(text)).split())
            if whole:
                _, _, never, named, article = stack[-1] if stack else ("", "", False, 0, False)
                path = "/".join(s[1] for s in stack)
                out.append((("x:" if never or named > article else "n:" if named else "a:" if article else "o:") + path, whole, links))
            text.clear()
        links = 0

    page = page or ""
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text.append(piece := page[at : m.start()])
            links += len(piece) if in_link else 0
        at = m.end()
        if (tag := m[3]) is None:
            continue
        tag, closing = tag.lower(), bool(m[2])
        if tag == "br":
            text.append(" ")
        elif tag == "a":
            in_link = not closing
        elif tag in BLOCKS:
            end()
            if closing:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
            elif tag == "body":
                stack[:] = []
            elif tag not in ("html", "hr"):
                while stack and (stack[-1][0] == "p" or (stack[-1][0] == tag and tag in SAME)):
                    stack.pop()
                _, _, was_never, was_named, was_article = stack[-1] if stack else ("", "", False, 0, False)
                label, never, named, article = _element(tag, m[4], was_article)
                never = never or (tag == "header" and not was_article)
                # an article resets names above it, but not those inside an article, and a comment is none
                resets = article and not was_article and (tag == "main" or not named)
                named = max(0 if resets else was_named, 0 if article else named)
                stack.append((tag, label, was_never or never, named, was_article or article))
            in_link = 0
    if at < len(page):
        text.append(page[at:])
    end()
    return out


# ---------------------------------------------------------------- union-free expressions

Item = tuple[tuple[str, ...], bool, bool]  # symbols of a group, repeated, optional


def folded(symbols: list[str]) -> tuple[list[Item], list[int]]:
    """A stream as an expression: runs of a group of up to four symbols become one repeated group. With it, for each
    symbol of the stream its number among the symbols of the expression."""
    items: list[Item] = [((s,), False, False) for s in symbols]
    spots: list[list[int]] = [[0] for _ in symbols]  # for each item, which of its symbols it stands for in turn
    for width in (1, 2, 3, 4):
        out: list[Item] = []
        put: list[list[int]] = []
        k = 0
        while k < len(items):
            group = items[k : k + width]
            n = 1
            while len(group) == width and items[k + n * width : k + (n + 1) * width] == group:
                n += 1
            if n > 1:
                out.append((tuple(s for g in group for s in g[0]), True, False))
                offsets = _offsets(group)
                put.append([offsets[r % width] + x for r in range(n * width) for x in spots[k + r]])
                k += n * width
            else:
                out.append(items[k])
                put.append(spots[k])
                k += 1
        items, spots = out, put
    return items, [at + x for at, spot in zip(_offsets(items), spots, strict=True) for x in spot]


def fold(symbols: list[str]) -> list[Item]:
    return folded(symbols)[0]


def _offsets(items: list[Item]) -> list[int]:
    out, at = [], 0
    for x in items:
        out.append(at)
        at += len(x[0])
    return out


def _best(x: list[Item], y: list[Item], weight: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The most weight of y that a common subsequence of x[i:] and y[j:] has, for all j: that of i and of i + 1, for
    each i in order. Rows depend on those behind them; of a long table some are kept, and the rest of it is counted
    again between them, so that memory has a bound and the length decides nothing."""
    number: dict[tuple[str, ...], int] = {}
    a, b = (np.array([number.setdefault(g[0], len(number)) for g in z], np.int64) for z in (x, y))
    weight = weight.astype(np.int32 if min(len(x), len(y)) * int(weight.max(initial=0)) < 2**31 else np.int64)

    def before(i: int, behind: np.ndarray) -> np.ndarray:
        row = np.maximum(behind[:-1], np.where(b == a[i], behind[1:] + weight, 0))
        return np.append(np.maximum.accumulate(row[::-1])[::-1], behind[-1:])

    def rows(lo: int, hi: int, behind: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        whole = hi - lo <= max(1, CELLS // len(behind))
        parts = hi - lo if whole else min(hi - lo, max(2, CELLS // len(behind)))
        ends = [lo + (hi - lo) * k // parts for k in range(1, parts + 1)]
        kept, marks = {hi: behind}, set(ends)
        for i in range(hi - 1, lo - 1 if whole else ends[0] - 1, -1):
            behind = before(i, behind)
            if whole or i in marks:
                kept[i] = behind
        for start, end in zip([lo, *ends], ends, strict=False):
            if whole:
                yield kept.pop(start), kept[end]
            else:
                yield from rows(start, end, kept.pop(end))

    return rows(0, len(x), np.zeros(len(y) + 1, weight.dtype)) if x else iter(())


def align(x: list[Item], y: list[Item]) -> list[Item]:
    """The expression that covers both: what they share stays, repeated if it is in either, and what only one has
    becomes optional. The groups of both are subsequences of it."""
    out: list[Item] = []
    j = 0
    for (group, more, maybe), (best, behind) in zip(x, _best(x, y, np.ones(len(y), np.int32)), strict=True):
        while j < len(y) and group != y[j][0] and behind[j] < best[j + 1]:
            out.append((y[j][0], y[j][1], True))
            j += 1
        if j < len(y) and group == y[j][0]:
            out.append((group, more or y[j][1], maybe or y[j][2]))
            j += 1
        else:
            out.append((group, more, True))
    return out + [(group, more, True) for group, more, _ in y[j:]]


#: The former way of long expressions; they are aligned like all others now.
_align_next = align


def match(stream: list[Item], expression: list[Item]) -> list[int]:
    """For each symbol of the stream its place: its number among the symbols of an expression that covers the stream.
    Of several ways the one that leaves out the fewest groups which are not optional."""
    offsets, out, j = _offsets(expression), [], 0
    weight = np.array([len(expression) + 1 + (not maybe) for _, _, maybe in expression], np.int64)
    for (group, _, _), (best, behind) in zip(stream, _best(stream, expression, weight), strict=True):
        while expression[j][0] != group or best[j] != behind[j + 1] + weight[j]:
            j += 1
        out += range(offsets[j], offsets[j] + len(group))
        j += 1
    return out


def write_items(items: list[Item]) -> str:
    return "\n".join(("+" if more else "") + ("?" if maybe else "") + " " + "\t".join(group) for group, more, maybe in items)


def read_items(text: str) -> list[Item]:
    return [(tuple(x.split(" ", 1)[1].split("\t")), "+" in x.split(" ", 1)[0], "?" in x.split(" ", 1)[0]) for x in text.split("\n") if x]


# ---------------------------------------------------------------- pages


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


_STREAMS = "host string, key long, stream string, pages long, lo array<long>, hi array<long>, chars array<long>, links array<long>"


def _stream_rows(found: dict) -> pa.RecordBatch:
    columns = list(zip(*((host, _digest(stream), stream, *x) for (host, stream), x in found.items()), strict=True)) or [[]] * 8
    longs = pa.list_(pa.int64())
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), longs, longs, longs, longs)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["host", "key", "stream", "pages", "lo", "hi", "chars", "links"])


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct streams with, for each symbol, the least and largest digest of its texts, their characters and those in links."""
    found: dict[tuple[str, str], list] = {}
    size = 0
    for batch in batches:
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            if not (got := blocks(page)):
                continue
            items, slots = folded([b[0] for b in got])
            key = (host, write_items(items))
            n = max(slots) + 1
            if key not in found:
                found[key] = [0, [2**63 - 1] * n, [-(2**63)] * n, [0] * n, [0] * n]
                size += n
            x = found[key]
            x[0] += 1
            _, lo, hi, chars, links = x
            for slot, (_, text, linked) in zip(slots, got, strict=True):
                d = _digest(text)
                lo[slot], hi[slot] = min(lo[slot], d), max(hi[slot], d)
                chars[slot] += len(text)
                links[slot] += linked
            if size > 200_000:
                yield _stream_rows(found)
                found, size = {}, 0
    if found:
        yield _stream_rows(found)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [blocks(page) for page in batch.column("html").to_pylist()]
        streams = [folded([b[0] for b in x]) for x in found]
        yield pa.RecordBatch.from_arrays(
            [*batch.select(["page_id", "url", "host"]).columns, pa.array([_digest(write_items(items)) for items, _ in streams], pa.int64()),
             pa.array([slots for _, slots in streams], pa.list_(pa.int32())), pa.array([[b[1] for b in x] for x in found], pa.list_(pa.string()))],
            ["page_id", "url", "host", "key", "slots", "texts"],
        )


def _aligned(group: pd.DataFrame) -> pd.DataFrame:
    streams = sorted(set(group["stream"]))
    items = read_items(streams[0])
    for other in streams[1:]:
        items = align(items, read_items(other))
    return pd.DataFrame({"host": [group["host"].iloc[0]], "part": [group["part"].iloc[0]], "parts": [group["parts"].iloc[0]], "stream": [write_items(items)]})


def expressions(dealt: DataFrame) -> DataFrame:
    """(host, stream): one expression for each host that covers the streams of dealt (host, part, parts, stream)."""
    level, at = dealt.select("host", "part", "parts", "stream"), None
    most = level.agg(F.max("parts")).first()[0] or 1
    while True:
        grown = level.groupBy("host", "part").applyInPandas(_aligned, "host string, part long, parts long, stream string")
        level = at = written(grown, "expressions", *([] if at is None else [at]))
        if most == 1:
            return level.select("host", "stream")
        most = -(-most // FAN)
        level = level.withColumn("parts", F.ceil(F.col("parts") / FAN).cast("long")).withColumn("part", F.pmod("part", "parts"))


def _places(streams: pd.DataFrame, wrapper: pd.DataFrame) -> pd.DataFrame:
    if not len(streams):
        return pd.DataFrame({"host": [], "key": [], "sigs": [], "places": []})
    expression = read_items(wrapper["stream"].iloc[0])
    read = [read_items(s) for s in streams["stream"]]
    return pd.DataFrame({"host": streams["host"], "key": streams["key"], "sigs": [[s for g, _, _ in x for s in g] for x in read], "places": [match(x, expression) for x in read]})


def _container(signature: str) -> str:
    parts = signature[2:].split("/")
    while parts and parts[-1].split(".")[0] in LEAVES:
        parts.pop()
    return "/".join(parts)


def kept_slots(rows: list[dict]) -> list[bool]:
    """For the symbols of one stream (sig, constant, linked, mean: characters that a page has at this place), whether
    they are main text."""
    if any(r["sig"].startswith("a:") for r in rows):  # an article keeps its constants but for those that are links: copies of a page make no template
        mine = lambda r: r["sig"].rsplit("/", 1)[-1].replace("a:", "") in LEAVES or not (r["constant"] and r["linked"])
        return [mine(r) if r["sig"].startswith("a:") else r["sig"].startswith("n:") and not r["constant"] and not r["linked"] for r in rows]
    inside = [_container(r["sig"]) if r["sig"].startswith("o:") and not r["constant"] and not r["linked"] else None for r in rows]
    size: dict[str, float] = {}
    for r, c in zip(rows, inside, strict=True):
        if c is not None:
            size[c] = size.get(c, 0.0) + r["mean"]
    best = min(size, key=lambda c: (-size[c], c), default=None)
    if best is None:
        return [False] * len(rows)
    # a sibling with a good part of the text is part of it
    whole = [c for c, n in size.items() if c == best or (c.rpartition("/")[0] == best.rpartition("/")[0] and n >= SIBLING * size[best])]
    return [c is not None and any(c == w or c.startswith(w + "/") for w in whole) for c in inside]


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = [kept_slots(x) for x in batch.column("slots").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("of_host"), batch.column("of_key"), batch.column("pages"), pa.array(kept, pa.list_(pa.bool_()))], ["of_host", "of_key", "pages", "kept"])


def _hosted(pages: DataFrame) -> DataFrame:
    host = F.coalesce(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][\w+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.col("html").cast("string").alias("html"))


def wrappers(pages: DataFrame) -> DataFrame:
    """(of_host, of_key, pages, kept): for every stream of a host the pages that have it and which symbols are main text."""
    seen = written(_hosted(pages).mapInArrow(_streams, _STREAMS), "streams")
    streams = seen.groupBy("host", "key").agg(F.first("stream").alias("stream"), F.sum("pages").alias("all"))
    sizes = streams.groupBy("host").agg(F.ceil(F.count("*") / FAN).cast("long").alias("parts"))
    dealt = written(streams.join(sizes, "host").withColumn("part", F.pmod("key", "parts")), "dealt")
    whole = expressions(dealt).join(sizes, "host").select("host", "stream", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    places = dealt.groupBy("host", "part").cogroup(whole.groupBy("host", "part")).applyInPandas(_places, "host string, key long, sigs array<string>, places array<int>")
    places = written(places, "places")
    each = seen.join(places, ["host", "key"]).select("host", "pages", F.explode(F.arrays_zip("places", "lo", "hi", "chars", "links")).alias("b"))
    stats = each.groupBy("host", F.col("b.places").alias("place")).agg(F.sum("pages").alias("n"), (F.min("b.lo") == F.max("b.hi")).alias("same"), F.sum("b.chars").alias("chars"), F.sum("b.links").alias("links"))
    stats = stats.select("host", "place", ((F.col("n") >= AGREE) & F.col("same")).alias("constant"), (2 * F.col("links") > F.col("chars")).alias("linked"), (F.col("chars") / F.col("n")).alias("mean"))
    slots = places.select("host", "key", F.posexplode(F.arrays_zip("sigs", "places")).alias("slot", "b")).select("host", "key", "slot", F.col("b.sigs").alias("sig"), F.col("b.places").alias("place")).join(stats, ["host", "place"])
    slots = slots.groupBy("host", "key").agg(F.sort_array(F.collect_list(F.struct("slot", "sig", "constant", "linked", "mean"))).alias("slots"))
    slots = slots.join(dealt.select("host", "key", "all"), ["host", "key"]).select(F.col("host").alias("of_host"), F.col("key").alias("of_key"), F.col("all").alias("pages"), "slots")
    return slots.mapInArrow(_kept, "of_host string, of_key long, pages long, kept array<boolean>")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row. Blocks of the main slots, in page order, joined by two line
    feeds; on a page without an article, those of the richest container among the places it reaches. A null or empty
    html, or a page without such blocks, gives an empty text. Repeated rows give repeated results; an empty table
    gives none."""
    learned = written(wrappers(pages), "wrappers")
    total = learned.agg(F.sum("pages")).first()[0] or 0
    # one stream may be that of a third of all pages: its slots go to several tasks, its pages are dealt to them
    often = F.col("pages") * 200 > total
    frequent = learned.where(often).select("of_host", "of_key", F.lit(True).alias("often"))  # 200 rows at most
    learned = learned.select("of_host", "of_key", "kept", F.explode(F.sequence(F.lit(0), F.when(often, SALTS - 1).otherwise(0))).alias("of_salt"))
    page = _hosted(pages).mapInArrow(_texts, "page_id long, url string, host string, key long, slots array<int>, texts array<string>")
    same = (F.col("host") == F.col("of_host")) & (F.col("key") == F.col("of_key"))
    page = page.join(F.broadcast(frequent), same, "left").drop("of_host", "of_key")
    page = page.withColumn("salt", F.when(F.col("often"), F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).otherwise(0))
    parts = 2 * tasks_wanted(pages.sparkSession)
    page, learned = page.repartition(parts, "host", "key", "salt"), learned.repartition(parts, "of_host", "of_key", "of_salt")
    page = page.join(learned.hint("merge"), same & (F.col("salt") == F.col("of_salt")), "left")
    kept = F.filter(F.arrays_zip("slots", "texts"), lambda b: F.coalesce(F.get("kept", b["slots"]), F.lit(False)))
    text = F.array_join(F.transform(kept, lambda b: b["texts"]), "\n\n")
    return page.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
