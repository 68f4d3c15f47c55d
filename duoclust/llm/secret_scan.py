"""Secrets in texts, and credentials whose parts only count together.

Patterns find parts: who (access identifiers, user names), what (secrets) and where (endpoints). Strong parts - the
kinds assign, access and hex - are reported wherever they stand. Weak ones - short passwords, mixed strings, user names,
endpoints - say nothing alone: they are reported only if a complementary part stands in the same scope, which is a
paragraph, and within REACH code points. Intervals meet by the blocks of REACH code points that they touch, so a join
compares a part only with its neighbourhood, however long the text.

Everything is DataFrame functions. A regular expression gives no positions, but the pieces it splits a text into and
its matches alternate: their lengths, summed in order, are the positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Code points between complementary parts, at most.
REACH = 300
_SIGN = r"""["']?\x20*[:=]\x20*["']?"""

#: Kind: (pattern, group that is the span, group whose length counts, its least length, role). Fixed order: spans that
#: start together follow it. The first three are fixed by contract; a span of another kind ends where its match ends.
KINDS = {
    "assign": (r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])" + _SIGN + r"([A-Za-z0-9+/_.=-]+)", 0, 2, 6, "what"),
    "access": (r"AKIA[A-Z0-9]+", 0, 0, 20, "who"),
    "hex": (r"[0-9a-f]{24,}", 0, 0, 24, "what"),
    # names and values that are no secret of their own
    "pass": (r"(?:^|[^A-Za-z0-9_])((?:[Pp][Ww][Dd]|[Pp][Aa][Ss][Ss]|[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Pp][Hh][Rr][Aa][Ss][Ee]|[Cc][Rr][Ee][Dd][Ee][Nn][Tt][Ii][Aa][Ll])" + _SIGN + r"[A-Za-z0-9+/_.=!@#$%^&*-]{4,})", 1, 0, 0, "what"),
    "blob": (r"(?:^|[^A-Za-z0-9+/_=-])([A-Za-z0-9+/_-]{32,}={0,2})", 1, 0, 0, "what"),
    "user": (r"(?:^|[^A-Za-z0-9_])((?:[Uu][Ss][Ee][Rr](?:_?[Nn][Aa][Mm][Ee])?|[Ll][Oo][Gg][Ii][Nn]|[Aa][Cc][Cc][Oo][Uu][Nn][Tt]|[Cc][Ll][Ii][Ee][Nn][Tt]_?[Ii][Dd]|[Kk][Ee][Yy]_?[Ii][Dd])" + _SIGN + r"[A-Za-z0-9@._+-]{3,})", 1, 0, 0, "who"),
    "endpoint": (r"(?:^|[^A-Za-z0-9])([A-Za-z][A-Za-z0-9+.-]{1,15}://[^\x00-\x20\x22'<>]+|(?:[Hh][Oo][Ss][Tt](?:[Nn][Aa][Mm][Ee])?|[Ss][Ee][Rr][Vv][Ee][Rr]|[Ee][Nn][Dd][Pp][Oo][Ii][Nn][Tt])" + _SIGN + r"[A-Za-z0-9.:/_-]{4,}|[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}:[0-9]{1,5})", 1, 0, 0, "where"),
}
STRONG = ("assign", "access", "hex")
#: The patterns as they are searched for: what may not stand before a span is looked back at and not consumed, which
#: takes a tenth of the time. The spans are the same: none can start where another of its kind ends.
SEARCHED = {name: spec[0].replace("(?:^|[^", "(?<![") for name, spec in KINDS.items()}
#: Ends a scope: an empty line.
BREAK = r"\x0A[\x20\x09\x0D]*\x0A"
#: A mixed string counts only with all three.
MIXED = ("[a-z]", "[A-Z]", "[0-9]")
_PART = "array<struct<kind:int,at:int,gap:int,length:int,span:int,kept:boolean>>"


def _all_in(v: Column) -> Column:
    return v.rlike(MIXED[0]) & v.rlike(MIXED[1]) & v.rlike(MIXED[2])


def _parts(kind: int, matches: Column, pattern: str, span: int, counted: int, least: int, mixed: bool) -> Column:
    """For each match, in order: the code points before it since the last one, its length, that of its span, and
    whether it counts. Only texts with a match are searched again."""
    p = F.lit(pattern)
    inner = F.regexp_extract_all("text", p, F.lit(span)) if span else matches
    values = F.regexp_extract_all("text", p, F.lit(counted)) if counted else inner
    fine = F.transform(values, lambda v: _all_in(v) if mixed else F.length(v) >= least)
    rows = F.arrays_zip(matches.alias("w"), inner.alias("i"), fine.alias("f"), F.slice(F.split("text", pattern, -1), F.lit(1), F.size(matches)).alias("g"))
    struct = F.transform(rows, lambda r, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), F.length(r["g"]).alias("gap"), F.length(r["w"]).alias("length"), F.length(r["i"]).alias("span"), r["f"].alias("kept")))
    return F.when(F.size(matches) > 0, struct.cast(_PART)).otherwise(F.array().cast(_PART))


def _found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, parts, breaks): all matches of a text; `key` tells texts of one id apart."""
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    matched = text.select("*", *[F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias(name) for name, pattern in SEARCHED.items()])
    parts = [_parts(k, F.col(name), SEARCHED[name], *spec[1:4], mixed=name == "blob") for k, (name, spec) in enumerate(KINDS.items())]
    # where no weak part could be reported, scopes are of no use
    some = {role: sum(F.size(name) for name, spec in KINDS.items() if spec[4] == role) > 0 for role in ("who", "what", "where")}
    weak = sum(F.size(name) for name in KINDS if name not in STRONG) > 0
    open_text = F.when(weak & some["what"] & (some["who"] | some["where"]), F.col("text")).otherwise("")
    found = matched.select("id", F.xxhash64("id", "text").alias("key"), F.concat(*parts).alias("parts"), open_text.alias("text"))
    found = found.select("*", F.regexp_extract_all("text", F.lit(BREAK), F.lit(0)).alias("empty"))
    return found.select("id", "key", "parts", _parts(len(KINDS), F.col("empty"), BREAK, 0, 0, 0, False).alias("breaks"))


def _meet(left: DataFrame, right: DataFrame, on: str, how: str) -> DataFrame:
    """Rows l and r of one text."""
    return left.alias("l").join(right.alias("r"), F.expr(f"l.key = r.key AND l.id <=> r.id AND {on}"), how)


def _blocks(df: DataFrame, reach: int) -> DataFrame:
    """A row for each block of REACH code points that [start - reach, end + reach) touches."""
    first, last = F.greatest(F.lit(0), F.col("start") - reach), F.col("end") + reach
    return df.withColumn("block", F.explode(F.sequence(F.floor(first / REACH), F.floor(last / REACH))))


def parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts, parts), both written. texts: id and key of every row. parts: (id, key, kind, role, start, end, scope),
    once for rows that repeat a text under its id; matches too short to count are gone, spans in code points, end
    exclusive."""
    found = written(_found(docs, id_col, text_col), "secrets-found")
    texts = written(found.select("id", "key"), "secrets-texts")
    some = found.where(F.size("parts") > 0).dropDuplicates(["key", "id"])
    rows = some.select("id", "key", F.explode(F.concat("parts", "breaks")).alias("p")).select("id", "key", "p.*")
    so_far, in_order = Window.partitionBy("key", "id", "kind").orderBy("at"), Window.partitionBy("key", "id").orderBy("start", "kind")
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(so_far).cast("int")).withColumn("start", F.col("end") - F.col("span"))
    rows = rows.where("kept").withColumn("scope", F.sum((F.col("kind") == len(KINDS)).cast("int")).over(in_order))
    role = F.element_at(F.array(*[F.lit(spec[4]) for spec in KINDS.values()]), F.col("kind") + 1)
    placed = rows.where(F.col("kind") < len(KINDS)).select("id", "key", "kind", role.alias("role"), "start", "end", F.coalesce("scope", F.lit(0)).alias("scope"))
    return texts, written(placed, "secrets-parts", found)


_OVERLAP = "l.block = r.block AND r.start < l.end AND l.start < r.end"
_NEAR = f"l.block = r.block AND l.scope = r.scope AND greatest(l.start, r.start) - least(l.end, r.end) <= {REACH}"


def reported(found: DataFrame) -> DataFrame:
    """The rows of parts() that are secrets: all strong ones, and the weak ones that overlap none and have a
    complementary part - for a secret an identifier or an endpoint, for those a secret - in their scope, within REACH."""
    strong, weak = found.where(F.col("kind") < len(STRONG)), found.where(F.col("kind") >= len(STRONG))
    covered = _meet(_blocks(weak, 0), _blocks(strong, 0), _OVERLAP, "left_semi").select("id", "key", "kind", "start").distinct()
    free = written(_meet(weak, covered, "l.kind = r.kind AND l.start = r.start", "left_anti"), "secrets-weak")
    every, asking = _blocks(strong.unionByName(free), 0), _blocks(free, REACH)
    kept = _meet(asking, every, f"(l.role = 'what') != (r.role = 'what') AND {_NEAR}", "left_semi").drop("block").distinct()
    return strong.unionByName(written(kept, "secrets-kept", free))


def credentials(found: DataFrame) -> DataFrame:
    """(id, scope, who_start, who_end, what_start, what_end, where_start, where_end): each reported identifier with the
    nearest secret of its scope within REACH, and the nearest endpoint (null if none); ties to the earlier start.
    Identifiers without a secret there are left out."""
    rows = reported(found)
    who = _blocks(rows.where("role = 'who'"), REACH)

    def nearest(role: str, name: str) -> DataFrame:
        met = _meet(who, _blocks(rows.where(F.col("role") == role), 0), _NEAR, "inner")
        best = F.min(F.expr("struct(greatest(l.start, r.start) - least(l.end, r.end) AS gap, r.start AS start, r.end AS end)"))
        return met.groupBy("l.id", "l.key", "l.scope", "l.start", "l.end").agg(best.alias(name))

    out = _meet(nearest("what", "what"), nearest("where", "place"), "l.start = r.start AND l.end = r.end", "left")
    return out.selectExpr("l.id", "l.scope", "l.start AS who_start", "l.end AS who_end", "what.start AS what_start", "what.end AS what_end", "place.start AS where_start", "place.end AS where_end")


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row. Null texts are empty, a text without spans
    has counts of 0 and the hash of nothing; rows without an id and repeated rows stay. `spans` lists the strong spans
    and the weak ones that complementary parts confirm, by start, then kind in the order of KINDS."""
    texts, found = parts(docs, id_col, text_col)
    rows = reported(found)
    spans = rows.groupBy("id", "key").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    spans = written(spans, "secrets-spans", found)
    out = _meet(texts, spans, "true", "left").select(F.col("l.id").alias("doc_id"), F.coalesce("spans", F.array().cast("array<struct<start:int,kind:int,end:int>>")).alias("every"))
    base = F.filter("every", lambda s: s["kind"] < len(STRONG))
    counts = [F.size(F.expr(f"filter(every, s -> s.kind = {k})")).cast("long").alias(f"n_{name}") for k, name in enumerate(STRONG)]
    return out.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("every")).alias("spans"))
