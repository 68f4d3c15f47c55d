"""The queries of this package over the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_topk, html_extract, license_scan, mixing, ngram_join, secret_scan, spelling, suffix_dedup, token_counts, toxicity, warc, whitening
from .common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no paths: a document stands at source/lang/doc_id."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("id"), path.alias("path"), "text")
    return license_scan.licences(files).withColumnRenamed("id", "doc_id")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = exact_topk.integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return exact_topk.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.suffix_sums(token_counts.length_histogram(table(spark, sf_dir, "documents")))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(table(spark, sf_dir, "documents"), length=100)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), mixing.quality_domains(spark, sf_dir), mixing.TARGETS)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fitted(spark, docs, sf_dir))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses_of_pages(table(spark, sf_dir, "pages")))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), width=4, percent=85)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(whitening.integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.frequent_words(table(spark, sf_dir, "documents")))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_decontaminate": op2_decontaminate,
    "op3_exact_topk": op3_exact_topk,
    "op4_token_counts": op4_token_counts,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_mixing": op6_mixing,
    "op7_toxicity": op7_toxicity,
    "op8_warc": op8_warc,
    "op9_html_extract": op9_html_extract,
    "op10_ngram_join": op10_ngram_join,
    "op11_whitening": op11_whitening,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_secret_scan": op13_secret_scan,
}


def _secrets_sql() -> str:
    """Parts by the pieces and matches of each pattern, then the rules of secret_scan.reported() as joins."""
    last, texts = len(secret_scan.KINDS), []
    for k, (name, (pattern, span, counted, least, role)) in enumerate([*secret_scan.KINDS.items(), ("break", (secret_scan.BREAK, 0, 0, 0, ""))]):
        p = pattern.replace("(?:^|[^", "(?:[^").replace("'", "''")  # every text begins with a space here
        fine = " AND ".join(f"regexp_matches(v, '{c}')" for c in secret_scan.MIXED) if name == "blob" else f"length(v) >= {least}"
        texts.append(f"""SELECT rid, {k} AS kind, '{role}' AS role, fine, CAST(stop - n - 1 AS BIGINT) AS a, CAST(stop - 1 AS BIGINT) AS b FROM (
            SELECT rid, length(s) AS n, {fine} AS fine, sum(length(g) + length(w)) OVER (PARTITION BY rid ORDER BY i) AS stop FROM (
            SELECT rid, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS w, unnest(s) AS s, unnest(v) AS v, unnest(g[1:len(w)]) AS g FROM (
            SELECT rid, regexp_extract_all(x, '{p}') AS w, regexp_extract_all(x, '{p}', {span}) AS s, regexp_extract_all(x, '{p}', {span if name == "blob" else counted}) AS v, string_split_regex(x, '{p}') AS g FROM t WHERE regexp_matches(x, '{p}'))))""")
    strong, reach = len(secret_scan.STRONG), secret_scan.REACH
    names = "[" + ", ".join(f"'{k}'" for k in secret_scan.KINDS) + "]"
    joined = f"string_agg({names}[kind + 1] || ':' || a || ':' || b, ',' ORDER BY a, kind)"
    return f"""
        WITH t AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, ' ' || coalesce(text, '') AS x FROM documents),
        parts AS ({" UNION ALL ".join(texts)}),
        scoped AS MATERIALIZED (SELECT * FROM (SELECT *, sum(CAST(kind = {last} AS INTEGER)) OVER (PARTITION BY rid ORDER BY a, kind) AS scope FROM parts WHERE fine) WHERE kind < {last}),
        free AS MATERIALIZED (SELECT * FROM scoped w WHERE kind < {strong} OR NOT EXISTS (SELECT 1 FROM scoped s WHERE s.rid = w.rid AND s.kind < {strong} AND s.a < w.b AND w.a < s.b)),
        kept AS (SELECT * FROM free w WHERE kind < {strong} OR EXISTS (SELECT 1 FROM free o WHERE o.rid = w.rid AND o.scope = w.scope AND (o.role = 'what') <> (w.role = 'what') AND greatest(o.a, w.a) - least(o.b, w.b) <= {reach})),
        found AS (SELECT rid, {", ".join(f"count(*) FILTER (kind = {k}) AS n_{name}" for k, name in enumerate(secret_scan.STRONG))}, {joined} FILTER (kind < {strong}) AS base, {joined} AS spans FROM kept GROUP BY rid)
        SELECT doc_id, {", ".join(f"CAST(coalesce(n_{name}, 0) AS BIGINT) AS n_{name}" for name in secret_scan.STRONG)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN found USING (rid)
    """


#: CRC-32 by its rule; words one edit apart share themselves without one code point.
_WORDS_SQL = f"""
        WITH RECURSIVE crc AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
        run AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS raw FROM documents),
        low AS (SELECT id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM run GROUP BY ALL),
        bytes AS (SELECT run, n, list_transform(range(1, length(h), 2), lambda i: CAST(('0x' || h[i : i + 1]) AS BIGINT)) AS b, steps FROM (SELECT run, n, hex(encode(id || ':' || run)) AS h FROM low), crc),
        hashed AS (SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(steps[CAST(xor(c, x) & 255 AS INTEGER) + 1], c >> 8)), 4294967295) AS h FROM bytes),
        words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % {spelling.DROPPED} = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
          WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
        cut AS MATERIALIZED (SELECT word, n, i, substring(word, 1, i) || substring(word, i + 2) AS rest FROM (SELECT word, n, CAST(unnest(range(0, length(word))) AS BIGINT) AS i FROM words)),
        pairs AS (SELECT a.word AS word, a.n AS n, b.word AS near, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
          UNION SELECT c.word, c.n, w.word, w.n FROM cut c JOIN words w ON w.word = c.rest UNION SELECT w.word, w.n, c.word, c.n FROM cut c JOIN words w ON w.word = c.rest),
        best AS (SELECT word, n, count(*) AS n_near, max(m) AS m, min(near) FILTER (m = top) AS near FROM (SELECT *, max(m) OVER (PARTITION BY word) AS top FROM pairs) GROUP BY word, n),
        form AS MATERIALIZED (SELECT word, near AS form, m AS form_n FROM best WHERE m >= 2 * n),
        path AS (SELECT word, form AS reached, 1 AS step FROM form UNION ALL SELECT p.word, f.form, step + 1 FROM path p JOIN form f ON f.word = p.reached),
        root AS (SELECT word, arg_max(reached, step) AS root FROM path GROUP BY word)
        SELECT w.word, f.form, coalesce(r.root, w.word) AS root, w.n, CAST(coalesce(b.n_near, 0) AS BIGINT) AS n_near, f.form_n
        FROM words w LEFT JOIN best b USING (word) LEFT JOIN form f USING (word) LEFT JOIN root r USING (word)
"""

ORACLE: dict[str, str] = {
    "op12_spelling_variants": _WORDS_SQL,
    "op13_secret_scan": _secrets_sql(),
    "op3_exact_topk": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS e
          FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                 CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op5_suffix_dedup": """
        WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
        s AS (SELECT doc_id, i, substring(h, CAST(2 * i + 1 AS BIGINT), 200) AS w FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM d WHERE n >= 100)),
        r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY md5(w) ORDER BY doc_id, i) AS k FROM s) WHERE k > 1),
        m AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS head FROM r),
        g AS (SELECT doc_id, i, sum(head) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM m),
        spans AS (SELECT doc_id, g, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY doc_id, g),
        gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
        cut AS (SELECT g.doc_id, sum(b - a) AS removed, count(*) AS spans,
                string_agg(substring(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) || substring(any_value(h), CAST(2 * max(b) + 1 AS BIGINT)) AS kept
                FROM gaps g JOIN d ON d.doc_id = g.doc_id GROUP BY g.doc_id)
        SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
               sha256(unhex(coalesce(kept, h))) AS kept_sha256
        FROM d LEFT JOIN cut USING (doc_id)
    """,
    "op10_ngram_join": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (
          SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 3], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM w WHERE len(w) >= 4)
          UNION SELECT doc_id, md5(array_to_string(w, ' ')) FROM w WHERE len(w) BETWEEN 1 AND 3),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
        l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
        e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id AS node, doc_id AS reach FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach)
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT node, min(reach) AS component_id FROM r GROUP BY node) c ON c.node = d.doc_id
    """,
}
