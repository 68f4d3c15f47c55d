"""Named queries over the driver's tables, each with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels, scalar
from ..operators import evaluate, gram, inference, lloyd, optimize, order, score, text
from ..sources import io
from . import benchmarks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: Columns of the sparse matrix that the score queries use; replicates of the resampling queries.
COLUMNS, REPLICATES = 100, 500


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- text

_DOCS = """
docs AS (
  SELECT conv_id AS key, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS seq, count(*) OVER (PARTITION BY conv_id) AS n_docs,
         list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+'), lambda t: lower(t)) AS toks,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+') AS raw
  FROM conversations),
axis AS (SELECT key, seq, n_docs, pos, toks[pos] AS tok, raw[pos] AS rawtok FROM (SELECT *, unnest(range(1, len(toks) + 1)) AS pos FROM docs))"""


def _occurrences_sql(n: int, w: int) -> str:
    gram = " || ' ' || ".join(["tok", *(f"lead(tok, {k}) OVER l" for k in range(1, n))])
    other = " || ' ' || ".join(["rawtok", *(f"lead(rawtok, {k}) OVER l" for k in range(1, n))])
    return f"""{_DOCS},
occ AS (
  SELECT key, n_docs, seq AS ds, lead(seq, {n - 1}) OVER l AS de, row_number() OVER l AS place, {gram} AS feature, {other} AS other
  FROM axis WINDOW l AS (PARTITION BY key ORDER BY seq, pos)),
found AS (
  SELECT * FROM (SELECT *, greatest(0, de - {w} + 1) AS lo, least(n_docs - 1, ds + {w}) AS hi FROM occ WHERE feature IS NOT NULL AND de <= n_docs - 2)
  WHERE hi >= lo),
counts AS (SELECT feature, CAST(sum(hi - lo + 1) AS BIGINT) AS cnt, min(struct_pack(k := key, l := lo, p := place)) AS first FROM found GROUP BY feature),
ranks AS (SELECT *, CAST(row_number() OVER (ORDER BY cnt DESC, first) AS INTEGER) AS rank FROM counts)"""


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = scalar.tokens("text")
    return text.sequences(table(spark, sf_dir, "conversations"), "conv_id", ["turn", "role", "text"], toks=F.transform(raw, F.lower), raw=raw)


@query(f"WITH {_occurrences_sql(2, 2)} SELECT feature, cnt, rank FROM ranks WHERE rank <= 100")
def windowed_ngram_top(spark, sf_dir):
    """The 100 most frequent bigrams over windows of two documents to either side."""
    counts = text.feature_counts(text.occurrences(_conversations(spark, sf_dir), 2, 2))
    return text.ranked(counts, 100).select(scalar.display("feature").alias("feature"), "cnt", "rank")


def _ngram_query(name: str, n: int, source: str) -> None:
    gram = " || ' ' || ".join(f"t[i + {k}]" if k else "t[i]" for k in range(n))

    def run(spark, sf_dir):
        words = table(spark, sf_dir, source).select(F.transform(scalar.tokens("text"), F.lower).alias("w"))  # a column of its own: ngrams() reads it for every n-gram
        grams = words.select(F.explode(scalar.ngrams("w", n)).alias("g"))
        return grams.groupBy(scalar.display("g").alias("ngram")).agg(F.count("*").alias("cnt"))

    QUERIES[name] = run
    ORACLE[name] = f"""
        WITH d AS (SELECT list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+'), lambda t: lower(t)) AS t FROM {source}),
        g AS (SELECT t, unnest(range(1, len(t) - {n} + 2)) AS i FROM d WHERE len(t) >= {n})
        SELECT {gram} AS ngram, count(*) AS cnt FROM g GROUP BY 1"""


for _n, _source in ((1, "documents"), (2, "conversations"), (3, "conversations")):
    _ngram_query(f"ngrams_n{_n}", _n, _source)


@query(f"""WITH {_DOCS} SELECT d.key, d.seq, CAST(coalesce(sum(len(e.toks)), 0) AS BIGINT) AS n_tokens, md5(coalesce(string_agg(array_to_string(e.toks, ' '), ' ' ORDER BY e.seq) FILTER (len(e.toks) > 0), '')) AS tokens_md5
    FROM docs d LEFT JOIN docs e ON e.key = d.key AND e.seq BETWEEN greatest(0, d.seq - 3) AND least(d.seq + 2, d.n_docs - 2) GROUP BY d.key, d.seq""")
def running_window_tokens(spark, sf_dir):
    windows = text.running_windows(_conversations(spark, sf_dir), 3)
    return windows.select("key", "seq", F.size("toks").cast("long").alias("n_tokens"), F.md5(F.concat_ws(" ", "toks").cast("binary")).alias("tokens_md5"))


@query(f"WITH {_occurrences_sql(3, 3)} SELECT feature, cnt FROM counts")
def windowed_ngram_counts(spark, sf_dir):
    return text.feature_counts(text.occurrences(_conversations(spark, sf_dir), 3, 3)).select(scalar.display("feature").alias("feature"), "cnt")


@query(f"""WITH {_occurrences_sql(1, 4)}, c AS (SELECT key, feature, CAST(sum(hi - lo + 1) AS BIGINT) AS cnt, min(struct_pack(l := lo, p := place)) AS first FROM found GROUP BY key, feature),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY key ORDER BY cnt DESC, first) AS INTEGER) AS rank FROM c) SELECT key, feature, cnt, rank FROM r WHERE rank <= 10""")
def feature_ranking(spark, sf_dir):
    """The ten first features of each conversation, ties by first appearance."""
    counts = text.feature_counts(text.occurrences(_conversations(spark, sf_dir), 1, 4), by_key=True)
    return text.ranked(counts, 10, by_key=True).select("key", scalar.display("feature").alias("feature"), "cnt", "rank")


_MATRIX_12 = f"""{_occurrences_sql(1, 2)}, matrix AS (
  SELECT key, row, rank AS feature_id, count(*) AS value FROM (SELECT f.key, r.rank, unnest(range(CAST(f.lo AS BIGINT), CAST(f.hi AS BIGINT) + 1)) AS row FROM found f JOIN ranks r USING (feature) WHERE r.rank <= 50) GROUP BY ALL)"""


def _window_matrix(spark, sf_dir):
    docs = _conversations(spark, sf_dir)
    found = text.occurrences(docs, 1, 2)
    return docs, text.count_matrix(found, text.ranked(text.feature_counts(found), 50))


@query(f"WITH {_MATRIX_12} SELECT key, row, feature_id, value FROM matrix")
def count_matrix(spark, sf_dir):
    return _window_matrix(spark, sf_dir)[1]


@query(f"WITH {_MATRIX_12} SELECT key, row, feature_id, CAST(1 AS DOUBLE) AS value FROM matrix")
def binary_matrix(spark, sf_dir):
    return text.binary(_window_matrix(spark, sf_dir)[1])


@query(f"WITH {_MATRIX_12} SELECT d.key, d.seq AS row FROM docs d ANTI JOIN (SELECT * FROM matrix WHERE feature_id BETWEEN 40 AND 50) m ON d.key = m.key AND d.seq = m.row")
def dropped_rows(spark, sf_dir):
    """Windows without any of the features of rank 40 to 50."""
    docs, matrix = _window_matrix(spark, sf_dir)
    return text.dropped_rows(docs, matrix.where("feature_id between 40 and 50"))


_REAL = f"""{_occurrences_sql(2, 2)}, real AS (SELECT feature, other, CAST(sum(hi - lo + 1) AS BIGINT) AS cnt, min(struct_pack(k := key, l := lo, p := place)) AS first FROM found GROUP BY feature, other)"""


@query(f"WITH {_REAL} SELECT feature, other, cnt, CAST(sum(cnt) OVER (PARTITION BY feature) AS BIGINT) AS total FROM real")
def surface_realizations(spark, sf_dir):
    """Lower-case bigrams and the forms in which they appear."""
    found = text.occurrences(_conversations(spark, sf_dir), 2, 2, more="raw")
    return text.surface_realizations(found).select(scalar.display("feature").alias("feature"), scalar.display("other").alias("other"), "cnt", "total")


@query(f"WITH {_REAL}, r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY cnt DESC, first) AS k FROM real) SELECT feature, other, cnt FROM r WHERE k = 1")
def top_realization(spark, sf_dir):
    found = text.occurrences(_conversations(spark, sf_dir), 2, 2, more="raw")
    return text.top_realization(text.surface_realizations(found)).select(scalar.display("feature").alias("feature"), scalar.display("other").alias("other"), "cnt")


@query(f"WITH {_DOCS} SELECT count(*) AS misaligned FROM docs WHERE len(toks) <> len(raw)")
def alignment(spark, sf_dir):
    return text.misaligned(_conversations(spark, sf_dir), "toks", "raw").agg(F.count("*").alias("misaligned"))


# ---------------------------------------------------------------- evaluation

_MCC = """
a AS (SELECT sum(x * x) AS aa FROM (SELECT CAST(sum(n) AS DOUBLE) AS x FROM con GROUP BY t)),
b AS (SELECT sum(x * x) AS bb FROM (SELECT CAST(sum(n) AS DOUBLE) AS x FROM con GROUP BY p)),
ab AS (SELECT sum(l.x * r.x) AS ab FROM (SELECT t AS k, CAST(sum(n) AS DOUBLE) AS x FROM con GROUP BY t) l JOIN (SELECT p AS k, CAST(sum(n) AS DOUBLE) AS x FROM con GROUP BY p) r USING (k)),
sc AS (SELECT CAST(sum(n) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (t = p), 0) AS DOUBLE) AS c FROM con)
SELECT round(CASE WHEN (s * s - bb) * (s * s - aa) > 0 THEN 50 + 50 * abs((c * s - coalesce(ab, 0)) / sqrt((s * s - bb) * (s * s - aa))) ELSE 50.0 END, 6) AS mcc FROM a, b, ab, sc"""


def _rounded(df: DataFrame, *columns: str, to: int = 6) -> DataFrame:
    """Other engines sum in another order; and no zero has a sign."""
    return df.withColumns({c: F.round(F.col(c), to) + 0.0 for c in columns})


@query(f"WITH con AS (SELECT quality AS t, toxic AS p, count(*) AS n FROM labels GROUP BY ALL), {_MCC}")
def mcc_binary(spark, sf_dir):
    return _rounded(evaluate.mcc(evaluate.contingency(table(spark, sf_dir, "labels"), "quality", "toxic")), "mcc")


@query(f"WITH con AS (SELECT role AS t, CASE WHEN turn % 3 = 0 THEN 'system' WHEN turn % 3 = 1 THEN 'user' ELSE 'assistant' END AS p, count(*) AS n FROM conversations GROUP BY ALL), {_MCC}")
def mcc_multiclass(spark, sf_dir):
    guess = F.when(F.col("turn") % 3 == 0, "system").when(F.col("turn") % 3 == 1, "user").otherwise("assistant")
    return _rounded(evaluate.mcc(evaluate.contingency(table(spark, sf_dir, "conversations").withColumn("guess", guess), "role", "guess")), "mcc")


@query("SELECT event_type, CAST(user_id % 7 AS BIGINT) AS panel, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(value) AS count FROM events WHERE NOT isnan(value) GROUP BY ALL")
def summary_mean_std_count(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("panel", F.col("user_id") % 7)
    return _rounded(evaluate.summary(events, ["event_type", "panel"], "value"), "mean", "std").where("count > 0")


@query("""WITH s AS (SELECT l_returnflag, CAST(floor(l_discount * 100) AS INTEGER) AS level, avg(l_quantity) AS mean, count(*) AS count FROM lineitem GROUP BY ALL),
    levels AS (SELECT f.l_returnflag, CAST(g.level AS INTEGER) AS level FROM (SELECT DISTINCT l_returnflag FROM lineitem) f CROSS JOIN range(0, 16) g(level))
    SELECT l_returnflag, level, round(mean, 6) AS mean, coalesce(count, 0) AS count FROM levels LEFT JOIN s USING (l_returnflag, level)""")
def reindexed_curve(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").withColumn("level", F.floor(F.col("l_discount") * 100).cast("int"))
    levels = evaluate.grid(line.select("l_returnflag").distinct(), spark.range(16).select(F.col("id").cast("int").alias("level")))
    return _rounded(evaluate.curve(line.groupBy("l_returnflag", "level").agg(F.avg("l_quantity").alias("mean"), F.count("*").alias("count")), levels, ["l_returnflag", "level"]).na.fill(0, ["count"]), "mean")


@query("SELECT l_returnflag, " + ", ".join(f"count(*) FILTER (s BETWEEN {a} AND {b}) AS n_{a}_{b}" for a, b in evaluate.INTERVALS) + " FROM (SELECT l_returnflag, 50 + l_quantity + l_tax * 5 AS s FROM lineitem) GROUP BY 1")
def interval_histogram(spark, sf_dir):
    return evaluate.interval_histogram(table(spark, sf_dir, "lineitem").withColumn("s", 50 + F.col("l_quantity") + F.col("l_tax") * 5), "s", ["l_returnflag"])


@query("""WITH m AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), n AS (SELECT o_orderstatus, count(*) AS size FROM orders GROUP BY 1),
    b AS (SELECT o_orderstatus, CAST(least(floor((o_totalprice - lo) / (hi - lo) * 24), 23) AS INTEGER) AS bin, count(*) AS n FROM orders, m GROUP BY ALL)
    SELECT b.o_orderstatus, bin, b.n, round(b.n / size, 9) AS share FROM b JOIN n USING (o_orderstatus)""")
def equal_width_histogram(spark, sf_dir):
    return _rounded(evaluate.equal_width_histogram(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderstatus"), "share", to=9)


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def keep_last_dedupe(spark, sf_dir):
    return evaluate.keep_last(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def resume_anti_join(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return evaluate.missing(table(spark, sf_dir, "customer").select("c_custkey"), done, ["c_custkey"])


@query("SELECT n.n_nationkey AS c_nationkey, s.c_mktsegment FROM nation n CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer) s WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = n.n_nationkey AND c.c_mktsegment = s.c_mktsegment AND c.c_acctbal > 9000)")
def missing_conditions(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    expected = evaluate.grid(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey")), customer.select("c_mktsegment").distinct())
    return evaluate.missing(expected, customer.where("c_acctbal > 9000"), ["c_nationkey", "c_mktsegment"])


@query("""SELECT n, w, coalesce(CAST(f AS VARCHAR), 'all') AS f, 'n-' || n || '_l-' || w || '_f-' || coalesce(CAST(f AS VARCHAR), 'all') AS combination
    FROM (SELECT DISTINCT r_regionkey AS n FROM region), (SELECT DISTINCT CAST(l_linenumber AS INTEGER) AS w FROM lineitem), (SELECT DISTINCT nullif(p_size % 5, 0) AS f FROM part)""")
def grid_cross_join(spark, sf_dir):
    n, w = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n")), table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("int").alias("w"))
    f = table(spark, sf_dir, "part").select(F.nullif(F.col("p_size") % 5, F.lit(0)).alias("f"))
    combined = evaluate.grid(n.distinct(), w.distinct(), f.distinct()).withColumn("combination", scalar.result_key("n", "w", "f"))
    return combined.withColumn("f", F.coalesce(F.col("f").cast("string"), F.lit("all")))


@query("SELECT p_partkey, method, CAST(mcc AS DOUBLE) AS mcc FROM (UNPIVOT (SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price FROM part) ON size, price INTO NAME method VALUE mcc)")
def unpivot_scores(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return evaluate.unpivot_scores(part, ["p_partkey"], ["size", "price"])


@query("SELECT p_brand, p_partkey, p_retailprice, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) WHERE k <= 20")
def topk_combinations(spark, sf_dir):
    return evaluate.top_combinations(table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice", ["p_partkey"]).select("p_brand", "p_partkey", "p_retailprice", "rank")


@query("""WITH e AS (SELECT o_custkey, sum(o_totalprice) AS v FROM orders GROUP BY 1), o AS (SELECT o_custkey, sum(o_totalprice) AS v FROM orders WHERE o_orderkey % 500 <> 1 GROUP BY 1)
    SELECT count(*) AS rows, count(*) FILTER (e.o_custkey IS NULL OR o.o_custkey IS NULL) AS unmatched, round(max(abs(e.v - o.v)), 2) AS max_v,
           bool_and(coalesce(abs(e.v - o.v) <= 1e-2 + 1e-9 * abs(e.v), FALSE)) AS passed FROM e FULL JOIN o USING (o_custkey)""")
def tolerance_compare(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    sums = lambda d: d.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("v"))
    return _rounded(evaluate.compare(sums(orders), sums(orders.where("o_orderkey % 500 <> 1")), ["o_custkey"], ["v"], atol=1e-2), "max_v", to=2)


@query("""WITH e AS (SELECT c_nationkey, c_mktsegment, avg(c_acctbal) AS mean, count(*) AS count FROM customer GROUP BY ALL),
    o AS (SELECT c_nationkey, c_mktsegment, avg(c_acctbal) AS mean, count(*) AS count FROM customer WHERE c_nationkey <> 5 AND NOT (c_nationkey = 3 AND c_custkey % 2 = 0) GROUP BY ALL),
    b AS (SELECT e.*, o.mean AS omean, o.count AS ocount, o.c_nationkey IS NULL AS gone FROM e LEFT JOIN o USING (c_nationkey, c_mktsegment)),
    c AS (SELECT c_nationkey, c_mktsegment, 'mean' AS "column", mean AS expected, omean AS observed, gone FROM b UNION ALL SELECT c_nationkey, c_mktsegment, 'count', count, ocount, gone FROM b)
    SELECT c_nationkey, c_mktsegment, "column", round(CAST(expected AS DOUBLE), 6) AS expected, round(CAST(observed AS DOUBLE), 6) AS observed, CASE WHEN gone THEN 'missing' ELSE 'differs' END AS problem FROM c WHERE gone OR abs(expected - observed) > 1e-6 + 1e-6 * abs(expected)""")
def validated_tables(spark, sf_dir):
    """A table of expected means, written as CSV and loaded again, against one that lacks customers of two nations."""
    customer = table(spark, sf_dir, "customer")
    mean = lambda df: df.groupBy("c_nationkey", "c_mktsegment").agg(F.avg("c_acctbal").alias("mean"), F.count("*").alias("count"))
    path = io.fresh_path(spark, "expected")
    io.write_csv(mean(customer), path)
    expected = io.expected(spark, path, "c_nationkey int, c_mktsegment string, mean double, count long")
    observed = mean(customer.where("c_nationkey <> 5 and not (c_nationkey = 3 and c_custkey % 2 = 0)"))
    return _rounded(evaluate.validated(expected, observed, ["c_nationkey", "c_mktsegment"], ["mean", "count"], 1e-6, 1e-6), "expected", "observed")


@query("SELECT lang, round(avg(quality), 6) AS share_quality, round(avg(toxic), 6) AS share_toxic FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def label_shares(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return _rounded(evaluate.label_shares(rows, "lang", ["quality", "toxic"]), "share_quality", "share_toxic")


@query("SELECT toxic AS label, count(*) AS n, (SELECT min(c) < 0.02 * sum(c) FROM (SELECT count(*) AS c FROM labels GROUP BY toxic)) AS collapsed FROM labels GROUP BY toxic")
def cluster_sizes(spark, sf_dir):
    return evaluate.cluster_sizes(table(spark, sf_dir, "labels").select(F.col("toxic").alias("label")), "label")


@query("""WITH v AS (SELECT p_partkey, [p_size % 2, CAST(floor(p_retailprice) AS INTEGER) % 2, length(p_type) % 2] AS bits FROM part),
    d AS (SELECT bits, row_number() OVER (ORDER BY bits) - 1 AS cluster FROM (SELECT bits FROM v GROUP BY bits HAVING count(*) >= 5))
    SELECT p_partkey, CAST(coalesce(cluster, -1) AS INTEGER) AS cluster FROM v LEFT JOIN d USING (bits)""")
def dbscan_duplicates(spark, sf_dir):
    bits = F.array(F.col("p_size") % 2, F.floor("p_retailprice").cast("int") % 2, F.length("p_type") % 2)
    return evaluate.duplicate_clusters(table(spark, sf_dir, "part").select("p_partkey", bits.alias("bits")), "bits").select("p_partkey", F.col("cluster").cast("int").alias("cluster"))


@query("SELECT CAST(l_linenumber AS INTEGER) AS l_linenumber, count(*) FILTER (w >= 0.5) AS by_threshold, count(*) FILTER (round_even(w, 0) = 1) AS by_half_even FROM (SELECT l_linenumber, l_tax * 12.5 AS w FROM lineitem) GROUP BY 1")
def label_rounding(spark, sf_dir):
    w = table(spark, sf_dir, "lineitem").withColumn("w", F.col("l_tax") * 12.5)
    return w.groupBy(F.col("l_linenumber").cast("int").alias("l_linenumber")).agg(F.sum(scalar.threshold_label("w")).alias("by_threshold"), F.count(F.when(scalar.half_even_label("w") == 1, 1)).alias("by_half_even"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS norm FROM embeddings WHERE len(embedding) > 0")
def l2_norms(spark, sf_dir):
    return _rounded(table(spark, sf_dir, "embeddings").where(F.size("embedding") > 0).select("vec_id", scalar.l2_norm("embedding").alias("norm")), "norm")


@query("SELECT item_id, reverse(text) AS mirrored FROM benchmark")
def mirrored_text(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", scalar.mirrored("text").alias("mirrored"))


# ---------------------------------------------------------------- scores

_MATRIX = f"""
tok AS (SELECT conv_id * 100000 + turn AS row, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+'), lambda t: lower(t))) AS feature FROM conversations),
chosen AS (SELECT feature FROM tok GROUP BY feature ORDER BY count(*) DESC, feature LIMIT {COLUMNS}),
x AS (SELECT row, feature, CAST(count(*) AS DOUBLE) AS value FROM tok JOIN chosen USING (feature) GROUP BY ALL),
r AS (SELECT row, sum(value) AS r FROM x GROUP BY row),
mem AS (SELECT row, CASE WHEN row_number() OVER (ORDER BY r, row) - 1 >= (SELECT count(*) FROM r) // 2 THEN 0.9::DOUBLE ELSE 0.1::DOUBLE END AS m FROM r),
lab AS (SELECT row, CAST(m > 0.5 AS INTEGER) AS label FROM mem)"""


def _matrix(spark, sf_dir, model: str = ""):
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100000 + F.col("turn")).alias("row"), F.explode(F.transform(scalar.tokens("text"), F.lower)).alias("feature"))
    chosen = rows.groupBy("feature").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "feature").limit(COLUMNS).select("feature")
    x = rows.join(F.broadcast(chosen), "feature").groupBy("row", "feature").agg(F.count("*").cast("double").alias("value"))  # COLUMNS rows
    x = score.checked(text.binary(x) if model == "bernoulli" else x, model)
    members = score.median_split(score.row_totals(x), "total")
    return x, members, members.select("row", scalar.threshold_label("m").alias("label"))


def _loss_sql(model: str, what: str) -> str:
    bern, multi = model == "bernoulli", model == "multinomial"
    parts = []
    for c, w in ((0, "(1 - m)"), (1, "m")):
        size = f"(SELECT sum({w}) FROM mem)" if bern else f"(SELECT sum({w} * value) FROM x JOIN mem USING (row))"
        lq = "0.0" if multi else "ln(1 - p + 1e-10)"
        parts.append(f"""
f{c} AS (SELECT feature, f, z, p, ln(p + 1e-10) AS lp, {lq} AS lq, f / (p + 1e-10) - {"0" if multi else "(z - f) / (1 - p + 1e-10)"} AS d
  FROM (SELECT feature, f, z, f / z AS p FROM (SELECT feature, sum({w} * value) AS f, {size} AS z FROM x JOIN mem USING (row) GROUP BY feature))),
t{c} AS (SELECT sum(f * lp + {"0" if multi else "(z - f) * lq"}) AS score, sum(lq) AS slq, sum(p * d) AS pd, max(z) AS z FROM f{c}),
g{c} AS (SELECT row, sum(value * ({"lp" if multi else "lp - lq"})) AS v, sum(value * d) AS vd FROM x JOIN f{c} USING (feature) GROUP BY row)""")
    scale = "ln(2)" if bern else "1.0"
    matrix = _MATRIX.replace("CAST(count(*) AS DOUBLE) AS value", "CAST(1 AS DOUBLE) AS value") if bern else _MATRIX
    head = f"WITH {matrix}, {', '.join(parts)}"
    if what == "loss":
        return f"{head} SELECT round(-(t0.score + t1.score) / {scale}, 4) AS loss FROM t0, t1"
    own = "1.0" if bern else "r"
    g = [f"(g{c}.v + {own if not multi else '0'} * t{c}.slq + (g{c}.vd - {own} * t{c}.pd) / t{c}.z) / {scale}" for c in (0, 1)]
    return f"{head} SELECT r.row, round({g[0]} - ({g[1]}), 5) AS g FROM r JOIN g0 USING (row) JOIN g1 USING (row), t0, t1"


def _score_queries(model: str) -> None:
    def loss(spark, sf_dir):
        x, members, _ = _matrix(spark, sf_dir, model)
        return _rounded(score.loss(x, members, model), "loss", to=4)

    def gradient(spark, sf_dir):
        x, members, _ = _matrix(spark, sf_dir, model)
        return _rounded(score.gradient(x, members, model), "g", to=5)

    for name, f in (("loss", loss), ("gradient", gradient)):
        QUERIES[f"{name}_{model}"] = f
        ORACLE[f"{name}_{model}"] = _loss_sql(model, name)


for _model in ("bernoulli", "binomial", "multinomial"):
    _score_queries(_model)


def _audit_sql(step: float = 1e-4) -> str:
    head, tail = _loss_sql("bernoulli", "gradient").rsplit(" SELECT r.row, ", 1)
    at = lambda f, z: f"(({f}) * ln(({f}) / ({z}) + 1e-10) + (({z}) - ({f})) * ln(1 - ({f}) / ({z}) + 1e-10))"
    h, v = f"{step}::DOUBLE", f"{step}::DOUBLE * value"
    base = f"{at('b', f'zb + {h}')} - {at('b', f'zb - {h}')} + {at('a', f'za - {h}')} - {at('a', f'za + {h}')}"
    own = f"{at(f'b + {v}', f'zb + {h}')} - {at(f'b - {v}', f'zb - {h}')} + {at(f'a - {v}', f'za - {h}')} - {at(f'a + {v}', f'za + {h}')}"
    return f"""{head}, d AS (SELECT f0.feature, f0.f AS a, f0.z AS za, f1.f AS b, f1.z AS zb FROM f0 JOIN f1 USING (feature)), grad AS (SELECT r.row AS row, {tail}),
    base AS (SELECT sum({base}) AS base FROM d), own AS (SELECT row, sum(({own}) - ({base})) AS own FROM x JOIN d USING (feature) GROUP BY row)
    SELECT row, round(-(base + own) / (2 * {h}) / ln(2), 3) AS slope, abs(g + (base + own) / (2 * {h}) / ln(2)) < 0.001 AS agrees FROM grad JOIN own USING (row), base"""


@query(_audit_sql())
def slope_audit(spark, sf_dir):
    """Do all derivatives of the bernoulli loss agree with its slopes?"""
    x, members, _ = _matrix(spark, sf_dir, "bernoulli")
    found = score.slope_audit(x, members)
    return found.select("row", F.round("slope", 3).alias("slope"), (F.abs(F.round("g", 5) - F.col("slope")) < 0.001).alias("agrees"))


_LOO = f"""{_MATRIX}, cf AS (SELECT label, feature, sum(value) AS f FROM x JOIN lab USING (row) GROUP BY ALL), ct AS (SELECT label, sum(f) AS t FROM cf GROUP BY label),
loo AS (SELECT x.row, lab.label, -sum(value * log2((f - value + 0.5) / (t - r + 0.5 * (SELECT count(*) FROM chosen)))) / max(r) AS bits
  FROM x JOIN lab USING (row) JOIN cf ON cf.label = lab.label AND cf.feature = x.feature JOIN ct ON ct.label = lab.label JOIN r ON r.row = x.row GROUP BY x.row, lab.label)"""


@query(f"WITH {_LOO} SELECT row, label, round(bits, 6) AS bits FROM loo")
def loo_self_information(spark, sf_dir):
    x, _, labels = _matrix(spark, sf_dir)
    return _rounded(score.loo_self_information(x, labels), "bits")


_SOFT = f"""{_MATRIX}, sf AS (SELECT feature, sum((1 - m) * value) AS f0, sum(m * value) AS f1 FROM x JOIN mem USING (row) GROUP BY feature), st AS (SELECT sum(f0) AS t0, sum(f1) AS t1, count(*) AS v FROM sf),
sb AS (SELECT x.row, m, -sum(value * log2((f0 - (1 - m) * value + 0.5) / (t0 - (1 - m) * r + 0.5 * v))) / max(r) AS b0, -sum(value * log2((f1 - m * value + 0.5) / (t1 - m * r + 0.5 * v))) / max(r) AS b1
  FROM x JOIN mem USING (row) JOIN sf USING (feature) JOIN r ON r.row = x.row, st GROUP BY x.row, m),
soft AS (SELECT sum((1 - m) * b0) / sum(1 - m) AS mean0, sum(m * b1) / sum(m) AS mean1 FROM sb)"""


@query(f"WITH {_SOFT} SELECT round(mean0, 6) AS mean0, round(mean1, 6) AS mean1 FROM soft")
def soft_loo_mean(spark, sf_dir):
    x, members, _ = _matrix(spark, sf_dir)
    return _rounded(score.soft_loo_mean(x, members), "mean0", "mean1")


@query(f"""WITH model AS ({_loss_sql("multinomial", "loss").replace("round(-(t0.score + t1.score) / 1.0, 4)", "-(t0.score + t1.score)")}), soft AS (WITH {_SOFT} SELECT * FROM soft),
    p AS (SELECT loss AS model_loss, abs(mean0 - mean1) AS gap, 2.0 * power(greatest(0.0, 0.5 - abs(mean0 - mean1)), 2) AS penalty FROM model, soft)
    SELECT round(model_loss * (1 + penalty), 3) AS loss, round(model_loss, 3) AS model_loss, round(penalty, 6) AS penalty, round(gap, 6) AS gap FROM p""")
def gap_penalised_loss(spark, sf_dir):
    x, members, _ = _matrix(spark, sf_dir)
    return _rounded(_rounded(score.penalised_loss(x, members, "multinomial", 2.0, 0.5), "penalty", "gap"), "loss", "model_loss", to=3)


_SOFT_G = f"""{_SOFT}, sa AS (SELECT x.row, x.feature, value, (1 - m) * value / r / (f0 - (1 - m) * value + 0.5) AS a0, m * value / r / (f1 - m * value + 0.5) AS a1 FROM x JOIN mem USING (row) JOIN sf USING (feature) JOIN r ON r.row = x.row),
share AS (SELECT feature, sum(a0) AS s0, sum(a1) AS s1 FROM sa GROUP BY feature),
sq AS (SELECT row, m, r, (1 - m) / (t0 - (1 - m) * r + 0.5 * v) AS q0, m / (t1 - m * r + 0.5 * v) AS q1 FROM mem JOIN r USING (row), st),
sw AS (SELECT sum(1 - m) AS w0, sum(m) AS w1, sum(q0) AS all_q0, sum(q1) AS all_q1 FROM sq),
sh AS (SELECT row, sum(value * (s0 - a0)) AS h0, sum(value * (s1 - a1)) AS h1 FROM sa JOIN share USING (feature) GROUP BY row),
sg AS (SELECT row, -(b0 - mean0 - (h0 - r * (all_q0 - q0)) / ln(2)) / w0 AS g0, (b1 - mean1 - (h1 - r * (all_q1 - q1)) / ln(2)) / w1 AS g1, mean0, mean1
  FROM sb JOIN sq USING (row) JOIN sh USING (row), sw, soft)"""


@query(f"WITH {_SOFT_G} SELECT row, round(g0, 7) + 0.0 AS g0, round(g1, 7) + 0.0 AS g1 FROM sg")
def soft_loo_gradient(spark, sf_dir):
    x, members, _ = _matrix(spark, sf_dir)
    return _rounded(score.soft_loo_gradient(x, members), "g0", "g1", to=7).select("row", "g0", "g1")


@query(f"""WITH model AS ({_loss_sql("multinomial", "loss").replace("round(-(t0.score + t1.score) / 1.0, 4)", "-(t0.score + t1.score)")}), of_model AS ({_loss_sql("multinomial", "gradient").replace(", 5) AS g", ", 12) AS g")}), sg AS (WITH {_SOFT_G} SELECT * FROM sg),
    p AS (SELECT row, g, loss, greatest(0.0, 0.5 - abs(mean1 - mean0)) AS short, sign(mean1 - mean0) * (g1 - g0) AS wider FROM of_model JOIN sg USING (row), model)
    SELECT row, round(g * (1 + 2.0 * short * short) - loss * 4.0 * short * wider, 4) + 0.0 AS g FROM p""")
def gap_penalised_gradient(spark, sf_dir):
    x, members, _ = _matrix(spark, sf_dir)
    return _rounded(score.penalised_gradient(x, members, "multinomial", 2.0, 0.5), "g", to=4)


_STATS = f"""{_MATRIX}, cf AS (SELECT label, feature, sum(value) AS f FROM x JOIN lab USING (row) GROUP BY ALL), ck AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY f DESC, feature) AS k, sum(f) OVER (PARTITION BY label) AS t FROM cf),
stats AS (SELECT label, max(t) AS tokens, count(*) AS vocabulary, -sum(f / t * log2(f / t)) AS entropy, coalesce(sum(f / t) FILTER (k <= 10), 0) AS top10_share, coalesce(sum(f / t) FILTER (k <= 100), 0) AS top100_share FROM ck GROUP BY label)"""


@query(f"""WITH {_STATS} SELECT label, (SELECT count(*) FROM lab l WHERE l.label = s.label) AS rows, tokens, vocabulary, round(entropy, 6) AS entropy, round(CASE WHEN vocabulary > 1 THEN entropy / log2(vocabulary) ELSE 0 END, 6) AS normalized_entropy,
    round(1 - vocabulary / tokens, 6) AS repetition, round(top10_share, 6) AS top10_share, round(top100_share, 6) AS top100_share FROM stats s""")
def cluster_stats(spark, sf_dir):
    x, _, labels = _matrix(spark, sf_dir)
    return _rounded(score.cluster_stats(x, labels), "entropy", "normalized_entropy", "repetition", "top10_share", "top100_share")


@query(f"""WITH b AS (WITH {_LOO} SELECT avg(bits) FILTER (label = 0) AS bits0, avg(bits) FILTER (label = 1) AS bits1 FROM loo), s AS (WITH {_STATS} SELECT max(1 - vocabulary / tokens) FILTER (label = 0) AS rep0, max(1 - vocabulary / tokens) FILTER (label = 1) AS rep1 FROM stats)
    SELECT CAST(CASE WHEN abs(bits0 - bits1) <= 1e-9 THEN rep1 > rep0 ELSE bits1 < bits0 END AS INTEGER) AS formulaic_cluster, abs(bits0 - bits1) <= 1e-9 AS tied, (bits1 < bits0) = (rep1 > rep0) AS diagnostics_agree,
           round(bits0, 6) AS bits0, round(bits1, 6) AS bits1, round(rep0, 6) AS repetition0, round(rep1, 6) AS repetition1 FROM b, s""")
def orientation(spark, sf_dir):
    x, _, labels = _matrix(spark, sf_dir)
    return _rounded(score.orientation(x, labels), "bits0", "bits1", "repetition0", "repetition1")


@query(f"WITH {_MATRIX} SELECT row, m FROM mem")
def median_split_init(spark, sf_dir):
    return _matrix(spark, sf_dir)[1]


@query("SELECT round(abs(avg(n_chars) FILTER (toxic = 0) - avg(n_chars) FILTER (toxic = 1)) / (stddev_samp(n_chars) * sqrt(1 / count(*) FILTER (toxic = 0) + 1 / count(*) FILTER (toxic = 1))), 6) AS z FROM documents JOIN labels USING (doc_id)")
def null_z(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return _rounded(inference.null_z(rows, "toxic", "n_chars"), "z")


@query(f"""WITH {_MATRIX}, n AS (SELECT count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM lab),
    s AS (SELECT feature, coalesce(sum(value) FILTER (label = 0), 0) / any_value(n0) AS mean0, coalesce(sum(value) FILTER (label = 1), 0) / any_value(n1) AS mean1 FROM x JOIN lab USING (row), n GROUP BY feature)
    SELECT feature, round(mean0, 6) AS mean0, round(mean1, 6) AS mean1, round(mean1 - mean0, 6) AS diff FROM s""")
def feature_contrast(spark, sf_dir):
    x, _, labels = _matrix(spark, sf_dir)
    return _rounded(inference.feature_contrast(x, labels), "mean0", "mean1", "diff")


_HALF = f"""{_MATRIX}, half AS (SELECT rep, row, label FROM (SELECT rep, row, label, row_number() OVER (PARTITION BY rep ORDER BY md5(rep || '-' || row), row) AS k FROM lab, range(0, {REPLICATES}) g(rep)) WHERE k <= (SELECT count(*) FROM lab) // 2),
hn AS (SELECT rep, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM half GROUP BY rep),
hs AS (SELECT rep, feature, coalesce(sum(value) FILTER (label = 0), 0) AS s0, coalesce(sum(value) FILTER (label = 1), 0) AS s1 FROM x JOIN half USING (row) GROUP BY ALL),
hd AS (SELECT c.feature, coalesce(s1, 0) / n1 - coalesce(s0, 0) / n0 AS d FROM (SELECT DISTINCT feature FROM x) c CROSS JOIN hn LEFT JOIN hs ON hs.rep = hn.rep AND hs.feature = c.feature),
imp AS (SELECT feature, avg(d) AS mean, stddev_samp(d) AS std FROM hd GROUP BY feature)"""


@query(f"WITH {_HALF} SELECT feature, round(mean, 6) AS mean, round(std, 6) AS std FROM imp")
def half_sample_importance(spark, sf_dir):
    x, _, labels = _matrix(spark, sf_dir)
    return _rounded(inference.half_sample_importance(x, labels, REPLICATES), "mean", "std")


@query(f"WITH {_HALF}, top AS (SELECT * FROM imp WHERE mean > 0 ORDER BY mean DESC, feature LIMIT 12) SELECT feature, round(mean, 6) AS mean, round(mean / max(mean) OVER (), 6) AS normalized FROM top")
def top_importances(spark, sf_dir):
    x, _, labels = _matrix(spark, sf_dir)
    top = inference.top_importances(inference.half_sample_importance(x, labels, REPLICATES))
    return _rounded(top.select("feature", "mean", "normalized"), "mean", "normalized")


@query("""WITH e AS (SELECT vec_id, label, unnest(range(0, len(embedding))) AS j, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
    w AS (SELECT *, (1 + label) / 10.0 AS w FROM e)
    SELECT CAST(j AS INTEGER) AS j, round(sum(w * x) / sum(w), 6) AS mean, round(sum(w * x * x) / sum(w) - power(sum(w * x) / sum(w), 2) + 0.01, 6) AS variance FROM w GROUP BY j""")
def weighted_gaussian_params(spark, sf_dir):
    """Weighted mean and ridged diagonal of the covariance of each coordinate."""
    e = table(spark, sf_dir, "embeddings").select(((1 + F.col("label")) / 10.0).alias("w"), F.posexplode("embedding").alias("j", "e")).withColumn("x", F.col("e").cast("double"))
    mean = F.sum(F.col("w") * F.col("x")) / F.sum("w")
    out = e.groupBy("j").agg(mean.alias("mean"), (F.sum(F.col("w") * F.col("x") * F.col("x")) / F.sum("w") - mean * mean + 0.01).alias("variance"))
    return _rounded(out, "mean", "variance")


@query("""WITH h AS (SELECT (1 + label) / 10.0 AS w, (1 + label) / 10.0 * sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS h FROM embeddings WHERE len(embedding) > 0)
    SELECT round(stddev_pop(h) * avg(h) / sqrt(sum(w * w)), 8) AS objective FROM h""")
def l2_objective(spark, sf_dir):
    w = (1 + F.col("label")) / 10.0
    h = table(spark, sf_dir, "embeddings").where(F.size("embedding") > 0).select(w.alias("w"), (w * scalar.l2_norm("embedding")).alias("h"))
    return _rounded(h.agg((F.stddev_pop("h") * F.avg("h") / F.sqrt(F.sum(F.col("w") * F.col("w")))).alias("objective")), "objective", to=8)


@query("""WITH e AS (SELECT vec_id, label % 2 AS c, unnest(range(0, len(embedding))) AS j, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), m AS (SELECT c, j, avg(x) AS m FROM e GROUP BY ALL),
    d AS (SELECT vec_id, m.c, sum(power(x - m, 2)) AS d FROM e JOIN m USING (j) GROUP BY ALL) SELECT vec_id, CAST(arg_min(c, (round(d, 9), c)) AS INTEGER) AS nearest FROM d GROUP BY vec_id""")
def kmeans_one_step(spark, sf_dir):
    """One Lloyd step from the centres of even and odd labels, ties to cluster 0."""
    e = table(spark, sf_dir, "embeddings").where(F.size("embedding") > 0).select("vec_id", "embedding", *((F.col("label") % 2 == c).cast("double").alias(f"w{c}") for c in (0, 1)))
    centres = [mean for _, mean, _ in gram.moments(e, "embedding", ["w0", "w1"])]
    return lloyd.nearest(e, "embedding", centres, "nearest").select("vec_id", "nearest")


@query("""WITH e AS (SELECT (1 + label) / 10.0 AS w, embedding AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings),
    p AS (SELECT w, i - 1 AS i, CAST(x[i] AS DOUBLE) AS a, unnest(range(i, len(x) + 1)) AS j, x FROM e), q AS (SELECT w, i, j - 1 AS j, a, CAST(x[j] AS DOUBLE) AS b FROM p)
    SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(sum(w * a * b) / sum(w) - sum(w * a) / sum(w) * (sum(w * b) / sum(w)) + CASE WHEN i = j THEN 0.01 ELSE 0 END, 6) + 0.0 AS covariance FROM q GROUP BY i, j""")
def weighted_covariance(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").withColumn("w", (1 + F.col("label")) / 10.0)
    return _rounded(optimize.weighted_moments(df, "embedding", "w"), "covariance")


@query("SELECT 'l_quantity' AS i, 'l_discount' AS j, round(covar_samp(l_quantity, l_discount), 6) AS covariance FROM lineitem UNION ALL SELECT 'l_quantity', 'l_quantity', round(covar_samp(l_quantity, l_quantity), 6) FROM lineitem UNION ALL SELECT 'l_discount', 'l_discount', round(covar_samp(l_discount, l_discount), 6) FROM lineitem")
def sample_covariance(spark, sf_dir):
    return _rounded(optimize.sample_covariance(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"]), "covariance")


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS label FROM embeddings WHERE len(embedding) > 0")
def argmax_label(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where(F.size("embedding") > 0).select("vec_id", scalar.argmax_label("embedding").alias("label"))


@query("""SELECT c_nationkey AS nation, 'expected' AS side FROM (SELECT c_nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier) UNION ALL
    SELECT s_nationkey, 'observed' FROM (SELECT s_nationkey FROM supplier EXCEPT ALL SELECT c_nationkey FROM customer)""")
def set_differences(spark, sf_dir):
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return evaluate.differences(customer.select(F.col("c_nationkey").alias("nation")), supplier.select(F.col("s_nationkey").alias("nation")))


@query("SELECT event_id, CAST(user_id AS BIGINT) AS user_id, value IS NULL AS to_compute FROM (SELECT o.o_orderkey AS event_id, o.o_custkey AS user_id, l.value FROM orders o LEFT JOIN (SELECT l_orderkey, max(l_quantity) AS value FROM lineitem WHERE l_quantity > 45 GROUP BY 1) l ON l.l_orderkey = o.o_orderkey)")
def reused_results(spark, sf_dir):
    known = table(spark, sf_dir, "lineitem").where("l_quantity > 45").groupBy(F.col("l_orderkey").alias("event_id")).agg(F.max("l_quantity").alias("value"))
    tasks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("user_id"))
    return evaluate.reused(tasks, known, ["event_id"], "value").select("event_id", "user_id", "to_compute")


# ---------------------------------------------------------------- single operators


@query("SELECT event_id, round(least(50.0, greatest(10.0, value)), 6) AS clipped FROM events WHERE value IS NOT NULL")
def clipped_values(spark, sf_dir):
    return _rounded(table(spark, sf_dir, "events").where("value is not null").select("event_id", scalar.clip(F.col("value"), 10.0, 50.0).alias("clipped")), "clipped")


@query("SELECT l_orderkey, l_linenumber, round(l_discount, 1) AS fraction FROM lineitem")
def rounded_fractions(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scalar.rounded_fraction(F.col("l_discount")).alias("fraction"))


@query("SELECT ps AS size, CAST(greatest(2, trunc(ps * 0.3)) AS INTEGER) AS chosen FROM (SELECT DISTINCT p_size AS ps FROM part)")
def truncated_products(spark, sf_dir):
    sizes = table(spark, sf_dir, "part").select(F.col("p_size").alias("size")).distinct()
    return sizes.select("size", scalar.truncated_share(F.col("size"), F.lit(0.3), 2).alias("chosen"))


@query("SELECT DISTINCT p, CASE WHEN abs(p - 1) <= 1e-5 + 1e-8 THEN '1' ELSE rtrim(printf('%.2f', p), '0') END AS shown FROM (SELECT l_tax * 12.5 AS p FROM lineitem)")
def probability_labels(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select((F.col("l_tax") * 12.5).alias("p")).distinct()
    return p.select("p", scalar.probability_label("p").alias("shown"))


@query("""SELECT o_orderkey, CAST(attempt AS INTEGER) AS attempt, CAST((CAST(o_orderkey AS HUGEINT) * 1000000007 + CAST(attempt AS HUGEINT) * 11400714819323198485) % 18446744073709551616 AS VARCHAR) AS seed
    FROM orders, range(0, 5) g(attempt)""")
def wrapped_seeds(spark, sf_dir):
    tries = spark.range(5).select(F.col("id").cast("int").alias("attempt"))
    each = evaluate.grid(table(spark, sf_dir, "orders").select("o_orderkey"), tries)
    return each.select("o_orderkey", "attempt", scalar.wrapped_seed(F.col("o_orderkey") * 1000000007, F.col("attempt")).cast("string").alias("seed"))


@query("SELECT DISTINCT 'n-' || p_size || '_l-' || (p_size % 7) || '_f-' || coalesce(CAST(nullif(p_size % 5, 0) AS VARCHAR), 'all') AS key FROM part")
def result_keys(spark, sf_dir):
    size = F.col("p_size")
    part = table(spark, sf_dir, "part").select(size.alias("n"), (size % 7).alias("w"), F.nullif(size % 5, F.lit(0)).alias("f"))
    return part.select(scalar.result_key("n", "w", "f").alias("key")).distinct()


@query(f"SELECT name, 'bernoulli' AS model, loss FROM ({_loss_sql('bernoulli', 'loss')}) AS l, (VALUES ('Binary'), (' BERNOULLI ')) t(name)")
def model_aliases(spark, sf_dir):
    """The loss of one matrix under every name of its model."""
    x, members, _ = _matrix(spark, sf_dir, "bernoulli")
    each = [score.loss(x, members, name).select(F.lit(name).alias("name"), F.lit(scalar.score_model(name)).alias("model"), F.round("loss", 4).alias("loss")) for name in ("Binary", " BERNOULLI ")]
    return each[0].unionByName(each[1])


@query(f"""WITH {_MATRIX} SELECT (SELECT count(DISTINCT feature) FROM x) AS columns, (SELECT count(*) FROM x WHERE value IS NULL OR value < 0) AS bad_values, (SELECT count(*) FROM x WHERE value NOT IN (0, 1)) AS not_binary,
    (SELECT count(*) FROM mem) AS rows, (SELECT count(*) FROM mem WHERE m <= 0 OR m >= 1) AS bad_memberships, TRUE AS sound""")
def matrix_report(spark, sf_dir):
    x, members, _ = _matrix(spark, sf_dir)
    return score.matrix_report(x, members)


@query("SELECT doc_id, quality, CAST(quality = (SELECT quality FROM documents JOIN labels USING (doc_id) GROUP BY quality ORDER BY avg(n_chars), quality LIMIT 1) AS INTEGER) AS oriented FROM labels")
def oriented_labels(spark, sf_dir):
    """1 for rows of the cluster with the lower mean length."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    chosen = evaluate.lower_mean_cluster(labels.join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id"), "quality", "n_chars").first()["quality"]
    return evaluate.oriented(labels, "quality", chosen)


@query("SELECT l_returnflag AS cluster, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1 ORDER BY avg(l_quantity), 1 LIMIT 1")
def lower_mean_cluster(spark, sf_dir):
    return _rounded(evaluate.lower_mean_cluster(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("cluster"), "l_quantity"), "cluster", "l_quantity"), "mean")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) - 1 AS place FROM orders")
def stable_order(spark, sf_dir):
    """Every order's place by priority, then price, ties by key."""
    return order.numbered(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_orderpriority", F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "place")


@query(f"WITH {_occurrences_sql(1, 4)} SELECT feature, cnt, rank FROM ranks")
def all_features_ranked(spark, sf_dir):
    """The feature setting "all": every word with its rank."""
    counts = text.feature_counts(text.occurrences(_conversations(spark, sf_dir), 1, 4))
    return text.ranked(counts, None).select(scalar.display("feature").alias("feature"), "cnt", "rank")


@query("SELECT o_orderkey, index FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS index FROM orders) WHERE index >= 100 AND index < 900 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def tasks_of_a_range(spark, sf_dir):
    tasks = order.numbered(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", name="index")
    done = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return io.still_to_run(tasks, done, ["o_orderkey"], 100, 900)


@query("""SELECT c_custkey AS key, c_acctbal AS value, 'new' AS source FROM customer WHERE c_custkey % 3 = 0 UNION ALL
    SELECT s_suppkey, s_acctbal, 'old' FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)""")
def merged_results(spark, sf_dir):
    old = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("value"), F.lit("old").alias("source"))
    new = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.lit("new").alias("source"), F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))
    return io.merged(old, new, ["key"])


@query("SELECT o_orderkey, o_orderpriority AS method, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS mcc FROM orders WHERE substring(o_orderpriority, 1, 1) IN ('1', '3') AND o_orderpriority IN (SELECT o_orderpriority FROM orders WHERE o_orderkey % 2 = 0 AND o_totalprice IS NOT NULL)")
def methods_with_values(spark, sf_dir):
    """Orders stand for trials and priorities for methods, of which only two have values at all, and these not everywhere."""
    mcc = F.when(F.substring("o_orderpriority", 1, 1).isin("1", "3"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice"))).otherwise(F.lit(float("nan")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("method"), mcc.alias("mcc"))
    return evaluate.without_empty_methods(rows, "method", "mcc")


@query("SELECT 'C' AS book, CAST(conv_id AS INTEGER) AS chapter, CAST(turn AS INTEGER) AS verse, CAST(role = 'user' AS INTEGER) AS label, row_number() OVER (ORDER BY conv_id, turn, role) - 1 AS seq, CAST(len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+')) AS INTEGER) AS n FROM (SELECT * FROM conversations QUALIFY count(*) OVER (PARTITION BY conv_id, turn) = 1)")
def annotated_corpus(spark, sf_dir):
    """An annotation CSV and a token corpus, written, read back and joined by book, chapter and verse."""
    rows = table(spark, sf_dir, "conversations")
    rows = rows.join(rows.groupBy("conv_id", "turn").count().where("count = 1"), ["conv_id", "turn"])
    csv, parquet = io.fresh_path(spark, "annotations"), io.fresh_path(spark, "corpus")
    marked = rows.select(F.lit("C").alias("Book"), F.col("conv_id").alias("Chapter"), F.col("turn").alias("Verse"), (F.col("role") == "user").cast("int").alias("P"), "role")
    io.write_csv(marked.orderBy("Chapter", "Verse", "role").drop("role").coalesce(1), csv)  # an annotation file is one small file, and its order counts
    toks = scalar.tokens("text")
    rows.select(F.lit("C").alias("book"), F.col("conv_id").cast("int").alias("chapter"), F.col("turn").cast("int").alias("verse"), toks.alias("morph"), toks.alias("text")).write.parquet(parquet)
    found = io.annotated_documents(io.annotations(spark, csv, "P"), io.corpus(spark, parquet))
    return found.select("book", "chapter", "verse", "label", "seq", F.size("morph").alias("n"))


@query("SELECT o_orderstatus AS method, count(*) AS trials, round(avg(o_totalprice), 4) AS mcc FROM orders GROUP BY 1")
def appended_results(spark, sf_dir):
    """A result table, appended in two steps and resumed: only what is missing is written the second time."""
    path, schema = io.fresh_path(spark, "results"), "key long, method string, mcc double"
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("method"), F.col("o_totalprice").alias("mcc"))
    io.append(rows.where("key % 2 = 0"), path, schema)
    io.append(io.still_to_run(rows, io.results(spark, path, schema), ["key"]), path, schema)
    return _rounded(io.results(spark, path, schema).groupBy("method").agg(F.count("*").alias("trials"), F.avg("mcc").alias("mcc")), "mcc", to=4)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_round_trip(spark, sf_dir):
    path = io.fresh_path(spark, "nations")
    io.write_json(table(spark, sf_dir, "nation"), path)
    return spark.read.schema("n_nationkey int, n_name string, n_regionkey int").json(path)


@query("SELECT lower(n_name) AS package, '1.' || n_nationkey AS version FROM nation")
def lock_files(spark, sf_dir):
    """A lock file with comments and blank lines, written and read back."""
    path = io.fresh_path(spark, "lock")
    lines = table(spark, sf_dir, "nation").select(F.explode(F.array(F.concat(F.lower("n_name"), F.lit("==1."), F.col("n_nationkey").cast("string")), F.lit("# a comment"), F.lit("  "))).alias("value"))
    lines.write.text(path)
    return io.lock_file(spark, path)


@query("""WITH z AS (SELECT c_custkey, abs((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_samp(c_acctbal) FROM customer)) / sqrt(2) AS x FROM customer WHERE c_acctbal IS NOT NULL)
    SELECT c_custkey, round(1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 80), lambda n: pow(-1, n) * pow(x, 2 * n + 1) / (gamma(n + 1) * (2 * n + 1)))), 8) AS p FROM z""")
def normal_tails(spark, sf_dir):
    """How unusual each balance is: two-sided tails of the normal law, there and back by way of their Z scores."""
    customer = table(spark, sf_dir, "customer").where("c_acctbal is not null").select("c_custkey", "c_acctbal")
    one = customer.agg(F.avg("c_acctbal").alias("mean"), F.stddev_samp("c_acctbal").alias("sd"))
    z = customer.crossJoin(F.broadcast(one)).select("c_custkey", inference.two_sided_p((F.col("c_acctbal") - F.col("mean")) / F.col("sd")).alias("p"))  # one row
    return _rounded(z.select("c_custkey", inference.two_sided_p(inference.z_of_p("p")).alias("p")), "p", to=8)


@query("""WITH h AS (SELECT label, CAST(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS DOUBLE) AS s FROM embeddings WHERE len(embedding) > 0)
    SELECT label, round(stddev_pop(0.5 * sqrt(s)) * avg(0.5 * sqrt(s)) / sqrt(count(*) * 0.25), 8) AS objective FROM h GROUP BY label HAVING count(*) > 1""")
def radius_objectives(spark, sf_dir):
    """The fitting kernel's L2 objective of each label's vectors at equal weights."""
    e = table(spark, sf_dir, "embeddings").where(F.size("embedding") > 0).select("label", "embedding")
    return _rounded(benchmarks.objectives(e, "label", "embedding", kernels.radius_objective).where("n > 1").select("label", "objective"), "objective", to=8)


@query("""WITH h AS (SELECT label, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings WHERE len(embedding) > 0), m AS (SELECT label, avg(x) AS mean, var_pop(x) + 0.01 AS v, count(*) AS n FROM h GROUP BY label),
    s AS (SELECT h.label, n, 0.5 * (ln(2 * pi()) + ln(v) + (x - mean) * (x - mean) / v) AS h FROM h JOIN m USING (label))
    SELECT label, round(stddev_pop(h) * avg(h) / sqrt(any_value(n) * 0.25), 8) AS objective FROM s GROUP BY label HAVING count(*) > 1""")
def gaussian_objectives(spark, sf_dir):
    """The fitting kernel's Gaussian objective of each label's first coordinate at equal weights."""
    e = table(spark, sf_dir, "embeddings").where(F.size("embedding") > 0).select("label", F.slice("embedding", 1, 1).alias("embedding"))
    return _rounded(benchmarks.objectives(e, "label", "embedding", kernels.gaussian_objective).where("n > 1").select("label", "objective"), "objective", to=8)


# ---------------------------------------------------------------- fits and benchmarks: no SQL


@query()
def large_partition(spark, sf_dir):
    """The distributed fit, on the matrix of the score queries."""
    return optimize.large_partition(_matrix(spark, sf_dir)[0], "multinomial")


@query()
def large_kmeans(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").where(F.size("embedding") > 0).select("vec_id", "embedding")
    return lloyd.kmeans(e, "embedding", "vec_id", [0, 1, 2, 3, 4, 5]).select("vec_id", "label")


@query()
def optimized_partitions(spark, sf_dir):
    """The best partition of each conversation's turns by its own word counts."""
    docs = _conversations(spark, sf_dir)
    found = text.occurrences(docs, 1, 2)
    chosen = text.ranked(text.feature_counts(found), 100)
    matrix = text.count_matrix(found, chosen).select("key", "row", F.col("feature_id").alias("feature"), "value")
    return benchmarks.partitions(matrix, "key", "multinomial")


@query()
def categorical_benchmark(spark, sf_dir):
    config = benchmarks.Config(simulations=1)
    trials = benchmarks.categorical_trials(benchmarks.categorical_tasks(spark, config), config)
    return evaluate.summary(trials, ["panel", "dimensions", "p", "p_form", "fraction", "method"], "mcc")


@query()
def gaussian_benchmark(spark, sf_dir):
    config = benchmarks.Config(simulations=1)
    tasks = benchmarks.gaussian_tasks(spark, config)
    return evaluate.summary(benchmarks.gaussian_trials(tasks, config), ["dimension", "coefficient", "samples_per_class", "noise", "method"], "mcc")


def _long_turns(spark, sf_dir):
    """(row, v, one) of each conversation: the mean length of its turns, and whether it has more of them than the mean."""
    turns = table(spark, sf_dir, "conversations").where("conv_id is not null").groupBy(F.col("conv_id").alias("row")).agg(F.avg(F.length("text")).alias("v"), F.count("*").alias("n")).where("v is not null")
    middle = turns.agg(F.avg("n").alias("middle"))
    return turns.crossJoin(F.broadcast(middle)).select("row", "v", (F.col("n") > F.col("middle")).alias("one"))  # one row


def _fmix_sql(x: str) -> str:
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        x = f"((xor({x}, ({x}) >> {shift}) * {factor}) % 4294967296)"
    return x


_PANEL = """WITH c AS (SELECT conv_id AS row, avg(length(text)) AS v, count(*) AS n FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id HAVING avg(length(text)) IS NOT NULL),
    x AS (SELECT row, v, n > (SELECT avg(n) FROM c) AS one FROM c), z AS (SELECT count(*) FILTER (one) AS n1, count(*) FILTER (NOT one) AS n2, avg(v) FILTER (one) AS m1, avg(v) FILTER (NOT one) AS m2, sum(v) AS total FROM x),"""


@query(f"""{_PANEL} r1 AS (SELECT row, v, CAST(row AS UBIGINT) % 4294967296 AS a FROM x), r2 AS (SELECT row, v, {_fmix_sql("a")} AS a FROM r1), r3 AS (SELECT row, v, xor(a, a >> 16) AS a FROM r2),
    g1 AS (SELECT rep, CAST(rep + 1 AS UBIGINT) AS b FROM range(0, 100000) g(rep)), g2 AS (SELECT rep, {_fmix_sql("b")} AS b FROM g1), g3 AS (SELECT rep, xor(b, b >> 16) AS b FROM g2),
    d1 AS (SELECT rep, row, v, xor(a, b) AS h FROM r3 CROSS JOIN g3), d2 AS (SELECT rep, row, v, {_fmix_sql("h")} AS h FROM d1), d3 AS (SELECT rep, row, v, xor(h, h >> 16) AS h FROM d2),
    k AS (SELECT rep, v, row_number() OVER (PARTITION BY rep ORDER BY h) AS k FROM d3), s AS (SELECT rep, sum(v) AS s FROM k, z WHERE k <= n1 GROUP BY rep),
    e AS (SELECT count(*) FILTER (abs(s * (1 / n1 + 1 / n2) - total / n2) >= abs(m1 - m2) - 1e-9) AS exceedances FROM s, z)
    SELECT round(abs(m1 - m2), 6) AS observed, exceedances, 100000 AS permutations, round((exceedances + 1) / 100001, 6) AS p, exceedances = 0 AS is_lower_bound FROM e, z""")
def permutation_significance(spark, sf_dir):
    """Do long conversations have longer turns? The 100,000 permutations of the published panels."""
    return _rounded(inference.permutation_by_hash(_long_turns(spark, sf_dir), "v", "one", 100_000, draw="counter"), "observed", "p")


@query(f"""{_PANEL}
    h AS (SELECT rep, v, row_number() OVER (PARTITION BY rep ORDER BY md5(rep || '-' || row), row) AS k FROM x, range(0, {REPLICATES}) g(rep)),
    s AS (SELECT rep, sum(v) AS s FROM h, z WHERE k <= n1 GROUP BY rep),
    e AS (SELECT count(*) FILTER (abs(s * (1 / n1 + 1 / n2) - total / n2) >= abs(m1 - m2) - 1e-9) AS exceedances FROM s, z)
    SELECT round(abs(m1 - m2), 6) AS observed, exceedances, {REPLICATES} AS permutations, round((exceedances + 1) / ({REPLICATES} + 1), 6) AS p FROM e, z""")
def permutation_by_hash(spark, sf_dir):
    """The same question with subsets that any engine draws by md5."""
    found = inference.permutation_by_hash(_long_turns(spark, sf_dir), "v", "one", REPLICATES)
    return _rounded(found.drop("is_lower_bound"), "observed", "p")


def _mixture(spark, sf_dir, method: str, max_iter: int | None = None):
    """Two clusters of all components of the vectors, from two rows that a hash picks."""
    e = table(spark, sf_dir, "embeddings").where(F.size("embedding") > 0).select("vec_id", "embedding")
    return gram.mixture(e, "embedding", method, gram.two_rows(e, "embedding", "vec_id"), max_iter=max_iter).select("vec_id", "label")


@query()
def large_gmm(spark, sf_dir):
    return _mixture(spark, sf_dir, "gmm")


@query()
def large_regularized_em(spark, sf_dir):
    return _mixture(spark, sf_dir, "regularized", 60)


@query()
def large_cross_entropy_clusters(spark, sf_dir):
    return _mixture(spark, sf_dir, "cec")


@query()
def gaussian_slopes(spark, sf_dir):
    """The Gaussian objective of all components under unequal weights, and its derivative by each of them."""
    e = table(spark, sf_dir, "embeddings").where(F.size("embedding") > 0).select("vec_id", "embedding", ((1 + F.col("label")) / 10.0).alias("w"))
    value, found = gram.gaussian_spread(e, "embedding", "w")
    return found.select("vec_id", F.lit(value).alias("objective"), "slope")


_GRID = (benchmarks.NGRAMS, benchmarks.WINDOWS, max(f for f in benchmarks.FEATURES if f))


def _one_sequence(spark, sf_dir):
    """All conversations, one after the other, with the label of each turn: whether a user has it."""
    turns = table(spark, sf_dir, "conversations").where("role is not null").withColumn("key", F.lit(0))
    return text.sequences(turns, "key", ["conv_id", "turn", "role", "text"], toks=F.transform(scalar.tokens("text"), F.lower), label=(F.col("role") == "user").cast("int"))


def _sweep_sql() -> str:
    gram_of = lambda n: " || ' ' || ".join(["tok", *(f"lead(tok, {k}) OVER l" for k in range(1, n))])
    each = " UNION ALL ".join(f"SELECT {n} AS ngram, n_docs, seq AS ds, lead(seq, {n - 1}) OVER l AS de, row_number() OVER l AS place, {gram_of(n)} AS feature FROM axis WINDOW l AS (ORDER BY seq, pos)" for n in _GRID[0])
    return f"""WITH docs AS (SELECT row_number() OVER (ORDER BY conv_id, turn, role, text) - 1 AS seq, count(*) OVER () AS n_docs, list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+'), lambda t: lower(t)) AS toks FROM conversations WHERE role IS NOT NULL),
    axis AS (SELECT seq, n_docs, pos, toks[pos] AS tok FROM (SELECT *, unnest(range(1, len(toks) + 1)) AS pos FROM docs)), occ AS ({each}),
    wide AS (SELECT ngram, width, feature, place, least(n_docs - 1, ds + width) - greatest(0, de - width + 1) + 1 AS n FROM occ, (SELECT unnest({_GRID[1]}) AS width) WHERE feature IS NOT NULL AND de <= n_docs - 2),
    counts AS (SELECT ngram, width, feature, CAST(sum(n) AS BIGINT) AS cnt, min(place) AS first FROM wide WHERE n > 0 GROUP BY ALL)
    SELECT CAST(ngram AS INTEGER) AS ngram, CAST(width AS INTEGER) AS width, feature, cnt, rank, n_features, total FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY ngram, width ORDER BY cnt DESC, first) AS INTEGER) AS rank, count(*) OVER (PARTITION BY ngram, width) AS n_features, CAST(sum(cnt) OVER (PARTITION BY ngram, width) AS BIGINT) AS total FROM counts) WHERE rank <= {_GRID[2]}"""


@query(_sweep_sql())
def sweep_counts(spark, sf_dir):
    """The features of the whole grid of the published sweep: 5 lengths, 13 widths, the 500 most frequent of each."""
    found = benchmarks.sweep_counts(_one_sequence(spark, sf_dir), *_GRID)
    return found.withColumn("feature", scalar.display("feature"))


@query()
def text_sweep(spark, sf_dir):
    """Part of the sweep's grid over the turns of all conversations as one sequence: user turns against the others."""
    docs = _one_sequence(spark, sf_dir)
    return benchmarks.text_sweep(docs.drop("label"), docs.select(F.col("seq").alias("row"), "label"), [1, 2], [2, 4], [100, 300], model="multinomial")
