"""Registered queries: the library's operators applied to the driver's tables, with SQL that does the same.

Points are made of whole-number keys by arithmetic that both engines share, so that results compare exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewise.functions import codes, geo, present, text
from placewise.operators import aggregates as agg
from placewise.operators import gates, measure, publish, relational, resolution, search, spatial, tiles
from placewise.operators.components import connected_components

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- points: customers and suppliers spread over a box of 2 by 1 degrees ----


def _points(df: DataFrame, key: str, a: int, b: int) -> DataFrame:
    return df.select(F.col(key).alias("id"), (127.0 + ((F.col(key) * a) % 20000) / F.lit(10000.0)).alias("x"), (36.0 + ((F.col(key) * b) % 10000) / F.lit(10000.0)).alias("y"))


def customers(spark: SparkSession, sf: str) -> DataFrame:
    return _points(t(spark, sf, "customer"), "c_custkey", 7919, 104729)


def suppliers(spark: SparkSession, sf: str) -> DataFrame:
    return _points(t(spark, sf, "supplier"), "s_suppkey", 6151, 3571)


C_SQL = "(SELECT c_custkey AS id, 127.0::DOUBLE + ((c_custkey * 7919) % 20000) / 10000.0::DOUBLE AS x, 36.0::DOUBLE + ((c_custkey * 104729) % 10000) / 10000.0::DOUBLE AS y FROM customer)"
S_SQL = "(SELECT s_suppkey AS id, 127.0::DOUBLE + ((s_suppkey * 6151) % 20000) / 10000.0::DOUBLE AS x, 36.0::DOUBLE + ((s_suppkey * 3571) % 10000) / 10000.0::DOUBLE AS y FROM supplier)"


# ---- joins ----


@query("SELECT count(*)::BIGINT AS n, min(c_custkey) AS first_key FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi_exists(spark: SparkSession, sf: str) -> DataFrame:
    found = relational.exists_in(t(spark, sf, "customer"), t(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"])
    return found.agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("first_key"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def anti_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """JN05, over keys of which most miss: every customer has orders, but few share a supplier's key."""
    return relational.missing_in(t(spark, sf, "customer"), t(spark, sf, "supplier").withColumnRenamed("s_suppkey", "c_custkey"), ["c_custkey"]).select("c_custkey", "c_name")


@query("SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda w: suffix(w, 'ing'))[1] AS token FROM documents WHERE len(list_filter(string_split_regex(text, '\\s+'), lambda w: suffix(w, 'ing'))) > 0")
def lateral_token(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "documents").select("doc_id", relational.first_token(F.col("text"), "ing").alias("token")).where("token IS NOT NULL")


@query("SELECT n_nationkey, n_name, r_name FROM nation LEFT JOIN region ON r_regionkey = n_regionkey AND r_name <> 'ASIA'")
def dict_left_join(spark: SparkSession, sf: str) -> DataFrame:
    regions = relational.within(t(spark, sf, "region").where("r_name <> 'ASIA'").withColumnRenamed("r_regionkey", "n_regionkey"))
    return t(spark, sf, "nation").join(regions, "n_regionkey", "left").select("n_nationkey", "n_name", "r_name")


@query("""
WITH a AS (SELECT lpad(r_regionkey::VARCHAR, 2, '0') AS code, r_name AS name FROM region
  UNION ALL SELECT lpad(n_regionkey::VARCHAR, 2, '0') || lpad(n_nationkey::VARCHAR, 3, '0'), n_name FROM nation
  UNION ALL SELECT lpad(n_regionkey::VARCHAR, 2, '0') || lpad(n_nationkey::VARCHAR, 3, '0') || lpad(s_suppkey::VARCHAR, 8, '0'), s_name FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT a.code, a.name, concat_ws(' ', p.name, q.name, a.name) AS full_name FROM a
LEFT JOIN a p ON length(p.code) = 2 AND length(a.code) > 2 AND p.code = left(a.code, 2)
LEFT JOIN a q ON length(q.code) = 5 AND length(a.code) > 5 AND q.code = left(a.code, 5)""")
def prefix_self_join(spark: SparkSession, sf: str) -> DataFrame:
    r, n, s = t(spark, sf, "region"), t(spark, sf, "nation"), t(spark, sf, "supplier")
    two, three = F.lpad(F.col("n_regionkey").cast("string"), 2, "0"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0")
    areas = r.select(F.lpad(F.col("r_regionkey").cast("string"), 2, "0").alias("code"), F.col("r_name").alias("name"))
    areas = areas.unionByName(n.select(F.concat(two, three).alias("code"), F.col("n_name").alias("name")))
    areas = areas.unionByName(s.join(n, s.s_nationkey == n.n_nationkey).select(F.concat(two, three, F.lpad(F.col("s_suppkey").cast("string"), 8, "0")).alias("code"), F.col("s_name").alias("name")))
    return relational.full_names(areas).select("code", "name", "full_name")


@query("SELECT a.n_regionkey AS region, a.n_name AS left_value, b.n_name AS right_value FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name <> b.n_name")
def residual_join(spark: SparkSession, sf: str) -> DataFrame:
    n = t(spark, sf, "nation").withColumnRenamed("n_regionkey", "region")
    return relational.differing_join(n, n, ["region"], "n_name")


@query("SELECT p_partkey, brand_max FROM part JOIN (SELECT p_brand AS b, max_by(p_partkey, (p_size, p_partkey)) AS k, max(p_size) AS brand_max FROM part GROUP BY p_brand) ON k = p_partkey")
def correlated_pick(spark: SparkSession, sf: str) -> DataFrame:
    p = t(spark, sf, "part")
    return relational.keep_first(p, ["p_brand"], [F.col("p_size").desc(), F.col("p_partkey").desc()]).select("p_partkey", F.col("p_size").alias("brand_max"))


@query("SELECT l_returnflag AS flag, count(*)::BIGINT AS both, count(*) FILTER (WHERE l_linestatus = o_orderstatus)::BIGINT AS agreed FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def two_path_agreement(spark: SparkSession, sf: str) -> DataFrame:
    j = t(spark, sf, "lineitem").join(t(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy(F.col("l_returnflag").alias("flag")).agg(F.count(F.lit(1)).alias("both"), F.count_if(F.col("l_linestatus") == F.col("o_orderstatus")).alias("agreed"))


@query("""
SELECT l_orderkey, l_partkey, p_name FROM lineitem JOIN (SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) = 1) USING_P
ON USING_P.p_partkey = l_partkey""")
def composite_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    first = relational.keep_first(t(spark, sf, "part"), ["p_brand", "p_size"], [F.col("p_partkey")]).select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return t(spark, sf, "lineitem").join(first, "l_partkey").select("l_orderkey", "l_partkey", "p_name")


@query("""
SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IS NULL OR (o_orderstatus, o_orderpriority) IN (SELECT 'F', '1-URGENT' UNION ALL SELECT 'O', '5-LOW')""")
def pairwise_in(spark: SparkSession, sf: str) -> DataFrame:
    pairs = spark.createDataFrame([("F", "1-URGENT"), ("O", "5-LOW")], "o_orderstatus string, o_orderpriority string")
    return relational.pair_filter(t(spark, sf, "orders"), pairs, "o_orderstatus", "o_orderpriority").select("o_orderkey", "o_orderpriority")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS urgent FROM customer")
def exists_as_flag(spark: SparkSession, sf: str) -> DataFrame:
    o = t(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").withColumnRenamed("o_custkey", "c_custkey")
    return relational.exists_flag(t(spark, sf, "customer"), o, ["c_custkey"], "urgent").select("c_custkey", "urgent")


# ---- windows ----


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def distinct_on_tiebreak(spark: SparkSession, sf: str) -> DataFrame:
    return relational.keep_first(t(spark, sf, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""
SELECT p_brand, p_size, p_partkey, p_type FROM part
QUALIFY row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_type DESC, p_partkey) = 1 AND count(*) OVER (PARTITION BY p_brand, p_size, p_type) = 1""")
def dual_window_unambiguous(spark: SparkSession, sf: str) -> DataFrame:
    return relational.unambiguous(t(spark, sf, "part"), ["p_brand", "p_size"], "p_type", [F.col("p_type").desc(), F.col("p_partkey")]).select("p_brand", "p_size", "p_partkey", "p_type")


@query("SELECT event_type, count(*)::BIGINT AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS pct FROM events GROUP BY event_type")
def share_of_total(spark: SparkSession, sf: str) -> DataFrame:
    return relational.share_of_total(t(spark, sf, "events"), ["event_type"])


@query("SELECT c_mktsegment, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(c_custkey::VARCHAR), c_custkey) <= 20")
def stratified_md5_sample(spark: SparkSession, sf: str) -> DataFrame:
    return relational.hashed_sample(t(spark, sf, "customer"), "c_mktsegment", "c_custkey", 20).select("c_mktsegment", "c_custkey")


@query("""
SELECT doc_id, (row_number() OVER (PARTITION BY md5(regexp_replace(lower(text), '[\\s.,]', '', 'g')) ORDER BY CASE source WHEN 'src0' THEN 0 WHEN 'src1' THEN 1 ELSE 2 END, doc_id) = 1)::INT AS is_primary
FROM documents""")
def primary_by_priority(spark: SparkSession, sf: str) -> DataFrame:
    order = F.when(F.col("source") == "src0", 0).when(F.col("source") == "src1", 1).otherwise(2)
    key = F.md5(F.regexp_replace(F.lower("text"), r"[\s.,]", "").cast("binary"))
    return relational.with_primary(t(spark, sf, "documents"), [key], [order, F.col("doc_id")]).select("doc_id", "is_primary")


@query("""
WITH s AS (SELECT o_orderpriority, o_orderkey, count(*) OVER (PARTITION BY o_orderpriority) AS n, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS i FROM orders),
g AS (SELECT count(DISTINCT o_orderpriority) AS gs FROM orders),
k AS (SELECT *, least(n, ceil(25.0 / gs)::BIGINT) AS take FROM s, g), u AS (SELECT *, floor((i * take + take - 1)::DOUBLE / n)::BIGINT AS slot FROM k)
SELECT o_orderpriority, o_orderkey FROM u WHERE floor(slot * n::DOUBLE / take)::BIGINT = i AND slot < take ORDER BY slot, o_orderpriority LIMIT 25""")
def round_robin_pick(spark: SparkSession, sf: str) -> DataFrame:
    return relational.round_robin(t(spark, sf, "orders"), "o_orderpriority", [F.col("o_orderkey")], 25).select("o_orderpriority", "o_orderkey")


# ---- aggregates ----


@query("""
SELECT l_returnflag, count(*)::BIGINT AS n, count(*) FILTER (WHERE l_discount > 0.05)::BIGINT AS discounted, count(*) FILTER (WHERE l_quantity > 60)::BIGINT AS huge,
  round(100.0::DOUBLE * count(*) FILTER (WHERE l_discount > 0.05) / nullif(count(*), 0), 2) AS discounted_pct, round(100.0::DOUBLE * count(*) FILTER (WHERE l_linestatus = 'X' AND l_discount > 0.05) / nullif(count(*) FILTER (WHERE l_linestatus = 'X'), 0), 2) AS none_pct
FROM lineitem GROUP BY l_returnflag""")
def conditional_rates(spark: SparkSession, sf: str) -> DataFrame:
    hit = {"discounted": F.col("l_discount") > 0.05, "huge": F.col("l_quantity") > 60, "_x": F.col("l_linestatus") == "X", "_xd": (F.col("l_linestatus") == "X") & (F.col("l_discount") > 0.05)}
    c = agg.conditional_counts(t(spark, sf, "lineitem"), ["l_returnflag"], hit)
    return c.withColumn("discounted_pct", agg.rate(F.col("discounted"), F.col("n"))).withColumn("none_pct", agg.rate(F.col("_xd"), F.col("_x"))).drop("_x", "_xd")


@query("SELECT md5(text) AS text_md5, count(*)::BIGINT AS n FROM documents GROUP BY text HAVING count(*) > 1")
def dup_keys_having(spark: SparkSession, sf: str) -> DataFrame:
    return agg.duplicates(t(spark, sf, "documents").select(F.md5(F.col("text").cast("binary")).alias("text_md5")), ["text_md5"])


@query("SELECT o_custkey, count(DISTINCT o_orderstatus)::BIGINT AS n_values FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 1")
def several_values_having(spark: SparkSession, sf: str) -> DataFrame:
    return agg.multi_valued(t(spark, sf, "orders"), ["o_custkey"], "o_orderstatus")


@query("SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS listed FROM part GROUP BY p_brand")
def ordered_array_agg(spark: SparkSession, sf: str) -> DataFrame:
    return agg.ordered_join(t(spark, sf, "part"), ["p_brand"], "p_type")


@query("""
WITH a AS (SELECT l_returnflag AS k, l_linestatus AS v, count(*) AS n FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2), b AS (SELECT l_returnflag, l_linestatus, count(*) FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1, 2)
SELECT k, v, n::BIGINT AS n, 'left' AS side FROM (FROM a EXCEPT ALL FROM b) UNION ALL SELECT *, 'right' FROM (FROM b EXCEPT ALL FROM a)""")
def crosstab_diff(spark: SparkSession, sf: str) -> DataFrame:
    li = t(spark, sf, "lineitem")
    tab = lambda n: li.where(F.col("l_linenumber") <= n).groupBy(F.col("l_returnflag").alias("k"), F.col("l_linestatus").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return relational.difference(tab(3), tab(4))


@query("SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.95), 4) AS p95 FROM orders GROUP BY 1")
def pct_linear(spark: SparkSession, sf: str) -> DataFrame:
    p = agg.percentiles_linear(t(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice", [0.5, 0.95])
    return p.select("o_orderpriority", F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"))


@query("""
SELECT o_orderpriority, min(o_totalprice) FILTER (WHERE r >= ceil(0.5 * n)) AS p50, min(o_totalprice) FILTER (WHERE r >= ceil(0.95 * n)) AS p95
FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) GROUP BY 1""")
def pct_nearest_rank(spark: SparkSession, sf: str) -> DataFrame:
    return agg.percentiles_nearest(t(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice", [0.5, 0.95])


@query("""
SELECT CASE WHEN n <= 3 THEN n::VARCHAR WHEN n <= 5 THEN '4-5' WHEN n <= 9 THEN '6-9' WHEN n <= 19 THEN '10-19' WHEN n <= 49 THEN '20-49' ELSE '50+' END AS bucket, count(*)::BIGINT AS n_keys, sum(n)::BIGINT AS n_rows
FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1""")
def bucket_hist(spark: SparkSession, sf: str) -> DataFrame:
    return agg.multiplicity(t(spark, sf, "orders"), ["o_custkey"])


@query("""
SELECT count(*)::BIGINT AS n_keys, count(*) FILTER (WHERE n > 1)::BIGINT AS n_shared, max(n)::BIGINT AS max_rows, count(*) FILTER (WHERE s > 1)::BIGINT AS conflicts_o_orderstatus, count(*) FILTER (WHERE p > 1)::BIGINT AS conflicts_o_orderpriority
FROM (SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderstatus) AS s, count(DISTINCT o_orderpriority) AS p FROM orders GROUP BY 1)""")
def key_profile(spark: SparkSession, sf: str) -> DataFrame:
    return agg.key_profile(t(spark, sf, "orders"), "o_custkey", ["o_orderstatus", "o_orderpriority"])


@query("""
SELECT o_custkey, o_orderpriority AS majority, n FROM (SELECT o_custkey, o_orderpriority, count(*)::BIGINT AS n FROM orders GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) = 1""")
def majority_vote(spark: SparkSession, sf: str) -> DataFrame:
    return agg.majority(t(spark, sf, "orders"), ["o_custkey"], "o_orderpriority")


@query("SELECT l_quantity > 25 AS a, l_discount > 0.05 AS b, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2")
def contingency_2x2(spark: SparkSession, sf: str) -> DataFrame:
    return agg.contingency(t(spark, sf, "lineitem"), F.col("l_quantity") > 25, F.col("l_discount") > 0.05)


@query("""
WITH o AS (SELECT o_orderstatus AS s, avg((o_totalprice > 200000)::INT::DOUBLE) AS p, count(*) AS n FROM orders WHERE o_orderkey % 10 = 3 GROUP BY 1), w AS (SELECT o_orderstatus AS s, count(*) AS size FROM orders GROUP BY 1),
j AS (SELECT *, size / sum(size) OVER ()::DOUBLE AS w FROM o JOIN w USING (s))
SELECT round(sum(w * p), 6) AS rate, sum(n)::BIGINT AS n, round(count(*) * sum(w * w), 6) AS deff FROM j""")
def poststrat_rate(spark: SparkSession, sf: str) -> DataFrame:
    o = t(spark, sf, "orders")
    est = agg.poststratified(o.where("o_orderkey % 10 = 3"), o, "o_orderstatus", F.col("o_totalprice") > 200000)
    return est.select(F.round("rate", 6).alias("rate"), "n", F.round("deff", 6).alias("deff"))


@query("""
WITH s AS (SELECT least(n_chars / 4000.0::DOUBLE, 1.0) AS score, quality AS y FROM labels JOIN documents USING (doc_id)), taus AS (SELECT (50 + 2 * i) / 100.0::DOUBLE AS tau FROM range(26) r(i))
SELECT round(tau, 2) AS tau, count(*) FILTER (WHERE score >= tau AND y = 1)::BIGINT AS tp, count(*) FILTER (WHERE score >= tau AND y = 0)::BIGINT AS fp, count(*) FILTER (WHERE score < tau AND y = 1)::BIGINT AS fn,
  round(count(*) FILTER (WHERE score >= tau AND y = 1) / nullif(count(*) FILTER (WHERE score >= tau), 0)::DOUBLE, 6) AS precision, round(count(*) FILTER (WHERE score >= tau AND y = 1) / nullif(count(*) FILTER (WHERE y = 1), 0)::DOUBLE, 6) AS recall
FROM taus, s GROUP BY tau""")
def prf_sweep(spark: SparkSession, sf: str) -> DataFrame:
    s = t(spark, sf, "labels").join(t(spark, sf, "documents"), "doc_id").select(F.least(F.col("n_chars") / F.lit(4000.0), F.lit(1.0)).alias("score"), F.col("quality").alias("y"))
    sweep = agg.threshold_sweep(s, "score", "y", [(50 + 2 * i) / 100 for i in range(26)])
    return sweep.select(F.round("tau", 2).alias("tau"), "tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("SELECT least(floor(l_discount * 100)::INT, 9) AS decile, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")
def decile_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return agg.decile_histogram(t(spark, sf, "lineitem").select((F.col("l_discount") * 100 / 10).alias("v")), "v")


@query(f"SELECT round(x, 1) AS lon, round(y, 1) AS lat, count(*)::BIGINT AS n FROM {C_SQL} GROUP BY 1, 2 ORDER BY n DESC, lon, lat LIMIT 8")
def density_top(spark: SparkSession, sf: str) -> DataFrame:
    return agg.density(customers(spark, sf).select(F.col("x").alias("lon"), F.col("y").alias("lat")), 1, 8)


@query("SELECT l_suppkey, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1 ORDER BY sum(l_quantity) DESC, 1 LIMIT 3")
def top_by_sum(spark: SparkSession, sf: str) -> DataFrame:
    return agg.top_by_sum(t(spark, sf, "lineitem"), "l_suppkey", "l_quantity", 3).select("l_suppkey", F.round("total", 2).alias("total"))


@query("""
SELECT c_custkey, bool_or(o_totalprice > 300000) AS "any" FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def three_valued_any(spark: SparkSession, sf: str) -> DataFrame:
    return agg.any_true(t(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey"), t(spark, sf, "customer").select("c_custkey"), ["c_custkey"], F.col("o_totalprice") > 300000)


# ---- text ----

_NORM = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query(f"""
SELECT doc_id, md5({_NORM}) AS squeezed, md5(regexp_replace(text, '[.\\s]', '', 'g')) AS compacted,
  md5(lower(regexp_replace(text, '[\\s()\\[\\]{{}}<>（）【】·.,/&\\-]+', '', 'g'))) AS keyed FROM documents""")
def text_norm_rules(spark: SparkSession, sf: str) -> DataFrame:
    whole = F.col("text")
    forms = {"squeezed": text.squeeze(whole), "compacted": text.compact(whole), "keyed": text.business_key(whole)}
    return t(spark, sf, "documents").select("doc_id", *(F.md5(form.cast("binary")).alias(name) for name, form in forms.items()))


@query("""
WITH g AS (SELECT p_partkey, p_brand, p_size, list_distinct(list_transform(range(1, length(p_name) + 2), lambda i: substr('  ' || p_name || ' ', i::BIGINT, 3))) AS t FROM part)
SELECT a.p_partkey AS a, b.p_partkey AS b, round(2.0::DOUBLE * len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t)), 6) AS sim FROM g a JOIN g b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey""")
def trigram_dice(spark: SparkSession, sf: str) -> DataFrame:
    p = t(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_size", F.coalesce("p_name", F.lit("")).alias("name"))
    names = p.select("p_brand", "p_size", "name").distinct().withColumn("t", text.trigrams(F.col("name")))
    other = names.select(F.col("p_brand").alias("brand2"), F.col("p_size").alias("size2"), F.col("name").alias("name2"), F.col("t").alias("t2"))
    # likeness of distinct names; parts of one name are paired after that
    pairs = names.join(other, (F.col("p_brand") == F.col("brand2")) & (F.col("p_size") == F.col("size2")) & (F.col("name") <= F.col("name2")))
    pairs = pairs.select("p_brand", "p_size", "name", "brand2", "size2", "name2", F.round(text.dice(F.col("t"), F.col("t2")), 6).alias("sim"))
    met = relational.member_pairs(pairs, p, ["p_brand", "p_size", "name"], ["brand2", "size2", "name2"])
    return met.select(F.col("id").alias("a"), F.col("id2").alias("b"), "sim")


@query("""
WITH terms AS (SELECT unnest(['green', 'ste', 'old', 'lin', 'ar', 'b']) AS term)
SELECT term, count(*)::BIGINT AS n, min(p_partkey) AS first_key FROM terms JOIN part ON CASE WHEN length(term) >= 3 THEN contains(lower(p_name), term) ELSE starts_with(p_name, term) END GROUP BY 1""")
def infix_prefix_search(spark: SparkSession, sf: str) -> DataFrame:
    terms = spark.createDataFrame([(w, w) for w in ("green", "ste", "old", "lin", "ar", "b")], "tid string, term string")
    parts = t(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_name")
    found = search.infix(terms.where(F.length("term") >= 3), parts, ["p_name"]).unionByName(search.prefixes(terms.where(F.length("term") < 3), parts, ["p_name"]))
    return found.groupBy(F.col("tid").alias("term")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_key"))


@query("""
SELECT s_suppkey, nullif(regexp_replace(s_name, '\\D', '', 'g'), '') AS digits, lower(regexp_replace(s_name, '[^\\pL\\pN]', '', 'g')) AS dup_key, substr(sha256(s_name), 1, 12) AS hashed FROM supplier""")
def keys_and_hashes(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("s_name")
    return t(spark, sf, "supplier").select("s_suppkey", F.nullif(text.phone_digits(n), F.lit("")).alias("digits"), text.duplicate_key(n).alias("dup_key"), text.query_hash(n).alias("hashed"))


_LOT = "CASE WHEN c_custkey % 5 = 0 THEN '산' ELSE '' END || (c_custkey % 900 + 1)::VARCHAR || CASE WHEN c_custkey % 3 = 0 THEN '-' || (c_custkey % 70)::VARCHAR ELSE '' END || CASE c_custkey % 4 WHEN 0 THEN '번지' WHEN 1 THEN '대' ELSE '' END"


@query(f"""
SELECT c_custkey, starts_with(s, '산') AS san, regexp_extract(s, '(\\d+)', 1)::BIGINT AS main, coalesce(nullif(regexp_extract(s, '-(\\d+)', 1), ''), '0')::BIGINT AS sub, regexp_matches(s, '대$') AS land_category, regexp_matches(s, '번지$') AS bunji
FROM (SELECT c_custkey, {_LOT} AS s FROM customer)""")
def lot_number_parse(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "customer").select("c_custkey", F.expr(_LOT.replace("::VARCHAR", "").replace("|| (", "|| string(").replace("THEN '-' || string(c_custkey % 70)", "THEN '-' || string(c_custkey % 70)")).alias("s")).select("c_custkey", text.parse_lot(F.col("s")).alias("p")).select("c_custkey", "p.*")


@query("""
SELECT event_id, CASE WHEN json_valid(props) AND json_extract_string(props, '$.k') IS NOT NULL THEN TRY_CAST(json_extract_string(props, '$.k') AS INT) END AS k, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INT) > 50, NULL) AS high FROM events""")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("int")
    return t(spark, sf, "events").select("event_id", k.alias("k"), (k > 50).alias("high"))


# ---- codes ----


@query("""
SELECT c_custkey, CASE WHEN left(code, 2) = '28' THEN coalesce(CASE WHEN c_custkey % 2 = 0 THEN '281' || substr(code, 4) END, code)
  WHEN left(code, 2) IN ('46', '29') THEN CASE WHEN c_custkey % 7 = 0 THEN '9999999999' WHEN c_custkey % 2 = 0 THEN '12' || substr(code, 3) ELSE code END ELSE code END AS remapped
FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '28' WHEN 1 THEN '46' WHEN 2 THEN '29' ELSE '11' END || lpad(c_custkey::VARCHAR, 8, '0') AS code FROM customer)""")
def code_remap(spark: SparkSession, sf: str) -> DataFrame:
    c = t(spark, sf, "customer")
    k = F.col("c_custkey")
    space = F.when(k % 4 == 0, "28").when(k % 4 == 1, "46").when(k % 4 == 2, "29").otherwise("11")
    coded = c.select("c_custkey", F.concat(space, F.lpad(k.cast("string"), 8, "0")).alias("code"))
    # an eight-digit prefix stands for a hundred keys here; those in 28 and 29 are even, those in 46 odd
    even = coded.where("c_custkey % 2 = 0")
    ren = even.where(F.substring("code", 1, 2) == "28").select(F.substring("code", 1, 8).alias("old8"), F.concat(F.lit("281"), F.substring("code", 4, 5)).alias("new8"))
    mer = even.where(F.substring("code", 1, 2).isin("46", "29")).select(F.substring("code", 1, 8).alias("old8"), F.concat(F.lit("12"), F.substring("code", 3, 6)).alias("new8"))
    exc = coded.where("c_custkey % 7 = 0").where(F.substring("code", 1, 2).isin("46", "29")).select(F.col("code").alias("old10"), F.lit("9999999999").alias("new10"))
    return codes.remap_codes(coded, "code", "remapped", ren, mer, exc).select("c_custkey", "remapped")


@query("""
SELECT c_custkey, bcode || CASE WHEN c_custkey % 5 = 0 THEN '2' ELSE '1' END || lpad((c_custkey % 9999)::VARCHAR, 4, '0') || lpad((c_custkey % 37)::VARCHAR, 4, '0') AS pnu, (c_custkey % 9999)::INT AS main, (c_custkey % 37)::INT AS sub
FROM (SELECT c_custkey, '11' || lpad(c_custkey::VARCHAR, 8, '0') AS bcode FROM customer)""")
def parcel_codes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    pnu = codes.compose_pnu(F.concat(F.lit("11"), F.lpad(k.cast("string"), 8, "0")), k % 5 == 0, k % 9999, k % 37)
    return t(spark, sf, "customer").select("c_custkey", pnu.alias("pnu")).withColumn("s", codes.split_pnu(F.col("pnu"))).select("c_custkey", "pnu", "s.main", "s.sub")


@query("SELECT p_partkey, CASE p_type WHEN 'A' THEN 1 ELSE CASE WHEN p_brand = 'Brand#11' THEN 12 ELSE 16 END END AS tier, trim(coalesce(p_name, '') || ' ' || coalesce(NULL, '') || ' ' || coalesce(p_brand, '')) AS search_text FROM part")
def derived_columns(spark: SparkSession, sf: str) -> DataFrame:
    tier = present.tier(F.col("p_brand"), F.col("p_type"), {"A": 1}, {"Brand#11": 12}, 16)
    return t(spark, sf, "part").select("p_partkey", tier.alias("tier"), present.search_text(F.col("p_name"), F.lit(None), F.col("p_brand")).alias("search_text"))


# ---- space ----


@query(f"""
SELECT q.id AS qid, s.id AS id, round(hypot2, 9) AS distance, rank FROM (SELECT q.id AS qid, s.id AS sid, sqrt((s.x - q.x) ** 2 + (s.y - q.y) ** 2) AS hypot2, row_number() OVER (PARTITION BY q.id ORDER BY sqrt((s.x - q.x) ** 2 + (s.y - q.y) ** 2), s.id)::INT AS rank FROM {S_SQL} q, {C_SQL} s)
JOIN {S_SQL} q ON q.id = qid JOIN {C_SQL} s ON s.id = sid WHERE rank <= 3""")
def knn_topk(spark: SparkSession, sf: str) -> DataFrame:
    q = suppliers(spark, sf).withColumnRenamed("id", "qid")
    c = customers(spark, sf).select(F.col("id").alias("tid"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return spatial.knn(q, c, 3, 0.05).select("qid", F.col("tid").alias("id"), F.round("distance", 9).alias("distance"), "rank")


@query(f"""
SELECT qid, id, rank FROM (SELECT q.id AS qid, s.id AS id, d, row_number() OVER (PARTITION BY q.id ORDER BY d, s.id)::INT AS rank FROM (SELECT q.id AS qid, s.id AS sid, 2 * 6371000.0 * asin(least(1.0, sqrt(power(sin(radians(s.y - q.y) / 2), 2) + cos(radians(q.y)) * cos(radians(s.y)) * power(sin(radians(s.x - q.x) / 2), 2)))) AS d FROM {S_SQL} q, {C_SQL} s)
JOIN {S_SQL} q ON q.id = qid JOIN {C_SQL} s ON s.id = sid WHERE d <= 2500) WHERE rank <= 8""")
def knn_radius(spark: SparkSession, sf: str) -> DataFrame:
    q = suppliers(spark, sf).withColumnRenamed("id", "qid")
    c = customers(spark, sf).select(F.col("id").alias("tid"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return spatial.knn_within(q, c, 8, 2500.0, spatial.sphere(), 2500.0 / 86000).select("qid", F.col("tid").alias("id"), "rank")


def _areas(spark: SparkSession) -> DataFrame:
    hexagon = [(127.2, 36.1), (127.6, 36.1), (127.8, 36.45), (127.6, 36.8), (127.2, 36.8), (127.05, 36.45)]
    triangle, box, hole = [(128.0, 36.0), (129.0, 36.0), (128.5, 37.0)], [(127.5, 36.2), (128.4, 36.2), (128.4, 36.7), (127.5, 36.7)], [(127.9, 36.4), (128.1, 36.4), (128.1, 36.5), (127.9, 36.5)]
    ring = lambda pts: [{"x": x, "y": y} for x, y in pts]
    return spark.createDataFrame([("sido", "A", [ring(hexagon)]), ("sido", "B", [ring(triangle)]), ("emd", "C", [ring(box), ring(hole)])], "level string, code string, rings array<array<struct<x:double,y:double>>>")


_EDGES = """(VALUES ('A',0,127.2,36.1,127.6,36.1),('A',0,127.6,36.1,127.8,36.45),('A',0,127.8,36.45,127.6,36.8),('A',0,127.6,36.8,127.2,36.8),('A',0,127.2,36.8,127.05,36.45),('A',0,127.05,36.45,127.2,36.1),
('B',0,128.0,36.0,129.0,36.0),('B',0,129.0,36.0,128.5,37.0),('B',0,128.5,37.0,128.0,36.0),('C',0,127.5,36.2,128.4,36.2),('C',0,128.4,36.2,128.4,36.7),('C',0,128.4,36.7,127.5,36.7),('C',0,127.5,36.7,127.5,36.2),
('C',1,127.9,36.4,128.1,36.4),('C',1,128.1,36.4,128.1,36.5),('C',1,128.1,36.5,127.9,36.5),('C',1,127.9,36.5,127.9,36.4)) e(code, ring, x1, y1, x2, y2)"""


@query(f"""
SELECT id, code FROM (SELECT id, code, count(*) FILTER (WHERE (y1 > y) <> (y2 > y) AND x < (x2 - x1)::DOUBLE * (y - y1) / (y2 - y1 + 1e-300) + x1) AS crossings FROM {C_SQL} p, {_EDGES} GROUP BY 1, 2) WHERE crossings % 2 = 1""")
def pip_areas(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.pip_join(customers(spark, sf), _areas(spark), 0.1).select("id", "code")


@query(f"SELECT a.id AS id, b.id AS id2, round(sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2), 9) AS distance FROM {C_SQL} a JOIN {C_SQL} b ON a.id < b.id AND sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) <= 0.03")
def grid_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.pair_join(customers(spark, sf), 0.03, digits=9)


@query(f"""
SELECT z, floor((x + 180) / 360 * power(2.0, z))::INT AS x, floor((1 - ln(tan(radians(y)) + 1 / cos(radians(y))) / pi()) / 2 * power(2.0, z))::INT AS y, count(*)::BIGINT AS n FROM {C_SQL}, (SELECT unnest([8, 12]) AS z) GROUP BY 1, 2, 3""")
def tile_bucket(spark: SparkSession, sf: str) -> DataFrame:
    p = customers(spark, sf).select(F.col("x").alias("lon"), F.col("y").alias("lat"))
    return tiles.bucketed(p, [8, 12]).groupBy("z", "x", "y").agg(F.count(F.lit(1)).alias("n"))


_TM = """(SELECT c_custkey, 900000.0::DOUBLE + (c_custkey * 7919) % 200000 AS e, 1800000.0::DOUBLE + (c_custkey * 104729) % 400000 AS n FROM customer)"""


@query(f"""
WITH k AS (SELECT 1 / 298.257222101::DOUBLE AS f), c AS (SELECT f * (2 - f) AS e2, f FROM k), c2 AS (SELECT *, e2 / (1 - e2) AS ep, (1 - sqrt(1 - e2)) / (1 + sqrt(1 - e2)) AS e1, radians(38.0::DOUBLE) AS l0 FROM c),
c3 AS (SELECT *, 1 - e2/4 - 3*e2**2/64 - 5*e2**3/256 AS k0, 3*e2/8 + 3*e2**2/32 + 45*e2**3/1024 AS k1, 15*e2**2/256 + 45*e2**3/1024 AS k2, 35*e2**3/3072 AS k3 FROM c2),
m AS (SELECT c_custkey, e, c3.*, (6378137.0::DOUBLE * (k0*l0 - k1*sin(2*l0) + k2*sin(4*l0) - k3*sin(6*l0)) + (n - 2000000.0) / 0.9996::DOUBLE) / (6378137.0::DOUBLE * k0) AS mu FROM {_TM}, c3),
p AS (SELECT *, mu + (3*e1/2 - 27*e1**3/32)*sin(2*mu) + (21*e1**2/16 - 55*e1**4/32)*sin(4*mu) + (151*e1**3/96)*sin(6*mu) + (1097*e1**4/512)*sin(8*mu) AS phi FROM m),
q AS (SELECT *, tan(phi)**2 AS t, ep*cos(phi)**2 AS c1, 1 - e2*sin(phi)**2 AS w FROM p), r AS (SELECT *, 6378137.0::DOUBLE / sqrt(w) AS n1, 6378137.0::DOUBLE*(1-e2)/w**1.5 AS r1 FROM q),
d AS (SELECT *, (e - 1000000.0) / (n1 * 0.9996::DOUBLE) AS d FROM r)
SELECT c_custkey, round(degrees(radians(127.5::DOUBLE) + (d - (1+2*t+c1)*d**3/6 + (5-2*c1+28*t-3*c1*c1+8*ep+24*t*t)*d**5/120)/cos(phi)), 6) AS lon,
  round(degrees(phi - (n1*tan(phi)/r1)*(d*d/2 - (5+3*t+10*c1-4*c1*c1-9*ep)*d**4/24 + (61+90*t+298*c1+45*t*t-252*ep-3*c1*c1)*d**6/720)), 6) AS lat FROM d""")
def tm_inverse(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    p = geo.tm_inverse(900000.0 + (k * 7919) % 200000, 1800000.0 + (k * 104729) % 400000)
    return t(spark, sf, "customer").select("c_custkey", p.alias("p")).select("c_custkey", "p.lon", "p.lat")


@query(f"SELECT id FROM {C_SQL} WHERE x BETWEEN 127.5 AND 128.0 AND y BETWEEN 36.25 AND 36.5")
def box_filter(spark: SparkSession, sf: str) -> DataFrame:
    return customers(spark, sf).where(F.col("x").between(127.5, 128.0) & F.col("y").between(36.25, 36.5)).select("id")


# ---- resolution, search, classes ----


@query(f"""
WITH RECURSIVE e AS (SELECT a.id AS a, b.id AS b FROM {C_SQL} a JOIN {C_SQL} b ON a.id <> b.id AND sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) <= 0.03), r AS (SELECT a AS node, a AS reach FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach)
SELECT node, min(reach) AS component FROM r GROUP BY node""")
def er_components(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.near_components(customers(spark, sf), 0.03)


#: Shops, five to a place and places 0.002 degrees apart, so that pairs grow with the table and not its square; in SQL for both engines.
_SHOPS = """SELECT s_suppkey AS id, '상점' || CAST(CAST(floor(s_suppkey / 2) AS INT) % 40 AS STRING) || CASE s_suppkey % 6 WHEN 0 THEN ' 신촌점' WHEN 1 THEN ' 명동점' ELSE '' END AS name,
  CASE WHEN s_suppkey % 7 > 0 THEN '02-555-' || CAST(1000 + CAST(floor(s_suppkey / 3) AS INT) % 60 AS STRING) END AS phone,
  127 + CAST(floor(s_suppkey / 5) AS INT) % 1000 * CAST(0.002 AS DOUBLE) + s_suppkey % 5 * CAST(0.0002 AS DOUBLE) + CAST(0.00003 AS DOUBLE) AS lon,
  37 + CAST(floor(s_suppkey / 5000) AS INT) * CAST(0.002 AS DOUBLE) + s_suppkey % 3 * CAST(0.0003 AS DOUBLE) + CAST(0.00003 AS DOUBLE) AS lat, CAST(NULL AS STRING) AS bld, 'x' AS source FROM supplier"""


@query(f"""
WITH s AS ({_SHOPS}),
f AS (SELECT id, lon, lat, replace(phone, '-', '') AS digits, CASE WHEN name LIKE '% %' THEN split_part(name, ' ', 2) END AS branch, split_part(name, ' ', 1) AS core, '  ' || split_part(name, ' ', 1) || ' ' AS padded,
  CASE WHEN phone IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY phone) END AS share, floor(lon / 0.0001::DOUBLE) AS bx, floor(lat / 0.0001::DOUBLE) AS b_y, floor(lon / 0.0006::DOUBLE) AS cx, floor(lat / 0.0006::DOUBLE) AS cy FROM s),
g AS (SELECT f.*, list_distinct(list_transform(range(1, length(padded) - 1), lambda i: substr(padded, i, 3))) AS tris, (SELECT count(*) FROM f o WHERE abs(o.bx - f.bx) <= 1 AND abs(o.b_y - f.b_y) <= 1) AS crowd FROM f),
p AS (SELECT a.id AS a, b.id AS b, least(length(a.core), length(b.core)) <= 3 AS short, 2.0::DOUBLE * len(list_intersect(a.tris, b.tris)) / (len(a.tris) + len(b.tris)) AS sim,
  coalesce(a.branch <> b.branch, false) AS branches, a.digits = b.digits AS same, greatest(a.share, b.share) AS share, greatest(a.crowd, b.crowd) AS crowd,
  2 * 6371000.0::DOUBLE * asin(sqrt(sin(radians(b.lat - a.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) ** 2)) AS d
  FROM g a JOIN g b ON a.id < b.id AND abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1),
w AS (SELECT *, CASE WHEN sim >= CASE WHEN short THEN 0.8 ELSE 0.6 END THEN 9.45 WHEN sim >= 0.3 AND NOT short THEN 2 ELSE -1.32 END::DOUBLE AS nw,
  CASE WHEN same IS NULL THEN 0 WHEN NOT same THEN -1 WHEN share >= 10 THEN 0 WHEN share >= 3 THEN 9.97 / 2 ELSE 9.97 END::DOUBLE AS pw,
  (CASE WHEN d <= 20 THEN 5.3 WHEN d <= 60 THEN 3.6 WHEN d <= 150 THEN 0 ELSE -3.32 END)::DOUBLE * least(1, 2.0::DOUBLE / crowd) AS lw FROM p),
o AS (SELECT *, CASE WHEN branches THEN 0 ELSE 1 - 1 / (1 + 2.0::DOUBLE ** (log2(0.1::DOUBLE / 0.9::DOUBLE) + nw + pw + lw)) END AS pr FROM w)
SELECT a, b, round(pr, 6) AS pr, CASE WHEN branches THEN 'NO' WHEN pr >= 0.9 AND (nw >= 9.45 OR pw >= 9.97) AND NOT (pw >= 9.97 AND sim < 0.3 AND lw <= 0) THEN 'AUTO' WHEN pr >= 0.5 THEN 'REVIEW' ELSE 'NO' END AS decision FROM o""")
def er_scored_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """JN17, AGG26, ER01, ER02."""
    places = spark.sql(_SHOPS.replace("FROM supplier", "FROM {s}"), s=t(spark, sf, "supplier"))
    return resolution.score(resolution.candidates(resolution.features(places))).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.round("pr", 6).alias("pr"), "decision")


@query("""
WITH q AS (SELECT p_partkey AS qid, CASE WHEN p_partkey % 3 = 0 THEN 'none' ELSE p_brand END AS brand, p_type AS type, (p_size + CASE WHEN p_partkey % 2 = 0 THEN 100 ELSE 0 END) AS size FROM part WHERE p_partkey % 50 = 0),
c AS (SELECT qid, p.p_partkey, CASE WHEN p.p_type = type AND p.p_size = size THEN 1 WHEN p.p_type = type THEN 2 ELSE 3 END AS tier FROM q JOIN part p ON p.p_brand = q.brand)
SELECT qid, p_partkey AS id, CASE tier WHEN 1 THEN 200 WHEN 2 THEN 150 ELSE 110 END AS score FROM (SELECT *, min(tier) OVER (PARTITION BY qid) AS best FROM c) WHERE tier = best QUALIFY row_number() OVER (PARTITION BY qid ORDER BY p_partkey) <= 8""")
def tiered_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The road tiers on parts: brand, type and size; then brand and type; then the brand."""
    p = t(spark, sf, "part")
    q = p.where("p_partkey % 50 = 0").select(
        F.col("p_partkey").alias("qid"), F.when(F.col("p_partkey") % 3 == 0, "none").otherwise(F.col("p_brand")).alias("brand"), F.col("p_type").alias("type"),
        (F.col("p_size") + F.when(F.col("p_partkey") % 2 == 0, 100).otherwise(0)).alias("size"),
    )
    j = q.join(p, F.col("brand") == F.col("p_brand"))
    level = F.when((F.col("p_type") == F.col("type")) & (F.col("p_size") == F.col("size")), 1).when(F.col("p_type") == F.col("type"), 2).otherwise(3)
    best = search.first_group(j.withColumn("grp", level))
    score = F.when(F.col("grp") == 1, search.ROAD_EXACT).when(F.col("grp") == 2, search.ROAD_MAIN).otherwise(search.ROAD_ONLY)
    return relational.keep_first_n(best, ["qid"], [F.col("p_partkey")], 8).select("qid", F.col("p_partkey").alias("id"), score.alias("score"))


@query("""
WITH c AS (SELECT o_custkey AS qid, o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'addr' ELSE 'poi' END AS kind, (100 + o_orderkey % 97)::INT AS score, o_custkey % 2 = 0 AS intent FROM orders),
f AS (SELECT *, min(score) FILTER (WHERE kind = 'addr') OVER (PARTITION BY qid) AS floor_ FROM c)
SELECT qid, id, CASE WHEN intent AND kind <> 'addr' AND floor_ IS NOT NULL THEN least(score, floor_ - 1) ELSE score END AS score, CASE WHEN intent AND kind <> 'addr' AND floor_ IS NOT NULL THEN 'nonaddr' END AS fallback FROM f WHERE NOT intent OR floor_ IS NOT NULL""")
def intent_gate(spark: SparkSession, sf: str) -> DataFrame:
    c = t(spark, sf, "orders").select(
        F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "addr").otherwise("poi").alias("kind"),
        (100 + F.col("o_orderkey") % 97).cast("int").alias("score"), (F.col("o_custkey") % 2 == 0).alias("intent"),
    )
    return search.intent_gate(c).select("qid", "id", "score", "fallback")


@query()
def near_dup_collapse(spark: SparkSession, sf: str) -> DataFrame:
    c = customers(spark, sf)
    ranked = c.select((F.col("id") % 20).alias("qid"), F.col("id").alias("rank"), F.concat(F.lit("spot "), (F.col("id") % 5).cast("string")).alias("name"), (127.0 + (F.col("id") % 50) / 100000.0).alias("lon"), F.lit(36.5).alias("lat"))
    return spatial.collapse(ranked, 10)


# The SQL follows the rules as SURVEY's CLS1 names them: groups of silence, tolerance and referee, each class by its own condition.
@query("""
WITH seen AS (
  SELECT o_orderkey AS k, o_orderkey % 101 = 0 AS e1, o_orderkey % 103 = 0 AS e2, o_orderkey % 4 AS addresses, o_orderkey % 3 AS others,
    ['A', 'A25', 'A19', 'P', 'N'][1 + (o_orderkey % 5)::INT] AS oracle, o_orderkey % 2 = 0 AS apx, o_orderpriority AS priority,
    CASE WHEN o_orderkey % 9 <> 0 THEN (o_orderkey % 300)::DOUBLE END AS d1, (o_orderkey % 150)::DOUBLE AS d5, CASE WHEN o_orderstatus = 'F' THEN 100.0 ELSE 40.0 END AS tol,
    CASE WHEN o_orderkey % 6 <> 0 THEN o_orderkey % 7 < 3 END AS v, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 13 < 5 END AS m FROM orders),
grouped AS (
  SELECT *, addresses = 0 AS silent, coalesce(d1 <= tol, FALSE) AS near1, d5 <= tol AS near5, priority = '1-URGENT' AS lots FROM seen),
labelled AS (
  SELECT *, CASE
    WHEN silent AND oracle IN ('A', 'A25', 'A19') THEN '1' WHEN silent AND oracle = 'P' THEN '2'
    WHEN silent AND oracle = 'N' AND apx AND lots THEN '3' WHEN silent AND oracle = 'N' AND NOT (apx AND lots) THEN '4'
    WHEN NOT silent AND near1 THEN '5' WHEN NOT silent AND NOT near1 AND near5 THEN '6'
    WHEN v IS NULL OR m IS NULL THEN '11' WHEN NOT v AND m THEN '7' WHEN v AND NOT m THEN '8' WHEN v AND m THEN '9' ELSE '10' END AS c FROM grouped)
SELECT CASE WHEN e1 THEN 'E1' WHEN e2 THEN 'E2' ELSE c END AS class, count(*)::BIGINT AS n,
  count(*) FILTER (WHERE silent AND others > 0)::BIGINT AS f2, count(*) FILTER (WHERE near5 AND k % 3 = 0)::BIGINT AS f3,
  count(*) FILTER (WHERE (k % 8 = 0) <> (k % 12 = 0))::BIGINT AS f4, count(*) FILTER (WHERE NOT silent AND oracle = 'P' AND k % 2 = 1)::BIGINT AS f8
FROM labelled GROUP BY 1""")
def excl_classes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = t(spark, sf, "orders").select(
        (k % 101 == 0).alias("e1"), (k % 103 == 0).alias("e2"), (k % 4).alias("addresses"), (k % 3).alias("other_kinds"),
        F.get(F.array(*map(F.lit, ("A", "A25", "A19", "P", "N"))), (k % 5).cast("int")).alias("oracle"),
        (k % 2 == 0).alias("o_apx"), F.when(F.col("o_orderpriority") == "1-URGENT", measure.LOTS).otherwise("road").alias("layer"),
        F.when(k % 9 != 0, (k % 300).cast("double")).alias("d_top1"), (k % 150).cast("double").alias("d_min5"), F.when(F.col("o_orderstatus") == "F", 100.0).otherwise(40.0).alias("tolerance"),
        F.when(k % 6 != 0, k % 7 < 3).alias("r_v"), F.when(k % 11 != 0, k % 13 < 5).alias("r_m"), (k % 3 != 0).alias("top1_nearest"),
        (k % 8 == 0).alias("san_query"), (k % 12 == 0).alias("san_ours"), F.when(k % 2 == 1, "parcel").otherwise("addr").alias("source"),
    )
    has = lambda f: F.count_if(F.array_contains("flags", f))
    return measure.classify(o).groupBy("class").agg(F.count(F.lit(1)).alias("n"), *(has(f).alias(f.lower()) for f in ("F2", "F3", "F4", "F8")))


@query("""
WITH new AS (SELECT o_custkey AS k, min_by(o_orderpriority, o_orderkey) AS v FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1)
SELECT count(*)::BIGINT AS n, count(*) FILTER (WHERE v IS NOT NULL)::BIGINT AS from_staged FROM (SELECT c_custkey AS k, NULL AS v FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT k, v FROM new WHERE k NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0))""")
def upsert_ignore(spark: SparkSession, sf: str) -> DataFrame:
    table = t(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.lit(None).cast("string").alias("v"))
    staged = t(spark, sf, "orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("v"), F.col("o_orderkey").alias("o"))
    merged, _ = publish.insert_ignore(table, staged, ["k"], [F.col("o")])
    return merged.agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("from_staged"))


@query("""
SELECT c_custkey, coalesce(p, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderpriority) AS p FROM orders WHERE o_orderkey % 5 = 0 GROUP BY 1) ON o_custkey = c_custkey""")
def update_from_join(spark: SparkSession, sf: str) -> DataFrame:
    changes = t(spark, sf, "orders").where("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("c_mktsegment"))
    return publish.update_from(t(spark, sf, "customer").select("c_custkey", "c_mktsegment"), changes, "c_custkey", "c_mktsegment")


@query("""
SELECT * FROM (VALUES ('rows', '[1, 1e+09]'), ('null_keys', '[0, 0]'), ('bad_quantity', '[0, 0]'), ('unknown', '[, ]')) e(name, expected) JOIN
(SELECT unnest(['rows', 'null_keys', 'bad_quantity', 'unknown']) AS name, unnest([count(*)::DOUBLE, count(*) FILTER (WHERE l_orderkey IS NULL)::DOUBLE, count(*) FILTER (WHERE l_quantity <= 0)::DOUBLE, 1.0::DOUBLE]) AS actual,
 unnest(['PASS', CASE WHEN count(*) FILTER (WHERE l_orderkey IS NULL) = 0 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN count(*) FILTER (WHERE l_quantity <= 0) = 0 THEN 'PASS' ELSE 'FAIL' END, 'SKIP']) AS verdict FROM lineitem) USING (name)""")
def gate_checks(spark: SparkSession, sf: str) -> DataFrame:
    checks = [
        gates.Check("rows", F.count(F.lit(1)), 1, 1e9), gates.Check("null_keys", F.count_if(F.col("l_orderkey").isNull()), 0, 0),
        gates.Check("bad_quantity", F.count_if(F.col("l_quantity") <= 0), 0, 0), gates.Check("unknown", F.max(F.lit(1))),
    ]
    return gates.run_checks(t(spark, sf, "lineitem"), checks).drop("ok")


@query("SELECT n_regionkey::VARCHAR AS target, sha256(string_agg(n_name || ':' || md5(n_name), chr(10) ORDER BY n_name || ':')) AS signature FROM nation GROUP BY 1")
def freshness_sig(spark: SparkSession, sf: str) -> DataFrame:
    from placewise.operators.control import signatures

    n = t(spark, sf, "nation")
    return signatures(n.select(F.col("n_regionkey").cast("string").alias("target"), F.col("n_name").alias("name"), F.md5(F.col("n_name").cast("binary")).alias("sha")))


@query("SELECT string_agg(p, ',' ORDER BY p) AS value FROM (SELECT l_returnflag || '>' || l_linestatus || ':' || count(*)::VARCHAR AS p FROM lineitem GROUP BY l_returnflag, l_linestatus)")
def cross_tab_text(spark: SparkSession, sf: str) -> DataFrame:
    return gates.cross_tab_text(t(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


@query("SELECT coalesce(reason, 'kept') AS reason, count(*)::BIGINT AS n FROM (SELECT CASE WHEN l_quantity > 45 THEN 'large' WHEN l_discount = 0 THEN 'full_price' END AS reason FROM lineitem) GROUP BY 1")
def exclusion_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return relational.reason_counts(relational.with_reason(t(spark, sf, "lineitem"), [("large", F.col("l_quantity") > 45), ("full_price", F.col("l_discount") == 0)]))


@query("""
(SELECT 'cheap' AS leg, p_partkey FROM part ORDER BY p_retailprice, p_partkey LIMIT 10) UNION ALL (SELECT 'dear', p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10)""")
def union_of_arms(spark: SparkSession, sf: str) -> DataFrame:
    p = t(spark, sf, "part")
    return relational.tagged_union({"cheap": p.orderBy("p_retailprice", "p_partkey").limit(10).select("p_partkey"), "dear": p.orderBy(F.col("p_retailprice").desc(), "p_partkey").limit(10).select("p_partkey")}).select("leg", "p_partkey")


@query("""
SELECT o_custkey AS k, list_aggregate(list_sort(list_distinct(list(o_orderpriority))), 'string_agg', ',') AS ours, len(list_intersect(list_distinct(list(o_orderpriority)), ['1-URGENT', '5-LOW'])) / len(list_distinct(list_concat(list(o_orderpriority), ['1-URGENT', '5-LOW'])))::DOUBLE AS jaccard FROM orders GROUP BY 1""")
def set_parity(spark: SparkSession, sf: str) -> DataFrame:
    own = t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("ids"))
    other = F.array(F.lit("1-URGENT"), F.lit("5-LOW"))
    return own.select("k", F.concat_ws(",", "ids").alias("ours"), agg.jaccard(F.col("ids"), other).alias("jaccard"))


@query("SELECT o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY (o_orderstatus = 'F') DESC, abs(o_totalprice - 100000), o_orderkey) <= 40")
def boolean_distance_order(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "orders").orderBy((F.col("o_orderstatus") == "F").desc(), F.abs(F.col("o_totalprice") - 100000), "o_orderkey").limit(40).select("o_orderkey")




def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """The tiered lookup's answers, each with the nearest customers of its supplier-like point."""
    found = tiered_lookup(spark, sf)
    near = knn_topk(spark, sf).where("rank = 1").select(F.col("qid").alias("supplier"), F.col("id").alias("customer"), "distance")
    n = t(spark, sf, "supplier").count()
    return found.join(near, (F.col("id") % n) + 1 == F.col("supplier"), "left").select("qid", "id", "score", "customer", "distance")
