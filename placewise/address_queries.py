"""Registered queries of the address, code and shape functions, with SQL written from their rules.

Addresses, lots and places are made of whole-number keys by expressions that both engines read alike
(``MADE``); the SQL states each rule anew, without the library's columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewise.functions import codes, geo, present, text
from placewise.operators import aggregates as agg
from placewise.operators import measure, relational, resolution, reverse, search
from placewise.queries import _EDGES, C_SQL, QUERIES, S_SQL, SQL, _areas, customers, query, suppliers, t  # noqa: F401

#: Inputs by table: columns made of its key, in SQL that Spark and DuckDB both take.
MADE = {
    "lots": ("orders", {
        "k": "o_orderkey",
        "emd8": "CASE WHEN o_orderkey % 11 = 0 THEN 'x' ELSE lpad(CAST((o_orderkey * 7919) % 100000000 AS STRING), 8, '0') END",
        "ri2": "CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'x1' ELSE lpad(CAST(o_orderkey % 100 AS STRING), 2, '0') END",
        "pnu": "CASE WHEN o_orderkey % 3 = 0 THEN lpad(CAST((o_orderkey * 7919) % 100000000 AS STRING), 8, '0') || '25' ELSE lpad(CAST(o_orderkey AS STRING), 10, '0') END || '100120003'",
        "management": "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE lpad(CAST(o_orderkey AS STRING), 10, '0') || '1' || lpad(CAST(o_custkey AS STRING), 8, '0') || '000001' END",
        "number": "CASE o_orderkey % 5 WHEN 0 THEN CAST(o_orderkey AS STRING) WHEN 1 THEN CAST(o_orderkey AS STRING) || '0000000' WHEN 2 THEN '' WHEN 3 THEN 'B' || CAST(o_custkey AS STRING) END",
        "jibun": "CASE o_orderkey % 6 WHEN 0 THEN '산' || CAST(o_custkey AS STRING) || '-' || CAST(o_orderkey % 90 AS STRING) WHEN 1 THEN CAST(o_custkey AS STRING) || '-' || CAST(o_orderkey % 90 AS STRING)"
                 " WHEN 2 THEN CAST(o_custkey AS STRING) WHEN 3 THEN '대' WHEN 4 THEN '123456789-1' END",
    }),
    "files": ("orders", {
        "k": "o_orderkey",
        "file": "CASE o_orderkey % 4 WHEN 0 THEN 'places_' || strftime_day || '.zip' WHEN 1 THEN 'places' || substr(strftime_day, 1, 6) || 'x.txt' WHEN 2 THEN 'n9' || strftime_day || '1.txt' ELSE 'none.txt' END",
        "have": "CASE o_orderkey % 3 WHEN 0 THEN '1996-07' WHEN 1 THEN '19951231' ELSE '' END",
        "deleted": "CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE strftime_day END",
    }),
    "places": ("part", {
        "k": "p_partkey",
        "name": "CASE p_partkey % 6 WHEN 0 THEN '(주)' || p_name || ' 강남점' WHEN 1 THEN '주식회사 ' || p_brand WHEN 2 THEN p_name || ' 2호점' WHEN 3 THEN '본점' WHEN 4 THEN p_brand || '역' ELSE '㈜' END",
        "emd_ri": "CASE p_partkey % 4 WHEN 0 THEN '가나면 다라리' WHEN 1 THEN '마바동' WHEN 2 THEN '사아리' ELSE '' END",
        "ref": "CASE p_partkey % 3 WHEN 0 THEN CAST(100 + p_size AS STRING) WHEN 1 THEN p_brand END",
        "building": "CASE WHEN p_partkey % 2 = 0 THEN 'apartments' ELSE 'house' END",
        "block": "CASE p_partkey % 5 WHEN 0 THEN '가람마을 ' || CAST(p_size AS STRING) || '동' WHEN 1 THEN '관리동 ' || CAST(p_size AS STRING) || '동' WHEN 2 THEN p_brand END",
        "height": "CAST(CASE WHEN p_partkey % 3 = 0 THEN p_size + 0.25 WHEN p_partkey % 3 = 1 THEN 0 END AS DOUBLE)",
        "levels": "CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS INT) END",
        "zoom": "CASE WHEN p_partkey % 4 > 0 THEN CAST(p_size AS INT) END",
        "cat1": "CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN ' ' END",
        "cat2": "CASE p_partkey % 2 WHEN 0 THEN p_type ELSE 'None' END",
        "subtype": "CASE WHEN p_partkey % 5 > 1 THEN p_type END",
    }),
    "roads": ("customer", {
        "k": "c_custkey",
        "sido": "CASE c_custkey % 5 WHEN 0 THEN '서울특별시' WHEN 1 THEN '전라남도' WHEN 2 THEN '광주' WHEN 3 THEN 'None' END",
        "sigungu": "CASE c_custkey % 3 WHEN 0 THEN '가나시' WHEN 1 THEN '다라군' ELSE ' ' END",
        "containing": "CASE c_custkey % 2 WHEN 0 THEN '가나시 마바구' ELSE '가나시장' END",
        "emd": "CASE c_custkey % 4 WHEN 0 THEN '하나읍' WHEN 1 THEN '두리동' WHEN 2 THEN '서이면' END",
        "road": "CASE c_custkey % 3 WHEN 0 THEN '한빛로' WHEN 1 THEN '새솔' || CAST(c_custkey % 40 AS STRING) || '번길' END",
        "main_no": "CASE WHEN c_custkey % 7 > 0 THEN CAST(c_custkey AS INT) END",
        "sub_no": "CAST(c_custkey % 3 AS INT)",
        "bld": "CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN '' WHEN 2 THEN 'None' END",
        "jibun": "CASE c_custkey % 3 WHEN 0 THEN '두리동 산 ' || CAST(c_custkey AS STRING) || '-0' WHEN 1 THEN '두리동' || CAST(c_custkey AS STRING) || '-4 (나무)' ELSE '' END",
    }),
}
#: A day as eight digits; the engines name the function differently.
DAY_SPARK, DAY_SQL = "date_format(o_orderdate, 'yyyyMMdd')", "strftime(o_orderdate, '%Y%m%d')"


def made(spark: SparkSession, sf: str, name: str) -> DataFrame:
    table, columns = MADE[name]
    return t(spark, sf, table).selectExpr(*(f"{e.replace('strftime_day', DAY_SPARK)} AS {c}" for c, e in columns.items()))


def made_sql(name: str) -> str:
    table, columns = MADE[name]
    return "(SELECT " + ", ".join(f"{e.replace('strftime_day', DAY_SQL)} AS {c}" for c, e in columns.items()) + f" FROM {table})"


# ---- codes ----


@query(f"""
SELECT k, CASE WHEN length(emd8) = 8 THEN emd8 || CASE WHEN length(ri2) = 2 AND ri2 <> 'x1' THEN ri2 ELSE '00' END END AS bcode,
  CASE WHEN left(pnu, 8) = emd8 THEN left(pnu, 10) WHEN length(emd8) = 8 THEN emd8 || CASE WHEN length(ri2) = 2 AND ri2 <> 'x1' THEN ri2 ELSE '00' END END AS parcel,
  left(pnu, 2) AS province, left(pnu, 5) AS county, left(pnu, 10) || substr(management, 11, 9) AS synthetic,
  CASE WHEN regexp_full_match(number, '[0-9]{{1,7}}') THEN number::INT END AS main_no, CASE WHEN regexp_full_match(number, '[0-9]{{1,7}}') THEN number::INT ELSE 0 END AS sub_no
FROM {made_sql('lots')}""")
def lot_codes(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ03, PRJ05, PRJ07, PRJ18, FLT15."""
    c = F.col
    return made(spark, sf, "lots").select(
        "k", codes.pad_bcode(c("emd8"), c("ri2")).alias("bcode"), codes.parcel_bcode(c("pnu"), c("emd8"), c("ri2")).alias("parcel"),
        codes.prefix(c("pnu"), 2).alias("province"), codes.prefix(c("pnu"), 5).alias("county"),
        codes.synthetic_pnu(codes.prefix(c("pnu"), 10), c("management")).alias("synthetic"),
        codes.guarded_int(c("number")).alias("main_no"), codes.sub_number(c("number")).alias("sub_no"),
    )


@query(f"""
SELECT k, CASE WHEN ok THEN main::INT END AS main, CASE WHEN ok THEN coalesce(sub, '0')::INT END AS sub, CASE WHEN ok THEN san::INT END AS san,
  CASE WHEN ok THEN CASE WHEN san THEN '산 ' ELSE '' END || main || CASE WHEN coalesce(sub, '0') <> '0' THEN '-' || sub ELSE '' END ELSE coalesce(jibun, '') END AS cleaned,
  CASE WHEN ok THEN '가나동 ' || CASE WHEN san THEN '산 ' ELSE '' END || main || CASE WHEN coalesce(sub, '0') <> '0' THEN '-' || sub ELSE '' END ELSE '가나동' END AS assembled
FROM (SELECT *, main IS NOT NULL AND length(main) <= 7 AS ok FROM (
  SELECT k, jibun, nullif(regexp_extract(jibun, '[0-9]+'), '') AS main, nullif(regexp_extract(jibun, '[0-9]+-([0-9]+)', 1), '') AS sub, left(jibun, 1) = '산' AS san FROM {made_sql('lots')}))""")
def lot_texts(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ06, TXT14, TXT15."""
    lot = codes.lot_columns(F.col("jibun"))
    return made(spark, sf, "lots").withColumn("lot", lot).select(
        "k", "lot.main", "lot.sub", "lot.san", text.clean_lot(F.col("jibun")).alias("cleaned"),
        text.assemble_lot(F.lit("가나동"), F.lit(None), F.col("lot.san") == 1, F.col("lot.main"), F.col("lot.sub")).alias("assembled"),
    )


@query(f"""
SELECT k, p AS period, CASE WHEN have = '' OR p IS NULL THEN 'unknown'
  WHEN left(replace(have, '-', ''), least(length(replace(have, '-', '')), length(p))) >= left(p, least(length(replace(have, '-', '')), length(p))) THEN 'current' ELSE 'update' END AS state,
  coalesce(trim(deleted), '') = '' AS is_current
FROM (SELECT *, CASE k % 4 WHEN 0 THEN substr(file, 8, 8) WHEN 1 THEN substr(file, 7, 6) END AS p FROM {made_sql('files')})""")
def file_periods(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ21, DT01, DT02."""
    df = made(spark, sf, "files").withColumn("period", codes.period_of(F.col("file")))
    return df.select("k", "period", codes.compare_periods(F.col("have"), F.col("period")).alias("state"), codes.is_current(F.col("deleted")).alias("is_current"))


@query(f"""
SELECT k, CASE WHEN trim(sido) = '전라남도' THEN '전남광주통합특별시' WHEN trim(sido) = '광주' THEN '전남광주' ELSE sido END AS merged,
  CASE WHEN containing LIKE sigungu || ' %' THEN containing ELSE sigungu END AS refined,
  CASE sido WHEN '서울특별시' THEN '서울' WHEN '전라남도' THEN '전남' ELSE sido END AS short
FROM {made_sql('roads')}""")
def own_regions(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ20, PRJ22."""
    df = made(spark, sf, "roads").withColumn("own", codes.normalize_own(F.col("sido"), F.col("sigungu"), F.col("containing")))
    return df.select("k", F.col("own.sido").alias("merged"), F.col("own.sigungu").alias("refined"), codes.short_province(F.col("sido"), {"전라남도": "전남"}).alias("short"))


@query(f"""
SELECT k, CASE WHEN k % 5 = 1 THEN NULL WHEN k % 5 = 0 THEN regexp_extract(block, '([0-9]+)동$', 1) || '동' WHEN building = 'apartments' AND regexp_full_match(ref, '[0-9]{{1,4}}') THEN ref || '동' END AS label,
  CASE WHEN height > 0 THEN round(height, 1) WHEN levels > 0 THEN round(levels * 3.3::DOUBLE, 1) ELSE 6 END AS height, zoom IS NULL OR zoom <= 14 AS visible,
  CASE WHEN trim(cat1) <> '' THEN trim(cat1) || CASE WHEN cat2 <> 'None' THEN ' > ' || cat2 ELSE '' END ELSE subtype END AS label_of_category,
  CASE WHEN trim(cat1) <> '' THEN trim(cat1) || CASE WHEN cat2 <> 'None' THEN '>' || cat2 ELSE '' END END AS path
FROM {made_sql('places')}""")
def place_columns(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ08, PRJ17, PRJ23, FLT14."""
    c = F.col
    df = made(spark, sf, "places").withColumn("category", present.category(c("cat1"), c("cat2"), c("subtype")))
    return df.select(
        "k", codes.block_label(c("block"), c("ref"), c("building")).alias("label"), present.building_height(c("height"), c("levels")).alias("height"),
        present.visible(c("zoom"), 14).alias("visible"), c("category.label").alias("label_of_category"), c("category.path").alias("path"),
    )


@query("""
WITH x AS (SELECT p_brand AS cat1, p_type AS subtype, min(p_size) AS size FROM part GROUP BY 1, 2)
SELECT p_partkey AS k, CASE WHEN size > 25 THEN 'C' || size ELSE p_brand END AS cat1, CASE WHEN size > 40 THEN NULL WHEN size > 25 THEN 'D' || size ELSE p_name END AS cat2
FROM part JOIN x ON cat1 = p_brand AND subtype = p_type""")
def category_crosswalk(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ12: the crosswalk has the kinds whose smallest part is over 25; over 40 its finer category is empty."""
    part = t(spark, sf, "part")
    sizes = part.groupBy(F.col("p_brand").alias("cat1"), F.col("p_type").alias("subtype")).agg(F.min("p_size").alias("size")).where("size > 25")
    table = sizes.selectExpr("cat1", "subtype", "'C' || size AS new_cat1", "CASE WHEN size > 40 THEN ' ' ELSE 'D' || size END AS new_cat2")
    return relational.crosswalk(part.selectExpr("p_partkey AS k", "p_brand AS cat1", "p_name AS cat2", "p_type AS subtype"), table).drop("subtype")


# ---- names and addresses ----


@query(f"""
SELECT k, CASE k % 6 WHEN 0 THEN '강남점' WHEN 2 THEN '2호점' END AS branch, lower(regexp_replace(CASE k % 6 WHEN 0 THEN replace(replace(name, '(주)', ''), ' 강남점', '')
  WHEN 1 THEN replace(name, '주식회사 ', '') WHEN 2 THEN replace(name, ' 2호점', '') ELSE name END, '[][(){{}}<>（）【】·.,/&[:space:]-]', '', 'g')) AS core,
  CASE WHEN k % 6 = 4 THEN name || ' ' || left(name, length(name) - 1) ELSE name END AS searched,
  CASE k % 4 WHEN 0 THEN '가나면' WHEN 1 THEN '마바동' WHEN 2 THEN '사아리' ELSE '' END AS emd, CASE k % 4 WHEN 0 THEN '다라리' ELSE '' END AS ri,
  name || CASE WHEN trim(cat1) <> '' THEN ', ' || cat1 ELSE '' END AS joined
FROM {made_sql('places')}""")
def place_names(spark: SparkSession, sf: str) -> DataFrame:
    """TXT04, TXT05, TXT12, PRJ13, AGG25."""
    name = F.col("name")
    df = made(spark, sf, "places").withColumn("area", text.split_emd_ri(F.col("emd_ri")))
    return df.select(
        "k", text.branch_of(name).alias("branch"), text.name_core(name).alias("core"), text.name_variants(name, name.endswith("역")).alias("searched"),
        "area.emd", "area.ri", agg.distinct_joined([name, F.col("cat1"), name], ", ").alias("joined"),
    )


@query(f"""
WITH r AS (SELECT *, CASE sido WHEN '전라남도' THEN '전남광주통합특별시' WHEN '광주' THEN '전남광주' WHEN 'None' THEN NULL ELSE sido END AS s,
  nullif(trim(sigungu), '') AS g, main_no::VARCHAR || CASE WHEN sub_no > 0 THEN '-' || sub_no ELSE '' END AS n, CASE WHEN bld NOT IN ('', 'None') THEN '(' || bld || ')' END AS b FROM {made_sql('roads')})
SELECT k, concat_ws(' ', s, g, emd, road, n, b) AS line, concat_ws(' ', s, g, CASE WHEN right(emd, 1) IN ('읍', '면') THEN emd END, road, n, b) AS road_form, concat_ws(' ', s, g, coalesce(nullif(jibun, ''), emd)) AS lot_form,
  CASE k % 3 WHEN 0 THEN '두리동 산' || k WHEN 1 THEN '두리동 ' || k || '-4' ELSE '' END AS compared,
  CASE WHEN road IS NOT NULL AND n IS NOT NULL THEN road END AS parsed_road, CASE WHEN road IS NOT NULL THEN main_no END AS parsed_main, CASE WHEN road IS NOT NULL AND n IS NOT NULL THEN sub_no END AS parsed_sub
FROM r""")
def address_lines(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ14, TXT07, TXT11: lines are written, compared forms made, and the road read back from the line without its building."""
    c = F.col
    parts = [c(n) for n in ("sido", "sigungu", "emd", "road", "main_no", "sub_no")]
    df = made(spark, sf, "roads").withColumn("road_of", text.parse_road(present.address_line(*parts, F.lit(None))))
    return df.select(
        "k", present.address_line(*parts, c("bld")).alias("line"), present.road_line(*parts, c("bld")).alias("road_form"),
        present.parcel_line(c("sido"), c("sigungu"), c("emd"), c("jibun")).alias("lot_form"), text.lot_address(c("jibun")).alias("compared"),
        c("road_of.road").alias("parsed_road"), c("road_of.main").alias("parsed_main"), c("road_of.sub").alias("parsed_sub"),
    )


@query(f"""
SELECT k, CASE WHEN k % 5 IN (0, 1) THEN sido WHEN k % 5 = 2 THEN '광주광역시' ELSE '경기도' END AS sido,
  CASE WHEN k % 5 < 3 THEN CASE k % 3 WHEN 0 THEN '가나시' WHEN 1 THEN '다라군' ELSE '' END WHEN k % 5 = 4 THEN '' ELSE CASE k % 3 WHEN 0 THEN '가나시' WHEN 1 THEN '다라군' ELSE '' END END AS sigungu,
  CASE WHEN k % 5 = 4 AND k % 3 = 2 THEN '' ELSE coalesce(emd, '') END AS emd
FROM {made_sql('roads')} WHERE k % 5 < 4
UNION ALL SELECT k, '경기도', '', coalesce(emd, '') FROM {made_sql('roads')} WHERE k % 5 = 4 AND k % 3 < 2
UNION ALL SELECT k, CASE WHEN emd IS NULL THEN '' ELSE '경기도' END, '', '' FROM {made_sql('roads')} WHERE k % 5 = 4 AND k % 3 = 2""")
def address_regions(spark: SparkSession, sf: str) -> DataFrame:
    """TXT13: provinces by name, by short name, or of the office that issued; an office's drops the first token."""
    line = F.concat_ws(" ", "sido", F.trim("sigungu"), "emd")
    df = made(spark, sf, "roads").withColumn("r", text.parse_region_of([line], F.lit("경기도")))
    return df.select("k", "r.sido", "r.sigungu", "r.emd")


@query(f"""
SELECT k, CASE WHEN sido IN ('서울특별시', '전라남도') THEN sido ELSE coalesce(CASE WHEN sido IS NULL THEN '' END, '') END AS sido,
  CASE WHEN sido IN ('서울특별시', '전라남도') OR sido IS NULL THEN sigungu ELSE '' END AS sigungu, coalesce(sido NOT IN ('서울특별시', '전라남도'), false) AS bad_region
FROM (SELECT k, sido, sigungu FROM {made_sql('roads')} WHERE sido IS NOT NULL)""")
def known_provinces(spark: SparkSession, sf: str) -> DataFrame:
    """FLT06: an unknown province blanks the county too."""
    known = spark.createDataFrame([("서울특별시",), ("전라남도",)], "sido string")
    return relational.blank_invalid(made(spark, sf, "roads").select("k", "sido", "sigungu").where("sido IS NOT NULL"), known)


# ---- relations ----


@query("""
WITH c AS (SELECT lpad(s_suppkey::VARCHAR, 5, '0') || '00000' AS code, lpad((s_suppkey + 7)::VARCHAR, 5, '0') || '00000' AS old_code, s_nationkey % 2 = 1 AS gone FROM supplier)
SELECT o.code AS old_code, n.code AS new_code FROM c o JOIN c n ON n.old_code = o.code
WHERE NOT n.gone AND length(rtrim(o.code, '0')) + length(rtrim(o.code, '0')) % 2 = length(rtrim(n.code, '0')) + length(rtrim(n.code, '0')) % 2""")
def code_successors(spark: SparkSession, sf: str) -> DataFrame:
    """JN06: each code replaced the one seven places on; levels are pairs of digits."""
    return relational.code_history(t(spark, sf, "supplier").selectExpr(
        "lpad(CAST(s_suppkey AS STRING), 5, '0') || '00000' AS code", "lpad(CAST(s_suppkey + 7 AS STRING), 5, '0') || '00000' AS old_code",
        "CASE WHEN s_nationkey % 2 = 1 THEN '2020-01-01' ELSE ' ' END AS deleted",
    ))


@query("SELECT s_suppkey AS old_code, c_custkey AS new_code, replace(s_name, 'Supplier#', '') AS tail FROM supplier JOIN customer ON replace(c_name, 'Customer#', '') = replace(s_name, 'Supplier#', '')")
def tail_names(spark: SparkSession, sf: str) -> DataFrame:
    """JN07: names that agree but for their first word."""
    old = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("code"), F.replace("s_name", F.lit("#"), F.lit(" ")).alias("name"))
    new = t(spark, sf, "customer").select(F.col("c_custkey").alias("code"), F.replace("c_name", F.lit("#"), F.lit(" ")).alias("name"))
    return relational.tail_name_join(old, new)


@query("SELECT count(*)::BIGINT AS \"both\", count(*) FILTER (WHERE l_suppkey % 7 = o_custkey % 7)::BIGINT AS agreed, round(100.0::DOUBLE * count(*) FILTER (WHERE l_suppkey % 7 = o_custkey % 7) / count(*), 2) AS rate FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def agreement_rate(spark: SparkSession, sf: str) -> DataFrame:
    """JN24."""
    a, b = t(spark, sf, "lineitem").selectExpr("l_orderkey AS id", "l_suppkey % 7 AS v"), t(spark, sf, "orders").selectExpr("o_orderkey AS id", "o_custkey % 7 AS v")
    return relational.agreement(a, b, "id", "v")


@query("SELECT DISTINCT o_custkey AS code, 'orders' AS source FROM orders UNION SELECT c_custkey, 'customer' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def codes_of_both(spark: SparkSession, sf: str) -> DataFrame:
    """SET02."""
    first, second = t(spark, sf, "orders").selectExpr("o_custkey AS code", "'orders' AS source"), t(spark, sf, "customer").selectExpr("c_custkey AS code", "'customer' AS source")
    return relational.union_minus(first, second, ["code"])


@query("""
WITH a AS (SELECT s_nationkey AS n, s_suppkey AS id, 's' AS arm FROM supplier ORDER BY 1, 2, 3 LIMIT 40), b AS (SELECT c_nationkey, c_custkey, 'c' FROM customer ORDER BY 1, 2, 3 LIMIT 40)
SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b) ORDER BY 1, 2, 3 LIMIT 60""")
def capped_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """TOP01: caps are the feature; every arm and the whole have a total order."""
    arms = [t(spark, sf, "supplier").selectExpr("s_nationkey AS n", "s_suppkey AS id", "'s' AS arm"), t(spark, sf, "customer").selectExpr("c_nationkey AS n", "c_custkey AS id", "'c' AS arm")]
    return relational.limited_arms(arms, [F.col("n"), F.col("id"), F.col("arm")], 40, 60)


@query("""
WITH x AS (SELECT l_returnflag, 'road' AS axis, nullif(l_returnflag, 'A') AS theirs, nullif(l_linestatus, 'F') AS ours, l_quantity > 25 AS eq FROM lineitem
  UNION ALL SELECT l_returnflag, 'lot', l_linestatus, l_linestatus, l_discount < 0.03 FROM lineitem)
SELECT l_returnflag, axis, n, judged, equal, round(100.0::DOUBLE * equal / n, 2) AS rate_all, round(100.0::DOUBLE * equal / nullif(judged, 0), 2) AS rate_judged FROM (
  SELECT l_returnflag, axis, count(*)::BIGINT AS n, count(*) FILTER (WHERE theirs IS NOT NULL AND ours IS NOT NULL)::BIGINT AS judged,
    count(*) FILTER (WHERE theirs IS NOT NULL AND ours IS NOT NULL AND eq)::BIGINT AS equal FROM x GROUP BY 1, 2)""")
def rates_by_axis(spark: SparkSession, sf: str) -> DataFrame:
    """AGG20: rates of all and of what can be judged."""
    c = F.col
    road = measure.axis(F.nullif(c("l_returnflag"), F.lit("A")), F.nullif(c("l_linestatus"), F.lit("F")), c("l_quantity") > 25)
    lot = measure.axis(c("l_linestatus"), c("l_linestatus"), c("l_discount") < 0.03)
    return agg.axis_rates(t(spark, sf, "lineitem").select("l_returnflag", F.create_map(F.lit("road"), road, F.lit("lot"), lot).alias("axes")), "axes", ["l_returnflag"])


@query("""
WITH e AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem), s AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem)
SELECT k, n, (SELECT min(s.n + d) FROM range(1, 11) g(d) WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.k = s.k AND e.n = s.n + d))::INT AS perturbed FROM s""")
def absent_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """SMP1: for every line the nearest higher number that its order hasn't."""
    lines = t(spark, sf, "lineitem").selectExpr("l_orderkey AS k", "CAST(l_linenumber AS INT) AS n").distinct()
    return measure.perturbed(lines, lines, ["k"], "n")


@query("""
SELECT c_nationkey, c_custkey FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)
QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('b:' || c_custkey), c_custkey) <= 5""")
def disjoint_sample(spark: SparkSession, sf: str) -> DataFrame:
    """SMP1: five rows a stratum, none of the first sample's; the sample is the feature."""
    first = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"))
    return measure.reservoir(t(spark, sf, "customer").select("c_nationkey", "c_custkey"), "c_nationkey", "c_custkey", 5, "b:", exclude=first).select("c_nationkey", "c_custkey")


#: Keys, parcels and addresses of the existence oracle, in SQL for both engines.
ORACLE = {
    "keys": "SELECT o_orderkey AS kid, CASE o_orderkey % 4 WHEN 0 THEN '12' WHEN 1 THEN '42' WHEN 2 THEN '29' ELSE '45' END || lpad(CAST(o_custkey % 500 AS STRING), 8, '0') AS bcode, o_orderkey % 2 = 0 AS san,"
            " CAST(o_custkey % 10 AS INT) AS main, CAST(0 AS INT) AS sub, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 4 = 3 THEN '45' ELSE '77' END || lpad(CAST(o_orderkey % 3000 AS STRING), 23, '7') END AS management FROM orders",
    "parcels": "SELECT CASE p_partkey % 3 WHEN 0 THEN '46' WHEN 1 THEN '51' ELSE '29' END || lpad(CAST(p_partkey % 500 AS STRING), 8, '0') || CASE WHEN p_partkey % 2 = 0 THEN '2' ELSE '1' END || lpad(CAST(p_partkey % 10 AS STRING), 4, '0') || '0000' AS pnu FROM part",
    "addresses": "SELECT CASE WHEN c_custkey % 2 = 0 THEN '29' ELSE '52' END || lpad(CAST(c_custkey % 500 AS STRING), 8, '0') AS bcode,"
                 " CASE WHEN c_custkey % 5 = 0 THEN CASE WHEN c_custkey % 4 = 3 THEN '52' ELSE '77' END || lpad(CAST(c_custkey AS STRING), 23, '7') ELSE '0000000000' || CASE WHEN c_custkey % 4 < 2 THEN '2' ELSE '1' END || lpad(CAST(c_custkey % 10 AS STRING), 4, '0') || '0000' || '000000' END AS bd_mgt_sn FROM customer",
}


@query(f"""
WITH keys AS ({ORACLE['keys']}), parcels AS ({ORACLE['parcels']}), addresses AS ({ORACLE['addresses']}),
s(n, a, b) AS (VALUES (1, '12', '46'), (2, '12', '29'), (1, '42', '51'), (1, '45', '52')),
tried AS (SELECT kid, management AS m, 0 AS n, bcode || CASE WHEN san THEN '2' ELSE '1' END || lpad(main::VARCHAR, 4, '0') || lpad(sub::VARCHAR, 4, '0') AS pnu FROM keys
  UNION ALL SELECT kid, CASE WHEN a <> '12' THEN b || substr(management, 3) END, n, b || substr(bcode, 3) || CASE WHEN san THEN '2' ELSE '1' END || lpad(main::VARCHAR, 4, '0') || lpad(sub::VARCHAR, 4, '0') FROM keys JOIN s ON a = left(bcode, 2)),
found AS (SELECT kid, n, CASE WHEN pnu IN (SELECT bcode || substr(bd_mgt_sn, 11, 9) FROM addresses) THEN 'A' WHEN coalesce(m IN (SELECT bd_mgt_sn FROM addresses), false) THEN 'A25'
  WHEN coalesce(left(m, 19) IN (SELECT left(bd_mgt_sn, 19) FROM addresses), false) THEN 'A19' WHEN pnu IN (SELECT pnu FROM parcels) THEN 'P' END AS o FROM tried)
SELECT kid, coalesce(own.o, one.o, two.o, 'N') AS oracle, own.o IS NULL AND coalesce(one.o, two.o) IS NOT NULL AS relaxed
FROM found own LEFT JOIN (SELECT * FROM found WHERE n = 1) one USING (kid) LEFT JOIN (SELECT * FROM found WHERE n = 2) two USING (kid) WHERE own.n = 0""")
def existence_oracle(spark: SparkSession, sf: str) -> DataFrame:
    """ORC1: by code, by management number, then parcels; only misses are tried under former codes."""
    def view(name: str, table: str) -> DataFrame:
        return spark.sql(ORACLE[name].replace(f"FROM {table}", "FROM {source}"), source=t(spark, sf, table))

    return measure.existence(view("keys", "orders"), view("parcels", "part"), view("addresses", "customer")).select("kid", "oracle", "relaxed")


# ---- points and rings ----


@query(f"""
SELECT id, round(abs(w * h), 6) AS area, round(w * h / 2 - h * w / 2 + w * h, 6) AS turned, x AS min_x, round(x + w, 6) AS max_x, round(y + h, 6) AS max_y, x + id % 9 BETWEEN 124 AND 132 AND y BETWEEN 33 AND 39 AS valid, round(x + w / 2, 6) AS cx, round(y + h / 2, 6) AS cy, w = 0 AS empty,
  round(sqrt((w * 111320.0::DOUBLE * cos(radians(y + h / 2))) ** 2 + (h * 110540.0::DOUBLE) ** 2), 3) AS diagonal, floor(x / 0.0006::DOUBLE)::BIGINT AS cell, floor(y * 1000 + 0.5::DOUBLE)::BIGINT AS key_y
FROM (SELECT *, (id % 5) / 100.0::DOUBLE AS w, (1 + id % 3) / 100.0::DOUBLE AS h FROM {C_SQL})""")
def box_rings(spark: SparkSession, sf: str) -> DataFrame:
    """FLT01, GEO04, GEO08, GEO09, GEO11, GEO13, AGG23: rectangles, every other one given clockwise, closed."""
    df = customers(spark, sf).withColumn("w", (F.col("id") % 5) / F.lit(100.0)).withColumn("h", (1 + F.col("id") % 3) / F.lit(100.0))
    corners = ["x, y", "x + w, y", "x + w, y + h", "x, y + h", "x, y"]
    ring = F.expr("array(" + ", ".join("named_struct('x', {}, 'y', {})".format(*c.split(", ")) for c in corners) + ")")
    df = df.withColumn("ring", F.when(F.col("id") % 2 == 0, F.reverse(ring)).otherwise(ring))
    r, c = F.col("ring"), F.col
    df = df.withColumn("box", geo.ring_box(r)).withColumn("centre", geo.ring_centroid(r))
    return df.select(
        "id", F.round(F.abs(geo.ring_area(r)), 6).alias("area"), F.round(geo.ring_area(geo.counter_clockwise(r)), 6).alias("turned"), c("box.min_x").alias("min_x"),
        F.round("box.max_x", 6).alias("max_x"), F.round("box.max_y", 6).alias("max_y"), F.round("centre.x", 6).alias("cx"), F.round("centre.y", 6).alias("cy"), (F.col("w") == 0).alias("empty"),
        geo.in_box(c("x") + c("id") % 9, c("y")).alias("valid"),
        F.round(geo.plane_distance(c("x"), c("y"), c("x") + c("w"), c("y") + c("h")), 3).alias("diagonal"), geo.cell(c("x"), 0.0006).alias("cell"), geo.rounded_key(c("x"), c("y"), 3)["y"].alias("key_y"),
    )


@query("""
SELECT k, round(-10000 + (r * 65536 + g * 256 + b) / 10.0::DOUBLE, 1) AS metres, r * 65536 + g * 256 + b AS rgb,
  round(CASE WHEN v <= 10 THEN 0 WHEN v < 30 THEN (v - 10) / 20.0::DOUBLE * 200 ELSE 200 END)::INT AS red, round(r + (g - r) * 0.25::DOUBLE + (b - r) * 0.5::DOUBLE + (v - b - g + r) * 0.125::DOUBLE, 6) AS between
FROM (SELECT p_partkey AS k, (p_partkey % 3)::INT AS r, (p_partkey * 7 % 256)::INT AS g, (p_partkey * 13 % 256)::INT AS b, p_size::INT AS v FROM part)""")
def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """SRC15, GEO15: heights of terrain pixels, a value between four, a colour ramp and packed colours."""
    c = F.col
    df = t(spark, sf, "part").selectExpr("p_partkey AS k", "CAST(p_partkey % 3 AS INT) AS r", "CAST(p_partkey * 7 % 256 AS INT) AS g", "CAST(p_partkey * 13 % 256 AS INT) AS b", "CAST(p_size AS INT) AS v")
    ramp = geo.ramp(c("v"), [(10.0, (0, 0, 0)), (30.0, (200, 0, 0))])
    return df.select(
        "k", F.round(geo.terrain_height(c("r"), c("g"), c("b")), 1).alias("metres"), geo.pack_rgb(c("r"), c("g"), c("b")).alias("rgb"), ramp["r"].alias("red"),
        F.round(geo.bilinear(c("r"), c("g"), c("b"), c("v"), F.lit(0.25), F.lit(0.5)), 6).alias("between"),
    )


_METRES = "2 * 6371000.0::DOUBLE * asin(sqrt(sin(radians(c.y - s.y) / 2) ** 2 + cos(radians(s.y)) * cos(radians(c.y)) * sin(radians(c.x - s.x) / 2) ** 2))"


@query(f"SELECT s.id AS qid, c.id AS aid, round({_METRES}, 3) AS metres FROM {S_SQL} s JOIN {C_SQL} c ON {_METRES} <= 2500 QUALIFY row_number() OVER (PARTITION BY s.id ORDER BY {_METRES}, c.id) = 1")
def nearest_address_of(spark: SparkSession, sf: str) -> DataFrame:
    """JN12 of the reverse lookup: the nearest address within 2.5 km."""
    points = suppliers(spark, sf).withColumnRenamed("id", "qid")
    addresses = customers(spark, sf).select("id", F.col("x").alias("lon"), F.col("y").alias("lat"))
    return reverse.nearest_address(points, addresses).select("qid", "aid", F.round("distance", 3).alias("metres"))


#: Addresses of the reverse lookup: customers where they are, and at every fourth supplier one on forest land; parcels are squares round two of three suppliers.
_REVERSE = {
    "customers": "SELECT id, x AS lon, y AS lat, CASE WHEN id % 3 = 0 THEN '산 ' || CAST(id AS STRING) ELSE CAST(id AS STRING) || '-1' END AS jibun, '0000000000' AS bcode, '0000000000' || lpad(CAST(id % 200 AS STRING), 9, '0') || '000000' AS bd_mgt_sn FROM {c}",
    "suppliers": "SELECT id + 1000000000 AS id, x AS lon, y AS lat, '산 7-1' AS jibun, '1111111111' AS bcode, CAST(NULL AS STRING) AS bd_mgt_sn FROM {s} WHERE id % 4 = 0",
    "parcels": "SELECT CAST(id AS STRING) AS pid, lpad(CAST(id % 40 AS STRING), 19, '0') AS pnu, CAST(CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END AS INT) AS p_san, CAST(id AS INT) AS ji_main, CAST(id % 2 AS INT) AS ji_sub, x, y FROM {s} WHERE id % 3 > 0",
}
_HALF = 0.01005
_TO_ADDRESS = "2 * 6371000.0::DOUBLE * asin(sqrt(sin(radians(a.lat - p.y) / 2) ** 2 + cos(radians(p.y)) * cos(radians(a.lat)) * sin(radians(a.lon - p.x) / 2) ** 2))"


@query(f"""
WITH p AS {S_SQL}, a AS ({_REVERSE['customers'].format(c=C_SQL)} UNION ALL {_REVERSE['suppliers'].format(s='p')}), l AS ({_REVERSE['parcels'].format(s='p')}),
near AS (SELECT p.id AS qid, a.id AS aid, a.jibun, {_TO_ADDRESS} AS d FROM p JOIN a ON {_TO_ADDRESS} <= 2500 QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY {_TO_ADDRESS}, a.id) = 1),
pip AS (SELECT p.id AS qid, l.pnu, l.p_san, l.ji_main, l.ji_sub FROM p JOIN l ON abs(p.x - l.x) < {_HALF} AND abs(p.y - l.y) < {_HALF}
  QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY l.p_san, l.ji_main, l.ji_sub, l.pid) = 1),
trusted AS (SELECT pip.* FROM pip LEFT JOIN near USING (qid) WHERE NOT coalesce(left(near.jibun, 1) = '산' AND pip.p_san = 0 AND near.d <= 5, false)),
road AS (SELECT p.id AS qid, a.id AS aid FROM trusted JOIN p ON p.id = trusted.qid JOIN a ON a.bcode || substr(a.bd_mgt_sn, 11, 9) = trusted.pnu QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY {_TO_ADDRESS}, a.id) = 1),
inside AS (SELECT id, code FROM (SELECT id, code, count(*) FILTER (WHERE (y1 > y) <> (y2 > y) AND x < (x2 - x1)::DOUBLE * (y - y1) / (y2 - y1 + 1e-300) + x1) AS n FROM p, {_EDGES} GROUP BY 1, 2) WHERE n % 2 = 1)
SELECT p.id AS qid, coalesce(road.aid, near.aid) AS road_id,
  CASE WHEN trusted.qid IS NULL THEN near.jibun ELSE CASE WHEN trusted.p_san = 1 THEN '산 ' ELSE '' END || trusted.ji_main || CASE WHEN trusted.ji_sub > 0 THEN '-' || trusted.ji_sub ELSE '' END END AS lot,
  CASE WHEN trusted.qid IS NOT NULL THEN 'pip_key' WHEN near.qid IS NOT NULL THEN 'knn' ELSE 'none' END AS address_source, round(near.d, 3) AS distance,
  (SELECT code FROM inside i WHERE i.id = p.id AND code <> 'C') AS sido, (SELECT code FROM inside i WHERE i.id = p.id AND code = 'C') AS emd
FROM p LEFT JOIN near ON near.qid = p.id LEFT JOIN trusted ON trusted.qid = p.id LEFT JOIN road ON road.qid = p.id""")
def reverse_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """GEOC2, GEOC3, JN11, JN12, JN14, PRJ05: every supplier's point against addresses, parcels and areas."""
    c, s = customers(spark, sf), suppliers(spark, sf)
    addresses = spark.sql(_REVERSE["customers"], c=c).unionByName(spark.sql(_REVERSE["suppliers"], s=s))
    corners = [(-_HALF, -_HALF), (_HALF, -_HALF), (_HALF, _HALF), (-_HALF, _HALF)]
    ring = F.array(*(F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in corners))
    parcels = spark.sql(_REVERSE["parcels"], s=s).withColumn("rings", F.array(ring)).drop("x", "y")
    return reverse.reverse(s.withColumnRenamed("id", "qid"), addresses, parcels, _areas(spark), ["sido", "emd"])


#: Addresses and queries of the forward lookup: ten roads in two counties; a query has a county, road and numbers, a road and a number that no address has, a postal code, or a lot.
_FORWARD = {
    "customers": "SELECT id, 'addr' AS kind, 'n' || CAST(id AS STRING) AS name, CASE WHEN id % 2 = 0 THEN '서울특별시' ELSE '부산광역시' END AS sido, CASE WHEN id % 2 = 0 THEN '강남구' ELSE '해운대구' END AS sigungu, '역삼동' AS emd,"
                 " CAST(NULL AS STRING) AS haeng_dong, substr('가나다라마바사아자차', CAST(id % 10 AS INT) + 1, 1) || '람로' AS road_norm, CAST(id % 7 + 1 AS INT) AS main_no, CAST(id % 3 AS INT) AS sub_no, CAST(NULL AS STRING) AS bld,"
                 " lpad(CAST(id % 300 + 6000 AS STRING), 5, '0') AS postal, '역삼동 ' || CAST(id % 90 + 1 AS STRING) || CASE WHEN id % 4 = 0 THEN '' ELSE '-' || CAST(id % 4 AS STRING) END AS jibun, '' AS search_text, CAST(1 AS INT) AS is_primary, x AS lon, y AS lat FROM {c}",
    "suppliers": "SELECT id AS qid, CASE id % 4 WHEN 0 THEN '강남구 ' || substr('가나다라마바사아자차', CAST(id % 10 AS INT) + 1, 1) || '람로 ' || CAST(id % 9 + 1 AS STRING) || CASE WHEN id % 5 = 0 THEN '' ELSE '-' || CAST(id % 5 AS STRING) END"
                 " WHEN 1 THEN substr('가나다라마바사아자차', CAST(id % 10 AS INT) + 1, 1) || '람로 999' WHEN 2 THEN lpad(CAST(id % 400 + 6000 AS STRING), 5, '0') ELSE '역삼동 ' || CAST(id % 100 + 1 AS STRING) END AS text FROM {s}",
}


@query(f"""
WITH a AS ({_FORWARD['customers'].format(c=C_SQL)}), q AS (SELECT id AS qid, id % 4 AS kind, substr('가나다라마바사아자차', (id % 10 + 1)::INT, 1) || '람로' AS road, CASE WHEN id % 4 = 1 THEN 999 ELSE id % 9 + 1 END AS m, id % 5 AS k, id % 400 + 6000 AS zip, id % 100 + 1 AS lot FROM {S_SQL} p),
by_road AS (SELECT qid, a.id, a.sigungu, q.kind, CASE WHEN m = main_no AND (CASE WHEN q.kind = 1 THEN 0 ELSE k END) = sub_no THEN 200 WHEN m = main_no THEN 150 ELSE 110 END AS base FROM q JOIN a ON road = road_norm WHERE q.kind < 2
  QUALIFY base = max(base) OVER (PARTITION BY qid)),
found AS (SELECT qid, id, base + CASE WHEN kind = 0 AND sigungu = '강남구' THEN 12 ELSE 0 END AS score, 0 AS place FROM by_road
  UNION ALL SELECT qid, a.id, 180, 0 FROM q JOIN a ON a.postal::INT = zip WHERE q.kind = 2
  UNION ALL SELECT qid, a.id, 200, CASE WHEN jibun = '역삼동 ' || lot THEN 0 ELSE 1 END + CASE WHEN sigungu = '강남구' THEN 0 ELSE 0.5 END FROM q JOIN a ON jibun = '역삼동 ' || lot OR jibun LIKE '역삼동 ' || lot || '-%' WHERE q.kind = 3)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, place, CASE WHEN qid % 4 = 3 THEN id END, id::VARCHAR) AS rank, id::VARCHAR AS id, score FROM found
QUALIFY rank <= 8""")
def forward_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """GEOC1, FLT10, TXT09, TOP02: every supplier's query against all addresses; eight results are the feature."""
    places = spark.sql(_FORWARD["customers"], c=customers(spark, sf))
    return search.geocode(spark.sql(_FORWARD["suppliers"], s=suppliers(spark, sf)), places).select("qid", F.col("rank").cast("long"), "id", "score")


# ---- measurement and resolution ----


@query("""
WITH a AS (SELECT l_orderkey AS qid, list(l_partkey::VARCHAR ORDER BY l_linenumber, l_partkey) AS x FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey + 1 AS qid, list(l_partkey::VARCHAR ORDER BY l_linenumber, l_partkey) AS y FROM lineitem GROUP BY 1),
j AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(x, []::VARCHAR[]) AS x, coalesce(y, []::VARCHAR[]) AS y FROM a FULL JOIN b ON a.qid = b.qid)
SELECT qid, round(len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))), 9) AS jaccard, x[1] IS NOT DISTINCT FROM y[1] AS top1 FROM j""")
def list_parity(spark: SparkSession, sf: str) -> DataFrame:
    """AGG21: the parts of each order against those of the order before it, as two result lists."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda r: r["l_partkey"].cast("string"))
    lists = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("qid")).agg(ordered.alias("ids"))
    return measure.parity(lists, lists.withColumn("qid", F.col("qid") + 1)).withColumn("jaccard", F.round("jaccard", 9))


@query("""
WITH p AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN p_brand || ' (A)' WHEN 1 THEN lower(p_brand) || 'a' ELSE p_type END AS name, 127 + (p_partkey % 40) / 10000.0::DOUBLE + 0.00001::DOUBLE AS lon, 36.50001::DOUBLE AS lat, p_size FROM part)
SELECT id, (row_number() OVER (PARTITION BY lower(regexp_replace(name, '[()# ]', '', 'g')), round(lon, 3), round(lat, 3) ORDER BY p_size, id) = 1)::INT AS is_primary
FROM p""")
def primary_by_name_and_cell(spark: SparkSession, sf: str) -> DataFrame:
    """ER04 in one pass: the primary of each name key in a three-place cell, by size and number."""
    df = t(spark, sf, "part").selectExpr(
        "p_partkey AS id", "CASE p_partkey % 3 WHEN 0 THEN p_brand || ' (A)' WHEN 1 THEN lower(p_brand) || 'a' ELSE p_type END AS name",
        "127 + CAST(p_partkey % 40 AS DOUBLE) / 10000 + CAST(0.00001 AS DOUBLE) AS lon", "CAST(36.50001 AS DOUBLE) AS lat", "p_size",
    )
    return resolution.simple_primary(df, F.col("p_size")).select("id", F.col("is_primary").cast("int"))


@query(f"""
SELECT id, round((x - 127) * (111412.84::DOUBLE * cos(radians(36)) - 93.5::DOUBLE * cos(3 * radians(36))), 4) AS east,
  round((y - 36) * (111132.92::DOUBLE - 559.82::DOUBLE * cos(2 * radians(36)) + 1.175::DOUBLE * cos(4 * radians(36))), 4) AS north FROM {C_SQL}""")
def local_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """GEO12."""
    df = customers(spark, sf).withColumn("m", geo.local_metres(F.col("x"), F.col("y"), F.lit(127.0), F.lit(36.0)))
    return df.select("id", F.round("m.east", 4).alias("east"), F.round("m.north", 4).alias("north"))
