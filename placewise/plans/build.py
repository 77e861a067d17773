"""The build of the places relation from national files, shops, facilities and OSM, as one lazy plan (entry point of the batch)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placewise.functions import codes, geo, present, text
from placewise.operators.relational import blank_invalid, composite_key_join, first_match_join, keep_first

#: Positions in the national files (fixed values).
LOTS = {0: "bcode", 1: "sido", 2: "sigungu", 3: "emd", 4: "ri", 5: "san", 6: "main", 7: "sub", 8: "pk1", 9: "pk2", 10: "pk3", 11: "pk4", 12: "sequence", 18: "lot_management", 19: "pk6"}
BUILDINGS = {0: "pk6", 1: "b_sido", 2: "b_sigungu", 3: "b_emd", 4: "pk1", 5: "road", 6: "pk2", 7: "pk3", 8: "pk4", 9: "postal", 10: "bd_mgt_sn", 11: "bld", 13: "hcode", 14: "haeng_dong", 19: "detail", 23: "e", 24: "n"}
LOT_WIDTH, BUILDING_WIDTH = 20, 27
KEY = ["pk1", "pk2", "pk3", "pk4", "pk6"]
PLACES = [
    "id", "kind", "name", "subtype", "sido", "sigungu", "emd", "ri", "road", "road_norm", "main_no", "sub_no", "bld", "postal", "haeng_dong", "bd_mgt_sn", "bcode", "hcode",
    "phone", "opened", "jibun", "cat1", "cat2", "source", "is_primary", "lon", "lat",
]
TYPES = {"id": "long", "main_no": "int", "sub_no": "int", "is_primary": "int", "lon": "double", "lat": "double"}
#: Names that stand for none, and name parts of shops that aren't places (fixed values).
PLACEHOLDERS = ["", "-", "없음", "미상"]


def shaped(df: DataFrame) -> DataFrame:
    """The columns of places in order; what a source lacks is null."""
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(TYPES.get(c, "string")).alias(c) for c in PLACES))


def addresses(buildings: DataFrame, lots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JN01: address places of the two national files on their five-part key, and one row of counts.

    Representative lots alone; of several lots of a key the first of the file; of several buildings of a
    management number the first; points outside the box are left out."""
    first = lots.where("sequence = '0'")
    matched, counts = composite_key_join(buildings, first, KEY, [F.col("file"), F.col("line")]) if "file" not in buildings.columns else composite_key_join(
        buildings.withColumnRenamed("file", "b_file").withColumnRenamed("line", "b_line"), first, KEY, [F.col("file"), F.col("line")]
    )
    once = keep_first(matched, ["bd_mgt_sn"], [F.col("b_file"), F.col("b_line")]) if "b_file" in matched.columns else matched.dropDuplicates(["bd_mgt_sn"])
    e, n = F.col("e").try_cast("double"), F.col("n").try_cast("double")
    placed = once.where(e.isNotNull() & n.isNotNull()).withColumn("p", geo.tm_inverse(e, n)).select("*", "p.lon", "p.lat").where(geo.in_box(F.col("lon"), F.col("lat")))
    jibun = text.assemble_lot(F.col("emd"), F.col("ri"), F.col("san") == "1", codes.guarded_int(F.col("main")), codes.sub_number(F.col("sub")))
    out = placed.select(
        F.lit("addr").alias("kind"), text.squeeze(F.col("bld")).alias("name"), text.squeeze(F.col("sido")).alias("sido"), text.squeeze(F.col("sigungu")).alias("sigungu"),
        text.squeeze(F.col("emd")).alias("emd"), text.squeeze(F.col("ri")).alias("ri"), text.squeeze(F.col("road")).alias("road"), text.compact(F.col("road")).alias("road_norm"),
        codes.guarded_int(F.col("pk3")).alias("main_no"), codes.sub_number(F.col("pk4")).alias("sub_no"),
        F.concat_ws(" ", F.array_distinct(F.filter(F.array(text.squeeze(F.col("bld")), text.squeeze(F.col("detail"))), lambda x: x != ""))).alias("bld"),
        "postal", "haeng_dong", "bd_mgt_sn", "bcode", "hcode", jibun.alias("jibun"), F.lit("navi").alias("source"), "lon", "lat",
    )
    return out, counts


def shops(raw: DataFrame, provinces: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Shops (name, subtype, address, lot_address, org_sido, lon, lat, phone, opened, cat1, cat2): regions parsed, placeholders and stray points out, bad provinces blanked."""
    df = raw.where(~F.trim(F.coalesce("name", F.lit(""))).isin(PLACEHOLDERS)).withColumn("r", text.parse_region_of([F.col("lot_address"), F.col("address")], F.col("org_sido")))
    df = df.select("*", F.col("r.sido").alias("sido"), F.col("r.sigungu").alias("sigungu"), F.col("r.emd").alias("emd")).withColumn("d", text.parse_road(F.col("address")))
    df = df.withColumn("lon", F.round(F.col("lon").try_cast("double"), 6)).withColumn("lat", F.round(F.col("lat").try_cast("double"), 6)).where(geo.in_box(F.col("lon"), F.col("lat")))
    out = blank_invalid(df, provinces).select(
        F.lit("biz").alias("kind"), text.squeeze(F.col("name")).alias("name"), "subtype", "sido", "sigungu", "emd", F.col("d.road").alias("road"), text.compact(F.col("d.road")).alias("road_norm"),
        F.col("d.main").alias("main_no"), F.col("d.sub").alias("sub_no"), "phone", "opened", text.squeeze(F.col("lot_address")).alias("jibun"), "cat1", "cat2", F.lit("localdata").alias("source"), "lon", "lat",
    )
    if table is not None:
        from placewise.operators.relational import crosswalk

        out = crosswalk(out, table)
    return out


def place_facilities(facilities: DataFrame, addressed: DataFrame) -> DataFrame:
    """JN15, JN16: facilities without a point get that of the address of their road key (the smallest id), or else of their lot key (the first); the rest are dropped."""
    road_key = ["sido", "sigungu", "road_norm", "main_no", "sub_no"]
    known = addressed.select(*road_key, F.col("id").alias("_i"), F.col("lon").alias("_x"), F.col("lat").alias("_y"), F.col("haeng_dong").alias("_h"), F.col("bd_mgt_sn").alias("_m"))
    by_road = first_match_join(facilities, known, road_key, [F.col("_i")])
    rest = by_road.where("_i IS NULL").drop("_i", "_x", "_y", "_h", "_m")
    lots = addressed.select("sido", "sigungu", "jibun", F.col("id").alias("_i"), F.col("lon").alias("_x"), F.col("lat").alias("_y"), F.col("haeng_dong").alias("_h"), F.col("bd_mgt_sn").alias("_m"))
    by_lot = first_match_join(rest, lots.where("jibun <> ''"), ["sido", "sigungu", "jibun"], [F.col("_i")], "inner")
    both = by_road.where("_i IS NOT NULL").unionByName(by_lot)
    return both.withColumn("lon", F.round("_x", 6)).withColumn("lat", F.round("_y", 6)).withColumn("haeng_dong", F.coalesce("_h", "haeng_dong")).withColumn("bd_mgt_sn", F.coalesce("bd_mgt_sn", "_m")).withColumn("is_primary", F.lit(1)).drop("_i", "_x", "_y", "_h", "_m")


def numbered(legs: list[DataFrame]) -> DataFrame:
    """Places with ids that follow kind, then content: the same input has the same ids. Numbers run within ranges of the order and are put end to end, so that no task numbers all rows."""
    from placewise.durable import stash

    df = None
    for leg in legs:
        part = shaped(leg)
        df = part if df is None else df.unionByName(part)
    order = ["kind", "bd_mgt_sn", "sido", "sigungu", "road_norm", "main_no", "sub_no", "name", "lon", "lat", "jibun", "source"]
    ranged = stash(df.drop("id").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy("_k")))
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))  # as many rows as ranges
    before = sizes.withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    return ranged.join(F.broadcast(before), "_p").withColumn("id", F.col("_before") + F.col("_n")).select(*PLACES)


def with_search_text(places: DataFrame) -> DataFrame:
    """PRJ02."""
    return places.withColumn("search_text", present.search_text(F.col("name"), F.col("road"), F.col("jibun")))


def gazetteer(places: DataFrame) -> DataFrame:
    """TXT11: (sido, sigungu, roads): the roads of each county, the longest first."""
    roads = places.where("kind = 'addr' AND road_norm <> ''").select("sido", "sigungu", "road_norm").distinct()
    longest = F.transform(F.array_sort(F.collect_list(F.struct((-F.char_length("road_norm")).alias("n"), F.col("road_norm").alias("r")))), lambda s: s["r"])
    return roads.groupBy("sido", "sigungu").agg(longest.alias("roads"))


def district_dictionary(places: DataFrame) -> DataFrame:
    """A9: one row (emd8, sido, sigungu, emd) of each eight-digit code."""
    rows = places.where("kind = 'addr' AND bcode IS NOT NULL").select(F.substring(F.trim("bcode"), 1, 8).alias("emd8"), "sido", "sigungu", "emd").distinct()
    return keep_first(rows, ["emd8"], [F.col("emd"), F.col("sigungu"), F.col("sido")])


def permit_filter(raw: DataFrame, state: str, name: str, blocked: list[str]) -> DataFrame:
    """FLT03, FLT04, FLT05: open businesses without blocked words or placeholder names."""
    pattern = "|".join(blocked) if blocked else "(?!)"
    return raw.where((F.col(state) == "영업/정상") & ~F.coalesce(F.col(name), F.lit("")).rlike(pattern) & ~F.trim(F.coalesce(F.col(name), F.lit(""))).isin(PLACEHOLDERS))


