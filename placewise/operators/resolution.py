"""Entity resolution: blocked pairs, probabilistic scores, components, primaries (ER01 to ER05, JN17, AGG26)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewise.functions import geo, text
from placewise.operators.components import connected_components
from placewise.operators.relational import with_primary

# ---- fixed values: weights in bits, and decision bounds ----
PRIOR = math.log2(0.1 / 0.9)
NAME, PHONE = 9.45, 9.97
AUTO, REVIEW = 0.90, 0.50
CELL = 0.0006


def features(df: DataFrame) -> DataFrame:
    """AGG26: adds to places (id, name, phone, lon, lat, bld) their name core, branch, phone share, building share and density."""
    df = df.withColumn("core", text.name_core(F.col("name"))).withColumn("branch", text.branch_of(F.col("name")))
    df = df.withColumn("tris", text.trigrams(F.col("core"))).withColumn("digits", F.nullif(text.phone_digits(F.col("phone")), F.lit("")))
    df = df.withColumn("national", F.coalesce(text.is_national_number(F.col("phone")), F.lit(False))).withColumn("bld", F.nullif(F.trim(F.coalesce("bld", F.lit(""))), F.lit("")))
    phones = df.where(F.col("digits").isNotNull()).groupBy("digits").agg(F.count(F.lit(1)).alias("phone_share"))
    buildings = df.where(F.col("bld").isNotNull()).groupBy("bld").agg(F.countDistinct("core").alias("bld_share"))
    df = df.join(phones, "digits", "left").join(buildings, "bld", "left").fillna(0, ["phone_share", "bld_share"])
    bucket = df.withColumn("bx", geo.cell(F.col("lon"), 0.0001)).withColumn("by", geo.cell(F.col("lat"), 0.0001))
    counts = bucket.groupBy("bx", "by").agg(F.count(F.lit(1)).alias("n"))
    side = [F.lit(k) for k in (-1, 0, 1)]
    around = counts.select("n", F.explode(F.array(*(F.struct((F.col("bx") + i).alias("bx"), (F.col("by") + j).alias("by")) for i in side for j in side))).alias("c"))
    density = around.groupBy(F.col("c.bx").alias("bx"), F.col("c.by").alias("by")).agg(F.sum("n").alias("density"))
    return bucket.join(density, ["bx", "by"], "left").drop("bx", "by").fillna(0, ["density"])


def candidates(df: DataFrame, size: float = CELL, cap: int | None = None) -> DataFrame:
    """JN17: pairs of structs (a, b) in the same or a neighbouring cell, each once, a.id < b.id.

    ``cap`` keeps, for the cell of the smaller id, only so many others: those nearest to its centre."""
    row = F.struct(*(F.col(c) for c in df.columns))
    own = df.select(row.alias("a"), geo.cell(F.col("lon"), size).alias("cx"), geo.cell(F.col("lat"), size).alias("cy"))
    side = [F.lit(k) for k in (-1, 0, 1)]
    cells = F.array(*(F.struct((geo.cell(F.col("lon"), size) + i).alias("cx"), (geo.cell(F.col("lat"), size) + j).alias("cy")) for i in side for j in side))
    others = df.select(row.alias("b"), F.explode(cells).alias("c")).select("b", "c.cx", "c.cy")
    if cap is not None:
        off = F.hypot(F.col("b.lon") - (F.col("cx") + 0.5) * size, F.col("b.lat") - (F.col("cy") + 0.5) * size)
        others = others.withColumn("_r", F.row_number().over(Window.partitionBy("cx", "cy").orderBy(off, "b.id"))).where(F.col("_r") <= cap).drop("_r")
    return own.join(others, ["cx", "cy"]).where(F.col("a.id") < F.col("b.id")).select("a", "b")


def score(pairs: DataFrame) -> DataFrame:
    """ER01, ER02: adds name_sim, dist_m, the weights, pr and decision (AUTO, REVIEW or NO) to pairs of featured places."""
    a, b = F.col("a"), F.col("b")
    sim = F.when((a["core"] == "") | (b["core"] == ""), 0.0).otherwise(text.dice(a["tris"], b["tris"]))
    short = F.least(F.char_length(a["core"]), F.char_length(b["core"])) <= 3
    name_w = F.when(short, F.when(F.col("name_sim") >= 0.8, NAME).otherwise(-1.32)).otherwise(F.when(F.col("name_sim") >= 0.6, NAME).when(F.col("name_sim") >= 0.3, 2.0).otherwise(-1.32))
    share = F.greatest(a["phone_share"], b["phone_share"])
    same_phone = a["digits"] == b["digits"]
    phone_w = (
        F.when(same_phone & (a["national"] | b["national"]), 0.0).when(same_phone & (share >= 10), 0.0).when(same_phone & (share >= 3), PHONE / 2)
        .when(same_phone, PHONE).when(a["digits"].isNotNull() & b["digits"].isNotNull(), -1.0).otherwise(0.0)
    )
    residents = F.greatest(a["bld_share"], b["bld_share"]).cast("double")
    same_building = F.when(residents <= 1, 6.0).otherwise(F.greatest(F.lit(0.0), 6.0 - F.log2(F.greatest(residents, F.lit(1.0)))))
    near = F.when(F.col("dist_m") <= 20, 5.3).when(F.col("dist_m") <= 60, 3.6).when(F.col("dist_m") <= 150, 0.0).otherwise(-3.32)
    crowd = F.greatest(a["density"], b["density"]).cast("double")
    near = near * F.when(crowd > 0, F.least(F.lit(1.0), 2.0 / crowd)).otherwise(1.0)
    both = a["bld"].isNotNull() & b["bld"].isNotNull()
    place_w = F.when(both & (a["bld"] == b["bld"]), same_building).when(both, -3.32).otherwise(near)
    df = pairs.withColumn("name_sim", sim).withColumn("dist_m", geo.haversine(a["lon"], a["lat"], b["lon"], b["lat"]))
    df = df.withColumn("name_w", name_w).withColumn("phone_w", phone_w).withColumn("place_w", place_w)
    odds = F.pow(F.lit(2.0), F.lit(PRIOR) + F.col("name_w") + F.col("phone_w") + F.col("place_w"))
    branches = a["branch"].isNotNull() & b["branch"].isNotNull() & (a["branch"] != b["branch"])
    df = df.withColumn("pr", F.when(branches, 0.0).otherwise(odds / (1 + odds)))
    weak = (F.col("name_w") < NAME) & (F.col("phone_w") < PHONE)
    phone_alone = (F.col("phone_w") >= PHONE) & (F.col("name_sim") < 0.3) & (F.col("place_w") <= 0)
    return df.withColumn("decision", F.when(branches, "NO").when((F.col("pr") >= AUTO) & ~weak & ~phone_alone, "AUTO").when(F.col("pr") >= REVIEW, "REVIEW").otherwise("NO"))


def resolve(places: DataFrame, priority: Column, cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """ER03, ER04: places with cluster_id and is_primary (by ``priority``, then a phone, then id), and the pairs to review."""
    scored = score(candidates(features(places), cap=cap))
    edges = scored.where("decision = 'AUTO'").select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    parts = connected_components(edges).withColumnRenamed("node", "id").withColumnRenamed("component", "cluster_id")
    clustered = places.join(parts, "id", "left").withColumn("cluster_id", F.coalesce("cluster_id", "id"))
    has_phone = F.when(F.coalesce("phone", F.lit("")) != "", 0).otherwise(1)
    review = scored.where("decision = 'REVIEW'").select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), "pr")
    return with_primary(clustered, ["cluster_id"], [priority, has_phone, F.col("id")]), review


def simple_primary(places: DataFrame, priority: Column) -> DataFrame:
    """WIN01, ER04, the one-pass alternative: primary by name key and three-place cell."""
    return with_primary(places, [text.business_key(F.col("name")), F.round("lon", 3), F.round("lat", 3)], [priority, F.col("id")])


def hide_facilities(places: DataFrame, subtypes: list[str]) -> DataFrame:
    """ER04, JN23: facilities are primary; those of ``subtypes`` aren't where a business of the same name key stands in the same three-place cell."""
    key = [text.business_key(F.col("name")).alias("_k"), F.round("lon", 3).alias("_x"), F.round("lat", 3).alias("_y")]
    biz = places.where("kind = 'biz'").select(*key).distinct().withColumn("_biz", F.lit(True))
    j = places.select("*", *key).join(biz, ["_k", "_x", "_y"], "left")
    hidden = (F.col("kind") == "facility") & F.col("subtype").isin(subtypes) & F.col("_biz").isNotNull()
    return j.withColumn("is_primary", F.when(hidden, 0).when(F.col("kind") == "facility", 1).otherwise(F.col("is_primary"))).drop("_k", "_x", "_y", "_biz")


def labelled_features(scored: DataFrame) -> DataFrame:
    """ER05: what a labeller needs of each pair."""
    cols = [F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("id", "name", "source")]
    same = (F.col("a.bld") == F.col("b.bld")).alias("same_bld")
    return scored.select(*cols, "decision", F.round("pr", 4).alias("pr"), F.round("name_sim", 4).alias("name_sim"), F.round("dist_m", 1).alias("dist_m"), (F.col("a.digits") == F.col("b.digits")).alias("phone_eq"), same)
