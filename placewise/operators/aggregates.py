"""Counts, rates, percentiles, profiles and estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate(part: Column, whole: Column, places: int = 2) -> Column:
    """AGG03: a percentage; of nothing it is null, never 0."""
    return F.round(100.0 * part / F.nullif(whole, F.lit(0)), places)


def conditional_counts(df: DataFrame, keys: list[str], conditions: dict[str, Column]) -> DataFrame:
    """AGG02, AGG19: all rows and those under each condition, in one pass."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(name) for name, c in conditions.items()))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """AGG05."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def multi_valued(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """AGG05: keys with several values."""
    return df.groupBy(*keys).agg(F.countDistinct(value).alias("n_values")).where("n_values > 1")


def ordered_join(df: DataFrame, keys: list[str], value: str, separator: str = ",", distinct: bool = True) -> DataFrame:
    """AGG06: a key's sorted values as one text."""
    gathered = F.collect_set(value) if distinct else F.collect_list(value)
    return df.groupBy(*keys).agg(F.concat_ws(separator, F.array_sort(gathered)).alias("listed"))


def distinct_joined(columns: list[Column], separator: str = " ") -> Column:
    """AGG25: different non-empty values in their order."""
    return F.concat_ws(separator, F.array_distinct(F.filter(F.array(*columns), lambda x: F.coalesce(F.trim(x), F.lit("")) != "")))


def any_true(df: DataFrame, keys: DataFrame, on: list[str], condition: Column) -> DataFrame:
    """AGG07: for every key whether any of its rows meets the condition; null for a key without rows."""
    return keys.join(df.groupBy(*on).agg(F.bool_or(condition).alias("any")), on, "left")


def _ranked_values(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct values of a key with ``_hi``, the rows up to and with them, and ``_n``, all rows.

    Values are counted before they are ordered, and ordered by a sort that can spill: no group is held in memory."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys)
    return counts.withColumn("_hi", F.sum("_c").over(w.orderBy(value))).withColumn("_n", F.sum("_c").over(w))


def percentiles_linear(df: DataFrame, keys: list[str], value: str, points: list[float]) -> DataFrame:
    """AGG10: exact, between neighbours."""
    v = F.col(value).cast("double")

    def at(place: Column) -> Column:
        return F.min(F.when(F.col("_hi") > place, v))

    def point(p: float) -> Column:
        place = F.lit(p) * (F.col("_n") - 1)
        low, high, part = at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))
        return (low + part * (high - low)).alias(f"p{round(p * 100):02d}")

    return _ranked_values(df, keys, value).groupBy(*keys).agg(*map(point, points))


def percentiles_nearest(df: DataFrame, keys: list[str], value: str, points: list[float]) -> DataFrame:
    """AGG11: the value at rank ceil(p n)."""
    ranked = _ranked_values(df, keys, value)
    return ranked.groupBy(*keys).agg(*(F.min(F.when(F.col("_hi") >= F.ceil(F.lit(p) * F.col("_n")), F.col(value))).alias(f"p{round(p * 100):02d}") for p in points))


#: Ranges of the multiplicity histogram (fixed values).
MULTIPLICITY = [(1, 1), (2, 2), (3, 3), (4, 5), (6, 9), (10, 19), (20, 49), (50, None)]


def bucket(n: Column, ranges: list[tuple[int, int | None]] = MULTIPLICITY) -> Column:
    """AGG12: the label of the range that holds a number."""
    out = F.lit(None).cast("string")
    for lo, hi in reversed(ranges):
        out = F.when(n >= lo if hi is None else n.between(lo, hi), f"{lo}+" if hi is None else str(lo) if lo == hi else f"{lo}-{hi}").otherwise(out)
    return out


def multiplicity(df: DataFrame, keys: list[str]) -> DataFrame:
    """AGG12, AGG14: how many keys have how many rows."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(bucket(F.col("n")).alias("bucket")).agg(F.count(F.lit(1)).alias("n_keys"), F.sum("n").alias("n_rows"))


def decile_histogram(df: DataFrame, value: str) -> DataFrame:
    """AGG12: rows by tenths of a probability; 1 is in the last."""
    return df.groupBy(F.least(F.floor(F.col(value) * 10), F.lit(9)).cast("int").alias("decile")).agg(F.count(F.lit(1)).alias("n"))


def majority(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """AGG13: the commonest value of a key, the least of equally common ones."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.col("n").desc(), F.col(value))
    return counts.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*keys, F.col(value).alias("majority"), "n")


def first_shown(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """AGG13: the first value of a key that isn't blank."""
    shown = df.where(F.trim(F.coalesce(value, F.lit(""))) != "")
    return shown.groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias("first_shown"))


def key_profile(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """AGG14: one row: keys, shared ones, the most rows of a key, and for each value the keys that have several of it."""
    by_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *(F.countDistinct(v).alias(f"_d_{v}") for v in values))
    return by_key.agg(
        F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("_n") > 1).alias("n_shared"), F.max("_n").alias("max_rows"),
        *(F.count_if(F.col(f"_d_{v}") > 1).alias(f"conflicts_{v}") for v in values),
    )


def contingency(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """AGG15."""
    return df.groupBy(a.alias("a"), b.alias("b")).agg(F.count(F.lit(1)).alias("n"))


def threshold_sweep(df: DataFrame, score: str, truth: str, taus: list[float]) -> DataFrame:
    """AGG16: counts, precision, recall and F1 at each threshold. Rows are first counted by the thresholds they pass."""
    passed = F.aggregate(F.array(*(F.lit(t) for t in taus)), F.lit(0), lambda n, t: n + F.when(F.col(score) >= t, 1).otherwise(0))
    counts = df.groupBy(passed.alias("passed"), F.col(truth).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    spark = df.sparkSession
    grid = spark.createDataFrame([(float(t), k + 1) for k, t in enumerate(taus)], "tau double, place int")
    j = F.broadcast(grid).crossJoin(counts)
    inside = F.col("passed") >= F.col("place")
    out = j.groupBy("tau").agg(
        F.sum(F.when(inside & (F.col("y") == 1), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(inside & (F.col("y") == 0), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(~inside & (F.col("y") == 1), F.col("n")).otherwise(0)).alias("fn"),
    )
    p, r = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    out = out.withColumn("precision", p).withColumn("recall", r)
    return out.withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)))


def best_threshold(sweep: DataFrame, least_precision: float) -> DataFrame:
    """AGG16: the threshold of the best F1 among those precise enough, the lowest of equal ones."""
    return sweep.where(F.col("precision") >= least_precision).orderBy(F.col("f1").desc_nulls_last(), "tau").limit(1)


def poststratified(observed: DataFrame, population: DataFrame, stratum: str, hit: Column) -> DataFrame:
    """AGG17, AGG18: one row: the weighted rate over strata that were observed (weights made to add up to 1 again), design effect H sum(W^2), effective n, and 95 % half-widths."""
    seen = observed.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"), F.avg(hit.cast("double")).alias("p"))
    joined = population.groupBy(stratum).agg(F.count(F.lit(1)).alias("size")).join(seen, stratum)
    weighted = joined.withColumn("w", F.col("size") / F.sum("size").over(Window.partitionBy()))  # over strata only
    out = weighted.agg(
        F.sum(F.col("w") * F.col("p")).alias("rate"), (F.count(F.lit(1)) * F.sum(F.col("w") * F.col("w"))).alias("deff"), F.sum("n").alias("n"),
        F.sum(F.col("w") * F.col("w") * F.col("p") * (1 - F.col("p")) / F.col("n")).alias("variance"),
    )
    out = out.withColumn("n_eff", F.col("n") / F.col("deff"))
    return out.select("rate", "n", "deff", "n_eff", (1.96 * F.sqrt(F.col("rate") * (1 - F.col("rate")) / F.col("n"))).alias("half_srs"), (1.96 * F.sqrt("variance")).alias("half_weighted"))


def axis_rates(df: DataFrame, axes: str, keys: list[str]) -> DataFrame:
    """AGG20: by axis of a map column (axis -> struct(theirs, ours, eq)): all, those that can be judged, equal ones, and both rates."""
    each = df.select(*keys, F.explode(axes).alias("axis", "v"))
    judged, equal = F.col("v.theirs").isNotNull() & F.col("v.ours").isNotNull(), F.coalesce(F.col("v.eq"), F.lit(False))
    out = each.groupBy(*keys, "axis").agg(F.count(F.lit(1)).alias("n"), F.count_if(judged).alias("judged"), F.count_if(judged & equal).alias("equal"))
    return out.withColumn("rate_all", rate(F.col("equal"), F.col("n"))).withColumn("rate_judged", rate(F.col("equal"), F.col("judged")))


def jaccard(a: Column, b: Column) -> Column:
    """AGG21: of two arrays as sets; two empty ones agree."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def top1_agreement(a: Column, b: Column) -> Column:
    """AGG21."""
    return F.get(a, 0).eqNullSafe(F.get(b, 0))


def density(df: DataFrame, places: int, top: int) -> DataFrame:
    """AGG24: the cells (rounded lon, lat) with most points."""
    cells = df.groupBy(F.round("lon", places).alias("lon"), F.round("lat", places).alias("lat")).agg(F.count(F.lit(1)).alias("n"))
    return cells.orderBy(F.col("n").desc(), "lon", "lat").limit(top)


def top_by_sum(df: DataFrame, key: str, value: str, top: int) -> DataFrame:
    """TOP06."""
    return df.groupBy(key).agg(F.sum(value).alias("total")).orderBy(F.col("total").desc(), key).limit(top)


def taxonomy(df: DataFrame) -> DataFrame:
    """SNK15: cat1, its rows, and its cat2 with rows and subtypes as JSON; commonest cat1 first."""
    leaves = df.where(F.coalesce("cat1", F.lit("")) != "").groupBy("cat1", "cat2").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("subtype")).alias("subtypes"))
    trees = leaves.groupBy("cat1").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("cat2", "n", "subtypes"))).alias("children"))
    return trees.select("cat1", "n", F.to_json("children").alias("children")).orderBy(F.col("n").desc(), "cat1")
