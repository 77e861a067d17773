"""Joins, keeps, shares and samples: the relational operators in their general form.

Sides named ``dictionary`` are code tables of some thousands of rows; they are broadcast only while
``within`` finds them under its bound, and joined by shuffle beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a dictionary that is sent to every task.
DICTIONARY_ROWS = 200_000


def within(df: DataFrame, rows: int = DICTIONARY_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows (checked by reading no more than that)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Ids of a class in one list.
BLOCK = 256


def keep_first(df: DataFrame, keys: list[Column | str], order: list[Column]) -> DataFrame:
    """WIN01, WIN05, WIN06, WIN07: the first row of each key; ``order`` must be total to be repeatable."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def member_pairs(pairs: DataFrame, members: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """Rows (id, id2, values of the pair): unordered pairs of members, each once, of pairs of classes.

    ``pairs`` has each unordered pair of classes once, a class with itself among them, as the columns ``left`` and ``right``;
    ``members`` (id, and a class in columns named as ``left``). What holds for two classes is worked out once, and only
    lists of about ``BLOCK`` ids are shuffled; pairs of ids are made where they are read."""
    counts = members.groupBy(*left).agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).alias("_n")).where("_n > 1")
    block = F.pmod(F.xxhash64("id"), F.coalesce("_n", F.lit(1)))
    one = members.join(counts, left, "left").groupBy(*left, block.alias("_b")).agg(F.collect_list("id").alias("_ids")).drop("_b")
    two = one.select(F.col("_ids").alias("_ids2"), *(F.col(k).alias(k2) for k, k2 in zip(left, right, strict=True)))
    values = [c for c in pairs.columns if c not in (*left, *right)]
    same = F.lit(True)
    for k, k2 in zip(left, right, strict=True):
        same = same & (F.col(k) == F.col(k2))
    met = pairs.withColumn("_same", same).join(one, left).join(two, right).select("_same", "_ids", "_ids2", *values)
    # small as they are, the lists are dealt out: what is made of them is not
    met = met.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = met.withColumn("id", F.explode("_ids")).drop("_ids").withColumn("id2", F.explode("_ids2")).drop("_ids2")
    met = met.where((F.col("id") < F.col("id2")) | (~F.col("_same") & (F.col("id") > F.col("id2"))))
    return met.select(F.least("id", "id2").alias("id"), F.greatest("id", "id2").alias("id2"), *values)


def with_primary(df: DataFrame, keys: list[Column | str], order: list[Column], name: str = "is_primary") -> DataFrame:
    """WIN01, ER04: marks the first row of each key instead of dropping the others."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1).cast("int"))


def unambiguous(df: DataFrame, keys: list[str], tier: str, order: list[Column]) -> DataFrame:
    """WIN02: the first row of each key, if it is the only one of its tier there; a key in doubt has none."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    same = F.count(F.lit(1)).over(Window.partitionBy(*keys, tier))
    return df.withColumn("_rank", rank).withColumn("_same", same).where("_rank = 1 AND _same = 1").drop("_rank", "_same")


def share_of_total(df: DataFrame, keys: list[str], places: int = 2) -> DataFrame:
    """WIN03: rows and their percentage by key; the window runs over the groups, not the rows."""
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return grouped.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), places))


def hashed_sample(df: DataFrame, stratum: str, key: str, n: int, seed: str = "") -> DataFrame:
    """WIN04, SMP1: ``n`` rows of each stratum by the MD5 of the key; repeatable, and stable when rows are added."""
    order = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary"))
    return keep_first_n(df, [stratum], [order, F.col(key)], n)


def keep_first_n(df: DataFrame, keys: list[Column | str], order: list[Column], n: int) -> DataFrame:
    """TOP01: the first ``n`` rows of each key."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def round_robin(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """TOP08: ``n`` rows in all, turn by turn from each group, evenly spaced in the group's order."""
    sized = df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(group))).withColumn("_i", F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1)
    groups = df.select(F.countDistinct(group).alias("_groups"))
    sized = sized.crossJoin(F.broadcast(groups)).withColumn("_take", F.least(F.col("_n"), F.ceil(F.lit(n) / F.col("_groups"))))
    # row i is picked if it is where one of the evenly spaced steps begins
    slot = F.floor((F.col("_i") * F.col("_take") + F.col("_take") - 1) / F.col("_n"))
    picked = sized.where((F.floor(slot * F.col("_n") / F.col("_take")) == F.col("_i")) & (slot < F.col("_take"))).withColumn("_slot", slot)
    return picked.orderBy("_slot", group).limit(n).drop("_n", "_i", "_groups", "_take", "_slot")


def first_match_join(left: DataFrame, right: DataFrame, keys: list[str], order: list[Column], how: str = "left") -> DataFrame:
    """JN01, JN15, JN16, SNK09: at most one row of ``right`` for each key, the first by ``order``."""
    return left.join(keep_first(right, keys, order), keys, how)


def composite_key_join(build: DataFrame, lots: DataFrame, keys: list[str], order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """JN01: inner join on a composite key, the first of duplicate lots; and one row (matched, missed, duplicates)."""
    first = keep_first(lots, keys, order)
    matched = build.join(first, keys, "inner")
    missed = build.join(lots.select(*keys).distinct(), keys, "left_anti").agg(F.count(F.lit(1)).alias("missed"))
    duplicates = lots.groupBy(*keys).count().agg(F.sum(F.col("count") - 1).alias("duplicates"))
    counted = matched.agg(F.count(F.lit(1)).alias("matched")).crossJoin(missed).crossJoin(duplicates)
    return matched, counted


def exists_in(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """JN04, FLT07."""
    return df.join(other, keys, "left_semi")


def missing_in(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """JN05."""
    return df.join(other, keys, "left_anti")


def exists_flag(df: DataFrame, other: DataFrame, keys: list[str], name: str) -> DataFrame:
    """JN23: whether the key exists, as a column."""
    return df.join(other.select(*keys).distinct().withColumn(name, F.lit(True)), keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def code_history(codes: DataFrame) -> DataFrame:
    """JN06: pairs (old_code, new_code) of a table (code, old_code, deleted): current codes of the same level that took another's place."""
    level = F.length(F.regexp_replace("code", "(00)+$", ""))
    c = codes.withColumn("_level", level)
    old, new = c.alias("o"), c.where(F.trim(F.coalesce("deleted", F.lit(""))) == "").alias("n")
    pairs = old.join(new, (F.col("n.old_code") == F.col("o.code")) & (F.col("n._level") == F.col("o._level")) & (F.substring("n.code", 1, 5) != F.substring("o.code", 1, 5)))
    return pairs.select(F.col("o.code").alias("old_code"), F.col("n.code").alias("new_code"))


def tail_name_join(old: DataFrame, new: DataFrame) -> DataFrame:
    """JN07: codes (code, name) whose names agree but for their first word."""

    def tail(c: str) -> Column:
        return F.regexp_replace(c, "^[^ ]+ ", "")

    return old.select(F.col("code").alias("old_code"), tail("name").alias("tail")).join(new.select(F.col("code").alias("new_code"), tail("name").alias("tail")), "tail")


def differing_join(a: DataFrame, b: DataFrame, on: list[str], value: str) -> DataFrame:
    """JN08: pairs that agree on ``on`` and differ in ``value``."""
    left, right = a.select(*on, F.col(value).alias("left_value")), b.select(*on, F.col(value).alias("right_value"))
    return left.join(right, on).where(F.col("left_value") != F.col("right_value"))


def first_token(text: Column, suffix: str) -> Column:
    """JN09: the first token with an ending; null if there is none."""
    return F.get(F.filter(F.split(text, r"\s+"), lambda w: w.endswith(suffix)), 0)


def pair_filter(df: DataFrame, pairs: DataFrame, a: str, b: str) -> DataFrame:
    """JN22: rows whose (a, b) is one of the pairs, and those without b."""
    return df.where(F.col(b).isNotNull()).join(pairs.select(a, b).distinct(), [a, b], "left_semi").select(*df.columns).unionByName(df.where(F.col(b).isNull()))


def agreement(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """JN24: one row (both, agreed, rate) of two ways to the same value; a rate of nothing is null."""
    both = a.select(key, F.col(value).alias("_x")).join(b.select(key, F.col(value).alias("_y")), key)
    n, same = F.count(F.lit(1)), F.count_if(F.col("_x") == F.col("_y"))
    return both.agg(n.alias("both"), same.alias("agreed"), F.round(100.0 * same / F.nullif(n, F.lit(0)), 2).alias("rate"))


def full_names(areas: DataFrame) -> DataFrame:
    """PRJ11: adds full_name to areas (code, name): the names of the two and five digit codes that begin the code, then its own."""
    names = areas.select(F.col("code").alias("_c"), F.col("name").alias("_n")).where(F.length("code") <= 5).dropDuplicates(["_c"])
    names = within(names)

    def up(df: DataFrame, digits: int, out: str) -> DataFrame:
        key = F.when(F.length("code") > digits, F.substring("code", 1, digits))
        return df.withColumn("_k", key).join(names.select(F.col("_c").alias("_k"), F.col("_n").alias(out)), "_k", "left").drop("_k")

    df = up(up(areas, 2, "_two"), 5, "_five")
    return df.withColumn("full_name", F.trim(F.regexp_replace(F.concat_ws(" ", "_two", "_five", "name"), r"\s+", " "))).drop("_two", "_five")


def crosswalk(df: DataFrame, table: DataFrame) -> DataFrame:
    """PRJ12: cat1 and cat2 by a table (cat1, subtype, new_cat1, new_cat2) where it has them; an empty new cat2 is null."""
    t = within(table.select("cat1", "subtype", F.col("new_cat1").alias("_c1"), F.nullif(F.trim("new_cat2"), F.lit("")).alias("_c2"), F.lit(True).alias("_hit")).dropDuplicates(["cat1", "subtype"]))
    j = df.join(t, ["cat1", "subtype"], "left")
    return j.withColumn("cat2", F.when(F.col("_hit"), F.col("_c2")).otherwise(F.col("cat2"))).withColumn("cat1", F.when(F.col("_hit"), F.coalesce("_c1", "cat1")).otherwise(F.col("cat1"))).select(*df.columns)


def with_reason(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """FLT02: adds ``reason``: the first rule that excludes a row; null if it stays."""
    out = F.lit(None).cast("string")
    for name, condition in reversed(rules):
        out = F.when(F.coalesce(condition, F.lit(False)), name).otherwise(out)
    return df.withColumn("reason", out)


def reason_counts(df: DataFrame) -> DataFrame:
    """FLT02: rows by reason, those that stay as ``kept``; they add up to all rows."""
    return df.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def blank_invalid(df: DataFrame, provinces: DataFrame) -> DataFrame:
    """FLT06: blanks sido and sigungu where the province isn't one of ``provinces`` (sido); adds ``bad_region``."""
    known = within(provinces.select("sido").distinct().withColumn("_ok", F.lit(True)))
    j = df.join(known, "sido", "left")
    ok = F.col("_ok").isNotNull() | (F.coalesce("sido", F.lit("")) == "")
    return j.withColumn("bad_region", ~ok).withColumn("sigungu", F.when(ok, F.col("sigungu")).otherwise("")).withColumn("sido", F.when(ok, F.col("sido")).otherwise("")).drop("_ok")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """SET04, AGG09: rows of one and not of the other, with the side, repeats counted."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def tagged_union(legs: dict[str, DataFrame], tag: str = "leg") -> DataFrame:
    """SET01."""
    out = None
    for name, df in legs.items():
        part = df.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def union_minus(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """SET02: distinct rows of the first, and of the second those whose key the first hasn't."""
    return first.unionByName(second.join(first.select(*keys), keys, "left_anti")).distinct()


def limited_arms(arms: list[DataFrame], order: list[Column], each: int, total: int) -> DataFrame:
    """SET03, TOP01: a limit on every arm and one on all, each in a total order."""
    out = None
    for arm in arms:
        part = arm.orderBy(*order).limit(each)
        out = part if out is None else out.unionByName(part)
    return out.orderBy(*order).limit(total)
