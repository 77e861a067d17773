"""Gates: uniform tables of checks (name, actual, expected, verdict) over DataFrames (GATE1 to GATE4, MAN1)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Check:
    """``actual`` is an aggregate over a table; ``low`` and ``high`` bound it (None: open); without any bound known it is skipped, which fails."""

    name: str
    actual: Column
    low: float | None = None
    high: float | None = None


def run_checks(df: DataFrame, checks: list[Check], allow_skip: bool = False) -> DataFrame:
    """GATE1, GATE2: all checks of a table in one pass over it. A check that can't be made is a SKIP and counts as failed unless allowed."""
    one = df.agg(*(c.actual.cast("double").alias(f"a{k}") for k, c in enumerate(checks)))
    rows = F.array(*(
        F.struct(
            F.lit(c.name).alias("name"), F.col(f"a{k}").alias("actual"), F.lit(f"[{'' if c.low is None else f'{c.low:g}'}, {'' if c.high is None else f'{c.high:g}'}]").alias("expected"),
            F.when(F.lit(c.low is None and c.high is None) | F.col(f"a{k}").isNull(), "SKIP")
            .when((F.lit(c.low).isNull() | (F.col(f"a{k}") >= F.lit(c.low))) & (F.lit(c.high).isNull() | (F.col(f"a{k}") <= F.lit(c.high))), "PASS").otherwise("FAIL").alias("verdict"),
        )
        for k, c in enumerate(checks)
    ))
    out = one.select(F.explode(rows).alias("c")).select("c.*")
    return out.withColumn("ok", (F.col("verdict") == "PASS") | (F.lit(allow_skip) & (F.col("verdict") == "SKIP")))


def row_window(baseline: int | None, absolute: int, low: float = 0.98, high: float = 1.10, hard: float = 0.93) -> list[tuple[str, float | None, float | None]]:
    """GATE1: the three floors of a row count: a window round the baseline, a hard share of it, an absolute number."""
    known = baseline is not None and baseline > 0
    return [
        ("rows_window", low * baseline if known else None, high * baseline if known else None),
        ("rows_hard_floor", hard * baseline if known else None, None), ("rows_absolute_floor", absolute, None),
    ]


def build_gates(places: DataFrame, baseline: int | None, absolute: int, misses: int, duplicates: int) -> DataFrame:
    """GATE1 (G2 to G10) on built places."""
    addr = F.col("kind") == "addr"
    ri_shown = F.coalesce(F.trim("ri"), F.lit("")) != ""
    code_has_ri = F.coalesce(F.substring("bcode", 9, 2), F.lit("00")) != "00"
    n = F.count_if(addr)
    checks = [Check(name, n, lo, hi) for name, lo, hi in row_window(baseline, absolute)]
    checks += [
        Check("ids_unique", F.count(F.lit(1)) - F.countDistinct("id"), 0, 0),
        Check("out_of_box", F.count_if(F.col("lon").isNotNull() & ~(F.col("lon").between(124, 132) & F.col("lat").between(33, 39))), 0, 0),
        Check("addresses_without_point", F.count_if(addr & F.col("lon").isNull()), 0, 0),
        Check("ri_code_parity", F.count_if(addr & (ri_shown != code_has_ri)), 0, 0),
        Check("key_misses", F.max(F.lit(misses)), 0, 0), Check("key_duplicates", F.max(F.lit(duplicates)), 0, 0),
    ]
    return run_checks(places, checks)


def dictionary_gates(df: DataFrame, key: str, value: str, low: int, high: int, code_space: str) -> DataFrame:
    """GATE2: rows in a window, no key with several values, all codes in their space."""
    multi = df.groupBy(key).agg(F.countDistinct(value).alias("k")).agg(F.coalesce(F.count_if(F.col("k") > 1), F.lit(0)).alias("multi"))
    checks = [
        Check("rows", F.count(F.lit(1)), low, high), Check("outside_code_space", F.count_if(~F.coalesce(F.col(key).rlike(code_space), F.lit(False))), 0, 0),
        Check("keys_with_several_values", F.max("multi"), 0, 0),
    ]
    return run_checks(df.crossJoin(F.broadcast(multi)), checks)


def quality_report(places: DataFrame) -> DataFrame:
    """GATE3: blanks, composition, and whether names are composed (a decomposed syllable counts as one that isn't)."""
    jamo = "[\\u1100-\\u11FF\\u0300-\\u036F]"
    checks = [
        Check("names_decomposed", F.count_if(F.col("name").rlike(jamo)), 0, 0), Check("codes_not_numeric", F.count_if(F.col("bcode").isNotNull() & ~F.col("bcode").rlike("^[0-9]*$")), 0, 0),
        Check("literal_none", F.count_if(F.col("name") == "None"), 0, 0), Check("blank_names_pct", 100.0 * F.count_if(F.coalesce(F.trim("name"), F.lit("")) == "") / F.nullif(F.count(F.lit(1)), F.lit(0)), 0, 50),
    ]
    return run_checks(places, checks)


def expectations(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """GATE4: rows (key, value) against expected ones; a missing side is a failure."""
    j = actual.select("key", F.col("value").cast("string").alias("actual")).join(expected.select("key", F.col("value").cast("string").alias("expected")), "key", "full")
    return j.withColumn("verdict", F.when(F.col("actual") == F.col("expected"), "PASS").otherwise("FAIL")).withColumn("verdict", F.coalesce("verdict", F.lit("FAIL")))


def cross_tab_text(df: DataFrame, old: str, new: str) -> DataFrame:
    """GATE4: one row: ``old>new:count`` of all pairs, in order."""
    counts = df.groupBy(old, new).agg(F.count(F.lit(1)).alias("n"))
    part = F.concat(F.coalesce(old, F.lit("")), F.lit(">"), F.coalesce(new, F.lit("")), F.lit(":"), F.col("n").cast("string"))
    return counts.agg(F.concat_ws(",", F.array_sort(F.collect_list(part))).alias("value"))


def add_manual(table: DataFrame, rows: DataFrame, key: str, target: str, tag: str = "manual") -> DataFrame:
    """MAN1: the table (key, target, source, ...) with corrections; keys that are there stay as they are; a target that another key has already stops everything."""
    fresh = rows.join(table.select(key), key, "left_anti")
    taken = fresh.join(table.select(target), target, "left_semi").limit(1).count()
    if taken:
        raise ValueError(f"a corrected {target} is in use")
    return table.unionByName(fresh.withColumn("source", F.concat(F.lit(f"{tag}:"), F.coalesce("source", F.lit("")))))


def require(checks: DataFrame) -> None:
    """Raise if any check failed."""
    failed = [f"{r['name']}: {r.actual} not in {r.expected} ({r.verdict})" for r in checks.where("NOT ok").collect()]
    if failed:
        raise AssertionError("; ".join(failed))
