"""Sampling, oracles, classes and scores of the measurement harness (SMP1, ORC1, CLS1, SCR1, SCR2, RTE4, JS02)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewise.functions import codes, geo, text
from placewise.operators.aggregates import rate
from placewise.operators.relational import hashed_sample

#: Largest step of the perturbed sub number.
STEPS = 10


def reservoir(df: DataFrame, stratum: str, key: str, n: int, seed: str, exclude: DataFrame | None = None) -> DataFrame:
    """SMP1: ``n`` rows of each stratum, the same for the same seed; none of those in ``exclude`` (key)."""
    pool = df if exclude is None else df.join(exclude.select(key), key, "left_anti")
    return hashed_sample(pool, stratum, key, n, seed)


def perturbed(sample: DataFrame, existing: DataFrame, keys: list[str], number: str) -> DataFrame:
    """SMP1: the sample with the nearest higher number (up to ``STEPS`` on) that doesn't exist under the same keys; rows without one go."""
    tried = sample.withColumn("_new", F.explode(F.array(*(F.col(number) + k for k in range(1, STEPS + 1)))))
    free = tried.join(existing.select(*keys, F.col(number).alias("_new")).distinct(), [*keys, "_new"], "left_anti")
    cols = [c for c in sample.columns if c != number]
    return free.groupBy(*cols, number).agg(F.min("_new").alias("perturbed"))


#: Province codes under which a code that isn't found is tried again, in this order; True: a former code, which the management number has too (fixed values).
RETRIES = {"12": (("46", False), ("29", False)), "42": (("51", True),), "45": (("52", True),)}


def existence(keys: DataFrame, parcels: DataFrame, addresses: DataFrame) -> DataFrame:
    """ORC1: adds ``oracle`` to keys (kid, bcode, san, main, sub, management): A (the parcel code is an address's), A25 or A19 (its management number, or the first 19 digits, is), P (a parcel's), N (nothing's).

    Only keys that are nothing's are tried again (``relaxed`` if that finds them), and the first code
    that is anything's decides: the merged province as either of its parts, a former one as its successor."""

    def variants(df: DataFrame) -> DataFrame:
        def attempt(k: int, code: Column, management: Column) -> Column:
            return F.struct(F.lit(k).alias("_attempt"), code.alias("_try"), management.alias("_management"))

        own = attempt(0, F.col("bcode"), F.col("management").cast("string"))
        tries = F.array(own)
        for old, others in RETRIES.items():
            more = [
                attempt(k + 1, F.concat(F.lit(new), F.substring("bcode", 3, 8)), F.concat(F.lit(new), F.expr("substring(management, 3)")) if former else F.lit(None).cast("string"))
                for k, (new, former) in enumerate(others)
            ]
            tries = F.when(F.substring("bcode", 1, 2) == old, F.array(own, *more)).otherwise(tries)
        return df.withColumn("_t", F.explode(tries)).select("kid", "san", "main", "sub", "_t.*")

    tried = variants(keys).withColumn("pnu", codes.compose_pnu(F.col("_try"), F.col("san"), F.col("main"), F.col("sub"))).withColumn("_m", F.substring("_management", 1, 19))
    ours = addresses.select(codes.synthetic_pnu(F.col("bcode"), F.col("bd_mgt_sn")).alias("pnu")).where("pnu IS NOT NULL").distinct().withColumn("_a", F.lit(True))
    lots = parcels.select("pnu").where("pnu IS NOT NULL").distinct().withColumn("_p", F.lit(True))
    full = addresses.select(F.col("bd_mgt_sn").alias("_management")).where("_management IS NOT NULL").distinct().withColumn("_m25", F.lit(True))
    head = addresses.select(F.substring("bd_mgt_sn", 1, 19).alias("_m")).where("_m IS NOT NULL").distinct().withColumn("_m19", F.lit(True))
    j = tried.join(ours, "pnu", "left").join(lots, "pnu", "left").join(full, "_management", "left").join(head, "_m", "left")
    order = F.when(F.col("_a"), 0).when(F.col("_m25"), 1).when(F.col("_m19"), 2).when(F.col("_p"), 3).otherwise(4)
    best = j.groupBy("kid").agg(F.min(F.struct((order == 4).alias("missed"), F.col("_attempt"), order.alias("o"))).alias("b"))
    names = F.element_at(F.array(*map(F.lit, ("A", "A25", "A19", "P", "N"))), F.col("b.o") + 1)
    return keys.join(best.select("kid", names.alias("oracle"), (~F.col("b.missed") & (F.col("b._attempt") > 0)).alias("relaxed")), "kid", "left")


def approximate_exists(keys: DataFrame, parcels: DataFrame) -> DataFrame:
    """JN04: whether a lot of the same district and main number exists, whatever its sub number."""
    known = parcels.select(F.substring("pnu", 1, 10).alias("bcode"), F.col("ji_main").alias("main")).distinct().withColumn("o_apx", F.lit(True))
    return keys.join(known, ["bcode", "main"], "left").withColumn("o_apx", F.coalesce("o_apx", F.lit(False)))


#: Observations of the measurement and their types; those that a table lacks count as null.
OBSERVED = {
    "layer": "string", "e1": "boolean", "e2": "boolean", "addresses": "int", "other_kinds": "int", "d_top1": "double", "d_min5": "double", "tolerance": "double", "top1_nearest": "boolean",
    "oracle": "string", "o_apx": "boolean", "r_v": "boolean", "r_m": "boolean", "code_ours": "string", "code_theirs": "string", "san_query": "boolean", "san_ours": "boolean",
    "source": "string", "normalised": "boolean",
}
#: The layer of lots, the sources that stand in for addresses, and the oracle's answers that are addresses (fixed values).
LOTS, STAND_INS, ADDRESSES = "jibun", ("navi", "parcel"), ("A", "A25", "A19")


def classify(observations: DataFrame, relaxed: bool = True) -> DataFrame:
    """CLS1: adds ``class``: E1, E2 or one of eleven classes that exclude each other, and ``flags`` F1 to F8, which don't.

    Columns are those of ``OBSERVED``: the gates e1 and e2; addresses and other kinds answered; distances
    and each row's own tolerance (an absent distance isn't within it); the oracle and whether a lot next
    to it exists; the referee on their point (r_v) and ours (r_m), null where absent. ``relaxed`` takes
    the codes of a merged province and its parts as equal."""
    o = {name: F.col(name) if name in observations.columns else F.lit(None).cast(kind) for name, kind in OBSERVED.items()}

    def sure(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    none = sure(o["addresses"] == 0)
    top, five = sure(o["d_top1"] <= o["tolerance"]), sure(o["d_min5"] <= o["tolerance"])
    neighbour = sure(o["o_apx"]) & sure(o["layer"] == LOTS)
    answered = F.when(top, "5").when(five, "6").when(o["r_v"].isNull() | o["r_m"].isNull(), "11")
    answered = answered.when(o["r_v"] & o["r_m"], "9").when(o["r_v"], "8").when(o["r_m"], "7").otherwise("10")
    silent = F.when(o["oracle"].isin(*ADDRESSES), "1").when(o["oracle"] == "P", "2").when(neighbour, "3").otherwise("4")
    gate = F.when(sure(o["e1"]), "E1").when(sure(o["e2"]), "E2")
    ours, theirs = F.nullif(o["code_ours"], F.lit("")), F.nullif(o["code_theirs"], F.lit(""))
    strict, loose = (sure(text.district_code_matches(ours, theirs, x)) for x in (False, True))
    both = ours.isNotNull() & theirs.isNotNull()
    flags = {
        "F1": both & ~(loose if relaxed else strict),  # another district
        "F2": none & sure(o["other_kinds"] > 0),  # answers, but no address
        "F3": five & ~F.coalesce(o["top1_nearest"], F.lit(True)),  # a nearer one ranks below
        "F4": sure(o["san_query"]) != sure(o["san_ours"]),  # a mountain lot for a plain one, or the reverse
        "F5": sure(o["source"].isin(*STAND_INS)),  # not from the addresses
        "F6": both & loose & ~strict if relaxed else F.lit(False),  # equal only since a province merged
        "F7": sure(o["normalised"]),  # normalisation changed a value
        "F8": ~none & sure(o["oracle"] == "P") & sure(o["source"] == "parcel"),  # a parcel for a parcel
    }
    named = F.filter(F.array(*(F.when(c, name) for name, c in flags.items())), lambda x: x.isNotNull())
    return observations.withColumn("class", F.coalesce(gate, F.when(none, silent).otherwise(answered))).withColumn("flags", named)


def class_table(classified: DataFrame, stratum: str) -> DataFrame:
    """CLS1: rows and percentage by class in each stratum; gated rows don't count in the percentage."""
    counts = classified.groupBy(stratum, "class").agg(F.count(F.lit(1)).alias("n"))
    judged = F.sum(F.when(~F.col("class").isin("E1", "E2"), F.col("n"))).over(Window.partitionBy(stratum))
    return counts.withColumn("pct", F.when(~F.col("class").isin("E1", "E2"), rate(F.col("n"), judged)))


def reverse_axes(reply: Column) -> Column:
    """JS02: struct(road, lot, zipcode) of a reply's first entries of either type; a reply that is missing, failed or empty has nulls, never success."""
    entry = "struct<type:string,text:string,zipcode:string>"
    parsed = F.from_json(reply, f"response struct<status:string,result:array<{entry}>>")
    ok = parsed["response"]["status"] == "OK"
    rows = F.when(ok, parsed["response"]["result"])

    def first(kind: str) -> Column:
        return F.get(F.filter(rows, lambda r: r["type"] == kind), 0)

    def shown(c: Column) -> Column:
        return F.when(F.trim(c) != "", F.trim(c))

    road, lot = first("road"), first("parcel")
    return F.struct(shown(road["text"]).alias("road"), shown(lot["text"]).alias("lot"), F.coalesce(shown(road["zipcode"]), shown(lot["zipcode"])).alias("zipcode"))


def axis(theirs: Column, ours: Column, equal: Column) -> Column:
    """AGG20: a struct(theirs, ours, eq); eq is null unless both sides are there."""
    return F.struct(theirs.alias("theirs"), ours.alias("ours"), F.when(theirs.isNotNull() & ours.isNotNull(), equal).alias("eq"))


def rescored(pairs: DataFrame, corrections: DataFrame | None = None) -> DataFrame:
    """SCR1: pairs (no, expected, actual) with matches without rules (base_ok) and with them (rule_ok); ``corrections`` (no, expected_fixed) go ahead."""
    df = pairs
    if corrections is not None:
        df = df.join(corrections.select("no", "expected_fixed"), "no", "left").withColumn("expected", F.coalesce("expected_fixed", "expected")).drop("expected_fixed")
    base = (text.address_base(F.col("expected")) == text.address_base(F.col("actual"))) & (text.address_base(F.col("expected")) != "")
    ruled = (text.lot_address(F.col("expected")) == text.lot_address(F.col("actual"))) & (text.lot_address(F.col("expected")) != "")
    return df.withColumn("base_ok", base).withColumn("rule_ok", ruled)


def rule_checks(scored: DataFrame) -> DataFrame:
    """SCR1: one row: rules lose no match (monotonic), and how many different expected texts they make one (collisions)."""
    lost = scored.agg(F.count_if(F.col("base_ok") & ~F.col("rule_ok")).alias("lost"), F.count_if("base_ok").alias("base"), F.count_if("rule_ok").alias("ruled"))
    forms = scored.groupBy(text.lot_address(F.col("expected")).alias("form")).agg(F.countDistinct(text.address_base(F.col("expected"))).alias("k"))
    return lost.crossJoin(forms.agg(F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("k") - 1)), F.lit(0)).alias("collisions")))


def truth_verdict(samples: DataFrame) -> DataFrame:
    """SCR2: one row on samples (lon, lat, our_lon, our_lat): the share closer than 0.5 m says the truth is our own; too few, or a common offset over 50 m, leave it open."""
    d = geo.haversine(F.col("lon"), F.col("lat"), F.col("our_lon"), F.col("our_lat"), geo.R_MEAN)
    df = samples.withColumn("_d", d)
    east = (F.col("our_lon") - F.col("lon")) * 111320.0 * F.cos(F.radians("lat"))
    north = (F.col("our_lat") - F.col("lat")) * 110540.0
    one = df.agg(
        F.count(F.lit(1)).alias("n"), F.count("_d").alias("effective"), rate(F.count_if(F.col("_d") < 0.5), F.count("_d")).alias("self_pct"),
        F.hypot(F.avg(east), F.avg(north)).alias("systematic"), F.percentile("_d", 0.5).alias("p50"),
    )
    verdict = F.when(F.col("self_pct") >= 5, "fail").when((F.col("effective") < 0.5 * F.col("n")) | (F.col("systematic") > 50), "inconclusive").when(F.col("effective") == 0, "inconclusive").otherwise("pass")
    return one.withColumn("verdict", F.coalesce(verdict, F.lit("inconclusive")))


def drift_verdict(runs: DataFrame, total: tuple[float, float] = (0.9, 1.1), least_p10: float = 0.7, most_failed: float = 0.05) -> DataFrame:
    """RTE4: one row on route pairs (before, after; null: failed): the ratio of totals, the nearest-rank tenth percentile of ratios, the share of new failures, and a verdict."""
    ok = runs.where("before IS NOT NULL AND after IS NOT NULL AND before > 0").withColumn("_ratio", F.col("after") / F.col("before"))
    ranked = ok.withColumn("_r", F.row_number().over(Window.orderBy("_ratio"))).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
    p10 = ranked.agg(F.min(F.when(F.col("_r") >= F.ceil(0.1 * F.col("_n")), F.col("_ratio"))).alias("p10"))
    sums = ok.agg((F.sum("after") / F.sum("before")).alias("total_ratio"))
    failed = runs.agg((F.count_if("before IS NOT NULL AND after IS NULL") / F.nullif(F.count("before"), F.lit(0))).alias("fail_ratio"))
    one = sums.crossJoin(p10).crossJoin(failed)
    good = F.col("total_ratio").between(*total) & (F.col("p10") >= least_p10) & (F.col("fail_ratio") <= most_failed)
    return one.withColumn("verdict", F.when(F.coalesce(good, F.lit(False)), "pass").otherwise("fail"))


def parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """AGG21: by query two result lists (qid, ids): Jaccard and agreement of the first."""
    from placewise.operators.aggregates import jaccard, top1_agreement

    j = a.select("qid", F.col("ids").alias("_a")).join(b.select("qid", F.col("ids").alias("_b")), "qid", "full")
    x, y = (F.coalesce(c, F.array().cast("array<string>")) for c in ("_a", "_b"))
    return j.select("qid", jaccard(x, y).alias("jaccard"), top1_agreement(x, y).alias("top1"))


def membership_transitions(before: DataFrame, after: DataFrame) -> DataFrame:
    """AGG15: counts of (before, after) of points' containing parcel: same, other, gained, lost, none."""
    j = before.select("id", F.col("pid").alias("x")).join(after.select("id", F.col("pid").alias("y")), "id", "full")
    kind = F.when(F.col("x").isNull() & F.col("y").isNull(), "none").when(F.col("x").isNull(), "gained").when(F.col("y").isNull(), "lost").when(F.col("x") == F.col("y"), "same").otherwise("other")
    return j.groupBy(kind.alias("transition")).agg(F.count(F.lit(1)).alias("n"))


