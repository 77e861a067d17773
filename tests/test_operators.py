import math

import numpy as np
import pytest
from placewise.operators import aggregates as agg
from placewise.operators import control, gates, measure, publish, relational, resolution, reverse, search, spatial, tiles
from pyspark.sql import functions as F

RING = "array<struct<x:double,y:double>>"


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def square(x, y, size=1.0):
    return ring((x, y), (x + size, y), (x + size, y + size), (x, y + size))


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_keeps_and_samples(spark):
    df = spark.createDataFrame([(1, "a", 3), (1, "b", 2), (2, "c", 1), (3, "d", 1), (3, "e", 1)], "k int, v string, t int")
    assert rows(relational.keep_first(df, ["k"], [F.col("t"), F.col("v")]), "k", "v") == [(1, "b"), (2, "c"), (3, "d")]
    assert rows(relational.unambiguous(df, ["k"], "t", [F.col("t"), F.col("v")]), "k", "v") == [(1, "b"), (2, "c")]
    assert relational.hashed_sample(df, "k", "v", 1).count() == 3
    assert rows(relational.with_primary(df, ["k"], [F.col("v")]), "v", "is_primary") == [("a", 1), ("b", 0), ("c", 1), ("d", 1), ("e", 0)]


def test_composite_join_counts(spark):
    build = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "k string, b int")
    lots = spark.createDataFrame([("x", "second", 2), ("x", "first", 1), ("y", "only", 1)], "k string, lot string, line int")
    matched, counts = relational.composite_key_join(build, lots, ["k"], [F.col("line")])
    assert rows(matched, "k", "lot") == [("x", "first"), ("y", "only")] and tuple(counts.first()) == (2, 1, 1)


def test_codes_over_time(spark):
    codes = spark.createDataFrame([("2811010100", None, "20240101"), ("2812510100", "2811010100", ""), ("2811010200", None, ""), ("2811010300", "2811010200", "")], "code string, old_code string, deleted string")
    assert rows(relational.code_history(codes), "old_code", "new_code") == [("2811010100", "2812510100")]
    old, new = spark.createDataFrame([("1", "옛도 가시")], "code string, name string"), spark.createDataFrame([("9", "새도 가시")], "code string, name string")
    assert rows(relational.tail_name_join(old, new), "old_code", "new_code") == [("1", "9")]


def test_regions_and_reasons(spark):
    p = spark.createDataFrame([("서울특별시",)], "sido string")
    df = spark.createDataFrame([("서울특별시", "중구"), ("서울틀별시", "중구"), (None, "x")], "sido string, sigungu string")
    assert rows(relational.blank_invalid(df, p), "sido", "sigungu", "bad_region") == [("", "", True), ("서울특별시", "중구", False), (None, "x", False)]
    cats = spark.createDataFrame([("old", None, "s"), ("keep", "k", "t")], "cat1 string, cat2 string, subtype string")
    table = spark.createDataFrame([("old", "s", "new", " ")], "cat1 string, subtype string, new_cat1 string, new_cat2 string")
    assert rows(relational.crosswalk(cats, table), "cat1", "cat2") == [("keep", "k"), ("new", None)]
    assert rows(relational.union_minus(df.limit(1), df, ["sido"]), "sido") == [("서울특별시",), ("서울틀별시",), (None,)]


def test_estimates(spark):
    obs = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1)], "s string, y int")
    pop = spark.createDataFrame([("a",)] * 30 + [("b",)] * 10 + [("c",)] * 60, "s string")
    est = agg.poststratified(obs, pop, "s", F.col("y") == 1).first()
    assert est.rate == pytest.approx(0.75 * 0.5 + 0.25) and est.deff == pytest.approx(2 * (0.75**2 + 0.25**2)) and est.n == 3
    sweep = agg.threshold_sweep(spark.createDataFrame([(0.9, 1), (0.7, 0), (0.4, 1)], "s double, y int"), "s", "y", [0.3, 0.5, 0.95])
    assert [(r.tau, r.tp, r.fp, r.fn) for r in sweep.orderBy("tau").collect()] == [(0.3, 2, 1, 0), (0.5, 1, 1, 1), (0.95, 0, 0, 2)]
    assert agg.best_threshold(sweep, 0.6).first().tau == 0.3 and sweep.where("tau > 0.9").first().precision is None
    assert spark.range(1).select(agg.rate(F.lit(0), F.lit(0)).alias("r"), agg.jaccard(F.array(F.lit(1)), F.array(F.lit(1), F.lit(2))).alias("j")).first() == (None, 0.5)


def test_overlap_and_containment(spark):
    new = spark.createDataFrame([(1, square(0, 0)), (2, square(0.95, 0)), (3, square(5, 5))], f"id int, ring {RING}")
    old = spark.createDataFrame([(9, square(0.5, 0))], f"oid int, oring {RING}")
    assert rows(spatial.overlap_anti_join(new, old, 1.0), "id") == [(3,)]
    areas = spark.createDataFrame([(1, [square(0, 0)]), (2, [square(2, 2)])], f"area_id int, rings array<{RING}>")
    points = spark.createDataFrame([(0.5, 0.5), (0.6, 0.5), (0.7, 0.5), (2.5, 2.5)], "x double, y double")
    assert rows(spatial.few_contained(areas, points, 1.0, 3), "area_id") == [(2,)]


def test_dissolve(spark):
    areas = spark.createDataFrame([("11a", square(0, 0)), ("11b", square(1, 0)), ("22a", square(9, 9))], f"code string, ring {RING}")
    found = {r.key: r.rings for r in spatial.dissolve(areas, F.substring("code", 1, 2)).collect()}
    assert {(p.x, p.y) for p in found["11"][0]} == {(0, 0), (1, 0), (2, 0), (2, 1), (1, 1), (0, 1)} and len(found["22"][0]) == 4


def test_knn_against_brute_force(spark):
    import random

    rng = random.Random(1)
    q = [(i, rng.random() * 50, rng.random()) for i in range(20)]
    p = [(i, rng.random(), rng.random()) for i in range(30)]
    found = spatial.knn(spark.createDataFrame(q, "qid int, x double, y double"), spark.createDataFrame(p, "tid int, x2 double, y2 double"), 4, 0.1)
    expected = {(i, t, k + 1) for i, x, y in q for k, (_, t) in enumerate(sorted((math.hypot(a - x, b - y), t) for t, a, b in p)[:4])}
    assert set(rows(found, "qid", "tid", "rank")) == expected


def test_collapse(spark):
    df = spark.createDataFrame(
        [(1, 1, "스타 벅스", 127.0, 37.0), (1, 2, "스타벅스", 127.0001, 37.0), (1, 3, "스타벅스", 127.001, 37.0), (1, 4, "다른", 127.0, 37.0), (1, 5, "없음", None, None), (2, 1, "스타벅스", 127.0, 37.0)],
        "qid int, rank int, name string, lon double, lat double",
    )
    assert rows(spatial.collapse(df, 3), "qid", "rank") == [(1, 1), (1, 3), (1, 4), (2, 1)]


def test_routing_helpers(spark):
    c = spark.createDataFrame([(1, 1, 30.0, 9.0), (1, 2, 75.0, 2.0), (2, 1, 10.0, 9.0), (2, 2, 20.0, 0.0)], "qid int, rank int, dist double, drive_min double")
    assert rows(spatial.snap(c), "qid", "rank") == [(1, 2), (2, 1)]
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 5.0)], "a string, b string, cost double")
    assert ("a", "c", 2.0) in rows(spatial.shortest_paths(edges, spark.createDataFrame([("a",)], "node string"), 3), "source", "node", "cost")
    roads = spark.createDataFrame([(ring((127, 37), (127.01, 37)), "primary", 1)], f"points {RING}, highway string, oneway int")
    r = spatial.road_cost(roads, {"primary": 60.0}, 30.0).first()
    assert r.reverse_cost == -1 and r.cost == pytest.approx(r.length / 60 * 3.6)


def places_of(spark, data):
    return spark.createDataFrame([(i, n, p, x, y, b, "x") for i, n, p, x, y, b in data], "id int, name string, phone string, lon double, lat double, bld string, source string")


def test_resolution(spark):
    data = [
        (1, "가나다라 식당", "02-123-4567", 127.0, 37.0, None), (2, "가나다라식당", "021234567", 127.00001, 37.0, None), (3, "전혀다른집", "1588-0000", 127.00001, 37.0, None),
        (4, "가나다라 식당 신촌점", None, 127.0, 37.0, None), (5, "가나다라 식당 홍대점", None, 127.0, 37.0, None), (6, "먼 곳", "02-999-9999", 128.0, 37.0, None),
    ]
    scored = {(r["a"].id, r["b"].id): (r.decision, r.pr) for r in resolution.score(resolution.candidates(resolution.features(places_of(spark, data)))).collect()}
    assert scored[1, 2][0] == "AUTO" and scored[4, 5] == ("NO", 0.0) and scored[1, 3][0] == "NO" and not any(6 in k for k in scored)
    resolved, _ = resolution.resolve(places_of(spark, data), F.lit(0))
    found = {r.id: (r.cluster_id, r.is_primary) for r in resolved.collect()}
    assert found[1] == (1, 1) and found[2] == (1, 0) and found[6] == (6, 1)


PLACES = "id long, kind string, name string, sido string, sigungu string, emd string, haeng_dong string, road string, road_norm string, main_no int, sub_no int, bld string, postal string, jibun string, search_text string, is_primary int, lon double, lat double, bcode string, bd_mgt_sn string"


@pytest.fixture(scope="module")
def places(spark):
    def addr(i, emd, road, main, sub, bld, postal, jibun, x):
        return (i, "addr", bld, "서울특별시", "강남구", emd, None, road, road, main, sub, bld, postal, jibun, f"{bld or ''} {road} {jibun}".strip(), None, x, 37.5, "1168010100", f"1168010100{100000000 + i}000000")

    data = [
        addr(1, "역삼동", "테헤란로", 152, 0, "강남파이낸스센터", "06236", "역삼동 737", 127.036), addr(2, "역삼동", "테헤란로", 152, 3, None, "06237", "역삼동 737-1", 127.037),
        addr(3, "역삼동", "테헤란로", 10, 0, None, "06238", "역삼동 산 5-2", 127.03), addr(4, "대치동", "도곡로", 401, 0, "은마아파트 101동", "06284", "대치동 316", 127.06),
        (5, "station", "강남역", "서울특별시", "강남구", None, None, None, None, None, None, None, None, None, "강남역", 1, 127.027, 37.498, None, None),
        (6, "biz", "강남역 분식", None, None, None, None, None, None, None, None, None, None, None, "강남역 분식", 1, 127.0271, 37.498, None, None),
        (7, "biz", "737 카페", None, None, "역삼동", None, None, None, None, None, None, None, None, "737 카페 역삼동", 1, 127.0371, 37.5, None, None),
    ]
    return spark.createDataFrame(data, PLACES)


def test_geocode_cascade(spark, places):
    q = [(1, "서울 강남구 테헤란로 152"), (2, "테헤란로 999"), (3, "06284"), (4, "역삼동 737"), (5, "강남역"), (6, "은마아파트 101동"), (7, "역삼동 산 5-2"), (8, "없는동 1-1"), (9, "강남"), (10, "테헤란로 152-9")]
    found = search.geocode(spark.createDataFrame(q, "qid int, text string"), places).collect()
    by = {}
    for r in sorted(found, key=lambda r: (r.qid, r["rank"])):
        by.setdefault(r.qid, []).append((r.id, r.score))
    assert by[1] == [("1", 212)] and {s for _, s in by[2]} == {110} and len(by[2]) == 3
    assert by[3] == [("4", 180)] and by[4][0][0] == "1" and [i for i, _ in by[4]] == ["1", "2"]
    assert by[5][0] == ("5", 205) and by[6] == [("4", 195)] and by[7] == [("3", 200)]
    assert 8 not in by and by[9][0][0] == "5" and [s for _, s in by[10]] == [150, 150]


def test_geocode_answers_a_text_once(spark, places, monkeypatch):
    """Queries of one text have one search, and each its answers."""
    walked = []
    monkeypatch.setattr(search, "collapse", lambda df, limit: walked.append(df) or spatial.collapse(df, limit))
    q = spark.createDataFrame([(4, "역삼동 737"), (9, "역삼동 737"), (2, "06284"), (7, "역삼동 737"), (8, None), (6, None)], "qid int, text string")
    found = search.geocode(q, places)
    assert rows(found, "qid", "rank", "id") == [(2, 1, "4")] + [(k, r, i) for k in (4, 7, 9) for r, i in ((1, "1"), (2, "2"))]
    assert {r.qid for r in walked[0].select("qid").distinct().collect()} == {2, 4}


def test_parcel_tier(spark, places):
    parcels = spark.createDataFrame(
        [("p1", "11680101", "1168010100107370000", 737, 0, 0, 127.03, 37.5), ("p2", "11680101", "1168010100107370004", 737, 4, 0, 127.04, 37.5), ("p3", "26680101", "2668010100107370000", 737, 0, 0, 129.0, 35.0), ("p4", "11680101", "1168010100207370000", 737, 0, 1, 127.05, 37.5)],
        "pid string, emd_cd string, pnu string, ji_main int, ji_sub int, p_san int, lon double, lat double",
    )
    d = {
        "districts": spark.createDataFrame([("11680101", "역삼동"), ("26680101", "역삼동")], "emd8 string, emd string"), "villages": spark.createDataFrame([], "emd8 string, ri string, ri2 string"),
        "counties": spark.createDataFrame([("11680", "강남구")], "sgg string, name string"), "provinces": spark.createDataFrame([("11", "서울"), ("26", "부산")], "sido string, name string"),
    }
    q = spark.createDataFrame([(1, "서울 역삼동 737"), (2, "강남구 역삼동 737-5"), (3, "역삼동 산 737"), (4, "대전 역삼동 737")], "qid int, text string")
    found = search.geocode(q, places.where("kind <> 'addr'"), parcels, d).collect()
    by = {}
    for r in sorted(found, key=lambda r: (r.qid, r["rank"])):
        by.setdefault(r.qid, []).append((r.id, r.score, r.approx))
    assert [x[0] for x in by[1]] == ["p1", "p4"] and by[2][0] == ("p2", 160, True) and [x[0] for x in by[3]] == ["p4"]
    assert {x[0] for x in by[4]} == {"p1", "p3", "p4"}


def test_narrowing(spark):
    c = spark.createDataFrame([(1, "11110101"), (1, "26110101"), (2, "11110101"), (3, "11110101")], "qid int, emd8 string")
    h = spark.createDataFrame([(1, "sgg", "26110"), (1, "sido", "26"), (3, "sido", "26")], "qid int, kind string, code string")
    assert rows(search.narrow(c, h), "qid", "emd8") == [(1, "26110101"), (2, "11110101")]


def test_reverse(spark, places):
    addresses = places.where("kind = 'addr'")
    parcels = spark.createDataFrame([("p1", "1168010100100000001", 0, 737, 1, [square(127.0355, 37.4995, 0.001)])], f"pid string, pnu string, p_san int, ji_main int, ji_sub int, rings array<{RING}>")
    areas = spark.createDataFrame([("sido", "11", [square(126, 37, 2)]), ("emd", "11680101", [square(127.03, 37.49, 0.02)])], f"level string, code string, rings array<{RING}>")
    pts = spark.createDataFrame([(1, 127.036, 37.5), (2, 127.061, 37.5), (3, 120.0, 30.0)], "qid int, x double, y double")
    found = {r.qid: r for r in reverse.reverse(pts, addresses, parcels, areas, ["sido", "emd"]).collect()}
    assert (found[1].lot, found[1].address_source, found[1].road_id, found[1].emd) == ("737-1", "pip_key", 1, "11680101")
    assert (found[2].address_source, found[2].road_id, found[2].sido, found[2].emd) == ("knn", 4, "11", None)
    assert found[3].address_source == "none" and found[3].sido is None
    near = reverse.nearest_places(pts, places.where("kind <> 'addr'"), 2)
    assert {r.qid for r in near.collect()} == {1, 2}


def test_gates(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    out = {r["name"]: (r.verdict, r.ok) for r in gates.run_checks(df, [gates.Check("rows", F.count(F.lit(1)), 2, 2), gates.Check("nulls", F.count_if(F.col("v").isNull()), 0, 0), gates.Check("open", F.count("id"))]).collect()}
    assert out == {"rows": ("PASS", True), "nulls": ("FAIL", False), "open": ("SKIP", False)}
    with pytest.raises(ValueError):
        gates.add_manual(spark.createDataFrame([("a", "b", "s")], "k string, t string, source string"), spark.createDataFrame([("c", "b", "x")], "k string, t string, source string"), "k", "t").count()
    j = gates.expectations(spark.createDataFrame([("a", 1)], "key string, value int"), spark.createDataFrame([("a", 1), ("b", 2)], "key string, value int"))
    assert rows(j, "key", "verdict") == [("a", "PASS"), ("b", "FAIL")]


def test_tiles_round_trip(spark):
    pts = spark.createDataFrame([(1, 127.0, 37.5, "가", None), (2, 127.0001, 37.5, "나", "x"), (3, -10.0, -20.0, "다", "y")], "id int, lon double, lat double, name string, kind string")
    encoded = tiles.tiles(pts, "poi", [10], ["name", "kind"], "id")
    found = sorted((r.tags["name"], r.tags.get("kind"), round(r.lon, 2), round(r.lat, 2)) for r in tiles.decoded(encoded).collect())
    assert found == [("가", None, 127.0, 37.5), ("나", "x", 127.0, 37.5), ("다", "y", -10.0, -20.0)]
    assert all(tiles.unzigzag(tiles.zigzag(n)) == n for n in (0, 1, -1, 12345, -99999)) and tiles.varints(tiles.varint(300)) == [300]
    assert '"FeatureCollection"' in tiles.collection(tiles.features(pts, ["name"])).first()[0]


def test_publication(spark, tmp_path):
    store = publish.Store(spark, str(tmp_path / "t"))
    store.publish(spark.range(3))
    gate = lambda df: gates.run_checks(df, [gates.Check("rows", F.count(F.lit(1)), 3, 10)])
    with pytest.raises(AssertionError):
        store.publish(spark.range(1), gate)
    assert store.read().count() == 3
    store.publish(spark.range(5), gate)
    assert store.read().count() == 5
    store.rollback()
    store.finalize()
    assert store.read().count() == 3


def test_upserts(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    merged, counts = publish.insert_ignore(t, spark.createDataFrame([(2, "x"), (3, "z"), (3, "c"), (None, "n")], "k int, v string"), ["k"], [F.col("v")])
    assert rows(merged, "k", "v") == [(1, "a"), (2, "b"), (3, "c")] and tuple(counts.first()) == (4, 1)
    new = spark.createDataFrame([(2, "x")], "k int, v string")
    assert rows(publish.upsert(t, new, ["k"]), "k", "v") == [(1, "a"), (2, "x")] == rows(publish.update_from(t, new, "k", "v"), "k", "v")
    done, progress = publish.backfill(t, new, "k", "v", 4)
    assert rows(done, "v") == [("a",), ("x",)] and progress.agg(F.sum("rows")).first()[0] == 1


def test_measurement(spark):
    keys = spark.createDataFrame([(1, "1168010100", False, 1, 0, None), (2, "1268010100", False, 1, 0, None), (3, "1168010100", False, 9, 9, None)], "kid int, bcode string, san boolean, main int, sub int, management string")
    parcels = spark.createDataFrame([("4668010100100010000", 1)], "pnu string, ji_main int")
    addresses = spark.createDataFrame([("1168010100", "1168010100100010000999999")], "bcode string, bd_mgt_sn string")
    assert rows(measure.existence(keys, parcels, addresses), "kid", "oracle", "relaxed") == [(1, "A", False), (2, "P", True), (3, "N", False)]
    s = spark.createDataFrame([("a", 1, 1), ("a", 2, 2)], "s string, k int, n int")
    free = measure.perturbed(s, spark.createDataFrame([("a", 1), ("a", 2), ("a", 3)], "s string, n int"), ["s"], "n")
    assert {r.perturbed for r in free.collect()} == {4}
    a = measure.reservoir(spark.range(100).withColumn("s", F.lit("x")), "s", "id", 10, "seed")
    b = measure.reservoir(spark.range(100).withColumn("s", F.lit("x")), "s", "id", 10, "seed", a)
    assert a.count() == b.count() == 10 and a.join(b, "id").count() == 0
    reply = '{"response":{"status":"OK","result":[{"type":"road","text":"길 1","zipcode":" "},{"type":"parcel","text":"동 2","zipcode":"1"}]}}'
    r = spark.createDataFrame([(reply,), ('{"response":{"status":"NOT_FOUND"}}',), (None,)], "x string").select(measure.reverse_axes(F.col("x")).alias("a")).collect()
    assert r[0].a.asDict() == {"road": "길 1", "lot": "동 2", "zipcode": "1"} and r[1].a.road is None and r[2].a.lot is None
    pairs = spark.createDataFrame([(1, "가면 산 5", "가면 산5"), (2, "나동 1", "나동 2"), (3, "", "")], "no int, expected string, actual string")
    assert rows(measure.rescored(pairs), "no", "base_ok", "rule_ok") == [(1, False, True), (2, False, False), (3, False, False)]


def test_classes_and_flags(spark):
    fields = "layer string, addresses int, oracle string, o_apx boolean, d_top1 double, d_min5 double, tolerance double, code_ours string, code_theirs string"
    cases = [
        ("jibun", 0, "N", True, None, None, 9.0, None, None), ("road", 0, "N", True, None, None, 9.0, "1100000000", ""), ("road", 1, "N", True, None, 9.0, 9.0, "1100000000", "1200000000"),
        ("road", 1, "N", True, 9.0, 9.0, 8.0, "1100000000", "1100000000"),
    ]
    found = measure.classify(spark.createDataFrame(cases, fields)).collect()
    assert [(r["class"], r.flags) for r in found] == [("3", []), ("4", []), ("6", ["F1"]), ("11", [])]


def test_control(spark, tmp_path):
    steps = [("schema", [], lambda: 1), ("load", ["schema"], lambda: 1 / 0), ("swap", ["load"], lambda: 2), ("other", [], lambda: 3)]
    assert rows(control.run_steps(spark, steps), "step", "status") == [("load", "failed"), ("other", "ok"), ("schema", "ok"), ("swap", "skipped")]
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "target string, signature string")
    was = spark.createDataFrame([("a", "0"), ("b", "2")], "target string, signature string")
    up = spark.createDataFrame([("b", "a")], "target string, needs string")
    assert rows(control.freshness(now, was, up), "target", "state") == [("a", "stale"), ("b", "stale"), ("c", "missing")]
    chain = spark.createDataFrame([("d", "b"), ("e", "d"), ("b", "a"), ("a", "e")], "target string, needs string")
    more = spark.createDataFrame([("a", "0"), ("b", "2"), ("d", "4"), ("e", "5"), ("f", "6")], "target string, signature string")
    assert [s for _, s in rows(control.freshness(more.replace("0", "1"), more, chain), "target", "state")] == ["stale"] * 4 + ["fresh"]
    twice = spark.createDataFrame([(1, "b"), (1, "c"), (None, "x"), (None, "x")], "k int, v string")
    table = spark.createDataFrame([(1, "a"), (2, "z")], "k int, v string")
    assert sorted(publish.upsert(table, twice, ["k"]).collect(), key=str) == sorted([(1, "c"), (2, "z"), (None, "x"), (None, "x")], key=str)
    (tmp_path / "f").write_text("x")
    (tmp_path / "empty").write_text("")
    store = control.Sources(str(tmp_path / "s"))
    store.snapshot("one", {"f": str(tmp_path / "f")}, 1)
    with pytest.raises(ValueError):
        store.put(str(tmp_path / "empty"))
    (store.manifests / "one").unlink()
    assert store.collect_garbage() == 1


def test_pairs_of_rows_that_share_points(spark):
    """Distances are of distinct points; rows at one point are paired, linked and searched as if each stood alone."""
    rng = np.random.default_rng(5)
    spots = [(float(x), float(y)) for x, y in rng.integers(0, 8, (12, 2)) / 10]
    rows = [(i, *spots[i % 12]) for i in range(3000)] + [(9001, 5.0, 5.0), (9002, 7.0, 7.0), (9003, 7.0, 7.0), (9004, None, 7.0), (9005, None, 7.0)]
    points = spark.createDataFrame(rows, "id int, x double, y double")
    near = lambda a, b: None not in (a[1], b[1]) and math.hypot(b[1] - a[1], b[2] - a[2]) <= 0.11
    some = [r for r in rows if r[0] % 40 < 3 or r[0] > 9000]
    found = spatial.pair_join(points.where("id % 40 < 3 OR id > 9000"), 0.11).collect()
    assert sorted((r.id, r.id2) for r in found) == sorted((a[0], b[0]) for a in some for b in some if a[0] < b[0] and near(a, b))
    assert all(r.distance == math.hypot(rows[r.id2][1] - rows[r.id][1], rows[r.id2][2] - rows[r.id][2]) for r in found if r.id2 < 3000)
    least = {p: min(i for i, *q in rows if tuple(q) == p) for p in spots}
    for _ in spots:
        least = {p: min(least[q] for q in spots if math.hypot(p[0] - q[0], p[1] - q[1]) <= 0.11) for p in spots}
    parts = {r.node: r.component for r in spatial.near_components(points, 0.11).collect()}
    assert parts == {**{i: least[spots[i % 12]] for i in range(3000)}, 9002: 9002, 9003: 9002}
    # an id that stands at two points links both
    twice = spark.createDataFrame([(5, 0.0, 0.0), (1, 0.0, 0.0), (5, 3.0, 0.0), (9, 3.1, 0.0), (7, 8.0, 0.0)], "id int, x double, y double")
    assert {r.node: r.component for r in spatial.near_components(twice, 0.11).collect()} == {1: 1, 5: 1, 9: 1}
    targets = points.selectExpr("id AS tid", "x AS x2", "y AS y2")
    got = spatial.knn(points.where("id < 24").selectExpr("id AS qid", "x", "y"), targets, 2, 0.05).select("qid", "tid", "rank").collect()
    here = {p: sorted(i for i, *q in rows if tuple(q) == p)[:2] for p in spots}
    assert sorted(map(tuple, got)) == [(q, here[spots[q % 12]][k], k + 1) for q in range(24) for k in (0, 1)]
    # lists of a class are parted by BLOCK, no pair is lost
    crowd = spark.range(700).selectExpr("CAST(id AS INT) AS id", "CAST(1.0 AS DOUBLE) AS x", "CAST(1.0 AS DOUBLE) AS y")
    assert spatial.pair_join(crowd, 0.01).distinct().count() == 700 * 699 // 2


def test_pairs_of_classes_members(spark):
    """What holds for two classes holds for all pairs of their members, each once and the lesser id first."""
    pairs = spark.createDataFrame([("a", "a", 1.0), ("a", "b", 0.5), ("b", "b", 1.0), ("c", "c", 1.0)], "k string, k2 string, sim double")
    members = spark.createDataFrame([(5, "a"), (1, "b"), (7, "a"), (9, "b"), (2, "c")], "id int, k string")
    assert rows(relational.member_pairs(pairs, members, ["k"], ["k2"]), "id", "id2", "sim") == [(1, 5, 0.5), (1, 7, 0.5), (1, 9, 1.0), (5, 7, 1.0), (5, 9, 0.5), (7, 9, 0.5)]
