from placewise import queries


def expected(k):
    code = {0: "28", 1: "46", 2: "29", 3: "11"}[k % 4] + f"{k:08d}"
    if code[:2] == "28":
        return "281" + code[3:]
    if code[:2] in ("46", "29"):
        return "9999999999" if k % 7 == 0 else "12" + code[2:] if k % 2 == 0 else code
    return code


def test_both_eight_digit_tables_are_used(spark, tmp_path, monkeypatch):
    spark.range(1, 1000).withColumnRenamed("id", "c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    given, whole = [], queries.codes.remap_codes
    monkeypatch.setattr(queries.codes, "remap_codes", lambda *args: given.append(args) or whole(*args))
    rows = queries.code_remap(spark, str(tmp_path)).collect()
    assert {r.c_custkey: r.remapped for r in rows} == {k: expected(k) for k in range(1, 1000)} and len(rows) == 999
    renumbered, merged = given[0][3:5]
    assert renumbered.count() and merged.count()
