import sys

import pytest


def test_without_the_optional_subpackage(monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "placewise.llm.queries", None)
    assert "knn_topk" in entry.queries() and not any(k.startswith("op1") for k in entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["tiered_lookup", "conditional_rates", "dual_window_unambiguous", "pip_areas", "existence_oracle", "file_periods", "address_regions", "place_names"])
def test_queries_against_sql(spark, name):
    import duckdb
    from placewise.address_queries import QUERIES, SQL

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    mine = QUERIES[name](spark, sf).toPandas()
    theirs = con.sql(SQL[name]).df()
    rows = lambda df: sorted(map(repr, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).values.tolist()))
    assert sorted(mine.columns) == sorted(theirs.columns) and rows(mine) == rows(theirs)
