import importlib.util

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    names, sql = set(entry.queries()), set(entry.oracle_sql())
    assert sql <= names and "pipeline_decisions" in names
    assert any(n.startswith("op1_") for n in names) == (importlib.util.find_spec("millrace.llm") is not None)


def test_catalogue_equals_its_sql(spark):
    import os

    import duckdb
    import pandas as pd

    from millrace.plans.catalogue import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    cell = lambda x: "" if pd.isna(x) else f"{x:.9g}" if isinstance(x, float) else str(x)
    rows = lambda d: sorted(tuple(map(cell, r)) for r in d[sorted(d.columns)].itertuples(index=False))
    for name, query in QUERIES.items():
        assert rows(query(spark, SF).toPandas()) == rows(con.sql(ORACLE_SQL[name]).df()), name


def test_public_names():
    import millrace

    assert all(getattr(millrace, name) is not None for name in millrace.__all__) and len(millrace.__all__) > 50
