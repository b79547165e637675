"""The registered queries against their DuckDB SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quillmark.plans import catalog

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(rows):
    tidy = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(tidy(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", [n for n in catalog.queries() if n in catalog.oracle_sql()])
def test_query_equals_its_oracle(spark, duck, name):
    df = catalog.queries()[name](spark, DIR)
    got = duck.sql(catalog.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(got.columns)
    want = [tuple(float(v) if type(v).__name__ == "Decimal" else v for v in r) for r in duck.sql(f"select {', '.join(columns)} from ({catalog.oracle_sql()[name]})").fetchall()]
    assert plain(tuple(r) for r in df.select(*columns).collect()) == plain(want)


def test_entry_answers(spark):
    rows = entry.entry(spark).collect()
    assert rows and {r.doctype_id for r in rows} & {"unknown", "prose_en"}
    assert set(entry.oracle_sql()) <= set(entry.queries())
