"""Each query of the package against its SQL on DuckDB, and orderless: the same rows over other partitions."""

import math
import os

import duckdb
import pytest

import symbolith.plans.resolve_queries  # noqa: F401
import symbolith.plans.shape_queries  # noqa: F401
import symbolith.plans.tree_queries  # noqa: F401
from symbolith.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


def plain(frame):
    def value(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        if isinstance(v, bool) or not hasattr(v, "__float__"):
            return str(v)
        return round(float(v), 9)

    columns = sorted(frame.columns)
    return columns, sorted(repr(tuple(map(value, r))) for r in frame[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = plain(QUERIES[name](spark, SF).toPandas())
    if name in ORACLE_SQL:
        assert got == plain(duck.execute(ORACLE_SQL[name]).df())
    else:
        assert got[1]


@pytest.mark.parametrize("name", ["q01_top_predictions", "q06_numbering_with_ranks", "q21_delegation", "q24_voting_sf"])
def test_order_does_not_matter(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        found = []
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(plain(QUERIES[name](spark, SF).toPandas()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]
