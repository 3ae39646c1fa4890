import importlib
from collections import Counter

import pytest

from quillspark.plans import catalog, published, stateful, topics

from .compare import DATA, same


QUERIES, ORACLE_SQL = catalog.QUERIES | published.QUERIES | topics.QUERIES | stateful.QUERIES, catalog.ORACLE_SQL | published.ORACLE_SQL | topics.ORACLE_SQL | stateful.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, name):
    same(QUERIES[name](spark, DATA), ORACLE_SQL[name])


def test_popular_order_all_has_every_id_in_order(spark):
    data = f"{DATA}/../sf0.01"
    got = [(r.id, r.n) for r in catalog.QUERIES["popular_order_all"](spark, data).collect()]
    ids = [r.user_id for r in spark.read.parquet(f"{data}/events.parquet").select("user_id").collect()]
    assert got == sorted(Counter(ids).items(), key=lambda x: (-x[1], x[0])) and len(got) == 150


def test_entry_has_every_query(spark):
    entry = importlib.import_module("__spark_entry__")
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_day_filter_reaches_the_scan(spark):
    plan = catalog.QUERIES["day_filter"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan
