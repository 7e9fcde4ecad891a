"""Every query of the engine against its oracle SQL on the smallest tables."""

import pytest

from lexarena.plans.catalogue import ORACLES, QUERIES
from tests.oracle import connect, rows

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, name):
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry_contract(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_greedy_dedupe_equals_a_plain_pass(spark):
    from lexarena.operators.dedupe import accept_in_order, accept_reference

    items = spark.createDataFrame([(1, "a", "d1", 1), (2, "b", "d1", 1), (3, "b", "d2", 2), (4, "a", "d3", 3), (5, "c", "d2", 2)], "seq long, url string, date string, number int")
    found = sorted(r.seq for r in accept_in_order(items).collect())
    assert found == accept_reference(items.toPandas()) == [1, 3]
    # a chain of collisions, and nulls, which meet nothing
    chain = [(i, f"u{i // 2}", f"d{(i + 1) // 2}", 1) for i in range(14)] + [(20, None, None, None), (21, None, None, None)]
    linked = spark.createDataFrame(chain, "seq long, url string, date string, number int")
    assert sorted(r.seq for r in accept_in_order(linked).collect()) == [*range(0, 14, 2), 20, 21]
    got = sorted(r.seq for r in QUERIES["greedy_batch_dedupe"](spark, DATA).collect())
    from pyspark.sql import functions as F

    orders = spark.read.parquet(f"{DATA}/orders.parquet").select(F.col("o_orderkey").alias("seq"), F.concat_ws("/", "o_custkey", "o_orderstatus").alias("url"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderpriority").alias("number"))
    assert got == sorted(accept_reference(orders.toPandas()))


def test_recent_plans_prune_and_push_down(spark):
    df = QUERIES["recent_activity"](spark, DATA)
    plan = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters: [IsNotNull(o_orderdate)" in plan
    assert "o_totalprice" not in plan
