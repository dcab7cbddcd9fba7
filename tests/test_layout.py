"""Partitions grow with the panel, so that a task's rows do not."""

import re
from datetime import date

from pyspark.sql import functions as F

from daypanel.operators import audit as A
from daypanel.operators import blocks as B
from daypanel.sources import panel as P
from daypanel.sources import standins

FIRST = date(2020, 1, 1)


def _raw(spark, users, days):
    rows = spark.range(users * days).select(
        (F.col("id") % users).alias("user_id"), F.date_add(F.lit(FIRST), (F.col("id") / users).cast("int")).alias("event_date"))
    return rows.select("*", *[F.lit(1.0).alias(c) for c in P.COLUMNS])


def test_a_panel_has_partitions_by_its_rows(spark):
    raw = _raw(spark, 50, 40)
    assert P.tasks_of(P.daily(raw, FIRST)) == P.tasks_for(spark, 2000) == 2
    assert P.tasks_for(spark, 100 * P.TASK_ROWS) == 100 and P.tasks_for(spark, 0) == 1
    days = P.daily(raw, FIRST, 100 * P.TASK_ROWS)
    assert days.count() == 2000
    assert days.rdd.getNumPartitions() == 100  # whatever the shuffle partitions of the session, and not coalesced


def test_parts_and_worlds_keep_the_number(spark):
    days = P.daily(_raw(spark, 50, 40), FIRST, 10 * P.TASK_ROWS)
    make = lambda panel, anchors: B.build(panel, anchors, 40, ["counts", "tsfeat"])
    wide = make(days, [35])
    assert P.tasks_of(wide) == 10 and wide.rdd.getNumPartitions() == 10
    assert wide.count() == 50
    found = A.look_ahead(days, 35, make).agg(F.sum("differing"), F.max("cells"), F.max("lone_keys")).first()
    assert tuple(found) == (0, 50, 0)


def test_the_order_panel_is_dealt_by_its_rows_once(spark, tmp_path, monkeypatch):
    """Facts are dealt by user in tasks by rows, before any sum; the daily panel stays in that layout."""
    n = 5000
    at = F.date_add(F.lit(FIRST), (F.col("id") % 90).cast("int"))
    spark.range(n).select(F.col("id").alias("o_orderkey"), (F.col("id") % 300).alias("o_custkey"), at.alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(2 * n).select((F.col("id") % n).alias("l_orderkey"), F.lit("N").alias("l_returnflag"), F.lit("O").alias("l_linestatus"), at.alias("l_shipdate"),
        F.lit(1.0).alias("l_quantity"), F.lit(2.0).alias("l_extendedprice"), F.lit(0.0).alias("l_discount")).write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(P, "TASK_ROWS", 500)
    raw = standins.order_panel(spark, str(tmp_path))
    assert raw.agg(F.sum("to_ord"), F.sum("gmv")).first()[:] == (2 * n, 4.0 * n)
    days = P.daily(raw, FIRST, 3 * n)
    plan = days._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\((.*), (\d+)\)", plan)
    assert [(re.sub(r"#\d+L?", "", keys), n) for keys, n in dealt if "user_id" in keys] == [("user_id", "30")]
    assert days.agg(F.sum("ord")).first()[0] == 2 * n
