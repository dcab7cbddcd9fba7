"""Panels derived from the order and event tables, in the raw panel schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .panel import COLUMNS, tasks_for

VALUES = list(COLUMNS)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _close(found: DataFrame, rows: int) -> DataFrame:
    """Sum facts to user-days and add the columns that follow from the sums.

    ``rows`` facts are dealt by user as ``panel.daily`` deals them, which then needs no shuffle of its own. Days repeat
    too little for sums before the shuffle to save anything.
    """
    found = found.repartition(tasks_for(found.sparkSession, rows), "user_id")
    names = ["gmv_search", "gmv_cat", "searches", "search", "cat",
             "search_to_cart", "search_to_ord", "cat_to_cart", "cat_to_ord"]
    rows = found.groupBy("user_id", "event_date").agg(
        *[(F.max(n) if n in ("search", "cat") else F.sum(n)).cast("double").alias(n) for n in names]
    )
    rows = rows.withColumns({n: F.round(n, 4) for n in ("gmv_search", "gmv_cat")})
    rows = rows.withColumns(
        {
            "gmv": F.round(F.col("gmv_search") + F.col("gmv_cat"), 4),
            "to_ord": F.col("search_to_ord") + F.col("cat_to_ord"),
            "to_cart": F.col("search_to_cart") + F.col("cat_to_cart"),
            **{f"has_{n}": (F.col(n) > 0).cast("double") for n in names[5:]},
        }
    )
    return rows.select("user_id", "event_date", *VALUES)


def order_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Lines dated by shipping, plus an activity-free row for each order date."""
    lines = _table(spark, folder, "lineitem").select(
        "l_orderkey", "l_returnflag", "l_linestatus", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount"
    )
    orders = _table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    sold, carted = F.col("l_returnflag") == "N", F.col("l_returnflag").isin("N", "R")
    value = F.col("l_extendedprice") * (1 - F.col("l_discount"))

    def per_channel(status: str, search: str) -> list:
        here = F.col("l_linestatus") == status
        num = lambda cond: cond.cast("double")
        return [
            F.when(here & sold, value).otherwise(0.0).alias(f"gmv_{search}"),
            num(here).alias(search),
            num(here & carted).alias(f"{search}_to_cart"),
            num(here & sold).alias(f"{search}_to_ord"),
        ]

    acts = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_shipdate").cast("date").alias("event_date"),
        F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(0.0).alias("searches"),
        *per_channel("O", "search"),
        *per_channel("F", "cat"),
    )
    visits = orders.select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderdate").cast("date").alias("event_date")
    )
    return acts.unionByName(visits, allowMissingColumns=True).fillna(0.0)


def event_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Events by day; the parity of ``props.k`` names the channel."""
    ev = _table(spark, folder, "events")
    odd = F.get_json_object("props", "$.k").cast("long") % 2 == 1
    kind = F.col("event_type")
    bought, carted = kind == "purchase", kind.isin("purchase", "click")
    seen = kind.isin("view", "click", "purchase")

    def per_channel(here, name: str) -> list:
        num = lambda cond: cond.cast("double")
        return [
            F.when(here & bought, F.col("value")).otherwise(0.0).alias(f"gmv_{name}"),
            num(here & seen).alias(name),
            num(here & carted).alias(f"{name}_to_cart"),
            num(here & bought).alias(f"{name}_to_ord"),
        ]

    return ev.select(
        "user_id",
        F.col("ts").cast("date").alias("event_date"),
        ((kind == "view") & ~odd).cast("double").alias("searches"),
        *per_channel(~odd, "search"),
        *per_channel(odd, "cat"),
    )


def most_rows(spark: SparkSession, folder: str, kind: str) -> int:
    """Facts behind a panel, which has no more rows: read from the files' footers."""
    return sum(_table(spark, folder, name).count() for name in {"order": ("lineitem", "orders"), "event": ("events",)}[kind])


FACTS = {"order": order_facts, "event": event_facts}


def panel_of(spark: SparkSession, folder: str, kind: str, rows: int | None = None) -> DataFrame:
    """A stand-in panel; ``rows`` are its facts, counted here if not given."""
    return _close(FACTS[kind](spark, folder), most_rows(spark, folder, kind) if rows is None else rows)


def order_panel(spark: SparkSession, folder: str) -> DataFrame:
    return panel_of(spark, folder, "order")


def event_panel(spark: SparkSession, folder: str) -> DataFrame:
    return panel_of(spark, folder, "event")
