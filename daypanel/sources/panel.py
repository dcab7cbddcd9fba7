"""The daily panel: one row per user and active day, absent days meaning zero."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Source column -> short name used by every operator.
COLUMNS = {
    "gmv": "gmv",
    "gmv_search": "gmvs",
    "gmv_cat": "gmvc",
    "to_ord": "ord",
    "to_cart": "cart",
    "searches": "srch",
    "search": "sev",
    "cat": "cev",
    "search_to_cart": "s2c",
    "search_to_ord": "s2o",
    "cat_to_cart": "c2c",
    "cat_to_ord": "c2o",
    "has_search_to_cart": "hs2c",
    "has_search_to_ord": "hs2o",
    "has_cat_to_cart": "hc2c",
    "has_cat_to_ord": "hc2o",
}
FLAGS = ["search", "cat", "has_search_to_cart", "has_search_to_ord", "has_cat_to_cart", "has_cat_to_ord"]
SHORT = list(COLUMNS.values())
TASK_ROWS = 1 << 15  # panel rows of one task: some tens of MB with the running sums of all blocks

SCHEMA = T.StructType(
    [T.StructField("user_id", T.LongType()), T.StructField("event_date", T.DateType())]
    + [T.StructField(c, T.DoubleType()) for c in COLUMNS]
)


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def day_range(raw: DataFrame) -> tuple[date, date]:
    """First and last date: the one row that the driver needs to name days."""
    row = raw.agg(F.min("event_date").alias("a"), F.max("event_date").alias("b")).first()
    return row["a"], row["b"]


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Partitions that hold ``TASK_ROWS`` rows each; a small panel still spreads over the cores."""
    return max(-(-rows // TASK_ROWS), min(spark.sparkContext.defaultParallelism, -(-rows // 1024)), 1)


def clustered(df: DataFrame, tasks: int) -> DataFrame:
    """Rows of a user together, in ``tasks`` partitions.

    A shuffle without a number is cut into ``spark.sql.shuffle.partitions`` or, adaptively, by its compressed bytes, so a
    task's rows, and what it sorts and spills, grow with the panel. The number goes along with the column ``user_id``, for
    later shuffles by user.
    """
    user = F.col("user_id").alias("user_id", metadata={"tasks": tasks})
    return df.repartition(tasks, "user_id").select(*[user if c == "user_id" else F.col(f"`{c}`") for c in df.columns])


def tasks_of(df: DataFrame) -> int | None:
    """The number of partitions that ``clustered`` chose for the panel behind ``df``, if it did."""
    return df.schema["user_id"].metadata.get("tasks")


def day_of(event_date: Column, first: date) -> Column:
    return F.date_diff(event_date, F.lit(first))


def date_of(day: Column, first: date) -> Column:
    return F.date_add(F.lit(first), day.cast("int"))


def as_day(d: date, first: date) -> int:
    return (d - first).days


def as_date(day: int, first: date) -> date:
    return first + timedelta(days=day)


def daily(raw: DataFrame, first: date, rows: int | None = None) -> DataFrame:
    """Rows keyed (user_id, day) with duplicates summed, flags 0/1, buy and empty-visit marks.

    ``rows``, the number of raw rows or a bound of it, decides the number of partitions; it is counted here if not given.

    Rows are clustered by user once and duplicates are added up inside that layout, which serves the
    grouping by (user, date) as well; every later operator that groups or windows within users reuses
    it and adds no shuffle.
    """
    sums = [F.sum(F.col(src).cast("double")).alias(short) for src, short in COLUMNS.items()]
    tasks = tasks_for(raw.sparkSession, raw.count() if rows is None else rows)
    summed = clustered(raw.select("user_id", "event_date", *COLUMNS), tasks).groupBy("user_id", "event_date").agg(*sums)
    return marked(summed.select("user_id", day_of(F.col("event_date"), first).alias("day"), *SHORT))


def marked(rows: DataFrame) -> DataFrame:
    quiet = (F.col("srch") == 0) & (F.col("cart") == 0) & (F.col("ord") == 0) & (F.col("sev") == 0) & (F.col("cev") == 0)
    return rows.withColumn("buy", (F.col("gmv") > 0).cast("double")).withColumn("empty", quiet.cast("double"))


def binary_flags(panel: DataFrame) -> DataFrame:
    """The six flag columns cut to 0/1, as the per-day channels read them."""
    return panel.withColumns({COLUMNS[c]: (F.col(COLUMNS[c]) > 0).cast("double") for c in FLAGS})


def check_panel(raw: DataFrame) -> DataFrame:
    """One row per stated rule with the number of violations."""
    c = F.col
    eq = lambda a, b: F.abs(a - b) <= 1e-6 * F.greatest(F.lit(1.0), F.abs(b))
    rules = {
        "order_needs_cart": c("to_ord") > c("to_cart"),
        "gmv_iff_order": (c("gmv") > 0) != (c("to_ord") > 0),
        "cart_is_channel_sum": c("to_cart") != c("search_to_cart") + c("cat_to_cart"),
        "order_is_channel_sum": c("to_ord") != c("search_to_ord") + c("cat_to_ord"),
        "gmv_is_channel_sum": ~eq(c("gmv"), c("gmv_search") + c("gmv_cat")),
        "gmv_not_negative": c("gmv") < 0,
    }
    for name in ("search_to_cart", "search_to_ord", "cat_to_cart", "cat_to_ord"):
        rules[f"flag_matches_{name}"] = (c(f"has_{name}") > 0) != (c(name) > 0)
    per_key = raw.groupBy("user_id", "event_date").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(cond.cast("long")).alias(k) for k, cond in rules.items()],
    )
    totals = per_key.agg(
        F.sum(F.col("n") - 1).alias("unique_user_day"), *[F.sum(k).alias(k) for k in rules]
    )
    names = ["unique_user_day", *rules]
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(F.col(n), F.lit(0)).alias("violations")) for n in names])
    return totals.select(F.inline(pairs))


def dense(panel: DataFrame, n_days: int, first_day: int = 0) -> DataFrame:
    """Every user on every day of ``first_day .. n_days-1``, zero-filled, ``active`` marking real rows.

    Each row spreads over the gap up to the user's next row, so there is no join and no second
    shuffle: the work is one window over rows already clustered by user. Rows outside the days count
    only in that their user has rows.
    """
    w = Window.partitionBy("user_id").orderBy("day")
    values = [c for c in panel.columns if c not in ("user_id", "day")]
    start = F.when(F.row_number().over(w) == 1, F.lit(first_day)).otherwise(F.greatest(F.col("day"), F.lit(first_day)))
    stop = F.least(F.coalesce(F.lead("day").over(w) - 1, F.lit(n_days - 1)), F.lit(n_days - 1))
    spans = panel.withColumns({"_from": start, "_to": stop}).filter("_from <= _to")
    spread = spans.withColumn("_at", F.explode(F.sequence(F.col("_from"), F.col("_to"))))
    here = F.col("_at") == F.col("day")
    return spread.select(
        "user_id",
        F.col("_at").alias("day"),
        here.cast("double").alias("active"),
        *[F.when(here, F.col(v)).otherwise(F.lit(0.0)).alias(v) for v in values],
    )
