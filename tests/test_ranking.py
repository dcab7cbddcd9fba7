"""Positions over groups where one value holds most of the rows."""

import pandas as pd
from pyspark.sql import functions as F

from daypanel.functions.ranking import ordinal_positions, running_totals, share_below


def hot(spark, n=6000):
    """Group 0 holds two thirds of the rows, and value 0 two thirds of each group."""
    i = F.col("id")
    return spark.range(n).select(
        F.when(i % 3 < 2, 0).otherwise(i % 5).alias("g"),
        F.when(i % 9 < 6, F.lit(0.0)).otherwise((i % 101) / 4.0).alias("v"),
        i.alias("user_id"),
    )


def test_ordinal_positions(spark):
    df = hot(spark)
    got = ordinal_positions(df, ["g"], ["v", "user_id"]).toPandas()
    want = df.toPandas().sort_values(["g", "v", "user_id"])
    want["position"] = want.groupby("g").cumcount() + 1
    want["group_size"] = want.groupby("g")["v"].transform("size")
    both = got.sort_values(["g", "v", "user_id"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(both, want.reset_index(drop=True), check_dtype=False)


def test_hot_group_is_spread(spark):
    rows = hot(spark).repartitionByRange(8, "g", "v", "user_id").groupBy(F.spark_partition_id()).count().toPandas()
    assert rows["count"].max() < 6000 / 8 * 2


def test_running_totals_without_groups(spark):
    df = hot(spark).select("v", "user_id")
    got = running_totals(df, [], ["v", "user_id"], {"run": F.col("v")}).toPandas().sort_values(["v", "user_id"])
    assert (got["run"] - got["v"].cumsum()).abs().max() < 1e-6
    assert (got["run_all"] - got["v"].sum()).abs().max() < 1e-6


def test_share_below(spark):
    df = hot(spark)
    got = share_below(df, ["g"], "v", ["g", "user_id"]).toPandas().set_index("user_id")["share"]
    pdf = df.toPandas().set_index("user_id")
    want = (pdf.groupby("g")["v"].rank(method="min") - 1) / pdf.groupby("g")["v"].transform("size")
    assert (got.sort_index() - want.sort_index()).abs().max() < 1e-12
