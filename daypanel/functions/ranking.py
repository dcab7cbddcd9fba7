"""Positions and running totals over ordered groups of any size.

``Window.orderBy`` sends a whole group to one task. Here the rows are range-partitioned on
(group, order), each partition is summed, the few partition sums are accumulated and handed back, and
the running total continues inside the partitions. A group that holds most of the data is spread over
as many partitions as it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import cut


def running_totals(df: DataFrame, group: list[str], order: list[str], measures: dict[str, Column]) -> DataFrame:
    """Add ``<name>`` (total up to and with this row) and ``<name>_all`` (group total) per measure.

    ``order`` must be unique within a group. The partitioned rows are checkpointed, because the
    range bounds are sampled and both readers below have to see the same ones.
    """
    names = list(measures)
    spread = df.withColumns({f"_{n}": m for n, m in measures.items()}).repartitionByRange(*group, *order)
    rows = cut(spread.withColumn("_part", F.spark_partition_id()))
    sums = rows.groupBy(*group, "_part").agg(*[F.sum(f"_{n}").alias(f"_s_{n}") for n in names])
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    # At most (partitions + groups) rows: a group shares a partition only at its two ends.
    offsets = sums.select(
        *group, "_part",
        *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in names],
        *[F.sum(f"_s_{n}").over(whole).alias(f"{n}_all") for n in names],
    )
    inside = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({f"_run_{n}": F.sum(f"_{n}").over(inside) for n in names})
    joined = local.join(F.broadcast(offsets), [*group, "_part"]) if group else local.join(F.broadcast(offsets), ["_part"])
    return joined.select(
        *df.columns,
        *[(F.col(f"_before_{n}") + F.col(f"_run_{n}")).alias(n) for n in names],
        *[F.col(f"{n}_all") for n in names],
    )


def ordinal_positions(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``position`` 1..n within the group in the given (unique) order, and ``group_size``."""
    out = running_totals(df, group, order, {"position": F.lit(1).cast("long")})
    return out.withColumnRenamed("position_all", "group_size")


def value_counts(df: DataFrame, group: list[str], value: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """Equal values folded into one row with their count before anything is ordered."""
    extra = extra or {}
    return df.groupBy(*group, value).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(e).alias(k) for k, e in extra.items()]
    )


def share_below(df: DataFrame, group: list[str], value: str, keep: list[str]) -> DataFrame:
    """Share of the group that is strictly lower than each row; ties share a value.

    The join back is on (group, value). A value that very many rows share (zero, usually) is one
    row on the right side, so the adaptive skew join can split the left side freely.
    """
    ordered = running_totals(value_counts(df, group, value), group, [value], {"upto": F.col("n")})
    below = ordered.select(*group, value, ((F.col("upto") - F.col("n")) / F.col("upto_all")).alias("share"))
    return df.select(*keep, *[c for c in (*group, value) if c not in keep]).join(below, [*group, value])
