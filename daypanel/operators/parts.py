"""Wide tables put together from parts that were computed apart."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.panel import clustered, tasks_of

KEYS = ["anchor", "user_id"]
TASK_CELLS = 1 << 15  # anchors times columns of one share of the users; more take more tasks


@dataclass
class Part:
    """Rows (anchor, user_id, value): one struct per key, or ``several`` that are put in order.

    ``columns`` read the value, written ``{v}``. Keys that lack a part are left out unless it is ``optional``.
    """

    rows: DataFrame
    columns: dict[str, str]
    several: bool = False
    optional: bool = False

    @classmethod
    def of(cls, table: DataFrame, optional: bool = False) -> Part:
        """A table with one row per key as a part."""
        names = [c for c in table.columns if c not in KEYS]
        rows = table.select(*KEYS, F.struct(*[F.col(f"`{n}`") for n in names]).alias("value"))
        return cls(rows, {n: f"{{v}}.`{n}`" for n in names}, optional=optional)


def together(parts: list[Part], anchors: int = 1) -> DataFrame:
    """One row per key with the columns of all parts: no join, one shuffle by user and one grouping.

    The structs of all parts are stacked under names of their own. A shuffle by user brings them together
    whatever layout a part has lost on the way (Arrow columns do), and serves whatever is joined later. It has as many tasks
    as the panel, times what ``anchors`` and columns need.
    """
    named = [(f"p{i}", p) for i, p in enumerate(parts)]
    stacked = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.rows.select(*KEYS, F.col("value").alias(n)) for n, p in named]
    )
    tasks = max((tasks_of(p.rows) or 0 for p in parts), default=0)
    cells = anchors * sum(len(p.columns) for p in parts)
    met = clustered(stacked, tasks * -(-cells // TASK_CELLS)) if tasks else stacked.repartition("user_id")
    met = met.groupBy(*KEYS).agg(
        *[(F.array_sort(F.collect_list(n)) if p.several else F.first(n, ignorenulls=True)).alias(n) for n, p in named]
    )
    there = [F.size(n) > 0 if p.several else F.col(n).isNotNull() for n, p in named if not p.optional]
    met = reduce(DataFrame.filter, there, met)
    return met.selectExpr(*KEYS, *[f"{e.format(v=n)} AS `{c}`" for n, p in named for c, e in p.columns.items()])
