"""Proofs that nothing reads the future: rebuild with later days removed and compare."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.panel import clustered, tasks_of

WHOLE = -1  # the world whose panel does not end


def differing_cells(full: DataFrame, cut: DataFrame, keys: list[str], by: list[str] = (), rtol: float = 1e-9,
                    atol: float = 1e-9) -> DataFrame:
    """Per column the number of cells that differ between two tables with the same keys, plus lone keys."""
    names = [c for c in full.columns if c not in keys]
    both = full.alias("f").join(cut.alias("c"), keys, "full_outer")

    def differs(n: str) -> str:
        a, b = f"f.`{n}`", f"c.`{n}`"
        return f"(abs({a} - {b}) > {atol!r}D + {rtol!r}D * abs({b}) OR ({a} IS NULL) <> ({b} IS NULL))"

    lone = f"(f.`{names[0]}` IS NULL) <> (c.`{names[0]}` IS NULL)"
    found = {"lone_keys": lone} | {n: differs(n) for n in names}
    counts = both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cells"), *[F.expr(f"count(CASE WHEN {e} THEN 1 END) AS `{n}`") for n, e in found.items()]
    )
    rows = ", ".join(f"struct('{n}' AS feature, `{n}` AS differing)" for n in names)
    return counts.selectExpr(*by, "cells", "lone_keys", f"inline(array({rows}))")


def look_ahead(panel: DataFrame, anchors: int | list[int], make: Callable[[DataFrame, list[int]], DataFrame], rtol: float = 1e-9,
               atol: float = 1e-9) -> DataFrame:
    """Features at anchors from the whole panel against those from panels that end there, per column.

    All panels are built together, once: the whole one and one that ends at each anchor are worlds of their
    own, in which the users are (user, world). Rows of a user and anchor then meet in one grouping; only cells
    that differ are written out.
    """
    anchors = [anchors] if isinstance(anchors, int) else anchors
    ends = F.array(F.lit(WHOLE), *[F.lit(int(a)) for a in anchors])
    seen = F.filter(ends, lambda w: (w == WHOLE) | (F.col("day") <= w))
    copies = panel.withColumn("world", F.explode(seen)).withColumn("user_id", F.struct("user_id", "world")).drop("world")
    tasks = tasks_of(panel)
    if tasks:
        copies = clustered(copies, tasks * (len(anchors) + 1))
    made = make(copies, anchors).filter(F.col("user_id.world").isin(WHOLE) | (F.col("user_id.world") == F.col("anchor")))
    names = [c for c in made.columns if c not in ("anchor", "user_id")]
    cells = F.array(*[F.col(f"`{n}`").cast("double") for n in names])
    whole = F.col("user_id.world") == WHOLE
    met = made.select("anchor", F.col("user_id.user_id").alias("user"), whole.alias("whole"), cells.alias("x"))
    met = met.groupBy("anchor", "user").agg(*[F.first(F.when(side, F.col("x")), ignorenulls=True).alias(n) for n, side in (("f", F.col("whole")), ("c", ~F.col("whole")))])

    def differs(a, b):
        return ((F.abs(a - b) > atol + rtol * F.abs(b)) | (a.isNull() != b.isNull())) & F.col("f").isNotNull() & F.col("c").isNotNull()

    bad = F.filter(F.zip_with("f", "c", lambda a, b: F.coalesce(differs(a, b), F.lit(False))), lambda x: x)
    spots = F.filter(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda i: F.coalesce(differs(F.col("f")[i], F.col("c")[i]), F.lit(False)))
    met = met.select((F.col("f").isNull() != F.col("c").isNull()).cast("int").alias("lone"), F.when(F.size(bad) > 0, spots).otherwise(F.slice(spots, 1, 0)).alias("spots"))
    # -1 stands for the pairs, -2 for those without a partner.
    listed = F.concat(F.array(F.lit(-1)), F.when(F.col("lone") == 1, F.array(F.lit(-2))).otherwise(F.array().cast("array<int>")), "spots")
    counts = met.select(F.explode(listed).alias("i")).groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.agg(F.map_from_entries(F.collect_list(F.struct("i", "n"))).alias("n"))  # a row per column at most
    at = lambda i: F.coalesce(F.try_element_at("n", i), F.lit(0))
    listed = F.split(F.lit("\n".join(names)), "\n")
    rows = F.transform(listed, lambda n, i: F.struct(n.alias("feature"), at(i).alias("differing")))
    return counts.select(at(F.lit(-1)).alias("cells"), at(F.lit(-2)).alias("lone_keys"), F.inline(rows))


def causality(dense: DataFrame, probes: list[int], make: Callable[[DataFrame], DataFrame], **tol) -> DataFrame:
    """Channels up to each probe day from the whole grid against those from a grid emptied after it.

    The emptied grids of all probes are built together, as if each were users of its own.
    """
    values = [c for c in dense.columns if c not in ("user_id", "day")]
    listed = F.array(*[F.lit(int(t)) for t in probes])
    copies = dense.withColumn("probe", F.explode(listed))
    copies = copies.withColumns({c: F.when(F.col("day") <= F.col("probe"), F.col(c)).otherwise(F.lit(0.0)) for c in values})
    copies = copies.withColumn("user_id", F.struct("user_id", "probe")).drop("probe")
    tasks = tasks_of(dense)
    made = make(clustered(copies, tasks * len(probes)) if tasks else copies)
    channels = [c for c in made.columns if c not in ("user_id", "day")]
    cut = made.select(F.col("user_id.probe").alias("probe"), F.col("user_id.user_id").alias("user_id"), "day", *channels)
    full = make(dense).withColumn("probe", F.explode(F.filter(listed, lambda t: t >= F.col("day"))))
    keys = ["probe", "user_id", "day"]
    return differing_cells(full, cut.filter(F.col("day") <= F.col("probe")), keys, by=["probe"], **tol)
