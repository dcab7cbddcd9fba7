"""Populations, targets, time folds, user folds, masks and training tables."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ranking import ordinal_positions
from ..sources.panel import as_day, date_of
from .blocks import build
from .windows import POPULATION_DAYS, Plan, ahead, features, target

HORIZON = 30
STRIDE = 7
GAP = 30
MIN_HISTORY = 90

SPEC = T.StructType(
    [
        T.StructField("fold_id", T.IntegerType()),
        T.StructField("valid_anchor", T.DateType()),
        T.StructField("target_window", T.ArrayType(T.DateType())),
        T.StructField("n_users", T.LongType()),
        T.StructField("zero_share", T.DoubleType()),
        T.StructField("train_anchors", T.ArrayType(T.DateType())),
    ]
)


def population(panel: DataFrame, anchors: list[int], n_days: int) -> DataFrame:
    """Users with at least one active day in the 30 days up to each anchor."""
    return features(panel, anchors, Plan(n_days), {}).select("anchor", "user_id")


# -- calendar grids: a few rows per fold, made from dates, not from users ------------------------------

def fold_calendar(spark: SparkSession, valid: list[date]) -> DataFrame:
    rows = [(k, a) for k, a in enumerate(valid)]
    return spark.createDataFrame(rows, "fold_id int, valid_anchor date")


def training_anchors(calendar: DataFrame, first: date, gap: int = GAP, stride: int = STRIDE,
                     min_history: int = MIN_HISTORY) -> DataFrame:
    """Every ``stride``-th day back from ``gap`` days before the validation anchor, oldest with enough history."""
    latest = F.date_sub("valid_anchor", gap)
    earliest = F.lit(first + timedelta(days=min_history - 1))
    steps = F.sequence(latest, earliest, F.make_interval(days=F.lit(-stride)))
    grid = calendar.filter(latest >= earliest).withColumn("train_anchor", F.explode(steps))
    return grid.withColumn("train_anchor", F.col("train_anchor").cast("date"))


def newest(grid: DataFrame, n: int) -> DataFrame:
    """The latest ``n`` training anchors of each fold."""
    w = Window.partitionBy("fold_id").orderBy(F.desc("train_anchor"))
    return grid.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def anchor_roles(grid: DataFrame, embargo: int = GAP) -> DataFrame:
    """The last anchor tunes, those far enough before it fit, the ones between are held back."""
    tune = F.max("train_anchor").over(Window.partitionBy("fold_id"))
    age = F.date_diff(tune, "train_anchor")
    role = F.when(age == 0, "tune").when(age >= embargo, "fit").otherwise("embargoed")
    return grid.withColumns({"age_days": age, "role": role})


def anchor_days(grid: DataFrame, first: date) -> list[int]:
    """Distinct anchors of a grid as day numbers. A grid holds calendar days only, never users."""
    rows = grid.select(F.date_diff("train_anchor", F.lit(first)).alias("d")).distinct().collect()
    return sorted(r["d"] for r in rows)


# -- folds -------------------------------------------------------------------------------------------

def folds(panel: DataFrame, valid: list[date], first: date, n_days: int, horizon: int = HORIZON) -> DataFrame:
    """Frozen validation rows: (fold_id, anchor_date, user_id, target)."""
    days = [as_day(a, first) for a in valid]
    rows = target(panel, days, n_days, horizon)
    fold = F.create_map(*[F.lit(v) for k, d in enumerate(days) for v in (d, k)])
    return rows.select(
        fold[F.col("anchor")].alias("fold_id"), date_of(F.col("anchor"), first).alias("anchor_date"), "user_id", "target"
    )


def fold_spec(fold_rows: DataFrame, grid: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """One row per fold with its window, size, share of zero targets and training anchors."""
    sizes = fold_rows.groupBy("fold_id", F.col("anchor_date").alias("valid_anchor")).agg(
        F.count(F.lit(1)).alias("n_users"), F.avg((F.col("target") <= 0).cast("double")).alias("zero_share")
    )
    anchors = grid.groupBy("fold_id").agg(F.sort_array(F.collect_list("train_anchor")).alias("train_anchors"))
    window = F.array(F.date_add("valid_anchor", 1), F.date_add("valid_anchor", horizon))
    return sizes.join(F.broadcast(anchors), "fold_id").select(
        "fold_id", "valid_anchor", window.alias("target_window"), "n_users", "zero_share", "train_anchors"
    )


def spec_to_json(spec: DataFrame) -> DataFrame:
    return spec.select(F.to_json(F.struct(*[f.name for f in SPEC])).alias("value"))


def spec_from_json(lines: DataFrame) -> DataFrame:
    return lines.select(F.from_json("value", SPEC).alias("s")).select("s.*")


def guard_violations(fold_rows: DataFrame, guard_start: date, first: date, horizon: int = HORIZON,
                     min_history: int = MIN_HISTORY) -> DataFrame:
    """Fold rows whose target window touches the guard zone, or whose anchor lacks history."""
    touches = F.date_add("anchor_date", horizon) >= F.lit(guard_start)
    short = F.date_diff("anchor_date", F.lit(first)) < min_history - 1
    return fold_rows.groupBy("fold_id", "anchor_date").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(touches.cast("long")).alias("touches_guard"),
        F.sum(short.cast("long")).alias("lacks_history"),
    )


def population_drift(fold_rows: DataFrame, table: DataFrame) -> DataFrame:
    """Users that are in the folds but not in the feature table, and the other way round.

    Both sides are marked and grouped once; no join is needed.
    """
    marks = fold_rows.select("anchor_date", "user_id", F.lit(1).alias("f"), F.lit(0).alias("t")).unionByName(
        table.select("anchor_date", "user_id", F.lit(0).alias("f"), F.lit(1).alias("t"))
    )
    per_user = marks.groupBy("anchor_date", "user_id").agg(F.max("f").alias("f"), F.max("t").alias("t"))
    count = lambda c: F.sum(c.cast("long"))
    return per_user.groupBy("anchor_date").agg(
        count((F.col("f") == 1) & (F.col("t") == 1)).alias("in_both"),
        count((F.col("f") == 1) & (F.col("t") == 0)).alias("only_in_folds"),
        count((F.col("f") == 0) & (F.col("t") == 1)).alias("only_in_table"),
    )


# -- training tables -----------------------------------------------------------------------------------

def stacked(panel: DataFrame, anchors: list[int], n_days: int, blocks: list[str], horizons=(HORIZON,),
            floor_days: int | None = None, keep=None) -> DataFrame:
    """Features and targets of every anchor at once: no loop and no union over anchors.

    Takes every block, floor and column choice that ``build`` takes; targets come from the aggregation
    of the projected blocks. With several horizons each row is repeated per horizon, which becomes a
    feature.
    """
    rows = build(panel, anchors, n_days, blocks, floor_days, keep,
                 lambda plan: {f"_y{h}": plan.total("gmv", ahead(h)) for h in horizons})
    cols = [c for c in rows.columns if c not in ("anchor", "user_id") and not c.startswith("_y")]
    if len(horizons) == 1:
        y = f"_y{horizons[0]}"
        return rows.withColumn("y_log", F.log1p(y)).withColumnRenamed(y, "y")
    pairs = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"_y{h}").alias("y")) for h in horizons])
    out = rows.select("anchor", "user_id", *cols, F.inline(pairs))
    return out.withColumn("y_log", F.log1p("y"))


def final_set(panel: DataFrame, anchors: list[int], n_days: int, blocks: list[str], **options) -> DataFrame:
    """Training rows of the clean anchors and, ``scored``, the rows of the last day, whose target is not known (0)."""
    rows = stacked(panel, [*anchors, n_days - 1], n_days, blocks, **options)
    scored = F.col("anchor") == n_days - 1
    known = lambda c: F.when(scored, F.lit(0.0)).otherwise(F.col(c))
    return rows.withColumns({"y": known("y"), "y_log": known("y_log"), "scored": scored})


def buyer_weight(y: Column, weight: float) -> Column:
    return F.when(y > 0, F.lit(float(weight))).otherwise(F.lit(1.0))


def decay_weight(age: Column, half_life: float) -> Column:
    return F.pow(F.lit(0.5), age / float(half_life))


STRETCHES = 1 << 14  # of the hash range of ``exact_sample``


def key_hash(seed: str, *keys: str) -> Column:
    """32 bits of md5 over the keys, as a whole number: the same on every engine and layout."""
    text = F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def exact_sample(df: DataFrame, n: int, keys: list[str], seed: str = "0") -> DataFrame:
    """Exactly ``n`` rows (or all, if fewer), chosen by a hash of the key.

    One aggregation counts rows per stretch of hashes (``STRETCHES`` numbers for the driver); only rows up to the
    stretch in which the ``n``-th lies are ranked. The rest is neither moved nor written.
    """
    width = (1 << 32) // STRETCHES
    hashed = df.withColumn("_h", key_hash(seed, *keys))
    upto = 0
    for r in sorted(hashed.groupBy(F.floor(F.col("_h") / width).alias("at")).agg(F.count(F.lit(1)).alias("n")).collect()):
        upto, bound = upto + r["n"], (r["at"] + 1) * width
        if upto >= n:
            hashed = hashed.filter(F.col("_h") < bound)
            break
    drawn = ordinal_positions(hashed, [], ["_h", *keys])
    return drawn.filter(F.col("position") <= n).select(*df.columns)


def user_fold(user: str = "user_id", salt: str = "gmv-v1", n_folds: int = 5) -> Column:
    share = key_hash(salt, user) / F.lit(float(0xFFFFFFFF))
    return F.least(F.floor(share * n_folds), F.lit(n_folds - 1)).cast("bigint")


# -- day tables on the dense grid ------------------------------------------------------------------------


def user_days():
    return Window.partitionBy("user_id").orderBy("day")


def max_anchor(n_days: int, horizon: int = HORIZON) -> int:
    """Last day whose whole target window is inside the panel."""
    return n_days - horizon - 1


def day_targets(dense: DataFrame, n_days: int, horizon: int = HORIZON, agg: str = "sum") -> DataFrame:
    """Add ``y_log``: log1p of the value of the next ``horizon`` days, 0 where the window is cut off."""
    if agg not in ("sum", "mean"):
        raise ValueError(agg)
    total = F.sum("gmv").over(user_days().rowsBetween(1, horizon))
    value = total / float(horizon) if agg == "mean" else total
    whole = F.col("day") <= max_anchor(n_days, horizon)
    return dense.withColumn("y_log", F.when(whole, F.log1p(value)).otherwise(0.0))


def day_masks(dense: DataFrame, last_anchor: int, burn_in: int = 14, from_first_seen: bool = True,
              pop_days: int = POPULATION_DAYS) -> DataFrame:
    """Add ``supervised`` (after the burn-in, up to the last anchor) and ``in_pop`` (recently active)."""
    if from_first_seen:
        first = F.min(F.when(F.col("active") > 0, F.col("day"))).over(Window.partitionBy("user_id"))
    else:
        first = F.lit(0)
    ready = (F.col("day") <= last_anchor) & (F.col("day") >= first + burn_in)
    recent = F.sum("active").over(user_days().rowsBetween(-(pop_days - 1), 0)) > 0
    return dense.withColumns({"supervised": ready, "in_pop": recent})


def calendar_role(cut: int, clean_max: int, horizon: int = HORIZON) -> Column:
    """Where a supervised day falls when the calendar is split at ``cut``."""
    day = F.col("day")
    return (
        F.when(~F.col("supervised"), "none")
        .when(day <= cut, "in_calendar")
        .when(day < cut + horizon, "embargo")
        .when(day <= clean_max, "forward_clean")
        .otherwise("forward")
    )


def capped_masks(cap: int, clean_max: int) -> dict[str, Column]:
    """Training runs to the cap; scoring stays on the clean block in every arm."""
    return {
        "train": F.col("supervised") & (F.col("day") <= cap),
        "score": F.col("supervised") & (F.col("day") <= clean_max),
    }


def strided(last_day: int, k: int) -> Column:
    """Every k-th day counted back from the last one."""
    return (F.col("day") <= last_day) & (F.pmod(F.lit(last_day) - F.col("day"), F.lit(k)) == 0)


def day_weight(last_anchor: int, half_life: float) -> Column:
    w = F.pow(F.lit(0.5), (F.lit(last_anchor) - F.col("day")) / float(half_life))
    return F.when(F.col("day") <= last_anchor, w).otherwise(0.0)


def mass_windows(cells: DataFrame, last_anchor: int, epochs: int, start: float, kind: str) -> DataFrame:
    """Day bounds per epoch that move by the number of supervised cells, not by days.

    ``cells`` holds (day, n), a row per calendar day. ``expand`` keeps the left edge and grows from the
    share ``start`` to everything; ``slide`` moves both edges with the same mass inside.
    """
    if kind not in ("expand", "slide"):
        raise ValueError(kind)
    upto = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    run = cells.filter(F.col("day") <= last_anchor).withColumn("upto", F.sum("n").over(upto))
    run = run.withColumn("before", F.col("upto") - F.col("n"))
    total = F.max("upto").over(Window.partitionBy())
    run = run.withColumn("total", total)
    steps = F.expr(f"explode(sequence(0, {epochs - 1}))")
    cap = lambda c, lo: F.least(F.greatest(F.coalesce(c, F.lit(last_anchor)), lo), F.lit(last_anchor))
    share = F.when(F.lit(epochs == 1), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.col("epoch") / float(max(epochs - 1, 1))))
    if kind == "expand":
        mass = F.col("total") * start + share * (F.col("total") - F.col("total") * start)
        at = run.withColumn("epoch", steps).groupBy("epoch").agg(
            F.min(F.when(F.col("upto") >= mass, F.col("day"))).alias("hi")
        )
        return at.select("epoch", F.lit(0).alias("lo"), cap(F.col("hi"), F.lit(0)).alias("hi"))
    rest = F.col("total") - F.col("total") * start
    edge = F.min(F.when(F.col("before") >= rest, F.col("day"))).over(Window.partitionBy())
    run = run.withColumn("lo_max", F.coalesce(edge, F.lit(last_anchor)))
    run = run.withColumn("lo_mass", F.max(F.when(F.col("day") == F.col("lo_max"), F.col("before"))).over(Window.partitionBy()))
    run = run.withColumn("epoch", steps)
    per = Window.partitionBy("epoch")
    left = F.min(F.when(F.col("before") >= share * F.col("lo_mass"), F.col("day"))).over(per)
    run = run.withColumn("lo", F.least(F.coalesce(left, F.col("lo_max")), F.col("lo_max")))
    run = run.withColumn("at_lo", F.max(F.when(F.col("day") == F.col("lo"), F.col("before"))).over(per))
    reach = F.min(F.when(F.col("upto") >= F.col("at_lo") + F.col("total") * start, F.col("day")))
    out = run.groupBy("epoch", "lo").agg(reach.alias("hi"))
    hi = F.when(share >= 1.0, F.lit(last_anchor)).otherwise(cap(F.col("hi"), F.col("lo")))
    return out.select("epoch", "lo", hi.alias("hi"))


def shuffled_epochs(windows: DataFrame, seed: str) -> DataFrame:
    """The same windows in an order fixed by a hash: a few rows, one per epoch."""
    w = Window.orderBy(key_hash(seed, "epoch"), "epoch")
    return windows.withColumn("turn", F.row_number().over(w) - 1)


def thinned(df: DataFrame, keep: float, keys: list[str], seed: str = "0") -> DataFrame:
    """Keep each cell with probability ``keep``, decided by its key."""
    return df.filter(key_hash(seed, *keys) / F.lit(float(2**32)) < keep)


def residual(y_log: Column, baseline: Column) -> Column:
    """Target as the distance from the user's own naive level, in logs."""
    return y_log - F.log1p(baseline)


def with_baseline(pred: Column, baseline: Column) -> Column:
    return pred + F.log1p(baseline)
