"""Log-space blending, calibration, fitted weights and checks of prediction tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import add_all, log_pos
from .metrics import gini, quantiles


def slot_logs(members: DataFrame, slots: dict[str, list[str]]) -> DataFrame:
    """Mean log prediction of the members of each slot, one row per user with a column per slot.

    Keys are matched by the grouping itself; ``complete`` tells whether every member had the user.
    """
    value = log_pos(F.col("predict"))
    mean = lambda names: F.avg(F.when(F.col("member").isin(names), value))
    size = sum(len(names) for names in slots.values())
    used = F.col("member").isin([m for names in slots.values() for m in names])
    return members.groupBy("user_id").agg(
        *[mean(names).alias(slot) for slot, names in slots.items()],
        (F.size(F.collect_set(F.when(used, F.col("member")))) == size).alias("complete"),
    )


def blend(logs: DataFrame, weights: dict[str, float], a: float = 1.0, b: float = 0.0) -> DataFrame:
    """Weighted mean of slot logs, affine correction in log space, back to values not below 0."""
    raw = add_all([F.col(slot) * float(w) for slot, w in weights.items()])
    return logs.select(
        "user_id", raw.alias("blend_log"), (raw * a + b).alias("calibrated_log"),
        F.greatest(F.expm1(raw * a + b), F.lit(0.0)).alias("predict"),
    )


def gram(wide: DataFrame, logs: list[str], y_log: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Second moments of members and truth: the squared score of any weights follows from them."""
    names = [*logs, y_log]
    cells = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    row = wide.agg(*[F.avg(F.col(names[i]) * F.col(names[j])).alias(f"c{i}_{j}") for i, j in cells]).first()
    full = np.zeros((len(names), len(names)))
    for i, j in cells:
        full[i, j] = full[j, i] = row[f"c{i}_{j}"]
    return full[:-1, :-1], full[:-1, -1], float(full[-1, -1])


def best_weights(g: np.ndarray, c: np.ndarray, steps: int = 200) -> np.ndarray:
    """Weights >= 0 with sum 1 that minimise w'Gw - 2c'w, by moving the active set."""
    n = len(c)
    free = list(range(n))
    w = np.full(n, 1.0 / n)
    for _ in range(steps):
        k = len(free)
        lhs = np.zeros((k + 1, k + 1))
        lhs[:k, :k], lhs[:k, k], lhs[k, :k] = g[np.ix_(free, free)], 1.0, 1.0
        sol = np.linalg.lstsq(lhs, np.append(c[free], 1.0), rcond=None)[0]
        goal = np.zeros(n)
        goal[free] = sol[:k]
        if (goal >= -1e-12).all():
            w = np.maximum(goal, 0.0)
            price = g @ w - c + sol[k]
            out = [i for i in range(n) if i not in free]
            worst = min(out, key=lambda i: price[i], default=None)
            if worst is None or price[worst] >= -1e-10:
                return w / w.sum()
            free = sorted([*free, worst])
        else:
            down = [i for i in free if goal[i] < 0]
            t = min(w[i] / (w[i] - goal[i]) for i in down)
            w = w + t * (goal - w)
            free = [i for i in free if w[i] > 1e-12]
            w = np.where(np.isin(np.arange(n), free), w, 0.0)
    raise RuntimeError(f"blend weights have not settled after {steps} steps")


def fit_weights(wide: DataFrame, logs: list[str], y_log: str) -> dict[str, float]:
    """Blend weights with the lowest out-of-fold score: one aggregation, then a tiny solve."""
    g, c, _ = gram(wide, logs, y_log)
    return dict(zip(logs, best_weights(g, c)))


def probe_calibration(moments: DataFrame) -> DataFrame:
    """Affine correction from probe scores.

    ``moments`` holds rmsle_zero and rmsle_const (scores of all zeros and of a constant whose log1p is
    ``c``), rmsle_model, and the mean and spread of the model's logs.
    """
    col = F.col
    m2 = col("rmsle_zero") * col("rmsle_zero")
    mean = (m2 + col("c") * col("c") - col("rmsle_const") * col("rmsle_const")) / (2 * col("c"))
    sd = F.sqrt(m2 - mean * mean)
    rho = F.sqrt(1 - F.pow(col("rmsle_model") / sd, 2))
    a = rho * sd / col("sd_m")
    return moments.select("*", mean.alias("mean_l"), sd.alias("sd_l"), rho.alias("rho"), a.alias("a"), (mean - a * col("mean_m")).alias("b"))


def check_predictions(pred: DataFrame, expected: DataFrame, low: float = 10.0, high: float = 400.0) -> DataFrame:
    """One row per rule with its violations; ``expected`` and ``pred`` carry user_id and their order ``pos``.

    Both sides are marked and grouped by user, so keys are compared without collecting either.
    """
    p = F.col("predict")
    a = pred.select("user_id", "predict", F.col("pos").alias("p"), F.lit(1).alias("got"), F.lit(0).alias("want"), F.lit(None).cast("bigint").alias("e"))
    b = expected.select("user_id", F.lit(None).cast("double").alias("predict"), F.lit(None).cast("bigint").alias("p"),
                        F.lit(0).alias("got"), F.lit(1).alias("want"), F.col("pos").alias("e"))
    bad = F.isnan(p) | (F.abs(p) == float("inf"))
    per_user = a.unionByName(b).groupBy("user_id").agg(
        F.sum("got").alias("got"), F.sum("want").alias("want"),
        F.max("p").alias("p"), F.max("e").alias("e"),
        F.sum(F.isnan(p).cast("long")).alias("nans"),
        F.sum((~F.isnan(p) & (p < 0)).cast("long")).alias("negatives"),
        F.sum((bad & ~F.isnan(p)).cast("long")).alias("infinite"),
        F.sum(F.when(~bad, p)).alias("total"),
    )
    many = lambda cond: F.coalesce(F.sum(cond.cast("long")), F.lit(0))
    row = per_user.agg(
        F.abs(F.sum("got") - F.sum("want")).alias("row_count"),
        many((F.col("got") == 0)).alias("missing_ids"),
        many((F.col("want") == 0)).alias("extra_ids"),
        F.sum(F.greatest(F.col("got") - 1, F.lit(0))).alias("repeated_ids"),
        many((F.col("got") > 0) & (F.col("want") > 0) & (F.col("p") != F.col("e"))).alias("moved_ids"),
        F.coalesce(F.sum("nans"), F.lit(0)).alias("nan"),
        F.coalesce(F.sum("negatives"), F.lit(0)).alias("negative"),
        F.coalesce(F.sum("infinite"), F.lit(0)).alias("infinite"),
        (~(F.sum("total") / F.sum("got")).between(low, high)).cast("long").alias("scale"),
    )
    rules = ["row_count", "missing_ids", "extra_ids", "repeated_ids", "moved_ids", "nan", "negative", "infinite", "scale"]
    return row.select(F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).cast("long").alias("violations")) for r in rules])))


def moment_report(pred: DataFrame, mean_l: float, score: float) -> DataFrame:
    """Log moments, what their miss costs, concentration, total, zero share, upper tail."""
    lp = log_pos(F.col("predict"))
    plain = pred.agg(
        F.avg(lp).alias("mean_log"), F.stddev_pop(lp).alias("sd_log"), F.sum("predict").alias("total"),
        F.avg((F.col("predict") <= 1e-9).cast("double")).alias("zero_share"), F.max("predict").alias("max"),
    ).withColumn("cost", F.pow(F.col("mean_log") - mean_l, 2) / (2 * score))
    # Three tables of one row each.
    return plain.crossJoin(gini(pred, [], "predict")).crossJoin(
        quantiles(pred, [], "predict", [0.99]).select(F.col("quantile").alias("p99"))
    )


def compare_predictions(left: DataFrame, right: DataFrame, accept_corr: float = 0.999) -> DataFrame:
    """Agreement of two prediction tables in log space."""
    rows = left.select("user_id", log_pos(F.col("predict")).alias("a")).join(
        right.select("user_id", log_pos(F.col("predict")).alias("b")), "user_id"
    )
    d = F.col("a") - F.col("b")
    out = rows.agg(
        F.corr("a", "b").alias("corr"), F.sqrt(F.avg(d * d)).alias("rms"), F.max(F.abs(d)).alias("max_abs"), F.count(F.lit(1)).alias("n")
    )
    r = F.col("corr")
    return out.withColumns({"unexplained": 1 - r * r, "accepted": r >= accept_corr})


# -- binned targets ------------------------------------------------------------------------------------

def merge_edges(edges: list[float], counts: list[int], floor: int) -> list[float]:
    """Drop an edge of the emptiest bin until every bin holds ``floor`` rows or two bins are left."""
    edges, counts = list(edges), list(counts)
    while len(counts) > 2 and min(counts) < floor:
        j = counts.index(min(counts))
        into = 1 if j == 0 else j - 1
        keep, gone = min(j, into), max(j, into)
        counts[keep] += counts.pop(gone)
        edges.pop(gone)
    return edges


def target_bins(rows: DataFrame, y_log: str, k: int, upper: float = 0.999, min_share: float = 0.002) -> list[float]:
    """Uniform edges up to an upper quantile of the positives, sparse bins merged away.

    The driver sees ``k`` counts and nothing else of the data.
    """
    at = quantiles(rows.filter(F.col(y_log) > 0), [], y_log, [upper]).first()
    top = float(at["quantile"]) if at is not None else 1.0
    edges = [top * i / k for i in range(k)] + [top]
    spot = place(F.col(y_log), edges)
    counts = {r["bin"]: r["n"] for r in rows.groupBy(spot.alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()}
    per_bin = [counts.get(i, 0) for i in range(k)]
    return merge_edges(edges, per_bin, max(20, int(min_share * sum(per_bin))))


def place(value: Column, edges: list[float]) -> Column:
    """Bin of a value cut to the grid; the last bin includes its upper edge."""
    inner = F.array(*[F.lit(float(e)) for e in edges[1:-1]])
    return F.size(F.filter(inner, lambda e: e <= value))


def centres(edges: list[float]) -> list[float]:
    return [(a + b) / 2 for a, b in zip(edges, edges[1:])]


def soft_targets(rows: DataFrame, y_log: str, edges: list[float], sigma: float) -> DataFrame:
    """Add ``q``: a normal around the value, integrated over the bins and rescaled to 1."""
    n = len(edges) - 1
    cut = F.least(F.greatest(F.col(y_log), F.lit(edges[0])), F.lit(edges[-1]))
    if sigma <= 1e-9:
        spot = place(cut, edges)
        return rows.withColumn("q", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == spot).cast("double")))
    from ..functions.series import normal_steps

    return rows.withColumn("q", normal_steps(edges, sigma)(cut))


def class_prior(rows: DataFrame) -> DataFrame:
    """Log of the mean target per bin, shifted so that the largest is 0. One row per bin."""
    from pyspark.sql import Window

    mean = rows.select(F.posexplode("q").alias("bin", "v")).groupBy("bin").agg(F.avg("v").alias("mean"))
    start = F.log(F.greatest(F.col("mean"), F.lit(1e-12)))
    return mean.select("bin", "mean", (start - F.max(start).over(Window.partitionBy())).alias("init"))


def readout(probs: Column, edges: list[float]) -> Column:
    """Expected log value: bin chances times bin centres."""
    mid = F.array(*[F.lit(c) for c in centres(edges)])
    return F.aggregate(F.zip_with(probs, mid, lambda p, c: p * c), F.lit(0.0), lambda a, x: a + x)
