"""Forecast scores and where their error comes from.

Every function groups by the given columns (folds, models, nothing) and stays an aggregation: what
needs an order over all rows first folds equal values together and then runs over range partitions.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import log_pos
from ..functions.ranking import running_totals, value_counts
from ..functions.session import cut


def squared_log_error(y: str, pred: str) -> Column:
    d = F.log1p(F.col(y)) - log_pos(F.col(pred))
    return d * d


def rmsle(y: str, pred: str) -> Column:
    """Root mean squared log error; only the prediction is clipped at 0."""
    return F.sqrt(F.avg(squared_log_error(y, pred)))


def total_rel_err(y: str, pred: str) -> Column:
    """Relative error of the total, not a number where the truth adds up to 0."""
    total = F.sum(y)
    return F.when(total == 0, F.lit(float("nan"))).otherwise(F.sum(F.greatest(F.col(pred), F.lit(0.0))) / total - 1)


def rmspe(y: str, pred: str, eps: float = 1.0) -> Column:
    e = (F.col(y) - F.greatest(F.col(pred), F.lit(0.0))) / F.greatest(F.col(y), F.lit(eps))
    return F.sqrt(F.avg(e * e))


def gini(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Concentration of ``value`` within each group, 0 where its sum is not positive."""
    ordered = running_totals(value_counts(df, by, value), by, [value], {"upto": F.col("n")})
    # Ranks upto-n+1 .. upto belong to one value; their sum times the value is its weighted rank.
    ranks = F.col("n") * (2 * F.col("upto") - F.col("n") + 1) / 2.0
    out = ordered.groupBy(*by).agg(
        F.sum(ranks * F.col(value)).alias("w"), F.sum(F.col("n") * F.col(value)).alias("s"), F.sum("n").alias("n")
    )
    g = 2.0 * F.col("w") / (F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n")
    return out.select(*by, F.when(F.col("s") > 0, g).otherwise(0.0).alias("gini"))


def score_all(df: DataFrame, by: list[str], y: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """All tracked scores in one row per group."""
    plain = df.groupBy(*by).agg(
        rmsle(y, pred).alias("rmsle"), total_rel_err(y, pred).alias("total_rel_err"), rmspe(y, pred).alias("rmspe")
    )
    tall = df.select(
        *by,
        F.inline(F.array(
            F.struct(F.lit("pred").alias("side"), F.col(pred).alias("value")),
            F.struct(F.lit("true").alias("side"), F.col(y).alias("value")),
        )),
    )
    pick = lambda s: F.max(F.when(F.col("side") == s, F.col("gini"))).alias(f"gini_{s}")
    ginis = gini(tall, [*by, "side"], "value").groupBy(*by).agg(pick("pred"), pick("true"))
    return plain.join(ginis, by) if by else plain.crossJoin(ginis)  # without groups both have one row


def auc(df: DataFrame, by: list[str], score: str, label: Column) -> DataFrame:
    """Chance that a positive outranks a negative, ties counting half."""
    folded = value_counts(df.withColumn("_z", label.cast("long")), by, score, {"pos": F.col("_z")})
    ordered = running_totals(folded, by, [score], {"upto": F.col("n")})
    middle = F.col("upto") - (F.col("n") - 1) / 2.0
    out = ordered.groupBy(*by).agg(
        F.sum(F.col("pos") * middle).alias("r"), F.sum("pos").alias("n1"), F.sum(F.col("n") - F.col("pos")).alias("n0")
    )
    value = (F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2.0) / (F.col("n1") * F.col("n0"))
    both = (F.col("n1") > 0) & (F.col("n0") > 0)
    return out.select(*by, F.when(both, value).otherwise(F.lit(float("nan"))).alias("auc"))


def calibrated(df: DataFrame, by: list[str], y_log: Column, m_log: Column) -> DataFrame:
    """Correlation of logs, both spreads, and the score left after the best affine correction."""
    out = df.withColumns({"_l": y_log, "_m": m_log}).groupBy(*by).agg(
        F.corr("_l", "_m").alias("rho"), F.stddev_pop("_l").alias("sd_l"), F.stddev_pop("_m").alias("sd_m")
    )
    return out.withColumn("star", F.col("sd_l") * F.sqrt(1 - F.col("rho") * F.col("rho")))


def within_day(df: DataFrame, by: list[str], day: str, y_log: Column, m_log: Column) -> DataFrame:
    """Correlation after centring every day on its own mean; days with one row carry nothing."""
    per_day = df.withColumns({"_l": y_log, "_m": m_log}).groupBy(*by, day).agg(
        F.count(F.lit(1)).alias("n"), F.var_pop("_m").alias("xx"), F.var_pop("_l").alias("yy"),
        F.covar_pop("_m", "_l").alias("xy"),
    ).filter(F.col("n") >= 2)
    weigh = lambda c: F.sum(F.col("n") * F.col(c))
    out = per_day.groupBy(*by).agg(weigh("xx").alias("xx"), weigh("yy").alias("yy"), weigh("xy").alias("xy"), F.sum("n").alias("n"))
    rho = F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))
    out = out.withColumn("rho_within", F.when((F.col("xx") > 0) & (F.col("yy") > 0), rho).otherwise(F.lit(float("nan"))))
    star = F.sqrt(F.col("yy") / F.col("n")) * F.sqrt(1 - F.col("rho_within") * F.col("rho_within"))
    return out.select(*by, "rho_within", star.alias("star_within"))


def covariance_split(df: DataFrame, by: list[str], y_log: Column, m_log: Column) -> DataFrame:
    """Covariance of truth and forecast, split into buyers against the rest and size among buyers."""
    rows = df.withColumns({"_l": y_log, "_m": m_log})
    buys = F.col("_l") > 0
    mean = lambda c, cond: F.avg(F.when(cond, F.col(c)))
    only = lambda c: F.when(buys, F.col(c))
    out = rows.groupBy(*by).agg(
        F.covar_samp("_l", "_m").alias("total"),
        F.covar_samp(only("_l"), only("_m")).alias("among"),
        F.avg(buys.cast("double")).alias("p"),
        (mean("_l", buys) - mean("_l", ~buys)).alias("dl"),
        (mean("_m", buys) - mean("_m", ~buys)).alias("dm"),
        F.corr(only("_l"), only("_m")).alias("rho_buyers"),
    )
    within = F.col("p") * F.col("among")
    between = F.col("dl") * F.col("dm") * F.col("p") * (1 - F.col("p"))
    return out.select(
        *by, "total", within.alias("within"), between.alias("between"),
        F.try_divide(within, "total").alias("within_share"), F.try_divide(between, "total").alias("between_share"), "rho_buyers",
    )


def quantiles(df: DataFrame, by: list[str], value: str, probs: list[float]) -> DataFrame:
    """Exact interpolated quantiles, one row per group and probability, of groups of any size.

    Values are folded and ordered over range partitions; each keeps the ranks it covers, and only the
    two ranks around every quantile are brought together.
    """
    ordered = running_totals(value_counts(df, by, value), by, [value], {"upto": F.col("n")})
    rows = ordered.select(
        *by, F.col(value).alias("v"), (F.col("upto") - F.col("n")).alias("lo"), (F.col("upto") - 1).alias("hi"),
        (F.col("upto_all") - 1).alias("top"),
    )
    wanted = ", ".join(f"{float(q)!r}D" for q in probs)
    rows = rows.selectExpr("*", f"explode(filter(array({wanted}), q -> q * top >= lo - 1 AND q * top < hi + 1)) AS q")
    rows = rows.selectExpr("*", "floor(q * top) AS f", "least(floor(q * top) + 1, top) AS c")
    ends = rows.groupBy(*by, "q").agg(
        F.expr("max(CASE WHEN f BETWEEN lo AND hi THEN v END) AS a"),
        F.expr("max(CASE WHEN c BETWEEN lo AND hi THEN v END) AS b"),
        F.expr("max(q * top - f) AS t"),
    )
    return ends.selectExpr(*by, "q", "a + (b - a) * t AS quantile")


def bin_edges(df: DataFrame, by: list[str], x: str, bins: int) -> DataFrame:
    """The inner edges of equal-count bins as one array per group."""
    edges = quantiles(df, by, x, [k / bins for k in range(1, bins)])
    return edges.groupBy(*by).agg(F.sort_array(F.collect_list("quantile")).alias("edges"))


def bin_of(x: Column) -> Column:
    """Number of edges strictly below the value."""
    return F.size(F.filter("edges", lambda e: e < x))


def binned_mean(train: DataFrame, by: list[str], x: str, y: str, bins: int = 200) -> DataFrame:
    """Per group: edges and the mean of ``y`` in each equal-count bin of ``x``, as two arrays.

    An empty bin takes the mean of all. A group comes down to one row of ``bins`` numbers.
    """
    edges = bin_edges(train, by, x, bins)
    binned = (train.join(F.broadcast(edges), by) if by else train.crossJoin(F.broadcast(edges))).withColumn("bin", bin_of(F.col(x)))
    sums = binned.groupBy(*by, "bin").agg(F.sum(y).alias("s"), F.count(F.lit(1)).alias("n"))
    table = sums.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", F.col("s") / F.col("n")))).alias("m"),
        (F.sum("s") / F.sum("n")).alias("overall"),
    )
    means = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.col("m")[b], F.col("overall")))
    table = table.select(*by, means.alias("means"))
    return table.join(edges, by) if by else table.crossJoin(edges)


def look_up(df: DataFrame, table: DataFrame, by: list[str], x: str, name: str) -> DataFrame:
    """The binned mean at each row's ``x``."""
    small = F.broadcast(table)
    joined = df.join(small, by) if by else df.crossJoin(small)
    return joined.withColumn(name, F.col("means")[bin_of(F.col(x))]).drop("means", "edges")


def with_oracles(oof: DataFrame, by: list[str], bins: int = 200) -> DataFrame:
    """Add to rows (y_log, m_log): ``z`` buyer, ``ghat`` size given the forecast, ``phat`` chance to buy."""
    # Read by five jobs below, so its lineage is cut once.
    rows = cut(oof.withColumn("z", (F.col("y_log") > 0).cast("double")))
    size = binned_mean(rows.filter("z = 1"), by, "m_log", "y_log", bins)
    chance = binned_mean(rows, by, "m_log", "z", bins)
    rows = look_up(rows, size, by, "m_log", "ghat")
    return look_up(rows, chance, by, "m_log", "phat")


def substitutions(oof: DataFrame, by: list[str], bins: int = 200) -> DataFrame:
    """Score the forecast with one half replaced by the truth: who buys, or how much."""
    rows = with_oracles(oof, by, bins)
    typical = rows.filter("z = 1").groupBy(*by).agg(F.avg("y_log").alias("typical"))
    rows = rows.join(F.broadcast(typical), by) if by else rows.crossJoin(F.broadcast(typical))
    z, l, c = F.col("z"), F.col("y_log"), F.col("typical")
    kinds = {
        "model": F.col("m_log"),
        "true_split_our_size": z * F.col("ghat"),
        "true_split_constant": z * c,
        "our_split_true_size": F.col("phat") * (z * l + (1 - z) * c),
        "truth": l,
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("predictor"), v.alias("p_log")) for k, v in kinds.items()])
    tall = rows.select(*by, "y_log", F.inline(pairs))
    return tall.groupBy(*by, "predictor").agg(F.corr("y_log", "p_log").alias("rho"), _log_rmse("p_log").alias("rmsle"))


def _log_rmse(p: str) -> Column:
    d = F.col("y_log") - F.greatest(F.col(p), F.lit(0.0))
    return F.sqrt(F.avg(d * d))


LAMBDAS = (0.0, 0.02, 0.05, 0.10, 0.20, 0.40, 1.0)


def payoff_curve(oof: DataFrame, by: list[str], lambdas=LAMBDAS, bins: int = 200, digits: int | None = None) -> DataFrame:
    """Mix the forecast towards the perfect split and read ranking, correlation, score and slope.

    ``digits`` rounds the mix before it is ranked, for callers to whom values that differ by the order of
    additions are ties.
    """
    rows = with_oracles(oof, by, bins)
    lam = F.explode(F.array(*[F.lit(float(v)) for v in lambdas])).alias("lam")
    mixed = rows.select(*by, "y_log", "z", "m_log", "ghat", lam)
    mix = (1 - F.col("lam")) * F.col("m_log") + F.col("lam") * F.col("z") * F.col("ghat")
    mixed = mixed.withColumn("p_log", mix if digits is None else F.round(mix, digits))
    keys, mixed = [*by, "lam"], cut(mixed)
    plain = mixed.groupBy(*keys).agg(F.corr("y_log", "p_log").alias("rho"), _log_rmse("p_log").alias("rmsle"))
    out = plain.join(auc(mixed, keys, "p_log", F.col("z") == 1), keys)
    step = Window.partitionBy(*by).orderBy("lam")
    d_rho, d_auc = (F.col(c) - F.lag(c).over(step) for c in ("rho", "auc"))
    return out.withColumn("slope", F.coalesce(d_rho / F.greatest(d_auc, F.lit(1e-9)), F.lit(0.0)))


def fold_report(oof: DataFrame, by: list[str], needed_wins: int = 4, noise: float | None = None) -> DataFrame:
    """Cross-validated score against the naive one: mean, spread, difference, folds won, significance.

    A difference counts if enough folds are won, or if it exceeds twice the spread over folds (or
    twice a known noise level, when given).
    """
    folds = oof.groupBy(*by, "fold_id").agg(rmsle("y_true", "y_pred").alias("s"), rmsle("y_true", "y_naive").alias("n"))
    out = folds.groupBy(*by).agg(
        F.avg("s").alias("cv_mean"), F.stddev_pop("s").alias("cv_std"), F.avg("n").alias("naive_mean"),
        F.sum((F.col("s") < F.col("n")).cast("int")).alias("wins"), F.count(F.lit(1)).alias("folds"),
    ).withColumn("delta", F.col("cv_mean") - F.col("naive_mean"))
    limit = 2 * F.col("cv_std") if noise is None else F.lit(2 * noise)
    return out.withColumn("significant", (F.col("wins") >= needed_wins) | (F.abs("delta") > limit))


def block_scores(days: DataFrame, blocks: dict[str, Column], y_log: str = "y_log", m_log: str = "m_log") -> DataFrame:
    """Log error, ranking and within-day correlation for overlapping sets of (user, day) cells."""
    named = F.array(*[F.struct(F.lit(n).alias("block"), c.alias("_in")) for n, c in blocks.items()])
    cells = days.select("day", y_log, m_log, F.inline(named)).filter("_in").drop("_in")
    d = F.col(y_log) - F.col(m_log)
    plain = cells.groupBy("block").agg(F.sqrt(F.avg(d * d)).alias("rmsle"), F.count(F.lit(1)).alias("cells"))
    ranked = auc(cells, ["block"], m_log, F.col(y_log) > 0)
    return plain.join(ranked, "block").join(within_day(cells, ["block"], "day", F.col(y_log), F.col(m_log)), "block")


def held_out(predictions: DataFrame, user_fold: Column, anchors: dict[int, int]) -> DataFrame:
    """Out-of-fold rows: each model scores only the users it did not see, at the frozen days."""
    frozen = F.create_map(*[F.lit(v) for k, d in anchors.items() for v in (d, k)])
    rows = predictions.filter((user_fold == F.col("model_fold")) & F.col("day").isin(list(anchors.values())))
    return rows.select(
        frozen[F.col("day")].alias("fold_id"), "user_id",
        F.expm1("y_log").alias("y_true"), F.greatest(F.expm1("m_log"), F.lit(0.0)).alias("y_pred"),
    )


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sum, mean, share of zeros and concentration of several columns, one row each."""
    tall = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])))
    plain = tall.groupBy("name").agg(
        F.sum("value").alias("sum"), F.avg("value").alias("mean"), F.avg((F.col("value") == 0).cast("double")).alias("zero_share")
    )
    return plain.join(gini(tall, ["name"], "value"), "name")


def correlation_matrix(wide: DataFrame, columns: list[str]) -> DataFrame:
    """Pairwise correlations of a few columns in one pass, as rows (a, b, corr)."""
    pairs = list(combinations(columns, 2))
    row = wide.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("corr")) for a, b in pairs]
    return row.select(F.inline(F.array(*cells)))


def seed_spread(df: DataFrame, keys: list[str], m_log: Column) -> DataFrame:
    """Mean over users of the spread between seeds: what averaging them removes."""
    per_user = df.withColumn("_m", m_log).groupBy(*keys).agg(F.stddev_pop("_m").alias("sd"))
    return per_user.agg(F.avg("sd").alias("mean_seed_sd"), F.count(F.lit(1)).alias("n"))


def run_report(runs: DataFrame) -> DataFrame:
    """Per fold the mean over seeds; over all runs mean, spread and the median best epoch.

    A run table has a row per fold and seed, so the median is over a handful of values.
    """
    whole = runs.agg(
        F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"),
        F.floor(F.percentile("best_epoch", F.lit(0.5))).alias("median_epoch"), F.count(F.lit(1)).alias("runs"),
    )
    per_fold = runs.groupBy("fold_id").agg(F.avg("score").alias("fold_score"))
    return per_fold.crossJoin(F.broadcast(whole))  # one row on the right
