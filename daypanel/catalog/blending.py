"""Blending, calibration, output checks, audits and models as queries."""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import ordinal_positions
from ..functions.session import cut
from ..operators import audit as A
from ..operators import blending as BL
from ..operators import blocks as B
from ..operators import channels as C
from ..operators import folds as P
from ..operators.shape import shape_reaches
from ..operators.windows import Plan, Span, features
from .channels import dense_events
from .common import ANCHORS, QUERIES, VALID_ANCHORS, anchor_cte, IN_POPULATION, ORDER_P, order_days, out, query, s, sql_result
from .data import GRID
from .metrics import MODEL, NAIVE, NAMES, OOF, gini_sql, member_oof, naive_oof, wide_logs

SLOTS = {"gbdt": NAMES[:2], "seq": NAMES[2:9], "usercv": NAMES[9:]}
# Fixed values of the final blend: slot weights and the affine correction in log space.
WEIGHTS = {"gbdt": 0.20, "seq": 0.38, "usercv": 0.42}
SLOPE, SHIFT = 1.0328948154022706, -0.17536170182531663


def final_members(spark, folder) -> DataFrame:
    """Predictions of all members for the last validation anchor."""
    rows = member_oof(spark, folder).filter(F.col("fold_id") == len(VALID_ANCHORS) - 1)
    return rows.select("user_id", "member", F.col("y_pred").alias("predict"))


_FINAL = f"{OOF}, fin AS (SELECT user_id, member, y_pred AS predict FROM mo WHERE fold_id = {len(VALID_ANCHORS) - 1})"
_IN = {k: ", ".join(f"'{n}'" for n in v) for k, v in SLOTS.items()}
_SLOT_COLS = ", ".join(f"avg(ln(1 + greatest(predict, 0))) FILTER (member IN ({v})) AS {k}" for k, v in _IN.items())
_SLOTS = f"{_FINAL}, slots AS (SELECT user_id, {_SLOT_COLS}, count(DISTINCT member) = 13 AS complete FROM fin GROUP BY user_id)"
_RAW = " + ".join(f"{w}::DOUBLE * {k}" for k, w in WEIGHTS.items())
_BLEND = f"""{_SLOTS}, bl AS (SELECT user_id, raw AS blend_log, raw * {SLOPE}::DOUBLE + {SHIFT}::DOUBLE AS calibrated_log,
    greatest(exp(raw * {SLOPE}::DOUBLE + {SHIFT}::DOUBLE) - 1, 0) AS predict FROM (SELECT user_id, {_RAW} AS raw FROM slots))"""


def final_blend(spark, folder) -> DataFrame:
    return BL.blend(BL.slot_logs(final_members(spark, folder), SLOTS), WEIGHTS, SLOPE, SHIFT)


@query("b7_slot_logs", sql_result("SELECT * FROM slots", ["user_id"], ctes=_SLOTS))
def b7_slot_logs(spark, folder):
    return out(BL.slot_logs(final_members(spark, folder), SLOTS), ["user_id"])


@query("b8_blend_calibrate", sql_result("SELECT * FROM bl", ["user_id"], digits=5, ctes=_BLEND))
def b8_blend_calibrate(spark, folder):
    return out(final_blend(spark, folder), ["user_id"], digits=5)


def _weights(spark, folder):
    return BL.fit_weights(wide_logs(spark, folder), NAMES, "y_log")


@query("b9_fitted_weights")
def b9_fitted_weights(spark, folder):
    wide = wide_logs(spark, folder)
    w = BL.fit_weights(wide, NAMES, "y_log")
    equal = {n: 1.0 / len(NAMES) for n in NAMES}
    err = lambda ws: F.pow(F.col("y_log") - sum(F.col(n) * float(v) for n, v in ws.items()), 2)
    best = [F.struct(F.lit(n).alias("member"), F.lit(float(v)).alias("weight")) for n, v in w.items()]
    rows = wide.agg(F.sqrt(F.avg(err(w))).alias("rmsle_fitted"), F.sqrt(F.avg(err(equal))).alias("rmsle_equal"))
    return out(rows.select("rmsle_fitted", "rmsle_equal", F.inline(F.array(*best))), MODEL)


_LOGC = log(10.0)


@query("b10_probe_calibration", sql_result(
    f"""SELECT *, rho * sd_l / sd_m AS a, mean_l - rho * sd_l / sd_m * mean_m AS b FROM (
  SELECT *, sqrt(1 - pow(rmsle_model / sd_l, 2)) AS rho FROM (SELECT *, sqrt(pow(rmsle_zero, 2) - pow(mean_l, 2)) AS sd_l FROM (
    SELECT *, (pow(rmsle_zero, 2) + c * c - pow(rmsle_const, 2)) / (2 * c) AS mean_l FROM (
      SELECT member, {_LOGC!r}::DOUBLE AS c, sqrt(avg(l * l)) AS rmsle_zero, sqrt(avg(pow(l - {_LOGC!r}::DOUBLE, 2))) AS rmsle_const,
        stddev_pop(l) * sqrt(1 - pow(corr(l, m), 2)) AS rmsle_model, avg(m) AS mean_m, stddev_pop(m) AS sd_m
      FROM (SELECT member, ln(1 + y_true) AS l, ln(1 + y_pred) AS m FROM mo) GROUP BY member))))""", MODEL, digits=4, ctes=OOF))
def b10_probe_calibration(spark, folder):
    rows = member_oof(spark, folder)
    l, m = F.log1p("y_true"), F.log1p("y_pred")
    moments = rows.groupBy("member").agg(
        F.lit(_LOGC).alias("c"), F.sqrt(F.avg(l * l)).alias("rmsle_zero"), F.sqrt(F.avg(F.pow(l - _LOGC, 2))).alias("rmsle_const"),
        (F.stddev_pop(l) * F.sqrt(1 - F.pow(F.corr(l, m), 2))).alias("rmsle_model"), F.avg(m).alias("mean_m"), F.stddev_pop(m).alias("sd_m"))
    return out(BL.probe_calibration(moments), MODEL, digits=4)


# -- output checks: the blend as it is, and a copy damaged in every way ------------------------------------

def _numbered(rows: DataFrame) -> DataFrame:
    return ordinal_positions(rows, [], ["user_id"]).drop("group_size").withColumnRenamed("position", "pos")


_POS = f"{_BLEND}, good AS (SELECT user_id, predict, row_number() OVER (ORDER BY user_id) AS pos FROM bl)"
_BAD = f"""{_POS}, bad AS (SELECT user_id, CASE WHEN user_id % 97 = 5 THEN -1.0 WHEN user_id % 101 = 7 THEN 'nan'::DOUBLE
    WHEN user_id % 103 = 9 THEN 'inf'::DOUBLE ELSE predict END AS predict, CASE WHEN user_id % 89 = 3 THEN pos + 1 ELSE pos END AS pos
  FROM good WHERE user_id <> (SELECT min(user_id) FROM good)
  UNION ALL SELECT max(user_id) + 1, 5.0, max(pos) + 1 FROM good
  UNION ALL SELECT user_id, predict, pos FROM good WHERE user_id % 83 = 1 AND user_id <> (SELECT min(user_id) FROM good))"""


def _check_sql(table: str) -> str:
    rules = {
        "row_count": f"abs((SELECT count(*) FROM {table}) - (SELECT count(*) FROM good))",
        "missing_ids": f"(SELECT count(*) FROM good WHERE user_id NOT IN (SELECT user_id FROM {table}))",
        "extra_ids": f"(SELECT count(DISTINCT user_id) FROM {table} WHERE user_id NOT IN (SELECT user_id FROM good))",
        "repeated_ids": f"(SELECT count(*) - count(DISTINCT user_id) FROM {table})",
        "moved_ids": f"(SELECT count(*) FROM (SELECT user_id, max(pos) AS pos FROM {table} GROUP BY user_id) t JOIN good g ON t.user_id = g.user_id WHERE t.pos <> g.pos)",
        "nan": f"(SELECT count(*) FROM {table} WHERE isnan(predict))",
        "negative": f"(SELECT count(*) FROM {table} WHERE predict < 0)",
        "infinite": f"(SELECT count(*) FROM {table} WHERE isinf(predict))",
        "scale": f"(SELECT CASE WHEN sum(predict) FILTER (isfinite(predict)) / count(*) BETWEEN 1 AND 100000 THEN 0 ELSE 1 END FROM {table})",
    }
    return "\nUNION ALL ".join(f"SELECT '{k}' AS rule, {e} AS violations" for k, e in rules.items())


@query("b11_output_checks", sql_result(_check_sql("good"), ["rule"], ctes=_POS))
def b11_output_checks(spark, folder):
    good = _numbered(final_blend(spark, folder).select("user_id", "predict"))
    return out(BL.check_predictions(good, good.select("user_id", "pos"), 1, 100000), ["rule"])


@query("b11_output_checks_broken", sql_result(_check_sql("bad"), ["rule"], ctes=_BAD))
def b11_output_checks_broken(spark, folder):
    good = _numbered(final_blend(spark, folder).select("user_id", "predict"))
    u, p = F.col("user_id"), F.col("predict")
    ends = F.broadcast(good.agg(F.min("user_id").alias("least"), F.max("user_id").alias("most"), F.max("pos").alias("end")))
    rows = good.crossJoin(ends).filter(u != F.col("least"))  # one row of limits
    value = (F.when(u % 97 == 5, F.lit(-1.0)).when(u % 101 == 7, F.lit(float("nan")))
             .when(u % 103 == 9, F.lit(float("inf"))).otherwise(p))
    bad = rows.select("user_id", value.alias("predict"), F.when(u % 89 == 3, F.col("pos") + 1).otherwise(F.col("pos")).alias("pos"))
    extra = good.agg((F.max("user_id") + 1).alias("user_id"), F.lit(5.0).alias("predict"), (F.max("pos") + 1).alias("pos"))
    again = rows.filter(u % 83 == 1).select("user_id", "predict", "pos")
    return out(BL.check_predictions(bad.unionByName(extra).unionByName(again), good.select("user_id", "pos"), 1, 100000), ["rule"])


@query("b12_moment_report", sql_result(
    f"""SELECT avg(ln(1 + predict)) AS mean_log, stddev_pop(ln(1 + predict)) AS sd_log, sum(predict) AS total,
  avg(CASE WHEN predict <= 1e-9 THEN 1.0 ELSE 0 END) AS zero_share, max(predict) AS max,
  pow(avg(ln(1 + predict)) - 2.3303, 2) / (2 * 1.6465) AS cost, (SELECT gini FROM ({gini_sql('bl', [], 'predict')})) AS gini,
  quantile_cont(predict, 0.99) AS p99 FROM bl""", [], digits=4, ctes=_BLEND))
def b12_moment_report(spark, folder):
    return out(BL.moment_report(final_blend(spark, folder), mean_l=2.3303, score=1.6465), [], digits=4)


@query("b13_compare_predictions", sql_result(
    """SELECT corr(a, b) AS corr, sqrt(avg(pow(a - b, 2))) AS rms, max(abs(a - b)) AS max_abs, count(*) AS n,
  1 - pow(corr(a, b), 2) AS unexplained, corr(a, b) >= 0.999 AS accepted
FROM (SELECT ln(1 + bl.predict) AS a, ln(1 + fin.predict) AS b FROM bl JOIN fin ON fin.user_id = bl.user_id WHERE member = 'm05')""",
    [], ctes=_BLEND))
def b13_compare_predictions(spark, folder):
    one = final_members(spark, folder).filter(F.col("member") == "m05")
    return out(BL.compare_predictions(final_blend(spark, folder), one), [])


# -- audits ------------------------------------------------------------------------------------------------

AUDITED = ["base", "counts", "trend", "funnel", "visit", "channel", "diff", "dispersion", "agebucket", "cartbacklog",
           "cumshare", "rank", "cohortrel", "tsfeat", "tsfresh", "sbc", "fcast"]


def _audit_sql() -> str:
    from .features import (base_sql, channel_sql, counts_sql, cumshare_sql, diff_sql, dispersion_sql, funnel_sql, trend_sql, visit_sql)

    names = {}
    for part in (base_sql, counts_sql, trend_sql, funnel_sql, visit_sql, channel_sql, diff_sql, dispersion_sql, cumshare_sql):
        names |= part()
    ranks = ["gmv_30", "gmv_90", "gmv_365", "ord_90", "ord_180", "days_90", "recency", "recency_ord"]
    names = [*names, "age_bucket_gmv_share_3", "cart_backlog_7", "cohort_rel_buy_rate90", "days_since_half_of_life_gmv",
             "days_since_p90_of_life_gmv", *[f"pct_{n}" for n in ranks], *[n for b in AUDITED[-4:] for n in shape_reaches(b)]]
    listed = ", ".join(f"('{n}')" for n in names)
    return f"""SELECT v.n AS feature, 0 AS differing, 0 AS lone_keys, (SELECT count(DISTINCT (anchor, user_id)) FROM p, a
  WHERE day BETWEEN anchor - 29 AND anchor) AS cells FROM (VALUES {listed}) v(n)"""


@query("b14_look_ahead", sql_result(_audit_sql(), ["feature"], ctes=f"{ORDER_P}, {anchor_cte(ANCHORS)}"))
def b14_look_ahead(spark, folder):
    d = order_days(spark, folder)
    make = lambda panel, anchors: B.build(panel, anchors, d.n_days, AUDITED)
    return out(A.look_ahead(d.panel, d.index(ANCHORS), make), ["feature"])


# Positive control: a window that reaches one day too far has to be caught.
@query("b14_look_ahead_leak", sql_result(
    f"""SELECT 'leak' AS feature, sum(CASE WHEN next > 0 THEN 1 ELSE 0 END) AS differing, 0 AS lone_keys, count(*) AS cells
FROM (SELECT user_id, {s('gmv', -30, -1)} AS next FROM a JOIN p ON day <= anchor + 30 GROUP BY user_id, anchor HAVING {IN_POPULATION})""",
    ["feature"], ctes=f"{ORDER_P}, {anchor_cte(ANCHORS[2:])}"))
def b14_look_ahead_leak(spark, folder):
    d = order_days(spark, folder)

    def make(panel, anchors):
        plan = Plan(d.n_days)
        return features(panel, anchors, plan, {"leak": plan.total("gmv", Span(-30, 6))})

    return out(A.look_ahead(d.panel, d.index(ANCHORS[2:])[0], make), ["feature"])


PROBES = (9, 19, 26)


def _causality(variant: str):
    from .channels import WIN

    def run(spark, folder):
        rows, d = dense_events(spark, folder)
        make = lambda g: C.channels(g, variant, d.n_days, d.first, WIN)
        cells = A.causality(rows, list(PROBES), make, rtol=0.0, atol=1e-6)
        return out(cells.groupBy("probe").agg(F.max("cells").alias("cells"), F.max("lone_keys").alias("lone_keys"),
                                              F.sum("differing").alias("differing"), F.count(F.lit(1)).alias("channels")), ["probe"])

    return run


def _causality_sql(n: int) -> str:
    return "\nUNION ALL ".join(
        f"SELECT CAST({t} AS BIGINT) AS probe, (SELECT count(*) FROM g WHERE day <= {t}) AS cells, 0 AS lone_keys, 0 AS differing, {n} AS channels"
        for t in PROBES)


for _variant, _n in (("behav", 127), ("extra", 143)):
    query(f"b15_causality_{_variant}", sql_result(_causality_sql(_n), ["probe"], ctes=GRID))(_causality(_variant))


@query("b15_causality_leak", sql_result(
    """SELECT 'leak' AS feature, sum(CASE WHEN day = 19 AND nxt > 0 THEN 1 ELSE 0 END) AS differing, 0 AS lone_keys, count(*) AS cells
FROM (SELECT user_id, day, lead(gmv) OVER (PARTITION BY user_id ORDER BY day) AS nxt FROM g) WHERE day <= 19""", ["feature"], ctes=GRID))
def b15_causality_leak(spark, folder):
    rows, d = dense_events(spark, folder)
    w = Window.partitionBy("user_id").orderBy("day")
    make = lambda g: g.select("user_id", "day", F.coalesce(F.lead("gmv").over(w), F.lit(0.0)).alias("leak"))
    return out(A.causality(rows, [19], make).drop("probe"), ["feature"])


# -- binned targets ------------------------------------------------------------------------------------------

def _target_rows(spark, folder):
    return naive_oof(spark, folder).select("fold_id", "user_id", F.log1p("y_true").alias("y_log"))


# One row per merge: the emptiest bin (the first of equal ones) joins its left neighbour, the first bin its right one.
_MERGED = f"""RECURSIVE {NAIVE}, logs AS (SELECT ln(1 + y_true) AS l FROM oof),
cap AS (SELECT quantile_cont(l, 0.999) AS top FROM logs WHERE l > 0),
grid AS (SELECT list_transform(range(13), lambda i: CASE i WHEN 12 THEN top ELSE top * i / 12 END) AS edges FROM cap),
spot AS (SELECT len(list_filter(edges[2:12], lambda e: e <= l)) AS bin FROM logs, grid),
steps AS (
  SELECT 0 AS turn, edges, (SELECT list(n ORDER BY b) FROM (SELECT b, count(bin) AS n FROM range(12) r(b) LEFT JOIN spot ON bin = b GROUP BY b)) AS n,
    greatest(20, floor(0.002 * (SELECT count(*) FROM logs))) AS least_n FROM grid
  UNION ALL
  SELECT turn + 1, list_concat(edges[:gone - 1], edges[gone + 1:]), list_concat(n[:gone - 2], [n[gone - 1] + n[gone]], n[gone + 1:]), least_n
  FROM (SELECT *, greatest(list_position(n, list_min(n)), 2) AS gone FROM steps WHERE len(n) > 2 AND list_min(n) < least_n)
),
bins AS (SELECT * FROM steps ORDER BY turn DESC LIMIT 1)"""


@query("b4_target_bins", sql_result(
    "SELECT i - 1 AS bin, n[i] AS n, edges[i] AS lo, edges[i + 1] AS hi, (edges[i] + edges[i + 1]) / 2 AS centre "
    "FROM (SELECT *, unnest(range(1, len(n) + 1)) AS i FROM bins) WHERE n[i] > 0", ["bin"], ctes=_MERGED))
def b4_target_bins(spark, folder):
    rows = _target_rows(spark, folder)
    edges = BL.target_bins(rows, "y_log", 12)
    mids = F.array(*[F.lit(c) for c in BL.centres(edges)])
    top = F.least(F.greatest(F.col("y_log"), F.lit(0.0)), F.lit(edges[-1]))
    binned = rows.groupBy(BL.place(top, edges).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    lows = F.array(*[F.lit(e) for e in edges])
    return out(binned.select("bin", "n", F.get(lows, F.col("bin")).alias("lo"), F.get(lows, F.col("bin") + 1).alias("hi"),
                             F.get(mids, F.col("bin")).alias("centre")), ["bin"])


EDGES = [0.0, 2.0, 4.0, 6.0, 8.0, 9.0, 10.0, 11.0, 12.5]
_INNER = ", ".join(f"{e}" for e in EDGES[1:-1])
_PLACED = f"{NAIVE}, pl AS (SELECT fold_id, user_id, len(list_filter([{_INNER}], lambda e: e <= ln(1 + y_true))) AS bin FROM oof)"


@query("b5_one_hot_prior", sql_result(
    f"""SELECT CAST(b AS BIGINT) AS bin, mean, ln(greatest(mean, 1e-12)) - max(ln(greatest(mean, 1e-12))) OVER () AS init
FROM (SELECT b, avg(CASE WHEN bin = b THEN 1.0 ELSE 0 END) AS mean FROM pl, range({len(EDGES) - 1}) r(b) GROUP BY b)""", ["bin"], ctes=_PLACED))
def b5_one_hot_prior(spark, folder):
    return out(BL.class_prior(BL.soft_targets(_target_rows(spark, folder), "y_log", EDGES, 0.0)), ["bin"])


@query("b5_one_hot_readout", sql_result(
    f"SELECT fold_id, user_id, [{', '.join(str((a + b) / 2) for a, b in zip(EDGES, EDGES[1:]))}][bin + 1] AS m_log FROM pl",
    ["fold_id", "user_id"], ctes=_PLACED))
def b5_one_hot_readout(spark, folder):
    rows = BL.soft_targets(_target_rows(spark, folder), "y_log", EDGES, 0.0)
    return out(rows.select("fold_id", "user_id", BL.readout(F.col("q"), EDGES).alias("m_log")), ["fold_id", "user_id"])


@query("b5_soft_targets")
def b5_soft_targets(spark, folder):
    rows = BL.soft_targets(_target_rows(spark, folder), "y_log", EDGES, 0.75)
    return out(rows.select("fold_id", "user_id", BL.readout(F.col("q"), EDGES).alias("m_log"),
                           F.aggregate("q", F.lit(0.0), lambda a, x: a + x).alias("mass"), F.array_max("q").alias("peak")),
               ["fold_id", "user_id"])


# -- models ----------------------------------------------------------------------------------------------------

MODEL_BLOCKS = ["base"]


def model_tables(spark, folder):
    """Fitting and tuning rows of the last fold's whole weekly grid, the rows to score, and the columns of the blocks.

    Anchors whose targets overlap that of the tuning anchor, the newest one, are held out of the fit.
    """
    d = order_days(spark, folder)
    roles = P.anchor_roles(P.training_anchors(P.fold_calendar(spark, VALID_ANCHORS[-1:]), d.first))
    role = {r.train_anchor: r.role for r in roles.select("train_anchor", "role").collect()}  # calendar days
    fit, tune = (d.index([t for t, what in role.items() if what == wanted]) for wanted in ("fit", "tune"))
    at = d.index(VALID_ANCHORS)[-1]
    rows = cut(P.stacked(d.panel, [*fit, *tune, at], d.n_days, MODEL_BLOCKS))
    names = [c for c in rows.columns if c not in ("anchor", "user_id", "y", "y_log")]
    return rows.filter(F.col("anchor") != at), rows.filter(F.col("anchor") == at), names, F.col("anchor") == tune[0], tune[0]


@query("b1_boosted_seeds")
def b1_boosted_seeds(spark, folder):
    from ..operators import models as ML

    train, score, names, held, newest = model_tables(spark, folder)
    weight = P.buyer_weight(F.col("y"), 2.0) * P.decay_weight(newest - F.col("anchor"), 60)
    return out(ML.boosted(train, score, names, ["anchor", "user_id"], [0, 1], weight, held))


@query("b2_two_part")
def b2_two_part(spark, folder):
    from ..operators import models as ML

    train, score, names, held, _ = model_tables(spark, folder)
    return out(ML.two_part(train, score, names, ["anchor", "user_id"], 0, held))


@query("b3_size_only")
def b3_size_only(spark, folder):
    from ..operators import models as ML

    train, score, names, held, _ = model_tables(spark, folder)
    keys = ["anchor", "user_id"]
    buyers = ML.size_only(train, score, names, keys, 0, held=held).select(*keys, F.col("m_log").alias("from_buyers"))
    control = ML.size_only(train, score, names, keys, 0, everyone=True, held=held).select(*keys, F.col("m_log").alias("from_everyone"))
    return out(buyers.join(control, keys))


@query("b6_top_features")
def b6_top_features(spark, folder):
    from ..operators import models as ML

    train, _, names, held, _ = model_tables(spark, folder)
    models = ML.fit_regressors(ML.training_rows(train, names, held=held), [0])
    rows = [(i + 1, n, v) for i, (n, v) in enumerate(ML.top_features(models, names, 15))]
    return out(spark.createDataFrame(rows, "place int, feature string, importance double"), ["place"])
