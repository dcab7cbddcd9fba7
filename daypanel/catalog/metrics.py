"""Scores, decompositions and reports as queries, on forecasts derived from the order panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import folds as P
from ..operators import metrics as M
from ..operators.windows import Plan, ahead, block, features, last
from ..sources import tables
from .common import IN_POPULATION, VALID_ANCHORS, order_days, out, query, s, sql_result
from .data import FOLDS
from .features import GEO3
from .folds import _MD5, CLEAN, CUT, H, MASKED, day_table

# Stand-ins for 13 models: each bends the naive forecast by a slope, a shift and key-made noise.
PRIMES = (101, 103, 107, 109, 113, 127, 131, 137, 139, 149, 151, 157, 163)
MEMBERS = [(f"m{i:02d}", round(0.55 + 0.03 * i, 2), round(((i * 7) % 5) * 0.15, 2), p) for i, p in enumerate(PRIMES)]
NAMES = [m[0] for m in MEMBERS]


def naive_oof(spark, folder) -> DataFrame:
    """(fold_id, anchor, user_id, y_true, y_naive, last30) at the validation anchors."""
    d = order_days(spark, folder)
    plan = Plan(d.n_days)
    days = d.index(VALID_ANCHORS)
    rows = features(d.panel, days, plan, {"y_true": plan.total("gmv", ahead(30)), "y_naive": plan.geo3(),
                                          "last30": plan.total("gmv", last(30))})
    fold = F.create_map(*[F.lit(v) for k, a in enumerate(days) for v in (a, k)])
    return rows.withColumn("fold_id", fold[F.col("anchor")])


def _bent(slope, shift, prime):
    noise = F.pmod(F.col("user_id") * prime, F.lit(1009)) / 1009.0 - 0.5
    return F.round(F.expm1(F.greatest(F.lit(0.0), F.log1p("y_naive") * slope + shift + noise)), 6)


def member_oof(spark, folder) -> DataFrame:
    rows = naive_oof(spark, folder)
    cells = [F.struct(F.lit(n).alias("member"), _bent(a, b, p).alias("y_pred")) for n, a, b, p in MEMBERS]
    return rows.select("fold_id", "anchor", "user_id", "y_true", "y_naive", "last30", F.inline(F.array(*cells)))


def wide_logs(spark, folder) -> DataFrame:
    """One row per fold and user with the log prediction of every member."""
    rows = naive_oof(spark, folder)
    return rows.select("fold_id", "user_id", F.log1p("y_true").alias("y_log"),
                       *[F.log1p(_bent(a, b, p)).alias(n) for n, a, b, p in MEMBERS])


_MV = ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE, {p})" for n, a, b, p in MEMBERS)
NAIVE = f"""{FOLDS}, oof AS (SELECT fold_id, anchor, user_id, {s('gmv', -30, -1)} AS y_true, {GEO3} AS y_naive, {s('gmv', 0, 29)} AS last30
  FROM va a JOIN p ON p.day <= a.anchor + 30 GROUP BY fold_id, anchor, user_id HAVING {IN_POPULATION})"""
OOF = f"""{NAIVE}, mo AS (SELECT oof.*, member,
    round(exp(greatest(0, ln(1 + y_naive) * slope + shift + (user_id * prime % 1009) / 1009.0::DOUBLE - 0.5)) - 1, 6) AS y_pred
  FROM oof, (VALUES {_MV}) m(member, slope, shift, prime))"""
RMSLE = "sqrt(avg(pow(ln(1 + y_true) - ln(1 + greatest({p}, 0)), 2)))"
MODEL = ["member"]


@query("m1_rmsle", sql_result(
    f"SELECT fold_id, count(*) AS n_users, {RMSLE.format(p='y_naive')} AS rmsle_naive, {RMSLE.format(p='last30')} AS rmsle_last30 FROM oof GROUP BY fold_id",
    ["fold_id"], ctes=NAIVE))
def m1_rmsle(spark, folder):
    rows = naive_oof(spark, folder).groupBy("fold_id").agg(
        F.count(F.lit(1)).alias("n_users"), M.rmsle("y_true", "y_naive").alias("rmsle_naive"), M.rmsle("y_true", "last30").alias("rmsle_last30"))
    return out(rows, ["fold_id"])


def gini_sql(table: str, by: list[str], value: str) -> str:
    keys = ", ".join(by)
    lead = f"{keys}, " if by else ""
    part = f"PARTITION BY {keys} " if by else ""
    group = f" GROUP BY {keys}" if by else ""
    return f"""SELECT {lead}CASE WHEN sum(x) > 0 THEN 2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1.0) / count(*) ELSE 0 END AS gini
FROM (SELECT {lead}{value} AS x, row_number() OVER ({part}ORDER BY {value}) AS i FROM {table}){group}"""


@query("m2_gini", sql_result(gini_sql("mo", ["member", "fold_id"], "y_pred"), ["member", "fold_id"], ctes=OOF))
def m2_gini(spark, folder):
    return out(M.gini(member_oof(spark, folder), ["member", "fold_id"], "y_pred"), ["member", "fold_id"])


@query("m3_total_error", sql_result(
    "SELECT member, fold_id, sum(greatest(y_pred, 0)) / sum(y_true) - 1 AS total_rel_err FROM mo GROUP BY ALL", ["member", "fold_id"], ctes=OOF))
def m3_total_error(spark, folder):
    rows = member_oof(spark, folder).groupBy("member", "fold_id").agg(M.total_rel_err("y_true", "y_pred").alias("total_rel_err"))
    return out(rows, ["member", "fold_id"])


_RMSPE = "sqrt(avg(pow((y_true - greatest(y_pred, 0)) / greatest(y_true, 1), 2)))"


@query("m4_rmspe", sql_result(f"SELECT member, {_RMSPE} AS rmspe FROM mo GROUP BY member", MODEL, digits=4, ctes=OOF))
def m4_rmspe(spark, folder):
    return out(member_oof(spark, folder).groupBy("member").agg(M.rmspe("y_true", "y_pred").alias("rmspe")), MODEL, digits=4)


@query("m5_score_all", sql_result(
    f"""SELECT a.member, a.rmsle, a.total_rel_err, a.rmspe, p.gini AS gini_pred, t.gini AS gini_true FROM
(SELECT member, {RMSLE.format(p='y_pred')} AS rmsle, sum(greatest(y_pred, 0)) / sum(y_true) - 1 AS total_rel_err, {_RMSPE} AS rmspe FROM mo GROUP BY member) a
JOIN ({gini_sql('mo', ['member'], 'y_pred')}) p ON p.member = a.member JOIN ({gini_sql('mo', ['member'], 'y_true')}) t ON t.member = a.member""",
    MODEL, digits=4, ctes=OOF))
def m5_score_all(spark, folder):
    return out(M.score_all(member_oof(spark, folder), ["member"]), MODEL, digits=4)


def auc_sql(table: str, by: str, score: str, label: str) -> str:
    return f"""SELECT {by}, (sum(CASE WHEN z THEN r END) - n1 * (n1 + 1) / 2.0) / (n1 * (n - n1)) AS auc FROM (
  SELECT {by}, z, rank() OVER (PARTITION BY {by} ORDER BY {score}) + (count(*) OVER (PARTITION BY {by}, {score}) - 1) / 2.0 AS r,
    count(*) OVER (PARTITION BY {by}) AS n, count(*) FILTER (z) OVER (PARTITION BY {by}) AS n1
  FROM (SELECT *, {label} AS z FROM {table})) GROUP BY {by}, n, n1"""


@query("m6_auc", sql_result(auc_sql("mo", "member", "y_pred", "y_true > 0"), MODEL, ctes=OOF))
def m6_auc(spark, folder):
    return out(M.auc(member_oof(spark, folder), ["member"], "y_pred", F.col("y_true") > 0), MODEL)


_LM = "(SELECT member, fold_id, ln(1 + y_true) AS l, ln(1 + y_pred) AS m FROM mo)"


@query("m7_correlation", sql_result(
    f"SELECT member, corr(l, m) AS rho, stddev_pop(l) AS sd_l, stddev_pop(m) AS sd_m, stddev_pop(l) * sqrt(1 - pow(corr(l, m), 2)) AS star FROM {_LM} GROUP BY member",
    MODEL, ctes=OOF))
def m7_correlation(spark, folder):
    return out(M.calibrated(member_oof(spark, folder), ["member"], F.log1p("y_true"), F.log1p("y_pred")), MODEL)


@query("m8_within_day_rho", sql_result(
    f"""SELECT member, cxy / sqrt(cxx * cyy) AS rho_within, sqrt(cyy / n) * sqrt(1 - cxy * cxy / (cxx * cyy)) AS star_within FROM (
  SELECT member, sum((m - mm) * (m - mm)) AS cxx, sum((l - ml) * (l - ml)) AS cyy, sum((l - ml) * (m - mm)) AS cxy, count(*) AS n
  FROM (SELECT *, avg(l) OVER w AS ml, avg(m) OVER w AS mm, count(*) OVER w AS c FROM {_LM} WINDOW w AS (PARTITION BY member, fold_id))
  WHERE c >= 2 GROUP BY member)""", MODEL, ctes=OOF))
def m8_within_day_rho(spark, folder):
    return out(M.within_day(member_oof(spark, folder), ["member"], "anchor", F.log1p("y_true"), F.log1p("y_pred")), MODEL)


@query("m9_covariance_split", sql_result(
    f"""SELECT member, total, p * among AS within, dl * dm * p * (1 - p) AS "between", p * among / total AS within_share,
  dl * dm * p * (1 - p) / total AS between_share, rho_buyers FROM (
  SELECT member, covar_samp(l, m) AS total, covar_samp(l, m) FILTER (l > 0) AS among, avg(CASE WHEN l > 0 THEN 1.0 ELSE 0 END) AS p,
    avg(l) FILTER (l > 0) - avg(l) FILTER (l = 0) AS dl, avg(m) FILTER (l > 0) - avg(m) FILTER (l = 0) AS dm,
    corr(l, m) FILTER (l > 0) AS rho_buyers FROM {_LM} GROUP BY member)""", MODEL, ctes=OOF))
def m9_covariance_split(spark, folder):
    return out(M.covariance_split(member_oof(spark, folder), ["member"], F.log1p("y_true"), F.log1p("y_pred")), MODEL)


BINS = 200
_PROBS = ", ".join(f"{k / BINS!r}" for k in range(1, BINS))


def _oracle_ctes() -> str:
    """Logs, bin edges and binned means per member, as the decomposition needs them."""
    return f"""{OOF}, lm AS (SELECT member, fold_id, user_id, ln(1 + y_true) AS l, ln(1 + y_pred) AS m,
    CASE WHEN y_true > 0 THEN 1.0::DOUBLE ELSE 0 END AS z FROM mo),
ea AS (SELECT member, quantile_cont(m, [{_PROBS}]) AS edges FROM lm GROUP BY member),
eb AS (SELECT member, quantile_cont(m, [{_PROBS}]) AS edges FROM lm WHERE z = 1 GROUP BY member),
ba AS (SELECT lm.*, len(list_filter(edges, lambda e: e < m)) AS bin FROM lm JOIN ea ON ea.member = lm.member),
bb AS (SELECT lm.*, len(list_filter(edges, lambda e: e < m)) AS bin FROM lm JOIN eb ON eb.member = lm.member),
ta AS (SELECT member, bin, avg(z) AS v FROM ba GROUP BY member, bin),
tb AS (SELECT member, bin, avg(l) AS v FROM bb WHERE z = 1 GROUP BY member, bin),
oa AS (SELECT member, avg(z) AS v FROM lm GROUP BY member),
ob AS (SELECT member, avg(l) AS v FROM lm WHERE z = 1 GROUP BY member),
dec AS (SELECT ba.*, coalesce(ta.v, oa.v) AS phat, coalesce(tb.v, ob.v) AS ghat, ob.v AS typical
  FROM ba JOIN bb ON bb.member = ba.member AND bb.fold_id = ba.fold_id AND bb.user_id = ba.user_id
  JOIN oa ON oa.member = ba.member JOIN ob ON ob.member = ba.member
  LEFT JOIN ta ON ta.member = ba.member AND ta.bin = ba.bin LEFT JOIN tb ON tb.member = bb.member AND tb.bin = bb.bin)"""


def _decomposed(spark, folder):
    rows = member_oof(spark, folder)
    return rows.select("member", "fold_id", "user_id", F.log1p("y_true").alias("y_log"), F.log1p("y_pred").alias("m_log"))


@query("m10_binned_mean", sql_result("SELECT member, fold_id, user_id, phat, ghat FROM dec", ["member", "fold_id", "user_id"], ctes=_oracle_ctes()))
def m10_binned_mean(spark, folder):
    rows = M.with_oracles(_decomposed(spark, folder), ["member"], BINS)
    return out(rows.select("member", "fold_id", "user_id", "phat", "ghat"), ["member", "fold_id", "user_id"])


def _kind(name: str, e: str) -> str:
    return f"SELECT member, '{name}' AS predictor, corr(l, {e}) AS rho, sqrt(avg(pow(l - greatest({e}, 0), 2))) AS rmsle FROM dec GROUP BY member"


@query("m11_substitutions", sql_result("\nUNION ALL ".join([
    _kind("model", "m"), _kind("true_split_our_size", "z * ghat"), _kind("true_split_constant", "z * typical"),
    _kind("our_split_true_size", "phat * (z * l + (1 - z) * typical)"), _kind("truth", "l")]),
    ["member", "predictor"], ctes=_oracle_ctes()))
def m11_substitutions(spark, folder):
    return out(M.substitutions(_decomposed(spark, folder), ["member"], BINS), ["member", "predictor"])


_LAM = ", ".join(f"({v}::DOUBLE)" for v in M.LAMBDAS)
_MIX = f"""{_oracle_ctes()}, mix AS (SELECT member || '/' || lam AS k, member, lam, l, z > 0 AS zb, round((1 - lam) * m + lam * z * ghat, 9) AS x
  FROM dec, (VALUES {_LAM}) v(lam))"""


@query("m12_payoff_curve", sql_result(
    f"""SELECT member, lam, rho, rmsle, auc, coalesce((rho - lag(rho) OVER w) / greatest(auc - lag(auc) OVER w, 1e-9), 0) AS slope
FROM (SELECT k, member, lam, corr(l, x) AS rho, sqrt(avg(pow(l - greatest(x, 0), 2))) AS rmsle FROM mix GROUP BY k, member, lam) a
JOIN ({auc_sql('mix', 'k', 'x', 'zb')}) b ON a.k = b.k WINDOW w AS (PARTITION BY member ORDER BY lam)""",
    ["member", "lam"], digits=5, ctes=_MIX))
def m12_payoff_curve(spark, folder):
    return out(M.payoff_curve(_decomposed(spark, folder), ["member"], bins=BINS, digits=9), ["member", "lam"], digits=5)


@query("m13_fold_report", sql_result(
    f"""SELECT member, avg(sc) AS cv_mean, stddev_pop(sc) AS cv_std, avg(nv) AS naive_mean, sum(CASE WHEN sc < nv THEN 1 ELSE 0 END) AS wins,
  count(*) AS folds, avg(sc) - avg(nv) AS delta,
  sum(CASE WHEN sc < nv THEN 1 ELSE 0 END) >= 4 OR abs(avg(sc) - avg(nv)) > 2 * stddev_pop(sc) AS significant,
  sum(CASE WHEN sc < nv THEN 1 ELSE 0 END) >= 4 OR abs(avg(sc) - avg(nv)) > 2 * 0.00009 AS beyond_noise
FROM (SELECT member, fold_id, {RMSLE.format(p='y_pred')} AS sc, {RMSLE.format(p='y_naive')} AS nv FROM mo GROUP BY ALL) GROUP BY member""",
    MODEL, ctes=OOF))
def m13_fold_report(spark, folder):
    rows = member_oof(spark, folder)
    noise = M.fold_report(rows, ["member"], noise=0.00009).select("member", F.col("significant").alias("beyond_noise"))
    return out(M.fold_report(rows, ["member"]).join(noise, "member"), MODEL)


# -- day level, on the event panel ---------------------------------------------------------------------
FORECAST = f"{MASKED}, fc AS (SELECT *, ln(1 + sum(gmv) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN {H - 1} PRECEDING AND CURRENT ROW)) AS m_log FROM masked)"


def day_forecast(spark, folder):
    rows, d = day_table(spark, folder)
    w = Window.partitionBy("user_id").orderBy("day").rowsBetween(-(H - 1), 0)
    return rows.withColumn("m_log", F.log1p(F.sum("gmv").over(w))), d


_IN = {"in_calendar": f"day <= {CUT}", "in_population": f"day <= {CUT} AND in_pop", "forward": f"day >= {CUT + H}",
       "forward_clean": f"day >= {CUT + H} AND day <= {CLEAN}"}
_CELLS = f"{FORECAST}, cells AS (" + " UNION ALL ".join(
    f"SELECT '{k}' AS block, * FROM fc WHERE supervised AND {c}" for k, c in _IN.items()) + ")"


@query("m14_block_scores", sql_result(
    f"""SELECT a.block, rmsle, cells, auc, rho_within, star_within FROM
(SELECT block, sqrt(avg(pow(y_log - m_log, 2))) AS rmsle, count(*) AS cells FROM cells GROUP BY block) a
JOIN ({auc_sql('cells', 'block', 'm_log', 'y_log > 0')}) b ON a.block = b.block
JOIN (SELECT block, cxy / sqrt(cxx * cyy) AS rho_within, sqrt(cyy / n) * sqrt(1 - cxy * cxy / (cxx * cyy)) AS star_within FROM (
  SELECT block, sum((m_log - mm) * (m_log - mm)) AS cxx, sum((y_log - ml) * (y_log - ml)) AS cyy, sum((y_log - ml) * (m_log - mm)) AS cxy, count(*) AS n
  FROM (SELECT *, avg(y_log) OVER w AS ml, avg(m_log) OVER w AS mm, count(*) OVER w AS c FROM cells WINDOW w AS (PARTITION BY block, day))
  WHERE c >= 2 GROUP BY block)) c ON c.block = a.block""", ["block"], ctes=_CELLS))
def m14_block_scores(spark, folder):
    rows, d = day_forecast(spark, folder)
    s_, day = F.col("supervised"), F.col("day")
    blocks = {"in_calendar": s_ & (day <= CUT), "in_population": s_ & (day <= CUT) & F.col("in_pop"),
              "forward": s_ & (day >= CUT + H), "forward_clean": s_ & (day >= CUT + H) & (day <= CLEAN)}
    return out(M.block_scores(rows, blocks), ["block"])


FROZEN = {0: 8, 1: 11, 2: 14, 3: 17, 4: 20}
_FZ = ", ".join(f"({k}, {v})" for k, v in FROZEN.items())


@query("m15_held_out", sql_result(
    f"""SELECT CAST(v.k AS BIGINT) AS fold_id, user_id, exp(y_log) - 1 AS y_true, exp(m_log * (0.9::DOUBLE + 0.05::DOUBLE * fold)) - 1 AS y_pred
FROM (SELECT *, least(CAST(floor({_MD5} / 4294967295.0::DOUBLE * 5) AS BIGINT), 4) AS fold FROM fc WHERE supervised) f
JOIN (VALUES {_FZ}) v(k, d) ON v.d = f.day""", ["fold_id", "user_id"], digits=4, ctes=FORECAST))
def m15_held_out(spark, folder):
    rows, d = day_forecast(spark, folder)
    models = rows.filter("supervised").withColumn("model_fold", F.explode(F.sequence(F.lit(0), F.lit(4))))
    models = models.withColumn("m_log", F.col("m_log") * (0.9 + 0.05 * F.col("model_fold")))
    return out(M.held_out(models, P.user_fold(), FROZEN), ["fold_id", "user_id"], digits=4)


_SUMMARY = "\nUNION ALL ".join(
    f"SELECT '{c}' AS name, sum({c}) AS sum, avg({c}) AS mean, avg(CASE WHEN {c} = 0 THEN 1.0 ELSE 0 END) AS zero_share, "
    f"(SELECT gini FROM ({gini_sql('last_fold', [], c)})) AS gini FROM last_fold" for c in ("m07", "y_naive", "last30"))


@query("m16_summary", sql_result(_SUMMARY, ["name"], digits=4, ctes=f"{OOF}, last_fold AS (SELECT y_pred AS m07, y_naive, last30 FROM mo WHERE member = 'm07')"))
def m16_summary(spark, folder):
    n, a, b, p = MEMBERS[7]
    rows = naive_oof(spark, folder).withColumn("m07", _bent(a, b, p))
    return out(M.summary(rows, ["m07", "y_naive", "last30"]), ["name"], digits=4)


@query("m17_log_correlations", sql_result(
    """SELECT x.member AS a, y.member AS b, corr(ln(1 + x.y_pred), ln(1 + y.y_pred)) AS corr FROM mo x
JOIN mo y ON x.fold_id = y.fold_id AND x.user_id = y.user_id AND x.member < y.member GROUP BY ALL""", ["a", "b"], ctes=OOF))
def m17_log_correlations(spark, folder):
    return out(M.correlation_matrix(wide_logs(spark, folder), NAMES), ["a", "b"])


@query("m17_seed_spread", sql_result(
    "SELECT avg(sd) AS mean_seed_sd, count(*) AS n FROM (SELECT stddev_pop(ln(1 + y_pred)) AS sd FROM mo GROUP BY fold_id, user_id)",
    [], ctes=OOF))
def m17_seed_spread(spark, folder):
    return out(M.seed_spread(member_oof(spark, folder), ["fold_id", "user_id"], F.log1p("y_pred")), [])


_RUNS = f"""{OOF}, runs AS (SELECT fold_id, member, {RMSLE.format(p='y_pred')} AS score FROM mo GROUP BY ALL),
ep AS (SELECT *, 1 + CAST(floor(score * 100) AS BIGINT) % 17 AS best_epoch FROM runs)"""


@query("m18_run_report", sql_result(
    """SELECT fold_id, avg(score) AS fold_score, (SELECT avg(score) FROM ep) AS mean, (SELECT stddev_pop(score) FROM ep) AS std,
  (SELECT floor(median(best_epoch)) FROM ep) AS median_epoch, (SELECT count(*) FROM ep) AS runs FROM ep GROUP BY fold_id""",
    ["fold_id"], ctes=_RUNS))
def m18_run_report(spark, folder):
    runs = member_oof(spark, folder).groupBy("fold_id", "member").agg(M.rmsle("y_true", "y_pred").alias("score"))
    runs = runs.withColumn("best_epoch", 1 + F.floor(F.col("score") * 100) % 17)
    return out(M.run_report(runs), ["fold_id"])


# Experiment records: an old table with hand-entered fields, and new runs that replace part of it.
_OLD = """SELECT 'e' || substr(member, 2) AS exp_id, 'old' AS tier, round(avg(y_pred), 2) AS cv_mean,
  CASE WHEN member < 'm05' THEN 'keep' ELSE '' END AS verdict, CASE WHEN member IN ('m01', 'm08') THEN '1.65' ELSE '' END AS lb
  FROM mo WHERE member < 'm09' GROUP BY member"""
_NEW = """SELECT 'e' || substr(member, 2) AS exp_id, 'new' AS tier, round(avg(y_pred) + 1, 2) AS cv_mean,
  CASE WHEN member = 'm03' THEN 'kill' ELSE '' END AS verdict, '' AS lb FROM mo WHERE member >= 'm03' GROUP BY member"""


@query("d11_run_records", sql_result(
    """SELECT coalesce(n.exp_id, o.exp_id) AS exp_id, coalesce(n.tier, o.tier) AS tier, coalesce(n.cv_mean, o.cv_mean) AS cv_mean,
  CASE WHEN n.exp_id IS NULL THEN o.verdict WHEN n.verdict <> '' THEN n.verdict ELSE coalesce(o.verdict, '') END AS verdict,
  CASE WHEN n.exp_id IS NULL THEN o.lb WHEN n.lb <> '' THEN n.lb ELSE coalesce(o.lb, '') END AS lb
FROM old o FULL JOIN new n ON o.exp_id = n.exp_id""", ["exp_id", "tier", "verdict", "lb"], digits=1,
    ctes=f"{OOF}, old AS ({_OLD}), new AS ({_NEW})"))
def d11_run_records(spark, folder):
    means = member_oof(spark, folder).groupBy("member").agg(F.avg("y_pred").alias("mean"))
    rec = means.withColumn("exp_id", F.concat(F.lit("e"), F.substring("member", 2, 2)))
    m = F.col("member")
    old = rec.filter(m < "m09").select(
        "exp_id", F.lit("old").alias("tier"), F.round("mean", 2).alias("cv_mean"),
        F.when(m < "m05", "keep").otherwise("").alias("verdict"), F.when(m.isin("m01", "m08"), "1.65").otherwise("").alias("lb"))
    new = rec.filter(m >= "m03").select(
        "exp_id", F.lit("new").alias("tier"), F.round(F.col("mean") + 1, 2).alias("cv_mean"),
        F.when(m == "m03", "kill").otherwise("").alias("verdict"), F.lit("").alias("lb"))
    # Through JSON files, as runs leave them.
    path = tables.scratch(spark, "runs")
    new.write.json(path)
    back = spark.read.schema(new.schema).json(path)
    merged = tables.merge_records(old, back)
    return out(merged, ["exp_id", "tier", "verdict", "lb"], digits=1)
