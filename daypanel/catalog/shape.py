"""Shape statistics as queries, in long form: one row per anchor, user, metric and window."""

from __future__ import annotations

from datetime import date

from ..operators import blocks as B
from ..operators import shape as SH
from .common import ANCHORS, ORDER_P, anchor_cte, order_days, out, query, sql_result

LONG = ["anchor", "user_id", "metric", "w"]
SERIES = "anchor, user_id, metric, w, n"


def dense_ctes(windows) -> str:
    """Every series written out day by day, zeros included."""
    ws = ", ".join(f"({w})" for w in windows)
    return f"""{ORDER_P}, {anchor_cte(ANCHORS)},
pop AS (SELECT DISTINCT anchor, user_id FROM a JOIN p ON p.day BETWEEN anchor - 29 AND anchor),
span AS (SELECT anchor, user_id, CAST(w AS BIGINT) AS w, least(w, anchor + 1) AS n FROM pop, (VALUES {ws}) v(w)),
pos AS (SELECT *, unnest(range(n)) AS t FROM span),
vals AS (SELECT pos.*, coalesce(p.gmv, 0) AS gmv, coalesce(p.ord, 0) AS ord
  FROM pos LEFT JOIN p ON p.user_id = pos.user_id AND p.day = pos.anchor - pos.n + 1 + pos.t),
m AS (SELECT anchor, user_id, w, n, t, 'gmv' AS metric, CAST(gmv AS DOUBLE) AS x FROM vals
  UNION ALL SELECT anchor, user_id, w, n, t, 'ord', CAST(ord AS DOUBLE) FROM vals),
c AS (SELECT *, avg(x) OVER g AS mu, stddev_pop(x) OVER g AS sd FROM m WINDOW g AS (PARTITION BY {SERIES}))"""


def long_query(name: str, body: str | None, make, windows, more: str = "", **digits):
    def run(spark, folder):
        d = order_days(spark, folder)
        return out(make(d.panel, d.index(ANCHORS)), LONG, **digits)

    query(name, None if body is None else sql_result(body, LONG, ctes=dense_ctes(windows) + more, **digits))(run)


def select(parts: dict[str, str], source: str = "c") -> str:
    return f"SELECT anchor, user_id, metric, w, {', '.join(f'{e} AS {n}' for n, e in parts.items())} FROM {source} GROUP BY {SERIES}"


W_SBC = (14, 30, 60, 90, 180, 365)

# -- sign changes and runs -----------------------------------------------------------------------------
_DIFF = f""", d1 AS (SELECT *, lead(x) OVER g - x AS d, row_number() OVER g - 1 AS j FROM c WINDOW g AS (PARTITION BY {SERIES} ORDER BY t)),
d2 AS (SELECT *, lead(d) OVER g AS dn FROM d1 WINDOW g AS (PARTITION BY {SERIES} ORDER BY t)),
d3 AS (SELECT *, dn IS NOT NULL AND sign(d) <> sign(dn) AS chg FROM d2),
d4 AS (SELECT *, CASE WHEN chg THEN t - coalesce(max(CASE WHEN chg THEN t END) OVER (PARTITION BY {SERIES} ORDER BY t
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) END AS run FROM d3)"""
_CH = "sum(CASE WHEN chg THEN 1 ELSE 0 END)"
_SHAPE = {
    "trendchangerate": f"{_CH} / (n - 2 + 1e-9)", "numtrendchanges": _CH, "zigzagfreq": f"{_CH} / (n - 2.0)",
    "fracup": "sum(CASE WHEN d > 0 THEN 1.0 ELSE 0 END) / (n - 1)", "fracdown": "sum(CASE WHEN d < 0 THEN 1.0 ELSE 0 END) / (n - 1)",
    "maxrunlength": "coalesce(max(run), 0)", "meanrunlength": f"coalesce(sum(run), 0) / greatest({_CH}, 1.0)",
    "zerocross": "sum(CASE WHEN d * dn < 0 THEN 1 ELSE 0 END)", "meanlast": "avg(d)",
}


def sbc(want: list[str], windows=W_SBC):
    return lambda panel, anchors: SH.sbc_table(panel, anchors, want, windows)


long_query("s_c_sbc_shape", select(_SHAPE, "d4"), sbc(SH.SBC_FAMILIES["sbcshape"]), W_SBC, _DIFF)

# -- moments -------------------------------------------------------------------------------------------
_Z = "((x - mu) / greatest(sd, 1e-9))"
_SK, _KU = f"avg(pow({_Z}, 3))", f"(avg(pow({_Z}, 4)) - 3)"
_MOMENT = {
    "mean": "avg(x)", "std": "stddev_pop(x)", "skew": _SK, "kurtosis": _KU, "mad": "avg(abs(x - mu))",
    "cv": "abs(stddev_pop(x) / (avg(x) + 1e-9))", "energy": "sum(x * x)", "rms": "sqrt(avg(x * x))", "fft": "n * sum(x * x)",
    "jarquebera": f"n / 6.0 * (pow({_SK}, 2) + pow({_KU}, 2) / 4)",
    "burstiness": "(stddev_pop(x) - avg(x)) / (stddev_pop(x) + avg(x) + 1e-9)", "dutycycle": "avg(CASE WHEN x > mu THEN 1.0 ELSE 0 END)",
}
long_query("s_c_sbc_moment", select(_MOMENT), sbc(SH.SBC_FAMILIES["sbcmoment"]), W_SBC, digits=4, energy=0, fft=-2, jarquebera=2)

# -- order statistics ----------------------------------------------------------------------------------
_S = f", s AS (SELECT {SERIES}, list(x ORDER BY x) AS v, avg(x) AS mu, sum(x) AS sx FROM c GROUP BY {SERIES})"


def _i(q: float) -> str:
    return f"CAST(floor({q}::DOUBLE * (n - 1)) AS BIGINT)"


def _v(q: float) -> str:
    return f"v[{_i(q)} + 1]"


_PART = f"v[{_i(0.1)} + 1 : {_i(0.9)} + 1]"
_ORDER = {
    "q10": _v(0.1), "q25": _v(0.25), "median": _v(0.5), "q75": _v(0.75), "q90": _v(0.9), "q99": _v(0.99),
    "q19": f"{_v(0.9)} - {_v(0.01)}", "iqr": f"{_v(0.75)} - {_v(0.25)}", "interdecile": f"{_v(0.9)} - {_v(0.1)}",
    "max": "v[-1]", "range": "v[-1] - v[1]", "trimmedmean": f"list_avg({_PART})", "trimmedstd": f"list_stddev_pop({_PART})",
    "winsorizedmean": f"list_avg(list_transform(v, lambda y: least(greatest(y, {_v(0.05)}), {_v(0.95)})))",
    "biweightmidvar": f"pow(1.4826::DOUBLE * list_median(list_transform(v, lambda y: abs(y - {_v(0.5)}))), 2)",
    "gini": "2 * list_sum(list_transform(v, lambda y, i: y * i)) / (n * greatest(sx, 1e-9)) - (n + 1.0) / n",
}
long_query("s_c_sbc_order", f"SELECT anchor, user_id, metric, w, {', '.join(f'{e} AS {k}' for k, e in _ORDER.items())} FROM s",
           sbc(SH.SBC_FAMILIES["sbcorder"]), W_SBC, _S, digits=3, biweightmidvar=0)

# -- series and entropy --------------------------------------------------------------------------------
_LAGS = ", ".join(f"lag(x, {k}) OVER g AS l{k}" for k in (1, 5, 7))
_LAG = f", lg AS (SELECT *, {_LAGS}, sum(x - mu) OVER g AS walk FROM c WINDOW g AS (PARTITION BY {SERIES} ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"


def pearson(k: int) -> str:
    den = f"sqrt(var_pop(x) FILTER (t >= {k}) * var_pop(l{k}) FILTER (t >= {k})) * (n - {k})"
    return f"CASE WHEN {den} > 1e-9 THEN covar_pop(x, l{k}) FILTER (t >= {k}) * (n - {k}) / ({den}) ELSE 0 END"


_TRENDSLOPE = "sum(x * (t - (n - 1) / 2.0)) / (n * (n * n - 1.0) / 12)"
_TS = {
    "trendslope": _TRENDSLOPE, "firsthalfmean": "avg(x) FILTER (t < n // 2)", "secondhalfmean": "avg(x) FILTER (t >= n // 2)",
    "hurstexp": "ln(greatest(stddev_pop(walk), 1e-9)) / ln(n + 1e-9)", **{f"autocorr{k}": pearson(k) for k in (1, 5, 7)},
}
long_query("s_c_sbc_ts", select(_TS, "lg"), sbc(SH.SBC_FAMILIES["sbcts"]), W_SBC, _LAG, digits=4)

_HIST = f""", lim AS (SELECT *, min(x) OVER g AS lo, max(x) OVER g AS hi FROM c WINDOW g AS (PARTITION BY {SERIES})),
h AS (SELECT {SERIES}, least(greatest(CAST(trunc((x - lo) / greatest(hi - lo, 1e-9) * 10) AS BIGINT), 0), 9) AS b, count(*) / CAST(n AS DOUBLE) AS share
  FROM lim GROUP BY {SERIES}, b)"""
long_query("s_c_sbc_entropy", select({"histentropy": "-sum(share * ln(greatest(share, 1e-12)))"}, "h"),
           sbc(SH.SBC_FAMILIES["sbcent"]), W_SBC, _HIST)

# -- spectra: a long-form Fourier transform as the oracle --------------------------------------------------


def dft(value: str, floor: float) -> str:
    return f""", bins AS (SELECT c.*, unnest(range(n // 2 + 1)) AS f FROM c),
pw AS (SELECT {SERIES}, f, pow(sum({value} * cos(2 * pi() * f * t / n)), 2) + pow(sum({value} * sin(2 * pi() * f * t / n)), 2) + {floor} AS p
  FROM bins GROUP BY {SERIES}, f),
sh AS (SELECT *, p / sum(p) OVER g AS q, sum(p) OVER (PARTITION BY {SERIES} ORDER BY f) AS run, sum(p) OVER g AS total, max(p) OVER g AS peak
  FROM pw WINDOW g AS (PARTITION BY {SERIES}))"""


_SPEC = {"spectralentropy": "-sum(q * ln(q))", "spectralflatness": "exp(avg(ln(p))) / (avg(p) + 1e-9)",
         "domfreqpower": "max(p)", "spectralrolloff": "min(CASE WHEN run >= 0.85 * total THEN f END)"}
long_query("s_c_sbc_spectral", select(_SPEC, "sh"), sbc(list(_SPEC), W_SBC), W_SBC, dft("x", 1e-9), digits=4, domfreqpower=0)
long_query("s_c_sbc_spectral_peak", select({"fftmaxfreq": "min(f) FILTER (p >= peak * (1 - 1e-9)) / CAST(n AS DOUBLE)"}, "sh"),
           sbc(["fftmaxfreq"]), W_SBC, dft("x", 1e-9), digits=4)
long_query("s_c_sbc_norm", None, sbc(SH.SBC_FAMILIES["sbcnorm"]), W_SBC, digits=4)


def _score_rows() -> str:
    """Normal scores of the series lengths of this panel; the first anchor has less than a year behind it."""
    first = (ANCHORS[0] - date(1995, 1, 1)).days + 1
    table = SH.normal_scores([min(w, first) for w in W_SBC] + list(W_SBC))
    return ", ".join(f"({n}, {i}, {x!r}::DOUBLE)" for n, scores, _ in table for i, x in enumerate(scores, 1))


_FRANCIA = f""", ns AS (SELECT * FROM (VALUES {_score_rows()}) v(n, i, score)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {SERIES} ORDER BY x) AS i FROM c),
fr AS (SELECT ranked.*, score FROM ranked JOIN ns ON ns.n = ranked.n AND ns.i = ranked.i)"""
long_query("s_c_sbc_francia", select({"shapirofrancia": "pow(sum(x * score), 2) / greatest(n * var_pop(x) * sum(score * score), 1e-12)"}, "fr"),
           sbc(["shapirofrancia"]), W_SBC, _FRANCIA, digits=4)

# -- tsfeat ----------------------------------------------------------------------------------------------
W_A = (30, 90)
_K7 = "round(n / 7.0)"
_SA = f"""{_LAG}, on_ AS (SELECT *, x > 0 AS up, lag(x > 0) OVER g AS was,
  t - coalesce(max(CASE WHEN x > 0 THEN t END) OVER (PARTITION BY {SERIES} ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS quiet
  FROM lg WINDOW g AS (PARTITION BY {SERIES} ORDER BY t)),
pw AS (SELECT {SERIES}, f, pow(sum((x - mu) * cos(2 * pi() * f * t / n)), 2) + pow(sum((x - mu) * sin(2 * pi() * f * t / n)), 2) AS p
  FROM (SELECT *, unnest(range(1, n // 2 + 1)) AS f FROM c) GROUP BY {SERIES}, f),
sp AS (SELECT {SERIES}, sum(CASE WHEN f = {_K7} THEN p ELSE 0 END) / greatest(sum(p), 1e-9) AS weeklypower,
  -sum(p / greatest(tot, 1e-9) * ln(greatest(p / greatest(tot, 1e-9), 1e-12))) / ln(count(*)) AS specentropy
  FROM (SELECT *, sum(p) OVER (PARTITION BY {SERIES}) AS tot FROM pw) GROUP BY {SERIES}),
one AS ({select({"skew": _SK, "kurt": _KU, "trendslope": _TRENDSLOPE, "autocorr1": pearson(1), "autocorr7": pearson(7),
                 "mad": "avg(abs(x - mu))", "maxshare": "max(x) / greatest(sum(x), 1e-9)", "dutycycle": "avg(CASE WHEN up THEN 1.0 ELSE 0 END)",
                 "switches": "sum(CASE WHEN up <> was THEN 1 ELSE 0 END)", "maxzerorun": "max(CASE WHEN up THEN 0 ELSE quiet END)"}, "on_")})"""
long_query("s_a_tsfeat", "SELECT one.*, weeklypower, specentropy FROM one JOIN sp USING (anchor, user_id, metric, w)",
           lambda panel, anchors: SH.tsfeat_table(panel, anchors), W_A, _SA, digits=4)

_QS = ", ".join(f"{k / 10}" for k in range(11))


@query("s_a_distshift", sql_result(
    f"""SELECT anchor, user_id, list_avg(list_transform(range(1, 12), lambda i: abs(ln(1 + qa[i]) - ln(1 + qb[i])))) AS distshift_gmv_30v60,
  ln(1 + qa[10]) - ln(1 + qb[10]) AS distshift_q90_gmv_30v60 FROM (
  SELECT anchor, user_id, quantile_cont(x, [{_QS}]) FILTER (t >= n - 30) AS qa, quantile_cont(x, [{_QS}]) FILTER (t < n - 30) AS qb
  FROM c WHERE metric = 'gmv' GROUP BY anchor, user_id)""", ctes=dense_ctes((90,)), digits=4))
def s_a_distshift(spark, folder):
    d = order_days(spark, folder)
    return out(SH.distance_30_60(d.panel, d.index(ANCHORS)), digits=4)


# -- tsfresh -------------------------------------------------------------------------------------------
W_B = (30, 90, 365)
_B = f""", nb AS (SELECT *, lag(x, 1) OVER g AS l1, lag(x, 2) OVER g AS l2, lag(x, 7) OVER g AS l7, x > mu AS up,
  avg(x * x) OVER h AS mu2, var_pop(x * x) OVER h AS var2 FROM c WINDOW g AS (PARTITION BY {SERIES} ORDER BY t), h AS (PARTITION BY {SERIES})),
isl AS (SELECT *, t - row_number() OVER (PARTITION BY {SERIES}, up ORDER BY t) AS grp FROM nb),
runs AS (SELECT {SERIES}, up, count(*) AS len FROM isl GROUP BY {SERIES}, up, grp),
longest AS (SELECT {SERIES}, coalesce(max(len) FILTER (up), 0) AS longstrike_above, coalesce(max(len) FILTER (NOT up), 0) AS longstrike_below FROM runs GROUP BY {SERIES}),
""" + ",\n".join(f"""w{o} AS (SELECT {SERIES}, sum(e) / greatest(n // {2**o}, 1) AS wavenergy{o} FROM (
  SELECT {SERIES}, b, sqrt(sum(d * d)) AS e FROM (SELECT {SERIES}, t // {2**o} AS b, t % {2**(o - 1)} AS i,
    sum(CASE WHEN t % {2**o} < {2**(o - 1)} THEN x ELSE -x END) AS d FROM c WHERE t < n // {2**o} * {2**o} GROUP BY {SERIES}, b, i)
  GROUP BY {SERIES}, b) GROUP BY {SERIES})""" for o in (1, 2, 3)) + f""",
fit AS (SELECT *, sum(x * (t - (n - 1) / 2.0)) OVER (PARTITION BY {SERIES}) / (n * (n * n - 1.0) / 12) AS slope FROM nb),
one AS (SELECT {SERIES}, sum(x * l1 * l2) / (n - 2) AS c3, sum(x * x * l1 - l1 * l2 * l2) FILTER (t >= 2) / (n - 2) AS timerev,
  max(slope) / greatest(sqrt(greatest(sum(pow(x - mu - slope * (t - (n - 1) / 2.0), 2)) / (n - 2) / (n * (n * n - 1.0) / 12), 1e-18)), 1e-9) AS trendt,
  CASE WHEN max(var2) > 1e-12 THEN sum((x * x - mu2) * (l7 * l7 - mu2)) / ((n - 7) * max(var2)) ELSE 0 END AS arch7,
  CASE WHEN var_pop(x) > 1e-12 THEN sum((x - mu) * (l1 - mu)) / ((n - 1) * var_pop(x)) ELSE 0 END AS pacf1
  FROM fit GROUP BY {SERIES})"""
long_query("s_b_tsfresh",
           "SELECT anchor, user_id, metric, w, c3, timerev, trendt, arch7, longstrike_above, longstrike_below, wavenergy1, wavenergy2, wavenergy3, pacf1 "
           f"FROM one JOIN longest USING ({SERIES}) JOIN w1 USING ({SERIES}) JOIN w2 USING ({SERIES}) JOIN w3 USING ({SERIES})",
           lambda panel, anchors: SH.tsfresh_table(panel, anchors), W_B, _B, digits=4, c3=-3, timerev=-3)
# Every series is read as letters, one word at a time: a word that is not known yet is added and the next one begins.
_LZ = f""", ext AS (SELECT *, min(x) OVER g AS lo, max(x) OVER g AS hi FROM c WINDOW g AS (PARTITION BY {SERIES})),
letters AS (SELECT {SERIES}, list(chr(CAST(65 + len(list_filter(range(1, 11), lambda i: CASE WHEN i = 10 THEN hi ELSE i * ((hi - lo) / 10) + lo END < x)) AS INT)) ORDER BY t) AS ls
  FROM ext GROUP BY {SERIES}),
words AS (SELECT {SERIES}, list_reduce(ls, lambda s, l: CASE WHEN list_contains(s.k, s.w || l) THEN {{w: s.w || l, k: s.k}} ELSE {{w: '', k: list_append(s.k, s.w || l)}} END,
  {{w: '', k: []::VARCHAR[]}}) AS r FROM letters)"""
long_query("s_b_lempelziv", "SELECT anchor, user_id, metric, w, len(r.k) / CAST(n AS DOUBLE) AS lempelziv FROM words", lambda panel, anchors: SH.tsfresh_table(panel, anchors, complexity=True).select(*LONG, "lempelziv"), W_B, _LZ)

# -- fcast -----------------------------------------------------------------------------------------------
W_D = (90, 365)


def fcast(family: str, windows=W_D):
    return lambda panel, anchors: SH.fcast_table(panel, anchors, SH.FCAST_FAMILIES[family], windows)


_HANN = "((x - mu) * (0.5 - 0.5 * cos(2 * pi() * t / (n - 1))))"
_H = "(-sum(q * ln(q)))"
long_query("s_d_omega", select({"omega_raw": f"1 - {_H} / ln(2 * pi())", "omega_bounded": f"1 - {_H} / ln(count(*))"}, "sh"),
           fcast("fcomega"), W_D, dft(_HANN, 1e-12), digits=4)
_STL = f""", tr AS (SELECT *, sum(x) OVER (PARTITION BY {SERIES} ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7.0 AS tt FROM c),
se AS (SELECT *, avg(x - tt) OVER (PARTITION BY {SERIES}, (anchor - n + 1 + t) % 7) AS ss FROM tr)"""
_VR = "var_pop(x - tt - ss)"
long_query("s_d_stl", select({"trendstr": f"greatest(0, 1 - {_VR} / greatest(var_pop(x - ss), 1e-9))",
                              "seasstr": f"greatest(0, 1 - {_VR} / greatest(var_pop(x - tt), 1e-9))",
                              "residshare": f"{_VR} / greatest(var_pop(x), 1e-9)"}, "se"), fcast("fcstl"), W_D, _STL)
_Q9 = ", ".join(f"{k / 8}" for k in range(9))
_SHIFT = f""", qq AS (SELECT {SERIES}, quantile_cont(x, [{_Q9}]) FILTER (t < n // 2) AS qa, quantile_cont(x, [{_Q9}]) FILTER (t >= n // 2) AS qb
  FROM c GROUP BY {SERIES})"""
long_query("s_d_shift", """SELECT anchor, user_id, metric, w, list_sum(list_transform(range(1, 10), lambda i: ln(1 + abs(qa[i] - qb[i])))) AS shift_lorentz,
  list_avg(list_transform(range(1, 10), lambda i: abs(ln(1 + qa[i]) - ln(1 + qb[i])))) AS shift_logq FROM qq""",
           fcast("fcshift"), W_D, _SHIFT, digits=4)
_TRANS = f""", th AS (SELECT *, quantile_cont(x, 1/3::DOUBLE) OVER g AS low, quantile_cont(x, 2/3::DOUBLE) OVER g AS high FROM c WINDOW g AS (PARTITION BY {SERIES})),
sy AS (SELECT *, CASE WHEN x > low THEN 1 ELSE 0 END + CASE WHEN x > high THEN 1 ELSE 0 END AS s FROM th),
nx AS (SELECT *, lead(s) OVER (PARTITION BY {SERIES} ORDER BY t) AS s2 FROM sy),
cell AS (SELECT {SERIES}, i, j, count(*) FILTER (s = i AND s2 = j) / (n - 1.0) AS v FROM nx, range(3) a_(i), range(3) b_(j) GROUP BY {SERIES}, i, j)"""
long_query("s_d_transition", select({"transition": "var_pop(v)", "selftransition": "sum(v) FILTER (i = j)"}, "cell"), fcast("fctrans"), W_D, _TRANS)
_ALL_LAGS = ", ".join(f"lag(x, {k}) OVER g AS l{k}" for k in SH.LAGS)
_ACF = f", lg AS (SELECT *, {_ALL_LAGS} FROM c WINDOW g AS (PARTITION BY {SERIES} ORDER BY t))"
_ACFS = f"(SELECT anchor, user_id, metric, w, [{', '.join(f'round({pearson(k)}, 9)' for k in SH.LAGS)}] AS r FROM lg GROUP BY {SERIES})"
long_query("s_d_acf", f"""SELECT anchor, user_id, metric, w, list_sum(list_transform(r, lambda y: abs(y))) AS acf_abssum,
  list_max(r) AS acf_max FROM {_ACFS}""",
           lambda panel, anchors: SH.fcast_table(panel, anchors, ["acf_abssum", "acf_max"]), W_D, _ACF, digits=4)
long_query("s_d_acf_argmax", f"SELECT anchor, user_id, metric, w, list_position([y >= list_max(r) - 1e-7 for y in r], true) AS acf_argmax FROM {_ACFS}",
           lambda panel, anchors: SH.fcast_table(panel, anchors, ["acf_argmax"]), W_D, _ACF)


def wide_query(name: str, blocks: list[str]):
    @query(name)
    def run(spark, folder):
        d = order_days(spark, folder)
        return out(B.build(d.panel, d.index(ANCHORS), d.n_days, blocks))


wide_query("s_c_sbc_wide", ["sbc"])
wide_query("s_c_shipped_matrix", ["base", "counts", "rank", "visit", "channel", "dispersion", "sbcnomoment"])
