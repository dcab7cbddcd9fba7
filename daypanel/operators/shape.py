"""Statistics of the shape of each user's daily series in the windows before an anchor.

A series is sparse: most days are zero. Every day with a value, and its two neighbours, becomes one
event. A user's events are gathered once with their running sums; a window looks these up at its two
ends, which gives moments, trends, autocorrelations, runs and sign changes of the zero-filled series
without ever writing the zeros, and takes its values as one slice. Work grows with events plus anchors
times windows. Order statistics read the sorted non-zero values and count the zeros. Only spectra, the weekly decomposition and one normality distance are
computed on arrays, in Arrow batches.

Events are derived within users, so the only shuffle is the one that clustered the panel.
"""

from __future__ import annotations

import re
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import series
from ..functions.text import mean, named
from .parts import Part
from .windows import POPULATION_DAYS, calendar, latest, place_of_days

METRICS = ("gmv", "ord")
LAGS = range(1, 15)

# Window lengths per block, and the shortest series a block accepts.
TSFEAT_WINDOWS, TSFRESH_WINDOWS, FCAST_WINDOWS = (30, 90), (30, 90, 365), (90, 365)
SBC_WINDOWS = (7, 14, 30, 60, 90, 180, 365)
SHORTEST = {"tsfeat": 1, "tsfresh": 30, "sbc": 8, "fcast": 28}

# The statistics of each family.
SBC_FAMILIES = {
    "sbcshape": ["trendchangerate", "numtrendchanges", "zigzagfreq", "fracup", "fracdown", "maxrunlength",
                 "meanrunlength", "zerocross", "meanlast"],
    "sbcmoment": ["mean", "std", "skew", "kurtosis", "mad", "cv", "energy", "rms", "fft", "jarquebera",
                  "burstiness", "dutycycle"],
    "sbcorder": ["q10", "q25", "median", "q75", "q90", "q99", "q19", "iqr", "interdecile", "max", "range",
                 "trimmedmean", "trimmedstd", "winsorizedmean", "biweightmidvar", "gini"],
    "sbcnorm": ["shapirofrancia", "andersondarling"],
    "sbcspec": ["spectralentropy", "spectralflatness", "fftmaxfreq", "domfreqpower", "spectralrolloff"],
    "sbcts": ["trendslope", "firsthalfmean", "secondhalfmean", "hurstexp", "autocorr1", "autocorr5", "autocorr7"],
    "sbcent": ["histentropy"],
}
FCAST_FAMILIES = {
    "fcomega": ["omega_raw", "omega_bounded"],
    "fcstl": ["trendstr", "seasstr", "residshare"],
    "fcshift": ["shift_lorentz", "shift_logq"],
    "fctrans": ["transition", "selftransition"],
    "fcacf": ["acf_abssum", "acf_argmax", "acf_max"],
}
TSFEAT = ["skew", "kurt", "trendslope", "autocorr1", "autocorr7", "weeklypower", "specentropy", "mad", "maxshare",
          "dutycycle", "switches", "maxzerorun"]
TSFRESH = ["c3", "timerev", "trendt", "arch7", "longstrike_above", "longstrike_below", "wavenergy1", "wavenergy2",
           "wavenergy3", "pacf1"]


def events(panel: DataFrame, metrics: tuple[str, ...] = METRICS, lags: list[int] = ()) -> DataFrame:
    """Per user, metric and day near a value: the value, both neighbours, lagged values, whether the slope turns.

    Days with a row but no value are kept as well; they show who is in the population.
    """
    def side(metric: str, shift: int) -> str:
        """What a value at ``day`` is to the event at ``day + shift``."""
        part = {1: "prev", 0: "mid", -1: "next"}[shift]
        cells = ", ".join(f"{metric if c == part else '0D'} AS {c}" for c in ("prev", "mid", "next"))
        return f"struct('{metric}' AS metric, cast(day + {shift} as int) AS m, {cells}, {int(shift == 0)} AS here)"

    sides = ", ".join(side(c, d) for c in metrics for d in (-1, 0, 1))
    near = panel.selectExpr("user_id", f"inline(array({sides}))").filter("here = 1 OR prev + next > 0")
    rows = near.groupBy("user_id", "metric", "m").agg(*[F.sum(c).alias(c) for c in ("prev", "mid", "next")], F.max("here").alias("here"))
    by = "PARTITION BY user_id, metric ORDER BY m"
    return rows.selectExpr(
        "*", "sign(mid - prev) <> sign(next - mid) AS turn",
        *[f"coalesce(sum(mid) OVER ({by} RANGE BETWEEN {k} PRECEDING AND {k} PRECEDING), 0D) AS lag{k}" for k in lags],
    )


_if = lambda cond: f"cast({cond} as int)"

# Per event, what running sums are taken of.
RUNNING = {
    "here": "here", "s1": "mid", "s2": "mid * mid", "k": _if("mid > 0"), "sm": "mid * m", "wn": "mid * (1 - 2 * pmod(m, 2))",
    "ups": _if("mid > prev"), "downs": _if("next < mid"), "cross": _if("(mid - prev) * (next - mid) < 0"), "turns": _if("turn"),
    "triple": "prev * mid * next", "skewed": "next * next * mid - mid * prev * prev", "switches": _if("(mid > 0) <> (prev > 0)"),
    "sq7": "mid * mid * lag7 * lag7", **{f"p{k}": f"mid * lag{k}" for k in LAGS},
}


def _upto(running: str, day: str) -> str:
    """A running sum as of a day: ``place`` says which event is the latest one by then."""
    return f"coalesce({latest(running, day, 'm')}, 0)"


def _over(running: str, first: str = "c.start", final: str = "c.anchor") -> str:
    """Sum over the days ``first`` .. ``final``: the running sum is searched at both ends."""
    if (first, final) != ("c.start", "c.anchor"):
        final = f"greatest({final}, {first} - 1)"
    return f"({_upto(running, final)} - {_upto(running, f'{first} - 1')})"


def _sums() -> dict[str, str]:
    """Quantities of the window ``c`` (anchor, n days from day ``start`` on), from running sums and slices."""
    inner = ("c.start + 1", "c.anchor - 1")
    out = {n: _over(n) for n in ("s1", "s2", "k")} | {n: _over(n, *inner) for n in ("cross", "turns", "triple", "skewed")}
    out |= {
        "st": f"{_over('sm')} - (c.start + (c.n - 1) / 2D) * {_over('s1')}",
        "half": _over("s1", "c.start", "c.start + c.n div 2 - 1"),
        "ups": _over("ups", "c.start + 1"), "downs": _over("downs", "c.start", "c.anchor - 1"), "switches": _over("switches", "c.start + 1"),
        "wave_n": f"(1 - 2 * pmod(c.start, 2)) * {_over('wn')}",
        "sq7": _over("sq7", "c.start + 7"),
        "pts": f"transform(slice(points, {_upto('k', 'c.start - 1')} + 1, {_over('k')}), p -> named_struct('t', p.m - c.start, 'x', p.x))",
        "turn_days": f"slice(turning, {_upto('turns', 'c.start')} + 1, {_over('turns', *inner)})",
    }
    for k in LAGS:
        out |= {
            f"p{k}": _over(f"p{k}", f"c.start + {k}"),
            f"a{k}": _over("s1", "c.start", f"c.anchor - {k}"), f"b{k}": _over("s1", f"c.start + {k}"),
            f"aa{k}": _over("s2", "c.start", f"c.anchor - {k}"), f"bb{k}": _over("s2", f"c.start + {k}"),
        }
    return out


SUMS = _sums()

# What follows from the quantities above inside one row, in an order in which each finds what it reads.
DERIVED = {
    "xs": "transform(pts, p -> p.x)", "ts": "transform(pts, p -> p.t)", "mu": "s1 / n", "z": "n - cast(k as int)",
    "v": "sort_array(xs)", "var": "greatest(s2 / n - mu * mu, 0D)",
    "sd": "CASE WHEN var > 1e-13 * s2 / n THEN sqrt(var) ELSE 0D END",
    # Higher powers are added up inside the window: as differences of running sums they would lose digits.
    "s3": "aggregate(xs, 0D, (a, x) -> a + x * x * x)", "s4": "aggregate(xs, 0D, (a, x) -> a + x * x * x * x)",
    "top": "coalesce(array_max(xs), 0D)",
    "x_first": "CASE WHEN get(ts, 0) = 0 THEN get(xs, 0) ELSE 0D END",
    "t_last": "get(ts, size(ts) - 1)", "x_last": "CASE WHEN t_last = n - 1 THEN get(xs, size(xs) - 1) ELSE 0D END",
    "turn_run": "aggregate(turn_days, named_struct('at', start, 'most', 0), (s, d) -> named_struct('at', d, 'most', greatest(s.most, d - s.at)), s -> s.most)",
    "turn_last": "coalesce(get(turn_days, size(turn_days) - 1) - start, 0)",
    "zero_run": "aggregate(ts, named_struct('at', -1, 'most', cast(null as int)), (s, t) -> named_struct('at', t, 'most', greatest(s.most, t - s.at - 1)), s -> s.most)",
    "wave_c": "aggregate(pts, 0D, (a, p) -> a + p.x * cos(2 * pi() * round(n / 7D) * p.t / n))",
    "wave_s": "aggregate(pts, 0D, (a, p) -> a + p.x * sin(2 * pi() * round(n / 7D) * p.t / n))",
}


def _read(texts, known) -> set[str]:
    return {n for t in texts for n in re.findall(r"[A-Za-z_]\w*", t)} & set(known)


def gathered(panel: DataFrame, anchors: list[int], running: set[str], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """One row per user and metric: events ``e`` with running sums, ``place`` of each day, ``points`` and ``turning`` days.

    Days are found through ``place``, as in ``windows.aggregate``.
    """
    lags = sorted({7 if n == "sq7" else int(n[1:]) for n in running if n == "sq7" or re.fullmatch(r"p\d+", n)})
    order = "(PARTITION BY user_id, metric ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    rows = events(panel, metrics, lags).selectExpr("user_id", "metric", "m", "mid", "turn", *[f"sum({RUNNING[n]}) OVER {order} AS `{n}`" for n in sorted(running)])
    listed = lambda x, name: F.expr(f"array_sort(collect_list({x})) AS {name}")
    users = rows.groupBy("user_id", "metric").agg(
        listed(f"struct(m, {', '.join(f'`{n}`' for n in sorted(running))})", "e"),
        listed("CASE WHEN mid > 0 THEN struct(m, mid AS x) END", "points"), listed("CASE WHEN turn THEN m END", "turning"),
    )
    return users.selectExpr("*", f"{place_of_days(max(anchors, default=0), 'm')} AS place")


def _present(anchors: list[int]) -> str:
    """The anchors that have the user in their population."""
    return f"filter({calendar(anchors)}, a -> {_upto('here', 'a')} > {_upto('here', f'a - {POPULATION_DAYS}')})"


def windows_table(panel: DataFrame, anchors: list[int], windows, shortest: int, texts) -> DataFrame:
    """One row per (anchor, population user, metric, window) with all that the expressions ``texts`` read.

    A user's events are gathered once, with their running sums. A window is an element of an array of
    (anchor, length), for which the running sums are looked up at both of its ends; no event is copied.
    """
    derived, found = set(), _read(texts, DERIVED)
    while found - derived:
        derived |= found
        found |= _read([DERIVED[n] for n in found], DERIVED)
    sums = _read([*texts, *[DERIVED[n] for n in derived]], SUMS)
    running = {n for s in sums for n in re.findall(r"\)\)\.(\w+)", SUMS[s])} | {"here"}
    users = gathered(panel, anchors, running)
    sizes = ", ".join(str(int(w)) for w in windows)
    span = "named_struct('anchor', a, 'w', w, 'n', least(w, a + 1), 'start', greatest(a + 1 - w, 0))"
    spans = f"filter(flatten(transform({_present(anchors)}, a -> transform(array({sizes}), w -> {span}))), c -> c.n >= {shortest})"
    cells = ", ".join(f"'{n}', {SUMS[n]}" for n in sorted(sums))
    keys = ", ".join(f"'{n}', c.{n}" for n in ("anchor", "w", "n", "start"))
    table = users.selectExpr("user_id", "metric", f"inline(transform({spans}, c -> named_struct({keys}{', ' if cells else ''}{cells})))")
    for n in DERIVED:
        if n in derived:
            table = table.selectExpr("*", f"{DERIVED[n]} AS {n}")
    return table


# -- expressions over a window row ---------------------------------------------------------------------

def _acf(k: int) -> str:
    """Pearson correlation of the series with itself ``k`` days later."""
    m = f"(n - {k})"
    den = f"sqrt(greatest(aa{k} - a{k} * a{k} / {m}, 0D) * greatest(bb{k} - b{k} * b{k} / {m}, 0D))"
    return f"CASE WHEN {den} > 1e-9 THEN (p{k} - a{k} * b{k} / {m}) / {den} ELSE 0D END"


def _global_acf(pair: str, mu: str, head: str, tail: str, var: str, k: int) -> str:
    """Autocorrelation with the mean and variance of the whole series."""
    num = f"({pair} - {mu} * ({head} + {tail}) + (n - {k}) * {mu} * {mu})"
    return f"CASE WHEN {var} > 1e-12 THEN {num} / greatest((n - {k}) * {var}, 1e-12) ELSE 0D END"


_M3 = "(s3 / n - 3 * mu * s2 / n + 2 * mu * mu * mu)"
_M4 = "(s4 / n - 4 * mu * s3 / n + 6 * mu * mu * s2 / n - 3 * mu * mu * mu * mu)"
SKEW = f"CASE WHEN sd > 0 THEN {_M3} / (sd * sd * sd) ELSE 0D END"
KURT = f"CASE WHEN sd > 0 THEN {_M4} / (sd * sd * sd * sd) - 3 ELSE -3D END"
SLOPE = "st / (n * (n * n - 1D) / 12)"
# Deviations above and below the mean are equal, so one side is enough.
MAD = "2 * aggregate(filter(v, x -> x > mu), 0D, (a, x) -> a + (x - mu)) / n"
ABOVE = "size(filter(v, x -> x > mu))"


def _at(i: str, values: str = "v", zeros: str = "z") -> str:
    """The i-th smallest value (from 0) of a series with ``zeros`` zero days."""
    return f"(CASE WHEN {i} < {zeros} THEN 0D ELSE element_at({values}, cast({i} - {zeros} + 1 as int)) END)"


def _index(q: float) -> str:
    return f"cast({q!r}D * (n - 1) as int)"


def _quantile(q: float, values: str, zeros: str, n: str) -> str:
    """Linear quantile of a zero-filled series."""
    h = f"({q!r}D * ({n} - 1))"
    lo, hi = f"cast(floor({h}) as int)", f"cast(least(floor({h}) + 1, {n} - 1) as int)"
    a, b = _at(lo, values, zeros), _at(hi, values, zeros)
    return f"({a} + ({b} - {a}) * ({h} - floor({h})))"


def _moments() -> dict[str, str]:
    return {
        "mean": "mu", "std": "sd", "skew": SKEW, "kurtosis": KURT, "mad": MAD, "cv": "abs(sd / (mu + 1e-9))",
        "energy": "s2", "rms": "sqrt(s2 / n)", "fft": "n * s2",
        "jarquebera": f"n / 6D * (pow({SKEW}, 2) + pow({KURT}, 2) / 4)",
        "burstiness": "(sd - mu) / (sd + mu + 1e-9)", "dutycycle": f"{ABOVE} / n",
    }


def _shape() -> dict[str, str]:
    return {
        "trendchangerate": "turns / (n - 2 + 1e-9)", "numtrendchanges": "turns", "zigzagfreq": "turns / (n - 2)",
        "fracup": "ups / (n - 1)", "fracdown": "downs / (n - 1)", "maxrunlength": "turn_run",
        "meanrunlength": "turn_last / greatest(turns, 1D)", "zerocross": "cross", "meanlast": "(x_last - x_first) / (n - 1)",
    }


def _order() -> dict[str, str]:
    q = {p: _at(_index(p)) for p in (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)}
    lo, hi = _index(0.10), _index(0.90)
    part = f"slice(v, greatest({lo} - z, 0) + 1, greatest({hi} - greatest({lo}, z) + 1, 0))"
    total = f"aggregate({part}, 0D, (a, x) -> a + x)"
    width = f"({hi} - {lo} + 1)"
    tm = f"({total} / {width})"
    around = f"(aggregate({part}, 0D, (a, x) -> a + (x - {tm}) * (x - {tm})) + ({width} - size({part})) * {tm} * {tm})"
    low, high = q[0.05], q[0.95]
    wins = f"(aggregate(v, 0D, (a, x) -> a + least(greatest(x, {low}), {high})) + z * {low}) / n"
    dev = f"sort_array(concat(array_repeat({q[0.5]}, z), transform(v, x -> abs(x - {q[0.5]}))))"
    middle = f"(element_at({dev}, cast((n + 1) div 2 as int)) + element_at({dev}, cast(n div 2 + 1 as int))) / 2"
    return {
        "q10": q[0.1], "q25": q[0.25], "median": q[0.5], "q75": q[0.75], "q90": q[0.9], "q99": q[0.99],
        "q19": f"{q[0.9]} - {q[0.01]}", "iqr": f"{q[0.75]} - {q[0.25]}", "interdecile": f"{q[0.9]} - {q[0.1]}",
        "max": "top", "range": f"top - {_at('0')}", "trimmedmean": tm, "trimmedstd": f"sqrt({around} / {width})",
        "winsorizedmean": wins,
        # With more than half of the days zero, the median distance from the median is zero.
        "biweightmidvar": f"CASE WHEN 2 * z > n + 1 THEN 0D ELSE pow(1.4826D * {middle}, 2) END",
        "gini": "2 * aggregate(transform(v, (x, i) -> (z + i + 1) * x), 0D, (a, x) -> a + x) / (n * greatest(s1, 1e-9)) - (n + 1D) / n",
    }


def _series() -> dict[str, str]:
    return {
        "trendslope": SLOPE, "firsthalfmean": "half / (n div 2)", "secondhalfmean": "(s1 - half) / (n - n div 2)",
        "hurstexp": "ln(greatest(sqrt(greatest(walk.q / n - pow(walk.s / n, 2), 0D)), 1e-9)) / ln(n + 1e-9)",
        **{f"autocorr{k}": _acf(k) for k in (1, 5, 7)},
    }


# Sum and sum of squares of the running deviation c[t] = sum(x[0..t]) - (t + 1) mu over all days: over a
# stretch t = a..b with a constant running sum, both follow from sums of (t + 1) and (t + 1)^2.
_TRI = "(({b} + 1D) * ({b} + 2) / 2 - {a} * ({a} + 1D) / 2)"
_PYR = "(({b} + 1D) * ({b} + 2) * (2 * {b} + 3) / 6 - {a} * ({a} + 1D) * (2 * {a} + 1) / 6)"


def _walk() -> str:
    add = lambda a, b, c: (
        f"w.s + ({b} - {a} + 1) * {c} - mu * {_TRI.format(a=a, b=b)}",
        f"w.q + ({b} - {a} + 1) * {c} * {c} - 2 * {c} * mu * {_TRI.format(a=a, b=b)} + mu * mu * {_PYR.format(a=a, b=b)}",
    )
    s1, q1 = add("w.at", "(p.t - 1)", "w.run")
    s2, q2 = add("w.at", "(n - 1)", "w.run")
    return (
        "aggregate(pts, named_struct('at', 0, 'run', 0D, 's', 0D, 'q', 0D), "
        f"(w, p) -> named_struct('at', p.t, 'run', w.run + p.x, 's', {s1}, 'q', {q1}), "
        f"w -> named_struct('s', {s2}, 'q', {q2}))"
    )


def _entropy() -> dict[str, str]:
    low = _at("0")
    bin_of = lambda x: f"least(greatest(cast(({x} - {low}) / greatest(top - {low}, 1e-9) * 10 as int), 0), 9)"
    count = f"(size(filter(v, x -> {bin_of('x')} = b)) + CASE WHEN b = {bin_of('0D')} THEN z ELSE 0 END) / cast(n as double)"
    shares = f"transform(sequence(0, 9), b -> {count})"
    return {"histentropy": f"-aggregate({shares}, 0D, (a, p) -> a + p * ln(greatest(p, 1e-12)))"}


def normal_scores(lengths: list[int]) -> list[tuple[int, list[float], float]]:
    """Centred normal order scores per series length: they depend on nothing else."""
    out = []
    for n in sorted(set(lengths)):
        m = [NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
        mid = sum(m) / n
        m = [x - mid for x in m]
        out.append((n, m, sum(x * x for x in m)))
    return out


def sbc_table(panel: DataFrame, anchors: list[int], want: list[str], windows=SBC_WINDOWS) -> DataFrame:
    """Chosen statistics of the 52-statistic set, one row per (anchor, user, metric, window)."""
    exprs = _shape() | _moments() | _order() | _series() | _entropy()
    arrays = {"hurstexp": _walk(), "andersondarling": "v mu sd", "shapirofrancia": "v z var"} | {n: "ts xs" for n in SBC_FAMILIES["sbcspec"]}
    table = windows_table(panel, anchors, windows, SHORTEST["sbc"], [exprs.get(n, "") for n in want] + [arrays.get(n, "") for n in want])
    if "hurstexp" in want:
        table = table.selectExpr("*", f"{_walk()} AS walk")
    if set(want) & set(SBC_FAMILIES["sbcspec"]):
        table = table.withColumn("_f", series.spectral("ts", "xs", "n"))
        exprs |= {n: f"_f.{n}" for n in SBC_FAMILIES["sbcspec"]}
    if "andersondarling" in want:
        table = table.withColumn("_ad", series.normal_misfit("v", "n", "mu", "sd"))
        exprs["andersondarling"] = "_ad"
    if "shapirofrancia" in want:
        lengths = [min(w, a + 1) for w in windows for a in anchors if min(w, a + 1) >= SHORTEST["sbc"]]
        scores = panel.sparkSession.createDataFrame(normal_scores(lengths), "n int, scores array<double>, score_sum double")
        table = table.join(F.broadcast(scores), "n")  # a row per window length
        fit = "aggregate(transform(v, (x, i) -> x * element_at(scores, z + i + 1)), 0D, (a, x) -> a + x)"
        exprs["shapirofrancia"] = f"pow({fit}, 2) / greatest(n * var * score_sum, 1e-12)"
    return table.selectExpr("anchor", "user_id", "metric", "w", *named({s: exprs[s] for s in want}))


def tsfeat_table(panel: DataFrame, anchors: list[int], windows=TSFEAT_WINDOWS) -> DataFrame:
    # Power at the 7-day period over all power without the constant, which Parseval gives.
    power = "(n * n * var + CASE WHEN n % 2 = 0 THEN wave_n * wave_n ELSE 0D END) / 2"
    exprs = {
        "skew": SKEW, "kurt": KURT, "trendslope": SLOPE, "autocorr1": _acf(1), "autocorr7": _acf(7),
        "weeklypower": f"(pow(wave_c, 2) + pow(wave_s, 2)) / greatest({power}, 1e-9)",
        "specentropy": "_f.specentropy", "mad": MAD, "maxshare": "top / greatest(s1, 1e-9)", "dutycycle": "k / n",
        "switches": "switches", "maxzerorun": "greatest(coalesce(zero_run, 0), coalesce(n - 1 - t_last, n))",
    }
    table = windows_table(panel, anchors, windows, SHORTEST["tsfeat"], [*exprs.values(), "ts xs"]).withColumn("_f", series.spectral("ts", "xs", "n"))
    return table.selectExpr("anchor", "user_id", "metric", "w", *named({s: exprs[s] for s in TSFEAT}))


def distance_30_60(panel: DataFrame, anchors: list[int], metric: str = "gmv") -> DataFrame:
    """How far the daily values of the last 30 days are from those of the 60 days before."""
    users = gathered(panel, anchors, {"here", "k"}, (metric,))
    part = lambda lo, hi: f"sort_array(transform(slice(points, {_upto('k', f'a - {hi + 1}')} + 1, {_upto('k', f'a - {lo}')} - {_upto('k', f'a - {hi + 1}')}), p -> p.x))"
    cells = f"named_struct('anchor', a, 'va', {part(0, 29)}, 'vb', {part(30, 89)}, 'na', least(30, a + 1), 'nb', least(60, greatest(a - 29, 0)))"
    out = users.selectExpr("user_id", f"inline(transform({_present(anchors)}, a -> {cells}))")
    out = out.filter("nb > 0").selectExpr("*", "na - size(va) AS za", "nb - size(vb) AS zb")
    gap = lambda q: f"(log1p({_quantile(q, 'va', 'za', 'na')}) - log1p({_quantile(q, 'vb', 'zb', 'nb')}))"
    gaps = mean([f"abs({gap(k / 10)})" for k in range(11)])
    return out.selectExpr("anchor", "user_id", f"{gaps} AS distshift_{metric}_30v60", f"{gap(0.9)} AS distshift_q90_{metric}_30v60")


def tsfresh_table(panel: DataFrame, anchors: list[int], windows=TSFRESH_WINDOWS, complexity: bool = False) -> DataFrame:
    tt = "(n * (n * n - 1D) / 12)"
    left = f"greatest(n * var - st * st / {tt}, 0D)"
    se = f"sqrt(greatest({left} / (n - 2) / {tt}, 1e-18))"
    # Longest stretch above the mean, and longest stretch of everything else between such days.
    strikes = (
        "aggregate(filter(pts, p -> p.x > mu), named_struct('t', -1, 'run', 0, 'up', 0, 'down', 0), "
        "(s, p) -> named_struct('t', p.t, 'run', CASE WHEN p.t = s.t + 1 THEN s.run + 1 ELSE 1 END, "
        "'up', greatest(s.up, CASE WHEN p.t = s.t + 1 THEN s.run + 1 ELSE 1 END), 'down', greatest(s.down, p.t - s.t - 1)), "
        "s -> named_struct('up', s.up, 'down', greatest(s.down, cast(n as int) - 1 - s.t)))"
    )
    def energy(octave: int) -> str:
        k, h = 2**octave, 2 ** (octave - 1)
        # Signed values by block and place; the difference of the two halves adds them up.
        signed = f"transform(filter(pts, p -> p.t < n div {k} * {k}), p -> named_struct('b', p.t div {k}, 'i', p.t % {h}, 'x', CASE WHEN p.t % {k} < {h} THEN p.x ELSE -p.x END))"
        blocks = f"array_distinct(transform({signed}, e -> e.b))"
        place = " + ".join(f"pow(aggregate(filter(es, e -> e.b = b AND e.i = {i}), 0D, (s, e) -> s + e.x), 2)" for i in range(h))
        return f"aggregate(transform(array({signed}), es -> aggregate({blocks}, 0D, (a, b) -> a + sqrt({place}))), 0D, (a, x) -> a + x) / greatest(n div {k}, 1)"

    exprs = {
        "c3": "triple / (n - 2)", "timerev": "skewed / (n - 2)", "trendt": f"{SLOPE} / greatest({se}, 1e-9)",
        "arch7": _global_acf("sq7", "(s2 / n)", "aa7", "bb7", "greatest(s4 / n - s2 / n * (s2 / n), 0D)", 7),
        "longstrike_above": "strike.up", "longstrike_below": "strike.down",
        "pacf1": _global_acf("p1", "mu", "a1", "b1", "var", 1),
        **{f"wavenergy{o}": energy(o) for o in (1, 2, 3)},
    }
    names = list(TSFRESH)
    read = [*exprs.values(), strikes, *(["ts xs"] if complexity else [])]
    table = windows_table(panel, anchors, windows, SHORTEST["tsfresh"], read).selectExpr("*", f"{strikes} AS strike")
    if complexity:
        table = table.withColumn("_lz", series.distinct_words("ts", "xs", "n"))
        exprs["lempelziv"] = "_lz.lempelziv"
        names.append("lempelziv")
    return table.selectExpr("anchor", "user_id", "metric", "w", *named({s: exprs[s] for s in names}))


def fcast_table(panel: DataFrame, anchors: list[int], want: list[str], windows=FCAST_WINDOWS) -> DataFrame:
    """Predictability and series traits, one row per (anchor, user, metric, window)."""
    acf = f"array({', '.join(_acf(k) for k in LAGS)})"
    arrays = {"fcomega": "ts xs", "fcstl": "ts xs", "fcshift": "pts", "fctrans": "v z pts", "fcacf": acf}
    read = [text for family, text in arrays.items() if set(want) & set(FCAST_FAMILIES[family])]
    table = windows_table(panel, anchors, windows, SHORTEST["fcast"], read)
    exprs: dict[str, str] = {}
    if set(want) & set(FCAST_FAMILIES["fcomega"]):
        table = table.withColumn("_f", series.spectral("ts", "xs", "n"))
        exprs |= {n: f"_f.{n}" for n in FCAST_FAMILIES["fcomega"]}
    if set(want) & set(FCAST_FAMILIES["fcstl"]):
        table = table.withColumn("_d", series.decomposed("ts", "xs", "n"))
        exprs |= {n: f"_d.{n}" for n in FCAST_FAMILIES["fcstl"]}
    if set(want) & set(FCAST_FAMILIES["fcshift"]):
        half = "cast(n div 2 as int)"
        table = table.selectExpr(
            "*", f"{half} AS na", f"cast(n as int) - {half} AS nb",
            f"sort_array(transform(filter(pts, p -> p.t < {half}), p -> p.x)) AS va",
            f"sort_array(transform(filter(pts, p -> p.t >= {half}), p -> p.x)) AS vb",
        ).selectExpr("*", "na - size(va) AS za", "nb - size(vb) AS zb")
        table = table.selectExpr(
            "*",
            f"array({', '.join(_quantile(i / 8, 'va', 'za', 'na') for i in range(9))}) AS qa",
            f"array({', '.join(_quantile(i / 8, 'vb', 'zb', 'nb') for i in range(9))}) AS qb",
        )
        exprs["shift_lorentz"] = "aggregate(zip_with(qa, qb, (a, b) -> log1p(abs(a - b))), 0D, (s, x) -> s + x)"
        exprs["shift_logq"] = "aggregate(zip_with(qa, qb, (a, b) -> abs(log1p(a) - log1p(b))), 0D, (s, x) -> s + x) / 9"
    if set(want) & set(FCAST_FAMILIES["fctrans"]):
        table = table.selectExpr("*", f"{_quantile(1 / 3, 'v', 'z', 'n')} AS low", f"{_quantile(2 / 3, 'v', 'z', 'n')} AS high")
        level = "cast(p.x > low as int) + cast(p.x > high as int)"
        table = table.selectExpr("*", f"filter(transform(pts, p -> named_struct('t', p.t, 's', {level})), e -> e.s > 0) AS sy")
        # A pair is counted where its second day has a symbol, or where its first has and the second has not.
        table = table.selectExpr(
            "*",
            "transform(filter(transform(sy, (e, i) -> named_struct('t', e.t, 'c', CASE WHEN i > 0 AND sy[i - 1].t = e.t - 1 THEN 3 * sy[i - 1].s + e.s ELSE e.s END)), e -> e.t >= 1), e -> e.c) AS into_",
            "transform(filter(transform(sy, (e, i) -> named_struct('t', e.t, 'c', 3 * e.s, 'free', i = size(sy) - 1 OR sy[i + 1].t > e.t + 1)), e -> e.t <= n - 2 AND e.free), e -> e.c) AS out_",
        ).selectExpr("*", "concat(into_, out_) AS codes")
        cell = "(size(filter(codes, c -> c = i)) + CASE WHEN i = 0 THEN n - 1 - size(codes) ELSE 0 END) / greatest(n - 1D, 1D)"
        table = table.selectExpr("*", f"transform(sequence(0, 8), i -> {cell}) AS cells")
        exprs["transition"] = "aggregate(cells, 0D, (s, x) -> s + x * x) / 9 - pow(aggregate(cells, 0D, (s, x) -> s + x) / 9, 2)"
        exprs["selftransition"] = "cells[0] + cells[4] + cells[8]"
    if set(want) & set(FCAST_FAMILIES["fcacf"]):
        table = table.selectExpr("*", f"{acf} AS acf")
        exprs["acf_abssum"] = "aggregate(acf, 0D, (s, x) -> s + abs(x))"
        # Correlations that differ in the last digits are equal, and the shortest lag counts.
        exprs["acf_argmax"] = "array_position(transform(acf, x -> x >= array_max(acf) - 1e-7D), true)"
        exprs["acf_max"] = "array_max(acf)"
    return table.selectExpr("anchor", "user_id", "metric", "w", *named({s: exprs[s] for s in want}))


def spread_out(table: DataFrame, names: dict[str, str], windows) -> Part:
    """One column per statistic, metric and window; ``names`` maps statistic to its column prefix.

    The few series of a user come together in a fixed order and are read by position.
    """
    tags = [(m, w) for m in METRICS for w in windows]
    stats = [c for c in table.columns if c in names]
    place = " ".join(f"WHEN metric = '{m}' AND w = {w} THEN {i}" for i, (m, w) in enumerate(tags))
    packed = table.selectExpr("anchor", "user_id", f"struct(CASE {place} END AS i, {', '.join(stats)}) AS value")
    return Part(packed, {f"{names[c]}{c}_{m}_{w}": f"{{v}}[{i}].{c}" for i, (m, w) in enumerate(tags) for c in stats}, several=True)


SBC_ALL = [s for names in SBC_FAMILIES.values() for s in names]
SBC_NOMOMENT = [s for s in SBC_ALL if s not in SBC_FAMILIES["sbcmoment"]]
FCAST_ALL = [s for names in FCAST_FAMILIES.values() for s in names]
SBC_SPREAD = tuple(w for w in SBC_WINDOWS if w >= SHORTEST["sbc"])

# Blocks of spread statistics: column prefix, statistics, windows and the table they come from.
SPREAD = {
    "tsfeat": ("", TSFEAT, TSFEAT_WINDOWS, lambda p, a, names, w: tsfeat_table(p, a, w)),
    "tsfresh": ("tf_", TSFRESH, TSFRESH_WINDOWS, lambda p, a, names, w: tsfresh_table(p, a, w)),
    **{b: ("sbc_", names, SBC_SPREAD, sbc_table) for b, names in {"sbc": SBC_ALL, "sbcnomoment": SBC_NOMOMENT, **SBC_FAMILIES}.items()},
    **{b: ("fc_", names, FCAST_WINDOWS, fcast_table) for b, names in {"fcast": FCAST_ALL, **FCAST_FAMILIES}.items()},
}


def _spread_block(block: str):
    prefix, names, windows, table = SPREAD[block]

    def make(panel, anchors, n_days):
        parts = [spread_out(table(panel, anchors, names, windows), {s: prefix for s in names}, windows)]
        return parts + ([Part.of(distance_30_60(panel, anchors), optional=True)] if block == "tsfeat" else [])

    return make


SHAPE_BLOCKS = {block: _spread_block(block) for block in SPREAD}


def shape_reaches(block: str) -> dict[str, int]:
    """Days before the anchor that each column of a shape block can see."""
    prefix, names, windows, _ = SPREAD[block]
    found = {f"{prefix}{s}_{m}_{w}": w for s in names for m in METRICS for w in windows}
    return found | ({"distshift_gmv_30v60": 90, "distshift_q90_gmv_30v60": 90} if block == "tsfeat" else {})
