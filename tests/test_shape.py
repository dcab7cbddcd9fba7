"""Shape statistics without an SQL oracle, against plain loops over written-out series."""

from math import erf, log, sqrt
from statistics import NormalDist

import numpy as np
import pytest

from daypanel.operators import blocks as B
from daypanel.operators import shape as SH

ANCHORS = [40, 200, 410]


def series(toy, row, w):
    i = int(np.flatnonzero(toy["users"] == row["user_id"])[0])
    a = int(row["anchor"])
    m = toy[row["metric"]][i, max(a - w + 1, 0) : a + 1].astype(float)
    return m, max(a - w + 1, 0)


def check(toy, frame, name, loop, tol=1e-7):
    assert len(frame)
    for _, row in frame.iterrows():
        m, start = series(toy, row, int(row["w"]))
        assert row[name] == pytest.approx(loop(m, start), rel=tol, abs=tol), (name, dict(row))


def test_normality(spark, toy):
    got = SH.sbc_table(toy["panel"], ANCHORS, SH.SBC_FAMILIES["sbcnorm"], (14, 90, 365)).toPandas()

    def francia(m, _):
        s, n = np.sort(m), len(m)
        q = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
        q -= q.mean()
        return (s @ q) ** 2 / max(((s - s.mean()) ** 2).sum() * (q @ q), 1e-12)

    def anderson(m, _):
        s, n = np.sort(m), len(m)
        z = (s - s.mean()) / max(s.std(), 1e-9)
        f = [min(max(0.5 * (1 + erf(x / sqrt(2))), 1e-7), 1 - 1e-7) for x in z]
        return -n - sum((2 * i + 1) * (log(f[i]) + log(1 - f[n - 1 - i])) for i in range(n)) / n

    check(toy, got, "shapirofrancia", francia)
    check(toy, got, "andersondarling", anderson)


def test_spectrum(spark, toy):
    got = SH.sbc_table(toy["panel"], ANCHORS, SH.SBC_FAMILIES["sbcspec"], (30, 365)).toPandas()
    power = lambda m: np.abs(np.fft.rfft(m)) ** 2 + 1e-9
    check(toy, got, "domfreqpower", lambda m, _: power(m).max())
    check(toy, got, "spectralrolloff", lambda m, _: int(np.argmax(power(m).cumsum() >= 0.85 * power(m).sum())))
    check(toy, got, "spectralflatness", lambda m, _: np.exp(np.log(power(m)).mean()) / (power(m).mean() + 1e-9))
    for _, row in got.iterrows():  # the peak is checked by its height: flat spectra have several
        m, _ = series(toy, row, int(row["w"]))
        assert power(m)[int(round(row["fftmaxfreq"] * len(m)))] == pytest.approx(power(m).max(), rel=1e-9)


def test_acf_peak(spark, toy):
    got = SH.fcast_table(toy["panel"], ANCHORS, SH.FCAST_FAMILIES["fcacf"]).toPandas()

    def acf(m):
        out = []
        for k in range(1, 15):
            a, b = m[:-k] - m[:-k].mean(), m[k:] - m[k:].mean()
            d = sqrt((a @ a) * (b @ b))
            out.append((a @ b) / d if d > 1e-9 else 0.0)
        return out

    for _, row in got.iterrows():
        r = acf(series(toy, row, int(row["w"]))[0])
        assert row["acf_max"] == pytest.approx(max(r), abs=1e-7)
        assert r[int(row["acf_argmax"]) - 1] == pytest.approx(max(r), abs=1e-7)


def test_complexity(spark, toy):
    got = SH.tsfresh_table(toy["panel"], ANCHORS, complexity=True).toPandas()

    def words(m, _):
        seq = np.searchsorted(np.linspace(m.min(), m.max(), 11)[1:], m, side="left").tolist()
        seen, word = set(), ()
        for s in seq:
            word += (s,)
            if word not in seen:
                seen.add(word)
                word = ()
        return len(seen) / len(m)

    check(toy, got, "lempelziv", words)


def test_weekly_decomposition(spark, toy):
    got = SH.fcast_table(toy["panel"], ANCHORS, SH.FCAST_FAMILIES["fcstl"]).toPandas()

    def rest(m, start):
        trend = np.convolve(m, np.ones(7) / 7, mode="same")
        d, season = m - trend, np.zeros_like(m)
        for k in range(7):
            on = (np.arange(start, start + len(m)) % 7) == k
            season[on] = d[on].mean()
        return ((d - season).var()) / max(m.var(), 1e-9)

    check(toy, got, "residshare", rest)


def test_block_sizes(toy):
    sizes = {"sbc": 624, "sbcnomoment": 480, "tsfeat": 50, "tsfresh": 60, "fcast": 48}
    for name, want in sizes.items():
        assert len(B.build(toy["panel"], [410], toy["n_days"], [name]).columns) - 2 == want


def test_wide_columns_hold_the_long_values(spark, toy):
    """Columns are read by position, so every value is compared with its row."""
    wide = B.build(toy["panel"], ANCHORS, toy["n_days"], ["sbcorder"]).toPandas().set_index(["anchor", "user_id"])
    tall = SH.sbc_table(toy["panel"], ANCHORS, SH.SBC_FAMILIES["sbcorder"], SH.SBC_WINDOWS[1:]).toPandas()
    for _, row in tall.iterrows():
        for stat in ("q90", "max", "gini", "trimmedstd"):
            assert wide.loc[(row["anchor"], row["user_id"]), f"sbc_{stat}_{row['metric']}_{row['w']}"] == row[stat]
