"""Hand cases and small references of the scores."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from daypanel.operators import blending as BL
from daypanel.operators import metrics as M


def scored(spark, y, p):
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y double, p double")
    return rows.agg(M.rmsle("y", "p").alias("s")).first()["s"]


@pytest.mark.parametrize(
    "y, p, want",
    [((0, 1, 3), (0, 1, 3), 0.0), ((0, 0), (math.e - 1, math.e - 1), 1.0), ((0,), (-5,), 0.0), ((0,), (9,), math.log(10))],
)
def test_rmsle_by_hand(spark, y, p, want):
    assert scored(spark, y, p) == pytest.approx(want, abs=1e-12)


def test_rmsle_explicit_sum(spark):
    rng = np.random.default_rng(0)
    y = rng.gamma(0.5, 200.0, 2000) * (rng.random(2000) > 0.45)
    p = rng.gamma(0.5, 200.0, 2000) - 20.0
    want = np.sqrt(np.mean((np.log(1 + y) - np.log(1 + np.maximum(p, 0))) ** 2))
    assert scored(spark, y, p) == pytest.approx(want, abs=1e-12)
    assert scored(spark, y, 0 * y) == pytest.approx(np.sqrt(np.mean(np.log1p(y) ** 2)), abs=1e-12)


def test_gini_bounds(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 0, 1.0).otherwise(1.0).alias("same"), (F.col("id") == 7).cast("double").alias("one"))
    g = lambda c: M.gini(rows, [], c).first()["gini"]
    assert abs(g("same")) < 1e-9
    assert g("one") > 0.99
    assert M.gini(rows.select(F.lit(0.0).alias("x")), [], "x").first()["gini"] == 0.0


def test_total_error_undefined(spark):
    rows = spark.createDataFrame([(0.0, 1.0)], "y double, p double")
    assert math.isnan(rows.agg(M.total_rel_err("y", "p").alias("e")).first()["e"])


def test_auc_with_ties(spark):
    rng = np.random.default_rng(3)
    score, label = rng.integers(0, 6, 500), rng.random(500) < 0.3
    rows = spark.createDataFrame([(int(a), int(b)) for a, b in zip(score, label)], "s int, z int")
    pos, neg = score[label][:, None], score[~label][None, :]
    want = ((pos > neg) + 0.5 * (pos == neg)).mean()
    assert M.auc(rows, [], "s", F.col("z") == 1).first()["auc"] == pytest.approx(want, abs=1e-12)
    assert math.isnan(M.auc(rows.filter("z = 0"), [], "s", F.col("z") == 1).first()["auc"])


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([np.zeros(400), rng.gamma(1, 30, 601)])  # two fifths of the rows share a value
    probs = [0.0, 0.1, 0.39, 0.4, 0.5, 0.9, 0.999, 1.0]
    got = {r["q"]: r["quantile"] for r in M.quantiles(spark.createDataFrame([(float(v),) for v in x], "x double"), [], "x", probs).collect()}
    assert got == pytest.approx(dict(zip(probs, np.quantile(x, probs))), abs=1e-9)


def test_covariance_split_adds_up(spark):
    rng = np.random.default_rng(1)
    z = rng.random(800) < 0.4
    l = np.where(z, rng.normal(4, 1, 800), 0.0)
    m = 0.5 * l + rng.normal(0, 1, 800)
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(l, m)], "l double, m double")
    r = M.covariance_split(rows, [], F.col("l"), F.col("m")).first()
    assert r["within"] + r["between"] == pytest.approx(r["total"], rel=0.01)


def test_fitted_weights_beat_random_ones(spark):
    rng = np.random.default_rng(2)
    y = rng.gamma(2, 1, 3000)
    members = np.column_stack([y * a + rng.normal(0, s, 3000) for a, s in ((1, 1.0), (0.9, 0.5), (0.2, 0.3), (-0.5, 0.2))])
    rows = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(members, y)], "a double, b double, c double, d double, y double")
    w = BL.fit_weights(rows, ["a", "b", "c", "d"], "y")
    w = np.array(list(w.values()))
    assert w.min() >= 0 and w.sum() == pytest.approx(1)
    err = lambda v: ((members @ v - y) ** 2).mean()
    tries = rng.dirichlet(np.full(4, 0.4), 20000)
    assert err(w) <= min(err(v) for v in tries) + 1e-9


def test_probe_calibration_recovers_the_affine_map(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(2.3, 1.5, 4000)
    l = 0.8 * m + 0.3 + rng.normal(0, 1.0, 4000)
    c = math.log(10)
    rho = np.corrcoef(l, m)[0, 1]
    row = (c, np.sqrt((l**2).mean()), np.sqrt(((l - c) ** 2).mean()), l.std() * np.sqrt(1 - rho**2), m.mean(), m.std())
    names = "c double, rmsle_zero double, rmsle_const double, rmsle_model double, mean_m double, sd_m double"
    r = BL.probe_calibration(spark.createDataFrame([tuple(map(float, row))], names)).first()
    slope, shift = np.polyfit(m, l, 1)
    assert (r["a"], r["b"]) == pytest.approx((slope, shift), abs=1e-9)


def test_target_bins_merge(spark):
    rng = np.random.default_rng(6)
    y = np.concatenate([np.zeros(900), rng.normal(4.2, 0.8, 1100).clip(0.01)])
    rows = spark.createDataFrame([(float(v),) for v in y], "y double")
    edges = BL.target_bins(rows, "y", 16)
    # Brute force: numpy's histogram, dropping one edge at a time.
    top = np.quantile(y[y > 0], 0.999)
    want = list(np.linspace(0, top, 17))
    while True:
        n = np.histogram(y.clip(0, top), bins=want)[0]
        if len(n) <= 2 or n.min() >= max(20, int(0.002 * len(y))):
            break
        j = int(n.argmin())
        del want[1 if j == 0 else j]
    assert edges == pytest.approx(want, abs=1e-9)
    assert len(edges) < 17


def test_soft_targets(spark):
    edges, sigma = [0.0, 1.0, 2.5, 3.0, 6.0], 0.7
    y = [0.0, 0.4, 2.5, 5.9, 9.0]
    rows = spark.createDataFrame([(v,) for v in y], "y double")
    got = [r["q"] for r in BL.soft_targets(rows, "y", edges, sigma).collect()]
    for v, q in zip(y, got):
        cdf = [0.5 * (1 + math.erf((e - min(v, 6.0)) / sigma / math.sqrt(2))) for e in edges]
        part = np.diff(cdf)
        assert q == pytest.approx(part / part.sum(), abs=1e-12)
    hard = [r["q"] for r in BL.soft_targets(rows, "y", edges, 0.0).collect()]
    assert [q.index(1.0) for q in hard] == [0, 0, 2, 3, 3]
