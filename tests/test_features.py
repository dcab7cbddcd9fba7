"""Feature sizes, floors, channels with the default windows, folds and plans."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from daypanel.operators import audit as A
from daypanel.operators import blocks as B
from daypanel.operators import channels as C
from daypanel.operators import folds as P
from daypanel.operators.windows import Plan, features, last
from daypanel.sources import panel as S
from daypanel.sources import tables

# Columns per block.
SIZES = {"base": 62, "counts": 47, "trend": 20, "funnel": 154, "visit": 14, "channel": 14, "diff": 51, "cumshare": 17,
         "ewm": 8, "com": 6, "dispersion": 40, "agebucket": 1, "cartbacklog": 1, "noisectl": 1}


@pytest.mark.parametrize("name", SIZES)
def test_block_size(name):
    assert len(B.block_columns([name], 400)[1]) == SIZES[name]


def test_reach_of_columns():
    cases = {"gmv_total": float("inf"), "tenure_days": float("inf"), "gmv_blk3": 120.0, "d1_gmv_4": 180.0, "ewm_gmv_hl30": 90.0,
             "geo3": 90.0, "recency_days": 30.0, "gmv_sum_45": 45.0, "d1_gmv_w60": 120.0, "cart_backlog_7": 7.0,
             "recency_order_days": float("inf"), "d2_gmv_0": 90.0, "gmv_logratio_30_prev30": 60.0}
    reach = B.reaches(list(B.PROJECTED), 400)
    assert {n: reach[n] for n in cases} == cases


def small_panel(spark, rows):
    """Rows of (user, day, gmv) with the other columns empty."""
    import pandas as pd

    frame = pd.DataFrame(rows, columns=["user_id", "day", "gmv"])
    for name in S.SHORT:
        if name not in frame:
            frame[name] = 1.0 if name == "srch" else 0.0
    return S.marked(spark.createDataFrame(frame.astype({"gmv": float}))).repartition("user_id")


def test_floor_reaches_blocks_across_users(spark, toy):
    wide, floored = (B.build(toy["panel"], [300], toy["n_days"], ["rank", "cohortrel"], floor_days=f).toPandas().set_index("user_id") for f in (None, 60))
    short = B.rank(toy["panel"], [300], toy["n_days"]).toPandas().set_index("user_id")
    assert (floored.pct_gmv_30 == short.pct_gmv_30.reindex(floored.index)).all()
    assert (wide.pct_gmv_365 != floored.pct_gmv_365.reindex(wide.index)).any()
    assert (wide.cohort_rel_buy_rate90 != floored.cohort_rel_buy_rate90.reindex(wide.index)).any()


def test_decay_on_a_very_long_panel(spark):
    days = [0, 3000, 4190, 4210, 7300, 9000]
    panel = small_panel(spark, [(1, d, 10.0) for d in days])
    plan = Plan(9001)
    got = features(panel, [4210, 7300, 9000], plan, {"e": plan.decay("gmv", 7)}).toPandas().set_index("anchor").e
    for a in got.index:
        assert got[a] == pytest.approx(sum(10 * 0.5 ** ((a - d) / 7) for d in days if d <= a), rel=1e-12)


def test_lifetime_totals_follow_returns(spark):
    panel = small_panel(spark, [(1, 5, 50.0), (1, 9, -30.0), (2, 9, 4.0)])
    got = B.build(panel, [10], 40, ["base"]).toPandas().set_index("user_id")
    assert got.gmv_total.to_dict() == {1: 20.0, 2: 4.0}


def test_dense_from_a_later_day(spark):
    panel = small_panel(spark, [(1, 2, 1.0), (1, 4, 2.0), (1, 7, 3.0), (1, 12, 4.0), (2, 1, 9.0), (3, 5, 8.0)])
    got = S.dense(panel, 10, first_day=5).toPandas().sort_values(["user_id", "day"])
    assert got.groupby("user_id").day.apply(list).to_dict() == {u: [5, 6, 7, 8, 9] for u in (1, 2, 3)}
    assert got[got.user_id == 1].gmv.tolist() == [0, 0, 3, 0, 0] and got[got.user_id == 3].gmv.tolist() == [8, 0, 0, 0, 0]


def test_a_block_stored_twice_is_stored_once(spark, tmp_path):
    block = spark.createDataFrame([(1, 7, 0.5), (2, 7, 0.25)], "anchor int, user_id long, x double")
    tables.store_block(block, str(tmp_path), "b")
    tables.store_block(block.filter("anchor = 2").selectExpr("anchor", "user_id", "x * 2 AS x"), str(tmp_path), "b")
    tables.store_block(block, str(tmp_path), "b", floor_days=60)
    got = tables.read_blocks(spark, str(tmp_path), ["b"], [1, 2], ["x"])
    assert sorted((r.anchor, r.x) for r in got.collect()) == [(1, 0.5), (2, 0.5)]


def test_nulls_do_not_collide_in_the_content_hash(spark):
    rows = lambda *r: spark.createDataFrame([r], "a int, b int, c int")
    kinds = [rows(1, None, 2), rows(1, 2, None), rows(None, 1, 2)]
    assert len({tables.content_hash(k, "a", "b", "c").first()["content"] for k in kinds}) == 3


def test_training_table_takes_every_block(spark, toy):
    from daypanel.operators import folds as P

    rows = P.stacked(toy["panel"], [200, 300], toy["n_days"], ["base", "rank", "cohortrel", "sbcent", "cumshare"], floor_days=180,
                     keep=lambda names: [n for n in names if "gmv" in n or "hist" in n])
    plain = P.stacked(toy["panel"], [200, 300], toy["n_days"], ["base"], floor_days=180)
    assert rows.count() == plain.count() and {"pct_gmv_30", "y", "y_log"} <= set(rows.columns)
    both = rows.join(plain.select("anchor", "user_id", "y", "gmv_sum_365"), ["anchor", "user_id", "y", "gmv_sum_365"])
    assert both.count() == rows.count()
    tall = P.stacked(toy["panel"], [200], toy["n_days"], ["rank"], horizons=(7, 30))
    assert tall.count() == 2 * tall.select("user_id").distinct().count()


def test_windows_against_loops(spark, toy):
    plan = Plan(toy["n_days"])
    cols = {"g": plan.total("gmv", last(90)), "d": plan.days(last(30)), "life": plan.life_total("gmv"), "e": plan.decay("gmv", 30),
            "rec": plan.recency(), "reco": plan.recency_order(), "ten": plan.tenure()}
    got = features(toy["panel"], [60, 300], plan, cols).toPandas()
    assert len(got)
    for r in got.itertuples():
        i, a = int(r.user_id) - 100, int(r.anchor)
        g, here, o = toy["gmv"][i], toy["here"][i], toy["ord"][i]
        lo = max(a - 89, 0)
        days = np.arange(a + 1)
        assert r.g == pytest.approx(g[lo : a + 1].sum(), abs=1e-6)
        assert r.d == here[max(a - 29, 0) : a + 1].sum()
        assert r.life == pytest.approx(g[: a + 1].sum(), abs=1e-6)
        assert r.e == pytest.approx((g[: a + 1] * 0.5 ** ((a - days) / 30)).sum(), abs=1e-6)
        assert r.rec == a - np.flatnonzero(here[: a + 1]).max()
        assert r.ten == a - np.flatnonzero(here).min()
        buys = np.flatnonzero(o[: a + 1] > 0)
        assert r.reco == (a - buys.max() if len(buys) else toy["n_days"])


def test_default_channel_windows(spark, toy):
    grid = S.dense(S.binary_flags(toy["panel"]), toy["n_days"])
    from datetime import date

    got = C.channels(grid, "behav", toy["n_days"], date(2025, 1, 1)).toPandas().sort_values(["user_id", "day"])
    users = got["user_id"].nunique()
    cube = lambda c: got[c].to_numpy().reshape(users, toy["n_days"])
    seen = np.flatnonzero(toy["here"].any(1))

    def mean(x, w):
        run = np.concatenate([np.zeros((len(x), 1)), np.cumsum(x, 1)], 1)
        t = np.arange(x.shape[1])
        lo = np.maximum(0, t + 1 - w)
        return (run[:, t + 1] - run[:, lo]) / (t + 1 - lo)

    cart, orders, gmv = (toy[c][seen].astype(float) for c in ("cart", "ord", "gmv"))
    for w in C.WINDOWS:
        assert np.abs(cube(f"gmv_rm{w}") - np.log1p(mean(gmv, w))).max() < 1e-9
        assert np.abs(cube(f"conv_{w}") - np.clip(mean(orders, w) / (mean(cart, w) + 1e-6), 0, 1.5)).max() < 1e-7
    run_c, run_o = np.cumsum(cart, 1), np.cumsum(orders, 1)
    age = np.array([np.arange(toy["n_days"]) - np.searchsorted(c, o) for c, o in zip(run_c, run_o)]).clip(0)
    assert np.abs(cube("queue_age") - np.log1p(age)).max() < 1e-12


def test_derived_channels_year_window(spark, toy):
    grid = S.dense(toy["panel"], toy["n_days"])
    got = C.derived_channels(grid, toy["n_days"]).filter("day = 419").toPandas().sort_values("user_id")
    want = toy["gmv"][got["user_id"].to_numpy() - 100][:, 420 - 365 :].sum(1)
    assert np.abs(np.expm1(got["gmv_365"]) - want).max() < 1e-6
    assert len(got.columns) == 29


def test_user_fold_is_md5(spark):
    got = spark.range(300).select(F.col("id").alias("user_id")).withColumn("f", P.user_fold()).toPandas()
    for u, f in got.itertuples(index=False):
        share = int(hashlib.md5(f"gmv-v1:{u}".encode()).hexdigest()[:8], 16) / 0xFFFFFFFF
        assert f == min(int(share * 5), 4)


def test_exact_sample(spark):
    df = spark.range(5000).select(F.col("id").alias("user_id"))
    a = {r[0] for r in P.exact_sample(df, 700, ["user_id"]).collect()}
    b = {r[0] for r in P.exact_sample(df.repartition(13), 700, ["user_id"]).collect()}
    assert len(a) == 700 and a == b
    assert P.exact_sample(df, 9000, ["user_id"]).count() == 5000


def test_noise_is_normal(spark, toy):
    big = spark.range(20000).select(F.col("id").alias("user_id"), F.lit(5).alias("day"), *[F.lit(0.0).alias(c) for c in S.SHORT])
    x = B.build(S.marked(big), [5], 10, ["noisectl"]).toPandas()["noise_ctl"]
    assert abs(x.mean()) < 0.03 and abs(x.std() - 1) < 0.03


def test_shape_blocks_do_not_look_ahead(spark, toy):
    make = lambda p, a: B.build(p, a, toy["n_days"], ["tsfeat", "fcast", "sbcshape", "cumshare", "cohortrel"])
    assert A.look_ahead(toy["panel"], 300, make).agg(F.sum("differing"), F.sum("lone_keys")).first()[:] == (0, 0)


def test_merge_records(spark):
    cols = "exp_id string, cv string, lb string, verdict string"
    old = spark.createDataFrame([("e1", "1", "0.5", "keep"), ("e2", "2", "", "kill")], cols)
    new = spark.createDataFrame([("e1", "9", "", ""), ("e3", "3", "0.7", "")], cols)
    got = {r["exp_id"]: (r["cv"], r["lb"], r["verdict"]) for r in tables.merge_records(old, new).collect()}
    assert got == {"e1": ("9", "0.5", "keep"), "e2": ("2", "", "kill"), "e3": ("3", "0.7", "")}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_do_not_shuffle_a_bucketed_panel(spark, toy):
    tables.save_panel(toy["panel"], "toy_panel", 4)
    panel = spark.table("toy_panel")
    for blocks in (["base", "counts", "dispersion"], ["trend", "diff"]):
        text = plan_of(B.build(panel, [200, 300], toy["n_days"], blocks))
        assert "Exchange" not in text and "Join" not in text
    text = plan_of(C.channels(S.dense(panel, toy["n_days"]), "full", toy["n_days"], pd.Timestamp("2025-01-01").date()))
    assert "Exchange" not in text and "Join" not in text


def test_scan_reads_only_needed_columns(spark, toy, tmp_path):
    path = str(tmp_path / "panel")
    toy["panel"].write.parquet(path)
    plan = Plan(toy["n_days"])
    text = plan_of(features(spark.read.parquet(path).filter("day >= 100"), [200], plan, {"g": plan.total("gmv", last(30))}))
    read = text[text.index("ReadSchema") :].split("\n")[0]
    assert "gmv:double" in read and "cart" not in read
    assert "GreaterThanOrEqual(day,100)" in text


def test_store_computes_only_missing_anchors(spark, toy):
    asked = []

    def maker(block):
        def make(anchors):
            asked.append((block, anchors))
            return B.build(toy["panel"], anchors, toy["n_days"], [block])

        return make

    names = {b: f"store_{b}" for b in ("base", "visit")}
    for wanted in ([200], [200, 300, 300], [300, 200]):
        for block, name in names.items():
            tables.store_missing(spark, name, wanted, maker(block), 4)
    assert asked == [("base", [200]), ("visit", [200]), ("base", [300]), ("visit", [300])]
    assert tables.stored_anchors(spark, "store_base") == {200, 300}
    assert tables.stored_anchors(spark, "no_such_store") == set()

    whole = B.build(toy["panel"], [200, 300], toy["n_days"], ["base", "visit"])
    columns = [c for c in whole.columns if c not in ("anchor", "user_id")]
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    old = {k: spark.conf.get(k) for k in (key, "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set(key, "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = tables.read_stored(spark, list(names.values()), [200, 300], columns)
        assert "Exchange" not in plan_of(got)
        got = got.select(whole.columns).toPandas()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    order = ["anchor", "user_id"]
    want = whole.toPandas()
    got["anchor"] = got["anchor"].astype(want["anchor"].dtype)
    pd.testing.assert_frame_equal(got.sort_values(order).reset_index(drop=True), want.sort_values(order).reset_index(drop=True))


def test_exact_sample_ranks_few_rows(spark):
    """The same rows as a ranking of all, also where one hash holds a third of the rows."""
    df = spark.range(30000).select((F.col("id") % 10 == 0).cast("int").alias("hot"), F.col("id").alias("user_id"))
    df = df.withColumn("user_id", F.when(F.col("user_id") % 3 == 0, F.lit(7)).otherwise(F.col("user_id")))
    hashed = df.select(P.key_hash("0", "user_id").alias("h"), "user_id")
    for n in (0, 1, 500, 29999, 30000, 40000):
        got = sorted(r.user_id for r in P.exact_sample(df.select("user_id"), n, ["user_id"]).collect())
        want = sorted(r.user_id for r in hashed.orderBy("h", "user_id").limit(n).collect())
        assert got == want
    assert P.exact_sample(df.limit(0), 5, ["user_id"]).count() == 0
