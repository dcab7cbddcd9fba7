"""Sources, sinks and panel checks as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import folds as P_
from ..sources import panel as P
from ..sources import standins, tables
from .common import (ANCHORS, EVENT_P, EVENT_RAW, ORDER_P, ORDER_RAW, VALID_ANCHORS, event_days, features_sql, order_days,
                     out, query, sql_result)
from .features import base_sql, visit_sql

DAY = ["user_id", "day"]
ROW = ["user_id", "event_date"]
SRC = ", ".join(P.COLUMNS)
SHORT = ", ".join(P.SHORT)


@query("d1_scan", sql_result(f"SELECT user_id, event_date, {SRC} FROM raw", ROW, ctes=ORDER_RAW))
def d1_scan(spark, folder):
    path = tables.scratch(spark, "panel")
    standins.order_panel(spark, folder).write.parquet(path)
    return out(P.read_panel(spark, path), ROW)


@query("d1_scan_events", sql_result(f"SELECT user_id, event_date, {SRC} FROM raw", ROW, ctes=EVENT_RAW))
def d1_scan_events(spark, folder):
    return out(standins.event_panel(spark, folder), ROW)


@query("d2_day_index", sql_result(
    "SELECT user_id, CAST(event_date - dmin AS BIGINT) AS day, event_date AS event_date, n_days FROM raw, cal",
    ["user_id", "day", "event_date"], ctes=ORDER_RAW))
def d2_day_index(spark, folder):
    d = order_days(spark, folder)
    rows = d.raw.select("user_id", P.day_of(F.col("event_date"), d.first).alias("day"))
    rows = rows.withColumns({"event_date": P.date_of(F.col("day"), d.first), "n_days": F.lit(d.n_days)})
    return out(rows, ["user_id", "day", "event_date"])


_TWICE = f"""{ORDER_P}, twice AS (SELECT * FROM p UNION ALL SELECT * FROM p WHERE gmv > 0)"""


@query("d3_sum_duplicates", sql_result(
    f"SELECT user_id, day, {', '.join(f'sum({c}) AS {c}' for c in P.SHORT)} FROM twice GROUP BY user_id, day", DAY, ctes=_TWICE))
def d3_sum_duplicates(spark, folder):
    d = order_days(spark, folder)
    twice = d.raw.unionByName(d.raw.filter(F.col("gmv") > 0))
    return out(P.daily(twice, d.first, 2 * d.rows).select(*DAY, *P.SHORT), DAY)


@query("d4_day_flags", sql_result(
    "SELECT user_id, day, buy, empty, sev, cev, hs2c, hs2o, hc2c, hc2o FROM p", DAY, ctes=ORDER_P))
def d4_day_flags(spark, folder):
    d = order_days(spark, folder)
    rows = P.binary_flags(d.panel)
    return out(rows.select(*DAY, "buy", "empty", "sev", "cev", "hs2c", "hs2o", "hc2c", "hc2o"), DAY)


_RULES = {
    "unique_user_day": "n - 1",
    "order_needs_cart": "CASE WHEN to_ord > to_cart THEN 1 ELSE 0 END",
    "gmv_iff_order": "CASE WHEN (gmv > 0) <> (to_ord > 0) THEN 1 ELSE 0 END",
    "cart_is_channel_sum": "CASE WHEN to_cart <> search_to_cart + cat_to_cart THEN 1 ELSE 0 END",
    "order_is_channel_sum": "CASE WHEN to_ord <> search_to_ord + cat_to_ord THEN 1 ELSE 0 END",
    "gmv_is_channel_sum": "CASE WHEN abs(gmv - gmv_search - gmv_cat) > 1e-6 * greatest(1, abs(gmv_search + gmv_cat)) THEN 1 ELSE 0 END",
    "gmv_not_negative": "CASE WHEN gmv < 0 THEN 1 ELSE 0 END",
} | {f"flag_matches_{n}": f"CASE WHEN (has_{n} > 0) <> ({n} > 0) THEN 1 ELSE 0 END"
     for n in ("search_to_cart", "search_to_ord", "cat_to_cart", "cat_to_ord")}


def _checks_sql(ctes: str) -> str:
    rules = "\nUNION ALL ".join(
        f"SELECT '{k}' AS rule, " + (
            "(SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM checked GROUP BY user_id, event_date)) AS violations"
            if k == "unique_user_day" else f"sum({e}) AS violations FROM checked") for k, e in _RULES.items())
    return sql_result(rules, ["rule"], ctes=ctes)


@query("d5_panel_checks", _checks_sql(f"{ORDER_RAW}, checked AS (SELECT * FROM raw)"))
def d5_panel_checks(spark, folder):
    return out(P.check_panel(standins.order_panel(spark, folder)), ["rule"])


# A broken copy, so that every rule is seen to fire: repeated rows, and orders and values moved off.
@query("d5_panel_checks_broken", _checks_sql(f"""{EVENT_RAW}, checked AS (
  SELECT * FROM raw UNION ALL
  SELECT * REPLACE (to_ord + 1 AS to_ord, gmv - 5 AS gmv, cat_to_cart + 1 AS cat_to_cart, 1 - has_cat_to_ord AS has_cat_to_ord)
  FROM raw WHERE to_ord > 0)"""))
def d5_panel_checks_broken(spark, folder):
    raw = standins.event_panel(spark, folder)
    broken = raw.filter(F.col("to_ord") > 0).withColumns(
        {"to_ord": F.col("to_ord") + 1, "gmv": F.col("gmv") - 5, "cat_to_cart": F.col("cat_to_cart") + 1,
         "has_cat_to_ord": 1 - F.col("has_cat_to_ord")})
    return out(P.check_panel(raw.unionByName(broken)), ["rule"])


GRID = f"""{EVENT_P}, g AS (
  SELECT u.user_id, d.day, CASE WHEN p.day IS NULL THEN 0 ELSE 1 END AS active,
    {', '.join(f'CAST(coalesce(p.{c}, 0) AS DOUBLE) AS {c}' for c in [*P.SHORT, 'buy', 'empty'])}
  FROM (SELECT DISTINCT user_id FROM p) u CROSS JOIN (SELECT unnest(range(n_days)) AS day FROM cal) d
  LEFT JOIN p ON p.user_id = u.user_id AND p.day = d.day)"""


@query("d6_dense", sql_result(f"SELECT user_id, day, active, {SHORT}, buy, empty FROM g", DAY, ctes=GRID))
def d6_dense(spark, folder):
    d = event_days(spark, folder)
    return out(P.dense(d.panel, d.n_days), DAY)


_ORDER_GRID = f"""{ORDER_P}, g AS (
  SELECT u.user_id, d.day, p.day IS NOT NULL AS active, coalesce(p.gmv, 0) AS gmv, coalesce(p.ord, 0) AS ord
  FROM (SELECT DISTINCT user_id FROM p) u CROSS JOIN (SELECT unnest(range(n_days)) AS day FROM cal) d
  LEFT JOIN p ON p.user_id = u.user_id AND p.day = d.day)"""


@query("d6_dense_orders", sql_result(
    """SELECT user_id, count(*) AS n_days, sum(CASE WHEN active THEN 1 ELSE 0 END) AS active_days, sum(gmv) AS gmv,
  sum(ord) AS ord, min(day) AS first_day, max(day) AS last_day FROM g GROUP BY user_id""", ["user_id"], ctes=_ORDER_GRID))
def d6_dense_orders(spark, folder):
    d = order_days(spark, folder)
    grid = P.dense(d.panel.select(*DAY, "gmv", "ord"), d.n_days)
    rows = grid.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_days"), F.sum("active").alias("active_days"), F.sum("gmv").alias("gmv"),
        F.sum("ord").alias("ord"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    return out(rows, ["user_id"])


_PRED = "SELECT user_id, sum(gmv) / count(*) AS predict FROM p GROUP BY user_id"


@query("d7_csv_predictions", sql_result(_PRED, ["user_id"], ctes=ORDER_P))
def d7_csv_predictions(spark, folder):
    d = order_days(spark, folder)
    pred = d.panel.groupBy("user_id").agg((F.sum("gmv") / F.count(F.lit(1))).alias("predict"))
    path = tables.scratch(spark, "predictions")
    tables.write_predictions(pred, path)
    return out(tables.read_predictions(spark, path), ["user_id"])


def fold_rows(spark, folder):
    d = order_days(spark, folder)
    return P_.folds(d.panel, VALID_ANCHORS, d.first, d.n_days)


_V = ", ".join(f"({k}, DATE '{a}')" for k, a in enumerate(VALID_ANCHORS))
FOLDS = f"""{ORDER_P},
va AS (SELECT CAST(fold_id AS BIGINT) AS fold_id, anchor_date, CAST(anchor_date - dmin AS BIGINT) AS anchor FROM (VALUES {_V}) v(fold_id, anchor_date), cal),
folds AS (SELECT fold_id, anchor_date, anchor, user_id,
    sum(CASE WHEN day > anchor THEN gmv ELSE 0 END) AS target
  FROM va JOIN p ON day BETWEEN anchor - 29 AND anchor + 30
  GROUP BY fold_id, anchor_date, anchor, user_id HAVING min(day) <= anchor)"""

_GRID_SQL = """tg AS (SELECT fold_id, anchor_date AS valid_anchor, CAST(unnest(range(anchor_date - INTERVAL 30 DAY,
    dmin + INTERVAL 88 DAY, INTERVAL (-7) DAY)) AS DATE) AS train_anchor FROM va, cal)"""
TRAIN_GRID = f"{FOLDS}, {_GRID_SQL}"


def train_grid(spark, folder):
    d = order_days(spark, folder)
    return P_.training_anchors(P_.fold_calendar(spark, VALID_ANCHORS), d.first)


@query("d8_partitioned_folds", sql_result("SELECT fold_id, anchor_date, user_id, target FROM folds WHERE fold_id >= 3",
                                          ["fold_id", "anchor_date", "user_id"], ctes=FOLDS))
def d8_partitioned_folds(spark, folder):
    path = tables.scratch(spark, "folds")
    tables.write_by(fold_rows(spark, folder), path, "fold_id")
    back = spark.read.parquet(path).filter(F.col("fold_id") >= 3)
    return out(back.select(F.col("fold_id").cast("int"), "anchor_date", "user_id", "target"), ["fold_id", "anchor_date", "user_id"])


@query("d9_fold_spec_json", sql_result(
    f"""SELECT s.fold_id, valid_anchor, train_anchor, n_users, zero_share,
  CAST(valid_anchor + INTERVAL 1 DAY AS DATE) AS window_start, CAST(valid_anchor + INTERVAL 30 DAY AS DATE) AS window_end
FROM tg JOIN (SELECT fold_id, count(*) AS n_users, avg(CASE WHEN target <= 0 THEN 1.0 ELSE 0 END) AS zero_share
  FROM folds GROUP BY fold_id) s ON s.fold_id = tg.fold_id""",
    ["fold_id", "valid_anchor", "train_anchor", "window_start", "window_end"], ctes=TRAIN_GRID))
def d9_fold_spec_json(spark, folder):
    path = tables.scratch(spark, "fold-spec")
    spec = P_.fold_spec(fold_rows(spark, folder), train_grid(spark, folder))
    P_.spec_to_json(spec).write.text(path)
    back = P_.spec_from_json(spark.read.text(path))
    rows = back.select("fold_id", "valid_anchor", F.explode("train_anchors").alias("train_anchor"), "n_users", "zero_share",
                       F.col("target_window")[0].alias("window_start"), F.col("target_window")[1].alias("window_end"))
    return out(rows, ["fold_id", "valid_anchor", "train_anchor", "window_start", "window_end"])


_STORED = ["gmv_sum_90", "geo3", "recency_days", "empty_days_90", "real_days_365"]


@query("d10_feature_store", features_sql(
    {n: e for n, e in (base_sql() | visit_sql()).items() if n in _STORED}, ANCHORS[1:]))
def d10_feature_store(spark, folder):
    d = order_days(spark, folder)
    path = tables.scratch(spark, "features")
    anchors = d.index(ANCHORS)
    for block in ("base", "visit"):
        tables.store_block(B.build(d.panel, anchors, d.n_days, [block]), path, block)
    return out(tables.read_blocks(spark, path, ["base", "visit"], anchors[1:], _STORED))


@query("d10_feature_store_resumed", features_sql(
    {n: e for n, e in (base_sql() | visit_sql()).items() if n in _STORED}, ANCHORS))
def d10_feature_store_resumed(spark, folder):
    d = order_days(spark, folder)
    anchors = d.index(ANCHORS)
    path = tables.scratch(spark, "features")
    name = "features_" + path[-12:]
    for block in ("base", "visit"):
        make = lambda missing, b=block: B.build(d.panel, missing, d.n_days, [b])
        for wanted in (anchors[:1], anchors):  # the second call computes what the first did not
            tables.store_missing(spark, f"{name}_{block}", wanted, make, 8, f"{path}/{block}")
    return out(tables.read_stored(spark, [f"{name}_base", f"{name}_visit"], anchors, _STORED))


@query("d12_content_hash", f"""WITH {ORDER_P} SELECT round(CAST(count(*) AS DOUBLE) + 3.7e-08, 6) AS n_rows,
  CAST(CAST(sum(CAST('0x' || substr(md5(concat_ws(',', '=' || user_id, '=' || day, '=' || CAST(ord AS BIGINT), '=' || CAST(cart AS BIGINT))), 1, 12) AS BIGINT)) AS DECIMAL(30,0)) AS VARCHAR) AS content
  FROM p""")
def d12_content_hash(spark, folder):
    d = order_days(spark, folder)
    whole = d.panel.select("user_id", "day", F.col("ord").cast("bigint").alias("ord"), F.col("cart").cast("bigint").alias("cart"))
    return out(tables.content_hash(whole, "user_id", "day", "ord", "cart"), ["content"])
