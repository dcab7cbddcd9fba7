"""Sums worked out on the days on which they change, against those of the dense grid."""

import math
import random
from datetime import date

import pytest

from daypanel.operators import channels as C
from daypanel.sources import panel as P

DAYS, WINDOWS = 60, (3, 7, 14, 30)


@pytest.fixture(scope="module")
def panel(spark):
    draw = random.Random(3)
    rows = []

    def row(user, day):
        cart = float(draw.choice([0, 0, 1, 3]))
        amount = round(draw.random() * 100, 2) if draw.random() < 0.5 else 0.0
        values = {n: float(draw.randint(0, 4)) for n in P.SHORT} | {"cart": cart, "ord": float(draw.choice([0, 0, 1, 2])), "gmv": amount, "gmvs": amount}
        values = {n: None if user % 3 == 0 and draw.random() < 0.3 else v for n, v in values.items()}
        rows.append((user, day, *values.values()))

    for user in range(24):
        first = [0, 1, 5, 59][user % 4]
        for day in sorted({first} | {d for d in range(first, DAYS) if draw.random() < [0.05, 0.3, 0.9][user % 3]}):
            row(user, day)
    for user, days in ((30, [None]), (31, [None, 0, 4]), (32, [None, 7, 8]), (None, [2, 30])):
        for day in days:
            row(user if user is not None else 0, day)
            if user is None:
                rows[-1] = (None, *rows[-1][1:])
    made = spark.createDataFrame(rows, "user_id long, day int, " + ", ".join(f"{n} double" for n in P.SHORT))
    return P.binary_flags(P.marked(made)).repartition(4, "user_id").cache()


def cells(df):
    return {(r["user_id"], r["day"]): r.asDict() for r in df.collect()}


def alike(a, b):
    return a == b or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-6))


def assert_same(got, want):
    assert got.columns == want.columns
    got, want = cells(got), cells(want)
    assert got.keys() == want.keys() and len(got) == 28 * DAYS
    wrong = [(k, n, got[k][n], want[k][n]) for k in want for n in want[k] if not alike(got[k][n], want[k][n])]
    assert not wrong, wrong[:5]


@pytest.mark.parametrize("variant", C.VARIANTS)
def test_channels_of_the_panel_are_those_of_the_grid(panel, variant):
    first = date(2020, 1, 1)
    assert_same(C.panel_channels(panel, variant, DAYS, first, WINDOWS), C.channels(P.dense(panel, DAYS), variant, DAYS, first, WINDOWS))


def test_derived_channels_of_the_panel_are_those_of_the_grid(panel):
    assert_same(C.panel_derived_channels(panel, DAYS, WINDOWS), C.derived_channels(P.dense(panel, DAYS), DAYS, WINDOWS))


@pytest.mark.parametrize("variant", ["full", "behav", "extra"])
def test_the_grid_is_neither_sorted_nor_windowed(panel, capsys, variant):
    capsys.readouterr()
    C.panel_channels(panel, variant, DAYS, date(2020, 1, 1), WINDOWS).explain()
    plan = capsys.readouterr().out.splitlines()
    spread = next(i for i, line in enumerate(plan) if "Generate inline(_days" in line)
    assert not any("Window" in line or "Sort" in line for line in plan[:spread])
    assert any("Window" in line for line in plan[spread:])


@pytest.mark.parametrize("variant", ["behav", "extra", "full_popidx"])
def test_means_by_user_are_those_of_all_days(panel, variant):
    given = variant, DAYS, date(2020, 1, 1), WINDOWS
    grid = C.channels(P.dense(panel, DAYS), *given)
    assert_same_means(C.panel_channels(panel, *given, means=[c for c in grid.columns if c not in ("user_id", "day")]), grid)


def test_means_of_derived_channels_are_those_of_all_days(panel):
    grid = C.derived_channels(P.dense(panel, DAYS), DAYS, WINDOWS)
    assert_same_means(C.panel_derived_channels(panel, DAYS, WINDOWS, means=[c for c in grid.columns if c not in ("user_id", "day")]), grid)


def assert_same_means(got, grid):
    names = [c for c in grid.columns if c not in ("user_id", "day")]
    want = {r["user_id"]: r.asDict() for r in grid.groupBy("user_id").avg(*names).collect()}
    got = {r["user_id"]: r.asDict() for r in got.select("user_id", *names).collect()}
    assert got.keys() == want.keys() and len(got) == 28
    wrong = [(u, n, got[u][n], want[u][f"avg({n})"]) for u in want for n in names if not alike(got[u][n], want[u][f"avg({n})"])]
    assert not wrong, wrong[:5]


@pytest.mark.parametrize("name, spread", [("c8_full_orders", 0), ("c6_rolling_orders", 0), ("c2_derived_orders", 1), ("c10_behav_orders", 1), ("c11_extra_orders", 1)])
def test_only_what_changes_by_the_day_is_spread(spark, capsys, name, spread):
    """Means of the order grid: columns that hold through a span are not written for every day."""
    from daypanel.catalog import load

    df = load()[0][name](spark, "/root/testdata/sf0.001")
    capsys.readouterr()
    df.explain()
    plan = capsys.readouterr().out
    assert ("Generate explode(sequence(" in plan) == bool(spread) and "inline(_days" not in plan
