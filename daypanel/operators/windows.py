"""Window aggregates of a sparse panel at many anchor days, in one pass.

A block of features is a projection. While it is written it asks a ``Plan`` for the aggregates it
reads; the plan names each one once, however many blocks share it, and ``aggregate`` computes those
that are read together. The panel is clustered by user, so a user's rows are gathered without a
shuffle, as one array by day with running sums. Every window of every anchor is a difference of two of
them, found by day: work grows with rows plus anchors times windows, and no row is copied to an anchor.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from math import inf

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import mean, named

HALF_LIVES = (7, 30, 90)
ERA = 600  # half-lives that powers of two are taken over
SUPPORT = 3  # half-lives after which a decayed sum counts as blind
POPULATION_DAYS = 30
# Columns that are no counts. Their running sums are kept in two parts, multiples of ``GRAIN`` and the rest:
# the first are exact, the second small, so that a difference of two large sums has the digits of the window's
# own sum. Counts are exact as they are.
AMOUNTS = ("gmv", "gmvs", "gmvc")
GRAIN = 2.0**-6


@dataclass(frozen=True)
class Span:
    """Ages in days before the anchor, both ends included; negative ages lie after it."""

    young: int
    old: int


def last(days: int) -> Span:
    return Span(0, days - 1)


def before(days: int) -> Span:
    """The window of the same length that ends where ``last(days)`` starts."""
    return Span(days, 2 * days - 1)


def block(k: int) -> Span:
    return Span(30 * k, 30 * k + 29)


def ahead(days: int) -> Span:
    return Span(-days, -1)


HISTORY = "(PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


class Plan:
    """Names and collects the aggregates that a set of feature expressions reads.

    Each method returns SQL text that stands for the finished aggregate.
    """

    def __init__(self, n_days: int, floor_days: int | None = None):
        self.n_days = n_days
        self.floor_days = floor_days
        self.sums: dict[str, tuple[str, Span]] = {}
        self.life: dict[str, tuple[str, int]] = {}

    # -- windows -------------------------------------------------------------------------------
    def _cut(self, span: Span) -> Span:
        if self.floor_days is None:
            return span
        return Span(span.young, min(span.old, self.floor_days - 1))

    def _sum(self, name: str, value: str, span: Span) -> str:
        span = self._cut(span)
        if span.old < span.young:
            return "0D"
        key = f"{name}|{span.young}|{span.old}"
        self.sums[key] = (value, span)
        return f"`{key}`"

    def total(self, col: str, span: Span) -> str:
        return self._sum(col, col, span)

    def squares(self, col: str, span: Span) -> str:
        return self._sum(f"{col}^2", f"{col} * {col}", span)

    def days(self, span: Span) -> str:
        return self._sum("days", "1D", span)

    def buys(self, span: Span) -> str:
        return self._sum("buy", "buy", span)

    def empties(self, span: Span) -> str:
        return self._sum("empty", "empty", span)

    def mass_age(self, which: str, span: Span) -> str:
        """Mean age of activity or value inside the window, -1 where there is none."""
        mass = self._sum(which, "1D" if which == "days" else which, span)
        return f"CASE WHEN {mass} > 0 THEN {self._aged(which, span)} / greatest({mass}, 1e-9) - {span.young} ELSE -1D END"

    def _aged(self, which: str, span: Span) -> str:
        """Sum of mass times age in the window."""
        v = "1D" if which == "days" else which
        return f"(anchor * {self._sum(which, v, span)} - {self._sum(f'{which}*day', f'{v} * day', span)})"

    def date_sd(self, which: str, span: Span) -> str:
        """Spread of the active or buying dates; -1 with fewer than two of them."""
        v = "1D" if which == "days" else which
        n, s1, s2 = (self._sum(which + tag, v + times, span) for tag, times in (("", ""), ("*day", " * day"), ("*day2", " * day * day")))
        m1 = f"({self._aged(which, span)} / greatest({n}, 1D))"
        m2 = f"((anchor * (anchor * {n} - 2 * {s1}) + {s2}) / greatest({n}, 1D))"
        return f"CASE WHEN {n} >= 2 THEN sqrt(greatest({m2} - {m1} * {m1}, 0D)) ELSE -1D END"

    # -- whole history -------------------------------------------------------------------------
    def _latest(self, name: str, value: str, back: int = 0) -> str:
        """A running quantity read at the user's latest row up to ``back`` days before the anchor, null without one."""
        key = f"{name}~{back}" if back else name
        self.life[key] = (value, back)
        return f"`{key}`"

    def life_total(self, col: str) -> str:
        if self.floor_days is not None:
            return self.total(col, last(self.floor_days))
        return self._latest(f"life_{col}", f"sum({col}) OVER {HISTORY}")

    def life_days(self) -> str:
        if self.floor_days is not None:
            return self.days(last(self.floor_days))
        return self._latest("life_days", f"cast(count(1) OVER {HISTORY} as double)")

    def _span_cap(self, value: str) -> str:
        """With a floor after the panel start, day counts stop at the visible span."""
        if self.floor_days is None:
            return value
        n = self.floor_days
        return f"CASE WHEN anchor >= {n} THEN least({value}, {n}D) ELSE {value} END"

    def _last_active(self) -> str:
        return self._latest("last_active", "cast(day as double)")

    def recency(self) -> str:
        return self._span_cap(f"(anchor - {self._last_active()})")

    def recency_order(self) -> str:
        seen = f"max(CASE WHEN ord > 0 THEN day END) OVER {HISTORY}"
        at = self._latest("last_order", f"cast(coalesce({seen}, -1) as double)")
        return self._span_cap(f"(CASE WHEN {at} < 0 THEN {self.n_days}D ELSE anchor - {at} END)")

    def first_day(self) -> str:
        return self._latest("first_active", f"cast(min(day) OVER {HISTORY} as double)")

    def tenure(self) -> str:
        return self._span_cap(f"(anchor - {self.first_day()})")

    def decay(self, col: str, half_life: int) -> str:
        """Exponentially weighted sum over all days up to the anchor."""
        name, value = f"decay_{col}_{half_life}", self._decayed(col, half_life)

        def faded(back: int) -> str:
            at = self._latest("last_active", "cast(day as double)", back)
            return f"{self._latest(name, value, back)} * pow(0.5D, (anchor - {at}) / {half_life}D)"

        return f"({faded(0)})" if self.floor_days is None else f"({faded(0)} - coalesce({faded(self.floor_days)}, 0D))"

    def _decayed(self, col: str, half_life: int) -> str:
        """The weighted sum as of each row.

        Days are weighted from an origin, and powers of two stay in range for ``ERA`` half-lives from
        it. A longer panel has two series of eras, half an era apart; each row reads the one in which
        it lies in the second half, so at least ``ERA / 2`` half-lives of history count.
        """
        era = ERA * half_life
        if self.n_days <= era:
            return f"sum({col} * pow(2D, day / {half_life}D)) OVER {HISTORY} * pow(0.5D, day / {half_life}D)"

        def within(shift: int) -> str:
            place = f"pmod(day + {shift}, {era})"
            frame = f"(PARTITION BY user_id, floor((day + {shift}) / {era}) ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
            return f"sum({col} * pow(2D, {place} / {half_life}D)) OVER {frame} * pow(0.5D, {place} / {half_life}D)"

        return f"CASE WHEN pmod(day, {era}) >= {era // 2} THEN {within(0)} ELSE {within(era // 2)} END"

    def own_age_total(self, col: str, lo: int, hi: int) -> str:
        """Lifetime total over the user's own days ``lo <= day - first day < hi``."""
        inside = f"CASE WHEN own_age BETWEEN {lo} AND {hi - 1} THEN {col} ELSE 0D END"
        name = f"own_{col}_{lo}_{hi}"
        if self.floor_days is not None:
            return self._sum(name, inside, last(self.floor_days))
        return self._latest(name, f"sum({inside}) OVER {HISTORY}")

    def reach(self, text: str) -> float:
        """Days before the anchor that an expression over this plan's aggregates can see."""
        days = 0.0
        for name in re.findall("`([^`]+)`", text):
            if name in self.sums:
                days = max(days, self.sums[name][1].old + 1)
            elif self.life.get(name, ("", 0))[1]:
                days = max(days, self.life[name][1])
            elif name.startswith("decay_"):
                days = max(days, SUPPORT * int(name.rsplit("_", 1)[1]))
            else:
                days = max(days, POPULATION_DAYS if name == "last_active" else inf)
        return days

    # -- common compounds ----------------------------------------------------------------------
    def geo3(self) -> str:
        """The naive level: three 30-day blocks averaged as logs."""
        return f"expm1({mean([f'log1p({self.total("gmv", block(k))})' for k in range(3)])})"


def place_of_days(until: int, day: str = "day") -> str:
    """Per calendar day from that of the first element of ``e`` on, the position of its latest element by then."""
    days = f"greatest(coalesce(get(e, i + 1).{day}, {until + 1}) - x.{day}, 0)"
    return f"flatten(transform(e, (x, i) -> array_repeat(i, {days})))"


def latest(field: str, at: str, day: str = "day") -> str:
    """A field of the latest element of ``e`` by a day, null before the first."""
    return f"get(e, get(place, {at} - e[0].{day})).{field}"


def calendar(anchors: Iterable[int]) -> str:
    return f"cast(array({', '.join(str(a) for a in sorted({int(a) for a in anchors}))}) as array<int>)"


def aggregate(panel: DataFrame, anchors: list[int], plan: Plan, read: Iterable[str]) -> DataFrame:
    """One row per (anchor, user) of the population, holding the plan's aggregates that the expressions ``read`` use.

    The population rule, an active day in the 30 days up to the anchor, is part of the same pass.
    """
    used = {n for text in read for n in re.findall("`([^`]+)`", text)}
    sums = {n: x for n, x in plan.sums.items() if n in used}
    life = {n: x for n, x in plan.life.items() if n in used}
    running = {v: f"r{i}" for i, v in enumerate(dict.fromkeys(v for v, _ in sums.values()))}
    levels = {v: f"l{i}" for i, v in enumerate(dict.fromkeys(v for v, _ in life.values()))}
    if any("own_age" in v for v in (*running, *levels)):
        panel = panel.selectExpr("*", f"day - min(day) OVER {HISTORY} AS own_age")
    kept = {}
    for v, r in running.items():
        if any(re.search(rf"\b{c}\b", v) for c in AMOUNTS):
            kept[v] = {r: f"{v} - pmod({v}, {GRAIN!r}D)", f"{r}s": f"pmod({v}, {GRAIN!r}D)"}
        else:
            kept[v] = {r: v}
    totals = {name: f"sum({x}) OVER {HISTORY}" for part in kept.values() for name, x in part.items()}
    rows = panel.selectExpr("user_id", "cast(day as int) AS day", *named(totals, cast=None), *[f"{v} AS {name}" for v, name in levels.items()])
    fields = ", ".join(["day", *totals, *levels.values()])
    users = rows.groupBy("user_id").agg(F.expr(f"array_sort(collect_list(struct({fields}))) AS e"))

    # A window needs the rows at both of its ends, which many windows share: each is looked up once.
    backs = sorted({x for _, s in sums.values() for x in (s.young, s.old + 1)} | {back for _, back in life.values()} | {0})
    end = {back: f"at{i}" for i, back in enumerate(backs)}
    users = users.selectExpr("*", f"{place_of_days(max(anchors, default=0) - backs[0])} AS place", "e[0].day AS first")
    here = f"filter({calendar(anchors)}, a -> coalesce(get(e, get(place, a - first)).day, -{POPULATION_DAYS}) > a - {POPULATION_DAYS})"
    looks = ", ".join(["'anchor', a", *[f"'{n}', get(e, get(place, a - {back} - first))" for back, n in end.items()]])
    looked = users.selectExpr("user_id", f"inline(transform({here}, a -> named_struct({looks})))")

    def between(value: str, s: Span) -> str:
        upto = lambda back, r: f"coalesce({end[back]}.{r}, 0D)"
        return " + ".join(f"({upto(s.young, r)} - {upto(s.old + 1, r)})" for r in kept[value])

    cells = {n: between(v, s) for n, (v, s) in sums.items()} | {n: f"{end[back]}.{levels[v]}" for n, (v, back) in life.items()}
    return looked.selectExpr("user_id", "anchor", *named(cells, cast=None))


def features(panel: DataFrame, anchors: list[int], plan: Plan, columns: dict[str, str]) -> DataFrame:
    """Project named expressions, written against ``plan``, for the population of each anchor."""
    return aggregate(panel, anchors, plan, columns.values()).selectExpr("anchor", "user_id", *named(columns))


def target(panel: DataFrame, anchors: list[int], n_days: int, horizon: int = 30) -> DataFrame:
    """Value over the days A+1 .. A+horizon for the population at A, 0 where nothing was bought."""
    plan = Plan(n_days)
    return features(panel, anchors, plan, {"target": plan.total("gmv", ahead(horizon))})
