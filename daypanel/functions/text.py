"""Expressions as SQL text, for tables of hundreds of columns.

Every call on a Column object crosses to the JVM and back; a text expression crosses once, when the
finished column is selected. Doubles carry the suffix D, because a bare 0.5 is a decimal in SQL.
"""

from __future__ import annotations


def num(value: float) -> str:
    return f"{float(value)!r}D"


def ratio(a: str, b: str, eps: float = 1.0) -> str:
    """Quotient whose denominator never falls below ``eps``."""
    return f"(({a}) / greatest(cast({b} as double), {num(eps)}))"


def positive(x: str) -> str:
    return f"greatest(cast({x} as double), 0D)"


def log_pos(x: str) -> str:
    """log1p of the value, negatives taken as 0."""
    return f"log1p({positive(x)})"


def log_change(now: str, then: str) -> str:
    return f"(log1p({now}) - log1p({then}))"


def clip(x: str, lo: float, hi: float) -> str:
    return f"least(greatest({x}, {num(lo)}), {num(hi)})"


def mean(parts: list[str]) -> str:
    return f"(({' + '.join(parts)}) / {num(len(parts))})"


def named(columns: dict[str, str], cast: str | None = "double") -> list[str]:
    """Select list from names to expressions."""
    return [f"cast({e} as {cast}) AS `{n}`" if cast else f"{e} AS `{n}`" for n, e in columns.items()]
