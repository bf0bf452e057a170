"""Arithmetic over arrays of doubles, as higher-order functions; null arrays give null, empty ones null where a mean is needed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What keeps divisions by a deviation finite; a fixed value of the results.
EPS = 1e-8


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body over a value that is computed once for each row.

    A column that a lambda mentions is otherwise computed again for each element, and the optimizer puts a value from
    an earlier projection back into the lambda; a lambda's own variable stays one.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return total(a) / F.nullif(F.size(a), F.lit(0))


def deviation(a: Column, ddof: int = 0) -> Column:
    squares = bound(mean(a), lambda m: F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)))
    return F.sqrt(squares / F.nullif(F.size(a) - ddof, F.lit(0)))


def centred(a: Column) -> Column:
    return bound(mean(a), lambda m: F.transform(a, lambda x: x - m))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def scaled(a: Column, ddof: int = 0, eps: float = EPS) -> Column:
    """The centred values over their own deviation."""

    def over(c: Column) -> Column:
        spread = F.sqrt(dot(c, c) / F.nullif(F.size(c) - ddof, F.lit(0))) + eps
        return bound(spread, lambda s: F.transform(c, lambda x: x / s))

    return bound(centred(a), over)


def z_score(a: Column) -> Column:
    return scaled(a)


def rsi(a: Column, period: int) -> Column:
    """Relative strength, 0 to 100, from plain means of the last `period` gains and losses (all, if fewer)."""
    last = F.slice(a, -F.least(F.lit(period), F.size(a)), F.least(F.lit(period), F.size(a)))
    # One pass: the sums of gains and losses; their common count is divided away but for the guard.
    start = F.struct(F.lit(0.0).alias("up"), F.lit(0.0).alias("down"))

    def step(s: Column, x: Column) -> Column:
        return F.struct((s["up"] + F.greatest(x, F.lit(0.0))).alias("up"), (s["down"] + F.greatest(-x, F.lit(0.0))).alias("down"))

    n = F.nullif(F.least(F.lit(period), F.size(a)), F.lit(0))
    return F.aggregate(last, start, step, lambda s: 100.0 - 100.0 / (1.0 + (s["up"] / n) / (s["down"] / n + EPS)))


def time_flip(a: Column, window: int) -> Column:
    """The first `window` values reversed, the rest as they are."""
    return F.concat(F.reverse(F.slice(a, 1, window)), F.slice(a, window + 1, F.greatest(F.size(a) - window, F.lit(0))))


def softplus(z: Column) -> Column:
    """ln(1 + e^z) without overflow."""
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t
