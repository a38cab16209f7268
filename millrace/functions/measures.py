"""Cube measures as three column expressions (build from rows, merge partial values, read), and computed measures.

``build`` and ``merge`` are Spark aggregates, so both phases combine before they shuffle. A partial value is what an
aggregation stores: a number, a sketch, a set, or a value with its time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Measure:
    name: str
    build: Callable[[], Column]  # over input rows
    merge: Callable[[Column], Column]  # over stored values
    read: Callable[[Column], Column] = lambda c: c


def sum_(name: str, source: str | None = None) -> Measure:
    return Measure(name, lambda: F.sum(F.col(source or name)), lambda c: F.sum(c), lambda c: F.coalesce(c, F.lit(0)))


def count_(name: str) -> Measure:
    return Measure(name, lambda: F.count(F.lit(1)), lambda c: F.sum(c), lambda c: F.coalesce(c, F.lit(0)))


def min_(name: str, source: str | None = None) -> Measure:
    return Measure(name, lambda: F.min(source or name), lambda c: F.min(c))


def max_(name: str, source: str | None = None) -> Measure:
    return Measure(name, lambda: F.max(source or name), lambda c: F.max(c))


def distinct_count(name: str, source: str, log_registers: int = 10) -> Measure:
    """An approximate count of distinct values by a mergeable sketch."""
    return Measure(
        name, lambda: F.hll_sketch_agg(F.col(source), F.lit(log_registers)), lambda c: F.hll_union_agg(c, F.lit(True)), lambda c: F.coalesce(F.hll_sketch_estimate(c), F.lit(0))
    )


def union_(name: str, source: str) -> Measure:
    """The set of values, sorted when read."""
    return Measure(name, lambda: F.collect_set(source), lambda c: F.array_distinct(F.flatten(F.collect_list(c))), lambda c: F.array_sort(c))


def last(name: str, source: str, time: str, not_null: bool = False) -> Measure:
    """The value with the largest time; with ``not_null`` the last one that is not null."""
    value = F.struct(F.col(time).alias("ts"), F.col(source).alias("value"))

    def build() -> Column:
        return F.max(F.when(F.col(source).isNotNull(), value) if not_null else value)

    return Measure(name, build, lambda c: F.max(c), lambda c: c["value"])


@dataclass(frozen=True)
class Computed:
    """A formula over stored measures, evaluated per group after aggregation."""

    needs: frozenset
    of: Callable[[Callable[[str], Column]], Column]
    label: str = field(default="", compare=False)

    def __add__(self, o): return _op(self, o, lambda a, b: a + b)  # noqa: E704
    def __sub__(self, o): return _op(self, o, lambda a, b: a - b)  # noqa: E704
    def __mul__(self, o): return _op(self, o, lambda a, b: a * b)  # noqa: E704
    def __truediv__(self, o): return div(self, o)  # noqa: E704


def _lift(x) -> Computed:
    return x if isinstance(x, Computed) else measure(x) if isinstance(x, str) else value(x)


def _op(a, b, f) -> Computed:
    a, b = _lift(a), _lift(b)
    return Computed(a.needs | b.needs, lambda get: f(a.of(get), b.of(get)))


def value(v) -> Computed:
    return Computed(frozenset(), lambda get: F.lit(v))


def measure(name: str) -> Computed:
    return Computed(frozenset([name]), lambda get: get(name))


def add(a, b) -> Computed: return _op(a, b, lambda x, y: x + y)  # noqa: E704
def sub(a, b) -> Computed: return _op(a, b, lambda x, y: x - y)  # noqa: E704
def mul(a, b) -> Computed: return _op(a, b, lambda x, y: x * y)  # noqa: E704


def div(a, b) -> Computed:
    """As double; 0.0 where the divisor is 0."""
    return _op(a, b, lambda x, y: F.when(y != 0, x.cast("double") / y).otherwise(F.lit(0.0)))


def sqrt(a) -> Computed:
    """0.0 where the argument is not positive."""
    a = _lift(a)
    return Computed(a.needs, lambda get: F.when(a.of(get) > 0, F.sqrt(a.of(get))).otherwise(F.lit(0.0)))


def sqr(a) -> Computed:
    a = _lift(a)
    return Computed(a.needs, lambda get: a.of(get).cast("double") * a.of(get))


def variance(total, squares, n) -> Computed:
    return sub(div(squares, n), sqr(div(total, n)))


def stddev(total, squares, n) -> Computed:
    return sqrt(variance(total, squares, n))


def percent(a, of=None) -> Computed:
    return mul(a if of is None else div(a, of), value(100))
