"""Joins: null-safe keys, lookups of the first match, broadcast dimensions of a checked size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

#: A side is broadcast only below this many rows, counted first.
BROADCAST_ROWS = 100_000


def _on(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], null_safe: bool) -> Column:
    out = None
    for a, b in keys:
        c = left[a].eqNullSafe(right[b]) if null_safe else left[a] == right[b]
        out = c if out is None else out & c
    return out


def _pairs(keys) -> list[tuple[str, str]]:
    return [(k, k) if isinstance(k, str) else tuple(k) for k in keys]


def equi_join(left: DataFrame, right: DataFrame, keys: list, how: str = "inner", null_safe: bool = False, strategy: str | None = None) -> DataFrame:
    """Join on keys (names, or pairs of names); ``null_safe`` lets null match null. Key columns of the right side go if
    they have the left's names, other columns that both have get the suffix 0 or 1."""
    keys = _pairs(keys)
    same = [a for a, b in keys if a == b]
    clash = [c for c in right.columns if c in left.columns and c not in same]
    left = left.select(*[F.col(f"`{c}`").alias(f"{c}0" if c in clash else c) for c in left.columns])
    right = right.select(*[F.col(f"`{c}`").alias(f"__{c}" if c in same else f"{c}1" if c in clash else c) for c in right.columns])
    keys = [(f"{a}0" if a in clash else a, f"__{b}" if b in same else f"{b}1" if b in clash else b) for a, b in keys]
    if strategy:
        right = right.hint(strategy)
    out = left.join(right, _on(left, right, keys, null_safe), how)
    return out.drop(*[f"__{c}" for c in same])


def first_per_key(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """One row per key: the least by ``by``; a partial aggregate, not a sort."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*rest)
    least = F.min_by(row, F.struct(*by, *[c for c in rest if c not in by])).alias("__r")
    return df.groupBy(*keys).agg(least).select(*keys, *[F.col("__r")[c].alias(c) for c in rest])


def lookup_join(left: DataFrame, right: DataFrame, keys: list, by: list[str], how: str = "left", null_safe: bool = True) -> DataFrame:
    """N:1: each left row meets at most one right row, the first of its key by ``by``."""
    return equi_join(left, first_per_key(right, [b for _, b in _pairs(keys)], by), keys, how, null_safe)


def merge_join(left: DataFrame, right: DataFrame, keys: list, combine: Callable[[DataFrame], DataFrame] | None = None, how: str = "left") -> DataFrame:
    """Sort-merge join of two sides dealt out by the same keys, then ``combine`` on the joined rows."""
    out = equi_join(left, right, keys, how, True, "merge")
    return combine(out) if combine else out


def left_join(left: DataFrame, right: DataFrame, keys: list, matched: Callable[[str], Column], alone: Callable[[str], Column] | None = None) -> DataFrame:
    """Per joined pair what ``matched`` makes of it, per left row without a partner what ``alone`` does; a null result is no row.

    Both get the name of the joined struct's column, whose fields are the columns of :func:`equi_join`; without ``alone`` only
    pairs give rows. The result is the column ``value``."""
    mark = right.withColumn("__there", F.lit(True))
    out = equi_join(left, mark, keys, "left" if alone else "inner", True)
    row = out.select(F.struct(*[F.col(f"`{c}`") for c in out.columns if c != "__there"]).alias("row"), "__there")
    value = F.when(F.col("__there"), matched("row")) if alone is None else F.when(F.col("__there"), matched("row")).otherwise(alone("row"))
    return row.select(value.alias("value")).where("value is not null")


def attribute_join(facts: DataFrame, dimension: DataFrame, keys: list, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Look attributes up; a miss leaves null. The dimension is broadcast if a count shows that it is small."""
    few = dimension.limit(rows + 1).count() <= rows
    return equi_join(facts, dimension, keys, "left", True, "broadcast" if few else None)


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: int) -> DataFrame:
    """Rows of ``left`` whose ``point`` lies in [low, high] of a right row.

    Buckets come in levels, each twice as wide as the one below, from ``width`` on. An interval goes to the level where it is no wider
    than a bucket, so it touches two at most however wide it is; a point looks once in each level that is in use, at most 64."""
    span = F.greatest((F.col(high) - F.col(low)).cast("double"), F.lit(0.0))
    level = F.greatest(F.ceil(F.log2((span + 1) / width)), F.lit(0)).cast("int")
    size = lambda lv: F.lit(float(width)) * F.pow(F.lit(2.0), lv)
    at = lambda c, lv: F.floor(F.col(c).cast("double") / size(lv)).cast("long")
    b = right.where(F.col(low) <= F.col(high)).withColumn("__l", level)
    b = b.withColumn("__b", F.explode(F.sequence(at(low, F.col("__l")), at(high, F.col("__l")))))
    levels = [r["__l"] for r in b.select("__l").distinct().collect()]  # at most 64
    a = left.withColumn("__l", F.explode(F.array(*[F.lit(x) for x in levels]) if levels else F.array().cast("array<int>")))
    a = a.withColumn("__b", at(point, F.col("__l")))
    return a.join(b, ["__l", "__b"]).where(F.col(point).between(F.col(low), F.col(high))).drop("__l", "__b")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """Each left row with the last right ``value`` of its key at or before its time; one shuffle, no pairs."""
    from pyspark.sql import Window

    l = left.withColumn("__v", F.lit(None).cast(right.schema[value].dataType)).withColumn("__side", F.lit(1))  # noqa: E741
    r = right.select(*keys, time, F.col(value).alias("__v")).withColumn("__side", F.lit(0))
    w = Window.partitionBy(*keys).orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r, allowMissingColumns=True).withColumn(value, F.last("__v", ignorenulls=True).over(w))
    return both.where("__side = 1").drop("__v", "__side")
