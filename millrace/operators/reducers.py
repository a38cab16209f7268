"""Reducers: a fold per key with partial and final phases, as expressions or as Python."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Reducer:
    """Column expressions: ``accumulate`` over rows, ``combine`` over accumulators, ``produce`` from an accumulator."""

    accumulate: Callable[[], Column]
    combine: Callable[[Column], Column]
    produce: Callable[[Column], Column] = lambda c: c


def input_to_accumulator(df: DataFrame, keys: list[str], reducers: dict[str, Reducer]) -> DataFrame:
    return df.groupBy(*keys).agg(*[r.accumulate().alias(n) for n, r in reducers.items()])


def accumulator_to_accumulator(df: DataFrame, keys: list[str], reducers: dict[str, Reducer]) -> DataFrame:
    return df.groupBy(*keys).agg(*[r.combine(F.col(n)).alias(n) for n, r in reducers.items()])


def accumulator_to_output(df: DataFrame, keys: list[str], reducers: dict[str, Reducer]) -> DataFrame:
    return accumulator_to_accumulator(df, keys, reducers).select(*keys, *[r.produce(F.col(n)).alias(n) for n, r in reducers.items()])


def input_to_output(df: DataFrame, keys: list[str], reducers: dict[str, Reducer]) -> DataFrame:
    return input_to_accumulator(df, keys, reducers).select(*keys, *[r.produce(F.col(n)).alias(n) for n, r in reducers.items()])


def split_reduce(df: DataFrame, keys: list[str], reducers: dict[str, Reducer], partitions: int | None = None) -> DataFrame:
    """Deal rows out by key first, then reduce each part: one shuffle of rows, for groups that do not combine well."""
    dealt = df.repartition(partitions, *keys) if partitions else df.repartition(*keys)
    return input_to_output(dealt, keys, reducers)


SUM = lambda c: Reducer(lambda: F.sum(c), F.sum)
COUNT = Reducer(lambda: F.count(F.lit(1)), F.sum)
MEAN = lambda c: Reducer(
    lambda: F.struct(F.sum(c).alias("s"), F.count(c).alias("n")), lambda a: F.struct(F.sum(a["s"]).alias("s"), F.sum(a["n"]).alias("n")), lambda a: F.when(a["n"] > 0, a["s"] / a["n"]).otherwise(F.lit(0.0))
)
MAX_BY = lambda c, by: Reducer(lambda: F.max(F.struct(F.col(by).alias("k"), F.col(c).alias("v"))), F.max, lambda a: a["v"])


def deduplicate(df: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    from .joins import first_per_key

    return first_per_key(df, keys, by or [c for c in df.columns if c not in keys])


def merge(*frames: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of all inputs in order of the keys."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.orderBy(*keys)


def reduce_inputs(inputs: list[tuple[DataFrame, dict[str, Reducer]]], keys: list[str]) -> DataFrame:
    """Inputs of different kinds, each with reducers of its own, merged by key; an accumulator no input has is null."""
    every: dict[str, Reducer] = {}
    out = None
    for df, reducers in inputs:
        part = input_to_accumulator(df, keys, reducers)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        every |= reducers
    return accumulator_to_output(out, keys, every)


def python_reduce(df: DataFrame, keys: list[str], create: Callable[[], Any], accumulate: Callable[[Any, Any], Any], combine: Callable[[Any, Any], Any], produce: Callable[[Any], Any], out: str) -> DataFrame:
    """A reducer in Python. Rows fold in their partition first, so what moves is one accumulator per key and partition."""
    import pickle

    names, types = keys, ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def partial(batches):
        accs: dict[tuple, Any] = {}
        for b in batches:
            for row in b.itertuples(index=False):
                k = tuple(getattr(row, n) for n in names)
                accs[k] = accumulate(accs[k] if k in accs else create(), row)
        yield pd.DataFrame([(*k, pickle.dumps(a)) for k, a in accs.items()], columns=[*names, "acc"])

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        acc = None
        for raw in pdf["acc"]:
            x = pickle.loads(raw)
            acc = x if acc is None else combine(acc, x)
        return pd.DataFrame([(*(pdf[n].iloc[0] for n in names), produce(acc))], columns=[*names, "result"])

    return df.mapInPandas(partial, f"{types}, acc binary").groupBy(*keys).applyInPandas(final, f"{types}, result {out}")


def fold(column: str, merge: Callable[[Column], Column]) -> Reducer:
    """A fold of values of one type, where accumulators are values too."""
    return Reducer(lambda: merge(F.col(column)), merge)


def stream_reduce(df: DataFrame, keys: list[str], by: list[str], first: Callable[[Any], tuple[Any, list]], following: Callable[[Any, Any], tuple[Any, list]], complete: Callable[[Any], list], schema: str) -> DataFrame:
    """A reducer over each group's rows in order of ``by`` that emits 0 to n rows at any time.

    ``first(row)`` and ``following(accumulator, row)`` return the accumulator and rows to emit, ``complete(accumulator)`` the last rows.
    Groups pass by in sorted partitions, so a worker holds an accumulator and a batch, whatever a group's size."""
    columns = df.sparkSession.createDataFrame([], schema).columns

    def run(batches):
        at, acc, any_ = None, None, False
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                k = tuple(None if pd.isna(v := getattr(row, n)) else v for n in keys)
                if any_ and k == at:
                    acc, more = following(acc, row)
                else:
                    out += complete(acc) if any_ else []
                    at, any_ = k, True
                    acc, more = first(row)
                out += more
            if out:
                yield pd.DataFrame(out, columns=columns)
        if any_ and (out := complete(acc)):
            yield pd.DataFrame(out, columns=columns)

    return df.repartition(*keys).sortWithinPartitions(*keys, *by).mapInPandas(run, schema)
