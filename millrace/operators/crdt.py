"""Replicated state: tables of (key, ts, tombstone, state) from several replicas, merged when read.

Every merge is an aggregate with partial sums, so replicas combine before the shuffle. A tombstone removes all
data of its key up to its time, and equal times go to the tombstone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def g_counter(df: DataFrame, keys: list[str], replica: str, value: str) -> DataFrame:
    """Largest value per replica, summed."""
    return df.groupBy(*keys, replica).agg(F.max(value).alias("__v")).groupBy(*keys).agg(F.sum("__v").alias("value"))


def pn_counter(df: DataFrame, keys: list[str], replica: str, plus: str, minus: str) -> DataFrame:
    each = df.groupBy(*keys, replica).agg(F.max(plus).alias("__p"), F.max(minus).alias("__n"))
    return each.groupBy(*keys).agg((F.sum("__p") - F.sum("__n")).alias("value"))


def g_set(df: DataFrame, keys: list[str], element: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.array_sort(F.collect_set(element)).alias("elements"))


def tp_set(df: DataFrame, keys: list[str], element: str, removed: str) -> DataFrame:
    """Two-phase set: what was removed once stays out."""
    each = df.groupBy(*keys, element).agg(F.max(F.col(removed).cast("int")).alias("__out"))
    return each.groupBy(*keys).agg(F.array_sort(F.collect_set(F.when(F.col("__out") == 0, F.col(element)))).alias("elements"))


def lww_set(df: DataFrame, keys: list[str], element: str, time: str, removed: str) -> DataFrame:
    """Last writer wins per element; an addition and a removal at the same time leave it in."""
    each = df.groupBy(*keys, element).agg(F.max(F.when(~F.col(removed), F.col(time))).alias("__a"), F.max(F.when(F.col(removed), F.col(time))).alias("__r"))
    there = F.col("__a").isNotNull() & (F.col("__r").isNull() | (F.col("__a") >= F.col("__r")))
    return each.groupBy(*keys).agg(F.array_sort(F.collect_set(F.when(there, F.col(element)))).alias("elements"))


def g_map(df: DataFrame, keys: list[str], entry: str, merge: Column) -> DataFrame:
    """Per entry the merged value (an aggregate), as a map."""
    each = df.groupBy(*keys, entry).agg(merge.alias("__v"))
    return each.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(entry).alias("key"), F.col("__v").alias("value"))))).alias("entries"))


def merge_state(df: DataFrame, keys: list[str], merges: dict[str, Column], time: str = "ts", tombstone: str = "tombstone", live: Column | None = None) -> DataFrame:
    """The state of each key: rows after its last tombstone merged by the given aggregates, with the largest time."""
    gone = df.where(F.col(tombstone)).groupBy(*keys).agg(F.max(time).alias("__gone"))
    cond = None
    g = gone.select(*[F.col(k).alias(f"__{k}") for k in keys], "__gone")
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"__{k}"))
        cond = c if cond is None else cond & c
    left = df.where(~F.col(tombstone)).join(g, cond, "left").where(F.col("__gone").isNull() | (F.col(time) > F.col("__gone")))
    out = left.groupBy(*keys).agg(F.max(time).alias(time), *[c.alias(n) for n, c in merges.items()])
    return out if live is None else out.where(live)


def owners(df: DataFrame, keys: list[str], nodes: list[str], replicas: int = 1) -> DataFrame:
    """Rendezvous hashing: the ``replicas`` nodes with the largest hash of key and node."""
    ranked = F.array_sort(F.array(*[F.struct((-F.xxhash64(*keys, F.lit(n)).cast("decimal(20,0)")).alias("h"), F.lit(n).alias("n")) for n in nodes]))
    return df.withColumn("owners", F.transform(F.slice(ranked, 1, replicas), lambda x: x["n"]))
