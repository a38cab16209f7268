"""Sharding by a two-pass external shuffle, with DataFrame functions only.

Pass 1 scatters records uniformly by seeded hashes into buckets that fit in memory and writes them to
the shared folder. Pass 2 brings every bucket into a Fisher-Yates permutation and numbers its records
within their shard. Which shard a record belongs to depends on its key and the number of shards alone
(rendezvous hashing: the shard with the largest hash of key and shard number wins), so one more shard
takes records only into itself. Buckets split a shard by a hash of the whole record and its place in
the input, so neither a frequent key's shard nor a group of equal records exceeds a bucket's size by
more than chance.

Defined cases: a null text has no bytes; records without a key are dealt out by a hash of the whole
record; equal records get slots of their own; a very long text fills a bucket alone; an empty table gives an
empty result; all columns of the input travel with their record, one named ``shard`` or ``slot`` as ``shard_`` or ``slot_``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import Scratch, apart


def rendezvous(key: Column, shards: int, seed: int) -> Column:
    """The shard of ``key``: argmax over shard numbers of a seeded hash."""
    each = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.xxhash64(F.lit(seed), key, s).alias("h"), s.alias("s")))
    return F.array_max(each)["s"].cast("int")


def shard(
    spark: SparkSession, df: DataFrame, shards: int, key: str, text: str = "text", seed: int = 20, bucket_bytes: int = 16 << 20
) -> DataFrame:
    """``df`` plus ``shard`` and ``slot`` (its place in the shuffled shard, gapless from 0)."""
    scratch = Scratch(spark, "shard")
    names = [f"`{c}`" for c in df.columns]
    total = df.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 64)).first()[0] or 0
    buckets = max(1, math.ceil(total / shards / bucket_bytes))

    of_key = F.coalesce(F.when(F.col(key).isNotNull(), F.xxhash64(key)), F.xxhash64(F.lit(seed + 1), *names))
    placed = df.select(
        rendezvous(of_key, shards, seed).alias("__shard"),
        F.xxhash64(F.lit(seed + 2), *names, F.monotonically_increasing_id()).alias("__h"),
        F.struct(*[F.col(n) for n in names]).alias("__row"),
    ).withColumn("__bucket", F.pmod(F.shiftright("__h", 7), F.lit(buckets)).cast("int"))
    scattered = placed.repartition(max(shards * buckets, int(spark.conf.get("spark.sql.shuffle.partitions"))), "__shard", "__bucket").groupBy("__shard", "__bucket").agg(F.array_sort(F.collect_list(F.struct("__h", "__row"))).alias("rows"))
    permuted = scattered.select("__shard", "__bucket", F.posexplode(F.shuffle("rows", F.lit(seed))).alias("__at", "__x"))
    written = scratch.put(permuted.select("__shard", "__bucket", "__at", F.col("__x.__row").alias("__row")), "buckets")
    scratch.release()

    # one row per bucket: their number is the input's bytes over the bucket's size, checked before a broadcast
    counts = written.groupBy("__shard", "__bucket").agg(F.count("*").alias("n"))
    sums = counts.groupBy("__shard").agg(F.array_sort(F.collect_list(F.struct(F.col("__bucket").alias("b"), "n"))).alias("all"))
    sums = sums.select(
        "__shard",
        F.explode(
            F.transform("all", lambda x, i: F.struct(x["b"].alias("b"), F.aggregate(F.slice(F.col("all"), F.lit(1), i), F.lit(0).cast("long"), lambda a, y: a + y["n"]).alias("before")))
        ).alias("x"),
    ).select("__shard", F.col("x.b").alias("__bucket"), "x.before")
    if shards * buckets <= 200_000:
        sums = F.broadcast(sums)
    out = written.join(sums, ["__shard", "__bucket"])
    return out.select(*[F.col(f"__row.`{c}`").alias(new) for c, new in apart(df.columns, ["shard", "slot"]).items()], F.col("__shard").alias("shard"), (F.col("before") + F.col("__at")).alias("slot"))


def write_shards(spark: SparkSession, df: DataFrame, path: str, shards: int, key: str, **options) -> None:
    """Write each shard, in the order of its slots, as one folder of ``path``."""
    out = shard(spark, df, shards, key, **options)
    out.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
