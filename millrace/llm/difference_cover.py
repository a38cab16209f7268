"""A suffix array by the difference cover modulo 3, as DataFrames, and the removal of repeats by it.

Suffixes that start at positions 1 and 2 modulo 3 are sampled. Their triples of symbols are sorted and named; where
names repeat, the string of names (positions 1 modulo 3, then 2 modulo 3) is ranked by recursion. The remaining suffixes
are a symbol before a ranked one, so two more sorts merge them: against positions 1 modulo 3 by (symbol, rank behind
it), against 2 modulo 3 by (symbol, symbol, rank behind them). Adjacent suffixes whose first ``length`` bytes are equal
form runs, of which all but the first in the input go.

Results equal :func:`.substring_dedup.remove_repeats`, which the query uses: this way moves some hundred bytes per byte of
text (figures in the README). Every sort is Spark's, so memory is bounded; every round's tables are written.

Defined cases: as there; ids must not repeat and must not be null, as they name the documents' places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import Scratch, in_batches
from .substring_dedup import _cut


def _ordered(scratch: Scratch, df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Written in order of ``keys``, with ``k``, which grows in that order."""
    return scratch.put(df.orderBy(*keys).withColumn("k", F.monotonically_increasing_id()), name)


def _running(df: DataFrame, value: Column, name: str) -> DataFrame:
    """``df`` (with ``k``) plus the sum of ``value`` over the rows before: sums by task first, then within each task."""
    part = F.shiftright("k", 33)
    sums = sorted((r["p"], r["s"]) for r in df.groupBy(part.alias("p")).agg(F.sum(value).alias("s")).collect())  # a row per task
    before, total = [], 0
    for p, s in sums:
        before.append((p, total))
        total += s
    at = F.broadcast(df.sparkSession.createDataFrame(before, "p long, at_start long"))
    earlier = Window.partitionBy("p").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("p", part).join(at, "p").withColumn(name, F.col("at_start") + F.coalesce(F.sum(value).over(earlier), F.lit(0))).drop("p", "at_start")


def suffix_ranks(scratch: Scratch, text: DataFrame, n: int) -> DataFrame:
    """(pos, rank): the rank of each suffix of ``text`` (pos from 0 to n - 1, sym above 0); ranks grow with the suffixes."""
    near = text.select(F.explode(F.array(*[F.struct((F.col("pos") - i).alias("pos"), F.lit(i).alias("i"), "sym") for i in range(3)])).alias("x")).select("x.*")
    near = near.where("pos >= 0").groupBy("pos").agg(*[F.coalesce(F.max(F.when(F.col("i") == i, F.col("sym"))), F.lit(0)).alias(f"s{i}") for i in range(3)])
    near = scratch.put(near, "triples")
    sample = near.where("pos % 3 <> 0")
    names = _ordered(scratch, sample.select("s0", "s1", "s2").distinct(), ["s0", "s1", "s2"], "names").withColumnRenamed("k", "name")
    named = scratch.put(sample.join(names, ["s0", "s1", "s2"]).select("pos", "name"), "named")
    size = n - (n + 2) // 3
    if names.count() < size:
        ones = (n + 1) // 3 + 1  # an empty place parts the two halves
        place = F.when(F.col("pos") % 3 == 1, F.floor(F.col("pos") / 3)).otherwise(F.floor(F.col("pos") / 3) + ones).cast("long")
        gap = scratch.spark.range(ones - 1, ones).select(F.col("id").alias("pos"), F.lit(1).cast("long").alias("sym"))
        string = named.select(place.alias("pos"), (F.col("name") + 2).alias("sym")).unionByName(gap)
        inner = suffix_ranks(scratch, scratch.put(string, "string"), size + 1)
        back = F.when(F.col("pos") < ones - 1, F.col("pos") * 3 + 1).otherwise((F.col("pos") - ones) * 3 + 2)
        ranked = inner.where(F.col("pos") != ones - 1).select(back.cast("long").alias("pos"), "rank")
    else:
        ranked = named.select("pos", F.col("name").alias("rank"))
    ranked = scratch.put(ranked, "ranked")
    # each suffix with the ranks behind it; an empty suffix has rank -1
    r = ranked.select(F.explode(F.array(*[F.struct((F.col("pos") - i).alias("pos"), F.lit(i).alias("i"), "rank") for i in range(3)])).alias("x")).select("x.*")
    behind = r.where("pos >= 0").groupBy("pos").agg(*[F.coalesce(F.max(F.when(F.col("i") == i, F.col("rank"))), F.lit(-1)).alias(f"r{i}") for i in range(3)])
    every = near.join(behind, "pos", "left").na.fill(-1, ["r0", "r1", "r2"])
    every = scratch.put(every.withColumn("m", F.col("pos") % 3), "behind")
    zero = F.when(F.col("m") == 0, 1).otherwise(0)
    other = F.when(F.col("m") != 0, 1).otherwise(0)
    by_one = _running(_running(_ordered(scratch, every.where("m <> 2").select("pos", "m", "s0", "r1"), ["s0", "r1"], "by-one"), zero, "zeros"), other, "others")
    by_two = _running(_running(_ordered(scratch, every.where("m <> 1").select("pos", "m", "s0", "s1", "r2"), ["s0", "s1", "r2"], "by-two"), zero, "zeros"), other, "others")
    samples = _running(_ordered(scratch, ranked, ["rank"], "samples"), F.lit(1), "before").select("pos", "before")
    by_one, by_two = scratch.put(by_one.select("pos", "m", "zeros", "others"), "one"), scratch.put(by_two.select("pos", "m", "zeros", "others"), "two")
    zeros = by_one.where("m = 0").select("pos", "zeros", "others").join(by_two.where("m = 0").select("pos", F.col("others").alias("more")), "pos")
    sampled = by_one.where("m = 1").unionByName(by_two.where("m = 2")).join(samples, "pos")
    out = zeros.select("pos", (F.col("zeros") + F.col("others") + F.col("more")).alias("rank")).unionByName(sampled.select("pos", (F.col("before") + F.col("zeros")).alias("rank")))
    return scratch.put(out, "ranks")


def remove_repeats(spark: SparkSession, docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As :func:`.substring_dedup.remove_repeats`, by a suffix array of all texts."""
    scratch = Scratch(spark, "suffixes")
    raw = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("text"))
    laid = _running(_ordered(scratch, raw.select("doc_id", F.octet_length("text").cast("long").alias("n")), ["doc_id"], "order"), F.col("n") + 1, "start")
    laid = scratch.put(laid.select("doc_id", "n", "start"), "laid")
    total = laid.agg(F.sum(F.col("n") + 1)).first()[0] or 0
    spans = spark.createDataFrame([], "doc_id long, lo int, hi int")
    if total:
        placed = raw.join(laid, "doc_id")
        # bytes are 1 to 256; every document ends with a symbol of its own, so suffixes part there
        byte = F.conv(F.hex(F.substring("text", F.col("i") + 1, F.lit(1))), 16, 10).cast("long") + 1
        inside = placed.where("n > 0").select("start", "text", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("i")).select((F.col("start") + F.col("i")).alias("pos"), byte.alias("sym"))
        ends = laid.select((F.col("start") + F.col("n")).alias("pos"), (F.lit(1000) + F.col("start")).alias("sym"))
        ranks = suffix_ranks(scratch, scratch.put(inside.unionByName(ends), "symbols"), total)
        # adjacent prefixes: whole strings only
        whole = placed.where(F.col("n") >= length).select("doc_id", "start", "text", F.explode(F.sequence(F.lit(0), (F.col("n") - length).cast("int"))).alias("i"))
        strings = whole.select("doc_id", (F.col("start") + F.col("i")).alias("pos"), "i", F.substring("text", F.col("i") + 1, F.lit(length)).alias("prefix")).join(ranks, "pos")
        rows = _ordered(scratch, strings.select("rank", "pos", "doc_id", "i", "prefix"), ["rank"], "strings")
        part = F.shiftright("k", 33)
        edges = rows.groupBy(part.alias("p")).agg(F.max_by("prefix", "k").alias("last"))  # a row per task
        beside = edges.select((F.lead("p").over(Window.orderBy("p"))).alias("p"), F.col("last").alias("earlier"))
        one = rows.withColumn("p", part).join(F.broadcast(beside), "p", "left")
        here = F.coalesce(F.lag("prefix").over(Window.partitionBy("p").orderBy("k")), F.col("earlier"))
        fresh = one.withColumn("new", F.when(here.eqNullSafe(F.col("prefix")), 0).otherwise(1)).select("k", "pos", "doc_id", "i", "new")
        runs = _running(scratch.put(fresh, "fresh"), F.col("new"), "opened").withColumn("run", F.col("opened") + F.col("new"))
        firsts = scratch.put(runs.select("run", "pos", "doc_id", "i"), "runs")
        least = firsts.groupBy("run").agg(F.min("pos").alias("first"), F.count("*").alias("c")).where("c > 1").select("run", "first")
        spans = firsts.join(least, "run").where("pos > first").select("doc_id", F.col("i").alias("lo"), (F.col("i") + length).alias("hi"))
    by_doc = scratch.put(spans.groupBy("doc_id").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "spans").withColumnRenamed("doc_id", "d")
    none = F.array().cast("array<struct<lo:int,hi:int>>")
    out = raw.join(by_doc, F.col("doc_id") == F.col("d"), "left").select("doc_id", F.col("text"), F.coalesce("spans", none).alias("spans"))
    return in_batches(out, _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
