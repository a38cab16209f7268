"""A lazy dataset: composable operators over a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, functions as F

from ..plans.sql import order
from . import joins, reducers


class Dataset:
    """Wraps a DataFrame; every operator returns a new Dataset and nothing runs before a collector."""

    def __init__(self, df: DataFrame, sorted_by: list[str] | None = None):
        self.df, self.sorted_by = df, sorted_by

    # rows
    def map(self, *columns: Column | str) -> Dataset:
        return Dataset(self.df.select(*columns))

    def map_batches(self, fn: Callable, schema: str) -> Dataset:
        """Pandas batches in and out, for what columns cannot express."""
        return Dataset(self.df.mapInPandas(fn, schema))

    def flat_map(self, array: Column, name: str) -> Dataset:
        return Dataset(self.df.withColumn(name, F.explode(array)))

    def peek(self, consumer: Callable) -> Dataset:
        """Show each pandas batch to ``consumer`` where it passes by; rows stay as they are."""

        def run(batches):
            for b in batches:
                consumer(b)
                yield b

        return Dataset(self.df.mapInPandas(run, self.df.schema), self.sorted_by)

    def lenient(self, *needed: str) -> Dataset:
        """Without rows in which a needed column is null, as failed casts and torn records leave it."""
        return Dataset(self.df.dropna("any", subset=list(needed) or None), self.sorted_by)

    def filter(self, p: Column) -> Dataset:
        return Dataset(self.df.where(F.coalesce(p, F.lit(False))), self.sorted_by)

    def until(self, p: Column, by: list[str]) -> Dataset:
        """Rows in order of ``by`` up to and with the first that satisfies ``p``: a bound found by an aggregate, no window."""
        key = F.struct(*by)
        stop = self.df.where(F.coalesce(p, F.lit(False))).agg(F.min(key).alias("__stop"))
        return Dataset(self.df.crossJoin(F.broadcast(stop)).where(F.col("__stop").isNull() | (key <= F.col("__stop"))).drop("__stop"))  # one row

    # order
    def local_sort(self, *keys: str) -> Dataset:
        return Dataset(self.df.sortWithinPartitions(*order(*keys)), list(keys))

    def repartition_sort(self, *keys: str, partitions: int | None = None) -> Dataset:
        names = [k.split()[0] for k in keys]
        dealt = self.df.repartition(partitions, *names) if partitions else self.df.repartition(*names)
        return Dataset(dealt.sortWithinPartitions(*order(*keys)), list(keys))

    def sort(self, *keys: str) -> Dataset:
        return Dataset(self.df.orderBy(*order(*keys)), list(keys))

    def distinct_sort(self, *keys: str) -> Dataset:
        return Dataset(self.df.dropDuplicates([k.split()[0] for k in keys]).orderBy(*order(*keys)), list(keys))

    def cast_to_sorted(self, *keys: str) -> Dataset:
        return Dataset(self.df, list(keys))

    # limits
    def limit(self, n: int) -> Dataset:
        return Dataset(self.df.limit(n), self.sorted_by)

    def skip(self, n: int) -> Dataset:
        return Dataset(self.df.offset(n), self.sorted_by)

    def offset_limit(self, offset: int, limit: int) -> Dataset:
        return Dataset(self.df.offset(offset).limit(limit), self.sorted_by)

    def top(self, *keys: str, limit: int, offset: int = 0) -> Dataset:
        """Sorted offset and limit: each partition keeps offset + limit rows before they meet."""
        return Dataset(self.df.orderBy(*order(*keys)).offset(offset).limit(limit), list(keys))

    def local_limit(self, n: int) -> Dataset:
        """At most ``n`` rows of each partition."""

        def cut(batches):
            left = n
            for b in batches:
                if left <= 0:
                    return
                yield b.head(left)
                left -= len(b)

        return Dataset(self.df.mapInPandas(cut, self.df.schema), self.sorted_by)

    # sets and parts
    def union_all(self, *others: Dataset) -> Dataset:
        out = self.df
        for o in others:
            out = out.union(o.df)
        return Dataset(out)

    def union(self, *others: Dataset) -> Dataset:
        """Distinct rows; map columns take part as sorted entries."""
        out = self.union_all(*others).df
        maps = [f.name for f in out.schema.fields if f.dataType.typeName() == "map"]
        for m in maps:
            out = out.withColumn(m, F.array_sort(F.map_entries(m)))
        out = out.distinct()
        for m in maps:
            out = out.withColumn(m, F.map_from_entries(m))
        return Dataset(out)

    def repartition(self, *keys: str, partitions: int | None = None) -> Dataset:
        return Dataset(self.df.repartition(partitions, *keys) if partitions else self.df.repartition(*keys))

    def to_single(self, *keys: str) -> Dataset:
        """One partition, in order if keys are given; for results that are small."""
        one = self.df.coalesce(1)
        return Dataset(one.sortWithinPartitions(*order(*keys)) if keys else one, list(keys) or None)

    def split(self, **routes: Column) -> dict[str, Dataset]:
        """Fan out: the rows of each route; routes may overlap."""
        return {n: self.filter(p) for n, p in routes.items()}

    # keys
    def join(self, other: Dataset, keys: list, how: str = "inner", null_safe: bool = True, strategy: str | None = None) -> Dataset:
        return Dataset(joins.equi_join(self.df, other.df, keys, how, null_safe, strategy))

    def lookup(self, other: Dataset, keys: list, by: list[str]) -> Dataset:
        return Dataset(joins.lookup_join(self.df, other.df, keys, by))

    def local_reduce(self, keys: list[str], fn: Callable, schema: str) -> Dataset:
        """Reduce within each partition: ``fn`` maps grouped pandas rows, sorted by key, to accumulators. A key's rows come
        together however many batches they fill; the worker holds a batch and one key's rows."""
        import pandas as pd

        def run(batches):
            held = None
            for b in batches:
                if not len(b):
                    continue
                b = b if held is None else pd.concat([held, b], ignore_index=True)
                ids = b.groupby(keys, sort=False, dropna=False).ngroup()
                open_ = ids == ids.iloc[-1]
                done, held = b[~open_], b[open_]
                if len(done):
                    yield fn(done.groupby(keys, sort=True, dropna=False))
            if held is not None:
                yield fn(held.groupby(keys, sort=True, dropna=False))

        return Dataset(self.df.sortWithinPartitions(*keys).mapInPandas(run, schema), keys)

    def reduce(self, keys: list[str], **by: reducers.Reducer) -> Dataset:
        """Combine before the shuffle, finish after it."""
        return Dataset(reducers.input_to_output(self.df, keys, by))

    def split_reduce(self, keys: list[str], partitions: int | None = None, **by: reducers.Reducer) -> Dataset:
        return Dataset(reducers.split_reduce(self.df, keys, by, partitions))

    # collectors
    def collect(self, limit: int | None = None) -> list[Row]:
        return (self.df.limit(limit) if limit else self.df).collect()

    def collect_sorted(self, *keys: str, distinct: bool = False, limit: int | None = None) -> list[Row]:
        d = self.distinct_sort(*keys) if distinct else self.sort(*keys)
        return d.collect(limit)

    def iterate(self) -> Iterator[Row]:
        """Partition by partition, a partition at a time on the driver."""
        return self.df.toLocalIterator()

    def write(self, path: str, rows_per_file: int | None = None, by: list[str] | None = None, codec: str = "zstd") -> None:
        w = self.df.write.mode("append").option("compression", codec)
        w = w.option("maxRecordsPerFile", rows_per_file) if rows_per_file else w
        (w.partitionBy(*by) if by else w).parquet(path)

    def drain(self) -> None:
        """Run everything and keep nothing."""
        self.df.write.format("noop").mode("overwrite").save()

    def for_each(self, consumer: Callable[[Iterator[Row]], None], acknowledge: Callable[[], None] = lambda: None) -> None:
        """Give each partition's rows to ``consumer`` on its executor; ``acknowledge`` is called once all have ended well."""
        self.df.foreachPartition(consumer)
        acknowledge()

    def stream_reduce(self, keys: list[str], by: list[str], first: Callable, following: Callable, complete: Callable, schema: str) -> Dataset:
        """A reducer that may emit any number of rows per group, see :func:`.reducers.stream_reduce`."""
        return Dataset(reducers.stream_reduce(self.df, keys, by, first, following, complete, schema))

    def observe(self, name: str, **metrics: Column) -> Dataset:
        return Dataset(self.df.observe(name, *[c.alias(n) for n, c in metrics.items()]), self.sorted_by)


def page_rank(spark, pages: DataFrame, rounds: int, path: str, damping: float = 0.85) -> DataFrame:
    """(page, rank) after ``rounds`` joins of pages (page, links) with ranks; each round is written, which cuts its lineage."""
    edges = pages.select("page", F.explode("links").alias("to"), F.size("links").alias("n"))
    ranks = pages.select("page", F.lit(1.0).alias("rank"))
    for i in range(rounds):
        sent = edges.join(ranks, "page").groupBy(F.col("to").alias("page")).agg(F.sum(F.col("rank") / F.col("n")).alias("got"))
        ranks = pages.select("page").join(sent, "page", "left").select("page", (F.lit(1 - damping) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        ranks.write.mode("overwrite").parquet(f"{path}/{i}")
        ranks = spark.read.parquet(f"{path}/{i}")
    return ranks
