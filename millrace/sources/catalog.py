"""Tables by name: files, merge-on-read tables, pruned suppliers, declared order, literal rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


class Catalog:
    """Registers tables as temporary views of one session."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._tables: dict[str, Callable[[Column | None], DataFrame]] = {}

    def add(self, name: str, source: DataFrame | str | Iterable, schema: StructType | str | None = None) -> DataFrame:
        """A DataFrame, a path of Parquet files, rows with a schema (any iterable, also an iterator, which is read now), or a
        function that returns one of these."""
        if callable(source):
            source = source()
        if isinstance(source, str):
            source = self.spark.read.parquet(source)
        elif not isinstance(source, DataFrame):
            source = self.spark.createDataFrame(list(source), schema)
        source.createOrReplaceTempView(name)
        self._tables[name] = lambda p: source if p is None else source.where(p)
        return source

    def add_folder(self, sf_dir: str, *names: str) -> Catalog:
        for n in names:
            self.add(n, f"{sf_dir}/{n}.parquet")
        return self

    def add_format(self, name: str, fmt: str, path: str, schema: StructType | str | None = None, **options) -> DataFrame:
        """Any format that Spark reads: csv, json, orc, text, binaryFile, jdbc."""
        reader = self.spark.read.format(fmt).options(**options)
        return self.add(name, (reader.schema(schema) if schema else reader).load(path))

    def add_merged(self, name: str, source: DataFrame, keys: list[str] | None = None, newest: list[str] | None = None, merge: dict[str, Column] | None = None, prefilter: Column | None = None) -> DataFrame:
        """A table whose parts may hold a key more than once and that is merged when read.

        ``newest``: per key the row with the greatest values of these columns. ``merge``: per key these aggregates.
        Neither: one row per key (the smallest), or distinct rows without keys. ``prefilter`` filters rows before
        they merge, which can bring an older row back; conditions of a query apply after the merge."""
        df = source if prefilter is None else source.where(F.coalesce(prefilter, F.lit(False)))
        keys = keys or []
        rest = [c for c in df.columns if c not in keys]
        if merge:
            out = df.groupBy(*keys).agg(*[c.alias(n) for n, c in merge.items()])
        elif not keys:
            out = df.distinct()
        else:
            whole = F.struct(*rest) if rest else F.struct(F.lit(1).alias("_"))
            picked = F.max_by(whole, F.struct(*newest, *[c for c in rest if c not in newest])) if newest else F.min_by(whole, whole)
            out = df.groupBy(*keys).agg(picked.alias("__row")).select(*keys, *[F.col("__row")[c].alias(c) for c in rest])
        return self.add(name, out.select(*[c for c in df.columns if c in out.columns], *[c for c in out.columns if c not in df.columns]))

    def add_pruned(self, name: str, supplier: Callable[[Column | None], DataFrame]) -> None:
        """A source that is handed the condition and may read less; the condition is applied again."""
        self._tables[name] = lambda p: supplier(p) if p is None else supplier(p).where(p)

    def add_failing(self, name: str, message: str, schema: str) -> DataFrame:
        """A table whose scan raises."""
        fields = self.spark.createDataFrame([], schema).schema.fields
        return self.add(name, self.spark.range(1).select(*[F.raise_error(F.lit(message)).cast(f.dataType).alias(f.name) for f in fields]))

    def add_log(self, name: str, path: str, partition: str | None = None, since: str = "", until: str | None = None) -> DataFrame:
        """A log folder as a table; its columns ``hour`` and ``part`` are folders, so conditions on them choose what is read."""
        log = self.spark.read.option("ignoreCorruptFiles", "true").option("basePath", path).parquet(path)
        keep = F.col("hour") >= since if since else F.lit(True)
        keep = keep & (F.col("hour") <= until) if until is not None else keep
        return self.add(name, log.where(keep if partition is None else keep & (F.col("part").cast("string") == partition)))

    def add_sorted(self, name: str, source: DataFrame, keys: list[str], declared: bool = False) -> DataFrame:
        """A table in order of its keys within hash partitions; ``declared`` trusts the source."""
        return self.add(name, source if declared else source.repartition(*keys).sortWithinPartitions(*keys))

    def add_bucketed(self, name: str, source: DataFrame, keys: list[str], buckets: int, table: str | None = None) -> DataFrame:
        """A table kept in the warehouse in buckets by its keys, sorted by them: joins and groups by the keys then read it
        without a shuffle."""
        table = table or f"{name}_bucketed"
        source.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
        return self.add(name, self.spark.table(table))

    def add_partitions(self, name: str, part: Callable[[int, int], Iterable], partitions: int, schema: str) -> DataFrame:
        """Rows made on the executors: ``part(index, partitions)`` yields the tuples of one partition."""
        import pandas as pd

        fields = self.spark.createDataFrame([], schema).columns

        def make(batches):
            for b in batches:
                for i in b["id"]:
                    rows = list(part(int(i), partitions))
                    if rows:
                        yield pd.DataFrame(rows, columns=fields)

        return self.add(name, self.spark.range(0, partitions, 1, partitions).mapInPandas(make, schema))

    def empty(self, name: str, schema: str) -> DataFrame:
        return self.add(name, self.spark.createDataFrame([], schema))

    def table(self, name: str, where: Column | None = None) -> DataFrame:
        if name not in self._tables:
            raise KeyError(f"no table {name!r}; there are {sorted(self._tables)}")
        return self._tables[name](where)


def concat(*frames: DataFrame) -> DataFrame:
    """Frames one after the other; column ``part`` keeps their order."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("part", F.lit(i))
        out = f if out is None else out.unionByName(f)
    return out
