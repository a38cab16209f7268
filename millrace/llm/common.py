"""Shared scratch tables, size-checked broadcasts and connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes and rows of an Arrow batch; a single longer row is a batch of its own.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2000
#: Written bytes from which finished steps' shuffle files are worth a pause to remove.
RELEASE_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset (tests on one machine)
    a temporary folder is taken instead.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.millrace.scratch", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.conf.set("spark.millrace.scratch", found)
    return found.rstrip("/")


class Scratch:
    """Written tables that cut lineage; a lost executor costs no more than the step that reads them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = self._held = 0
        atexit.register(self._remove)  # results may be read until the driver ends

    def put(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        """Write ``df`` as Parquet and return the DataFrame that reads it."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._millrace_path = path
        self._held += self._fs(path).getContentSummary(self._path(path)).getLength()
        return out

    def release(self) -> None:
        """Let Spark's cleaner remove the shuffle files of steps whose results are written.

        Finished queries stay referenced until Spark's listeners and the gateway have let go, hence a second round. Steps
        that wrote little are left to Spark's own cleaning.
        """
        if self._held < RELEASE_BYTES:
            return
        self._held = 0
        for _ in range(2):
            gc.collect()
            time.sleep(0.7)
            self.spark._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for df in tables:
            if path := getattr(df, "_millrace_path", None):
                self._delete(path)

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _delete(self, path: str) -> None:
        self._fs(path).delete(self._path(path), True)

    def _remove(self) -> None:
        with contextlib.suppress(Exception):  # the session may be gone already
            self._delete(self.root)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if a count shows at most ``rows`` rows, else unmarked for a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for mapInArrow, after which the worker gives freed memory back: workers outlive their tasks."""

    def task(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # only where the C library has it
            ctypes.CDLL(None).malloc_trim(0)

    return task


def in_batches(df: DataFrame, run, schema: str, rows: int = BATCH_ROWS) -> DataFrame:
    """``df.mapInArrow`` with batches bounded by bytes, so that long texts do not gather in one.

    Spark reads the bounds from the session when a plan runs, which may be long after this call, so they are
    lowered there if they are higher and stay so; results do not depend on them."""
    conf = df.sparkSession.conf
    for key, bound in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", BATCH_BYTES)):
        now = _number(conf.get(f"spark.sql.execution.arrow.{key}"))
        if not 0 < now <= bound:
            conf.set(f"spark.sql.execution.arrow.{key}", str(bound))
    return df.mapInArrow(lean(run), schema)


def _number(setting: str) -> int:
    """A setting's number; sizes with a unit count as unbounded."""
    digits = setting.removesuffix("b").removesuffix("B")
    return int(digits) if digits.lstrip("-").isdigit() else 0


def apart(names: list[str], own: list[str]) -> dict[str, str]:
    """The name under which each input column travels on: with underscores behind it if an operator's own column has its name."""
    taken = {x.lower() for x in own}
    out = {}
    for name in names:
        new = name
        while new.lower() in taken or (new != name and new.lower() in {x.lower() for x in names}):
            new += "_"
        out[name] = new
        taken.add(new.lower())
    return out


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, label): for every node of ``edges`` (a, b: long) the smallest node that it reaches.

    Every round each node takes its smallest neighbour, if that is smaller, and jumps to its label's label until nothing
    changes; then edges are drawn between labels, and those within one label or drawn twice go. So all edges
    are joined once, and rounds, in each two of which half of the labels go, join what few are left. Every round is an aggregate with
    partial sums or a join that adaptive execution can split, so one hub with many links is no
    single task's work. Nothing is gathered on the driver but a count of changes.
    """
    once = lambda df, x, y: df.where(F.col(x) != F.col(y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()
    live, found = scratch.put(once(edges, "a", "b"), "edges"), None
    while True:
        both = live.union(live.select("b", "a"))
        labels = scratch.put(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
        changed = True
        while changed:
            over = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
            jump = scratch.put(labels.join(over, "label").select("node", F.col("label").alias("old"), F.col("up").alias("label")), "jump")
            scratch.drop(labels)
            labels = jump.select("node", "label")
            labels._millrace_path = jump._millrace_path
            changed = jump.where("label <> old").limit(1).count() > 0
        ends = live.join(labels.toDF("a", "la"), "a").join(labels.toDF("b", "lb"), "b")
        left = scratch.put(once(ends, "la", "lb"), "edges")
        scratch.drop(live)
        if found is None:
            found = labels
        else:
            next_ = scratch.put(found.join(labels.toDF("label", "up"), "label", "left").select("node", F.coalesce("up", "label").alias("label")), "found")
            scratch.drop(found, labels)
            found = next_
        if not left.limit(1).count():
            scratch.drop(left)
            return found
        live = left
