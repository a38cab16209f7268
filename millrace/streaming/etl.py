"""Incremental loads: positions and results commit together, so each row counts once."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import ATOMIC, Files
from ..sources import logs


class Manifest:
    """A state in numbered files, each created only if it does not exist: the first writer of a number wins.

    That takes a store whose rename refuses an existing target; others are refused."""

    def __init__(self, spark: SparkSession, root: str):
        if ("://" in root and root.split("://")[0] not in ATOMIC) or not Files(spark, root).renames_atomically():
            raise ValueError(f"{root}: renaming does not refuse an existing target on this store, so two writers could both win")
        self.files = Files(spark, f"{root}/manifest")

    def latest(self) -> tuple[int, dict]:
        names = [n for n in self.files.names("") if n.endswith(".json")]
        return (int(names[-1][:-5]), json.loads(self.files.read(names[-1]))) if names else (0, {})

    def at(self, revision: int) -> dict:
        return json.loads(self.files.read(f"{revision:010d}.json"))

    def commit(self, revision: int, state: dict) -> bool:
        """Make ``state`` the successor of ``revision``; False if another writer did so first."""
        return self.files.create(f"{revision + 1:010d}.json", json.dumps(state))

    def update(self, change: Callable[[dict], dict | None], tries: int = 20) -> tuple[int, dict]:
        """Apply ``change`` to the latest state until the commit succeeds; None leaves it as it is."""
        for _ in range(tries):
            revision, state = self.latest()
            new = change(json.loads(json.dumps(state)))
            if new is None:
                return revision, state
            if self.commit(revision, new):
                return revision + 1, new
        raise RuntimeError("other writers kept changing the manifest")


class LogLoader:
    """Loads a log folder into named Parquet tables step by step.

    The files of a step go to folders of their own, and one commit adds the folders and the position behind them, so a step
    that fails leaves nothing and one that runs twice commits once. ``run`` reads the files that the committed position does
    not hold, and needs no other state; ``stream`` leaves the reading to a stream with a checkpoint."""

    def __init__(self, spark: SparkSession, root: str, consumers: dict[str, Callable[[DataFrame], DataFrame]]):
        self.spark, self.root, self.consumers = spark, root.rstrip("/"), consumers
        self.manifest = Manifest(spark, self.root)

    def _write(self, batch: DataFrame, step: str) -> dict[str, str]:
        paths = {name: f"data/{name}/{step}" for name in self.consumers}
        for name, consumer in self.consumers.items():
            consumer(batch).write.mode("overwrite").parquet(f"{self.root}/{paths[name]}")
        return paths

    def _commit(self, paths: dict[str, str], source: str, before, position) -> bool:
        """Add the folders if the source's position is still ``before``; False if another loader moved it."""
        won = True

        def add(state: dict) -> dict | None:
            nonlocal won
            won = state.get("positions", {}).get(source) == before
            if not won:
                return None
            for name, p in paths.items():
                state.setdefault("chunks", {}).setdefault(name, []).append(p)
            state.setdefault("positions", {})[source] = position
            return state

        self.manifest.update(add)
        return won

    def position(self, source: str = "log"):
        return self.manifest.latest()[1].get("positions", {}).get(source)

    def run(self, path: str, source: str = "log", files_per_step: int | None = None, partition: str | None = None, **names: str) -> int:
        """Process everything that is there now; call again for what came since. Returns the number of steps."""
        steps = 0
        while True:
            before = self.position(source)
            new, position = logs.new_files(self.spark, path, partition, before, None, files_per_step, **names)
            if not new:
                return steps
            batch = logs.read_files(self.spark, path, new)
            if self._commit(self._write(batch, f"{source}-{uuid.uuid4().hex}"), source, before, position):
                steps += 1

    def settle(self, before: str, source: str = "log") -> None:
        """Close the log's hours before ``before``, so that positions stay small and old files may be deleted."""

        def change(state: dict) -> dict:
            state["positions"][source] = logs.settle(state["positions"][source], before)
            return state

        self.manifest.update(change)

    def consume(self, batch: DataFrame, batch_id: int, source: str = "stream") -> None:
        """One batch of a stream, known by its number: a number that was loaded is skipped, one that leaves a gap raises."""
        done = self.position(source)
        if done is not None and batch_id <= done:
            return
        if batch_id != (0 if done is None else done + 1):
            raise RuntimeError(f"{source} is at batch {done}; {batch_id} does not continue it")
        self._commit(self._write(batch, f"{source}-{batch_id:010d}"), source, done, batch_id)

    def stream(self, path: str, schema: str, source: str = "stream", files_per_batch: int | None = None) -> None:
        """As ``run``, by a stream. Batch numbers only mean something with the checkpoint they come from, so a source that was
        loaded and has lost its checkpoint raises instead of taking new batches for old ones."""
        at = Files(self.spark, f"{self.root}/checkpoint")
        if self.position(source) is not None and "metadata" not in at.names(source):
            raise RuntimeError(f"{source} was loaded up to batch {self.position(source)}, but its checkpoint is gone")
        reader = self.spark.readStream.schema(schema)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        query = (
            reader.parquet(path).writeStream.foreachBatch(lambda df, i: self.consume(df, i, source))
            .option("checkpointLocation", f"{self.root}/checkpoint/{source}").trigger(availableNow=True).start()
        )
        query.awaitTermination()

    def read(self, name: str) -> DataFrame | None:
        chunks = self.manifest.latest()[1].get("chunks", {}).get(name, [])
        return self.spark.read.parquet(*[f"{self.root}/{c}" for c in chunks]) if chunks else None


def windowed(df: DataFrame, time: str, width: str, keys: list[str], aggs: list[Column], slide: str | None = None, late: str | None = None) -> DataFrame:
    """Tumbling or sliding event-time windows, for batches and streams; ``late`` bounds the state of a stream."""
    if late:
        df = df.withWatermark(time, late)
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return df.groupBy(w.alias("w"), *keys).agg(*aggs).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *[F.col(f"`{c}`") for c in _names(df, keys, aggs)])


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], aggs: list[Column], late: str | None = None) -> DataFrame:
    if late:
        df = df.withWatermark(time, late)
    return df.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*aggs).select(F.col("w.start").alias("session_start"), *keys, *[F.col(f"`{c}`") for c in _names(df, keys, aggs)])


def _names(df: DataFrame, keys: list[str], aggs: list[Column]) -> list[str]:
    return [a._jc.toString().rpartition(" AS ")[2] for a in aggs]
