"""Stores of replicated state: appended folders under a manifest, merged on read; replication and a write-ahead log."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import Files
from ..streaming.etl import Manifest
from .crdt import merge_state, owners


@dataclass(frozen=True)
class State:
    """A column of state: ``lift`` makes a state of an uploaded row, ``merge`` (an aggregate) joins states, ``read`` shows one.

    ``merge`` must not depend on how states were joined before, as compaction joins them too; for replicas
    joining a state with itself must not change it either."""

    lift: Callable[[], Column]
    merge: Callable[[Column], Column]
    read: Callable[[Column], Column] = lambda c: c


def largest(column: str) -> State:
    return State(lambda: F.col(column), F.max)


def counted() -> State:
    return State(lambda: F.lit(1).cast("long"), F.sum)


class CrdtStore:
    """Folders of (keys, ts, tombstone, states) named by a manifest."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], states: dict[str, State]):
        self.spark, self.path, self.keys, self.states = spark, path.rstrip("/"), keys, states
        self.manifest = Manifest(spark, self.path)

    # writes
    def upload(self, rows: DataFrame, once: str | None = None) -> None:
        """``rows``: keys, ts and what the states are lifted from. An upload named by ``once`` counts once."""
        lifted = rows.select(*self.keys, "ts", F.lit(False).alias("tombstone"), *[s.lift().alias(n) for n, s in self.states.items()])
        self._add(lifted, once)

    def remove(self, keys: DataFrame) -> None:
        """``keys``: keys and ts."""
        self._add(keys.select(*self.keys, "ts", F.lit(True).alias("tombstone")))

    def put(self, states: DataFrame) -> None:
        """Entries as ``entries`` gives them: keys, ts, tombstone and states."""
        self._add(states)

    def _write(self, rows: DataFrame) -> dict:
        name = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return {"path": name, "rows": self.spark.read.parquet(f"{self.path}/{name}").count()}  # from the files' footers

    def _add(self, rows: DataFrame, once: str | None = None) -> None:
        new = self._write(rows)

        def change(state: dict) -> dict | None:
            if once is not None and once in state.get("uploads", []):
                return None
            if once is not None:
                state.setdefault("uploads", []).append(once)
            state.setdefault("folders", []).append(new)
            return state

        self.manifest.update(change)

    def _replace(self, old: list[dict], new: list[dict]) -> None:
        gone = {f["path"] for f in old}

        def change(state: dict) -> dict:
            if lost := gone - {f["path"] for f in state.get("folders", [])}:
                raise RuntimeError(f"folders {sorted(lost)} were taken by another")
            return state | {"folders": [f for f in state["folders"] if f["path"] not in gone] + new}

        self.manifest.update(change)

    # reads
    def folders(self) -> list[dict]:
        return self.manifest.latest()[1].get("folders", [])

    def entries(self, folders: list[dict] | None = None) -> DataFrame:
        """The entries of all folders, or of these, unmerged."""
        folders = self.folders() if folders is None else folders
        if not folders:
            raise LookupError(f"{self.path} holds nothing")
        return self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.path}/{f['path']}" for f in folders])

    def _joined(self, rows: DataFrame) -> DataFrame:
        return merge_state(rows, self.keys, {n: s.merge(F.col(n)) for n, s in self.states.items() if n in rows.columns})

    def _shown(self, merged: DataFrame) -> DataFrame:
        return merged.select(*self.keys, "ts", *[s.read(F.col(n)).alias(n) for n, s in self.states.items() if n in merged.columns])

    def download(self, since=None) -> DataFrame:
        """The merged state of every key, or of those with a time of at least ``since``."""
        out = self._joined(self.entries())
        return self._shown(out if since is None else out.where(F.col("ts") >= F.lit(since)))

    def get(self, **key) -> DataFrame:
        rows = self.entries()
        for k, v in key.items():
            rows = rows.where(F.col(k).eqNullSafe(F.lit(v)))
        return self._shown(self._joined(rows))

    @contextmanager
    def take(self) -> Iterator[DataFrame]:
        """The merged state, drained: it leaves the store when the block ends, and stays if the block fails."""
        folders = self.folders()
        yield self._shown(self._joined(self.entries(folders)))
        self._replace(folders, [])

    # upkeep
    def compact(self, everything: bool = False) -> int:
        """Merge the largest group of folders of about one size (their rows' order of magnitude), or all; returns how many."""
        groups: dict[int, list[dict]] = {}
        for f in self.folders():
            groups.setdefault(0 if everything else int(math.log10(max(1, f["rows"]))), []).append(f)
        picked = max(groups.values(), key=len, default=[])
        if len(picked) < 2:
            return 0
        rows = self.entries(picked)
        live = self._joined(rows).withColumn("tombstone", F.lit(False))
        gone = rows.where("tombstone").groupBy(*self.keys).agg(F.max("ts").alias("ts")).withColumn("tombstone", F.lit(True))
        self._replace(picked, [self._write(live.unionByName(gone, allowMissingColumns=True))])
        return len(picked)

    def clean(self) -> list[str]:
        """Delete folders that the manifest does not name; no reader may be at work."""
        files, held = Files(self.spark, self.path), {f["path"] for f in self.folders()}
        gone = [f"data/{n}" for n in files.names("data") if f"data/{n}" not in held]
        for n in gone:
            files.delete(n)
        return gone


class ReplicatedStore:
    """Stores by node; an entry lives on the ``replicas`` nodes that rendezvous hashing gives its key."""

    def __init__(self, nodes: dict[str, CrdtStore], replicas: int = 2):
        self.nodes, self.replicas = nodes, replicas
        first = next(iter(nodes.values()))
        self.spark, self.keys, self.states = first.spark, first.keys, first.states

    def _dealt(self, rows: DataFrame, send: Callable[[CrdtStore, DataFrame], None]) -> None:
        placed = owners(rows, self.keys, sorted(self.nodes), min(self.replicas, len(self.nodes)))
        for name, store in self.nodes.items():
            send(store, placed.where(F.array_contains("owners", name)).drop("owners"))

    def upload(self, rows: DataFrame) -> None:
        self._dealt(rows, lambda store, part: store.upload(part))

    def remove(self, keys: DataFrame) -> None:
        self._dealt(keys, lambda store, part: store.remove(part))

    def _entries(self, down: frozenset[str]) -> DataFrame:
        if len(down & self.nodes.keys()) >= min(self.replicas, len(self.nodes)):
            raise RuntimeError(f"{len(down)} nodes are down; some keys have no other replica")
        frames = [s.entries() for n, s in self.nodes.items() if n not in down and s.folders()]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

    def download(self, down: frozenset[str] = frozenset()) -> DataFrame:
        """The merged state of all nodes but those that are ``down``, fewer than the replicas."""
        any_ = next(iter(self.nodes.values()))
        return any_._shown(any_._joined(self._entries(down)))

    def repartition(self, nodes: dict[str, CrdtStore], replicas: int | None = None) -> ReplicatedStore:
        """The same entries on other nodes: each is put where the new scheme wants it, then leaves where it does not."""
        new = ReplicatedStore(nodes, replicas or self.replicas)
        every = self._entries(frozenset()).distinct()
        before = {n: s.folders() for n, s in (self.nodes | nodes).items()}
        new._dealt(every, lambda store, part: store.put(part))
        for n, s in (self.nodes | nodes).items():
            if before[n]:
                s._replace(before[n], [])
        return new


class WriteAheadLog:
    """Rows put on the driver, flushed as files to a shared folder, then uploaded to a store; each file counts once."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._rows: list[tuple] = []

    def put(self, *row) -> None:
        self._rows.append(row)

    def flush(self) -> str | None:
        """Make all rows put so far last; the name of their file's folder."""
        if not self._rows:
            return None
        name = f"wal-{uuid.uuid4().hex}"
        self.spark.createDataFrame(self._rows, self.schema).coalesce(1).write.parquet(f"{self.path}/{name}")
        self._rows = []
        return name

    def upload(self, store: CrdtStore) -> int:
        """Send what was flushed. The store remembers names, so a crash before files are deleted does no harm."""
        files = Files(self.spark, self.path)
        done = [n for n in files.names("") if n.startswith("wal-") and "_SUCCESS" in files.names(n)]
        for n in done:
            store.upload(self.spark.read.parquet(f"{self.path}/{n}"), once=n)
            files.delete(n)
        return len(done)
