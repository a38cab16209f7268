"""The cube: ingest, storage as chunks under a manifest, queries, compaction."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import date
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.predicates import Predicate, TRUE
from ..operators.joins import attribute_join, first_per_key
from ..session import Files
from ..streaming.etl import Manifest
from .structure import DATA_WITH_TOTALS, METADATA, Aggregation, Plan, Query, Structure, plan, prunes


#: Types of dimensions whose bounds are kept.
PLAIN = ("int", "long", "bigint", "string", "double", "date")


@dataclass
class Report:
    attributes: list[str]
    measures: list[str]
    rows: DataFrame | None = None
    totals: DataFrame | None = None
    total_count: int | None = None
    dropped: tuple[str, ...] = ()

    def to_json(self) -> str:
        out: dict[str, Any] = {"attributes": self.attributes, "measures": self.measures}
        if self.rows is not None:
            out["records"] = [json.loads(r[0]) for r in self.rows.select(F.to_json(F.struct("*"))).collect()]
        if self.totals is not None:
            out["totals"] = json.loads(self.totals.select(F.to_json(F.struct("*"))).first()[0])
            out["totalCount"] = self.total_count
        return json.dumps(out)


def compatible(s: Structure, a: Aggregation, columns: list[str]) -> bool:
    return set(a.dimensions) <= set(columns)


def build(s: Structure, a: Aggregation, rows: DataFrame, check: dict[str, Predicate] | None = None) -> DataFrame:
    """One aggregation of input rows: invalid ones go, rows that pass but break ``check`` raise, the rest is grouped."""
    valid = rows.where(s.predicate(a).column())
    for d, p in (check or {}).items():
        if d in a.dimensions:
            valid = valid.where(F.when(~p.column(), F.raise_error(F.lit(f"{d} breaks its precondition")).cast("boolean")).otherwise(F.lit(True)))
    return valid.groupBy(*a.dimensions).agg(*[s.measures[m].build().alias(m) for m in a.measures])


def _merge(s: Structure, frame: DataFrame, dims: list[str], measures: list[str]) -> DataFrame:
    return frame.groupBy(*dims).agg(*[s.measures[m].merge(F.col(m)).alias(m) for m in measures])


class Cube:
    """Aggregations are DataFrames (in memory) or chunk folders under ``root`` (stored)."""

    def __init__(self, spark: SparkSession, structure: Structure, root: str | None = None):
        self.spark, self.s, self.root = spark, structure, root
        self._frames: dict[str, DataFrame] = {}
        self.manifest = Manifest(spark, root) if root else None

    # ingest
    def load(self, rows: DataFrame, check: dict[str, Predicate] | None = None) -> list[str]:
        """Send rows to every aggregation whose dimensions they have; returns the aggregations."""
        fits = [a for a in self.s.aggregations.values() if compatible(self.s, a, rows.columns)]
        if self.root is None:
            for a in fits:
                new = build(self.s, a, rows, check)
                old = self._frames.get(a.id)
                self._frames[a.id] = new if old is None else old.unionByName(new, allowMissingColumns=True)
            return [a.id for a in fits]
        chunks = [self._write(a, build(self.s, a, rows, check)) for a in fits]
        self.commit(add=[c for c in chunks if c["rows"]])
        return [a.id for a in fits]

    def _write(self, a: Aggregation, frame: DataFrame) -> dict:
        """A sorted run: rows in order of their keys, files of ``chunk_rows``. The manifest keeps the run's key bounds and counts,
        ``_bounds.json`` beside the files keeps each file's; both come from one pass over the keys."""
        name = f"chunks/{a.id}/{uuid.uuid4().hex}"
        path = f"{self.root}/{name}"
        frame.repartitionByRange(*a.dimensions).sortWithinPartitions(*a.dimensions).write.option("maxRecordsPerFile", a.chunk_rows).parquet(path)
        keys = [d for d in a.dimensions if self.s.dimensions[d] in PLAIN]
        text = lambda d: F.col(d).cast("string") if self.s.dimensions[d] == "date" else F.col(d)
        sides = [x for d in keys for x in (F.min(text(d)).alias(f"lo_{d}"), F.max(text(d)).alias(f"hi_{d}"), (F.count(d) < F.count("*")).alias(f"no_{d}"))]
        files = []
        for r in self.spark.read.parquet(path).groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n"), *sides).collect():  # a row per file
            files.append({"file": r["file"].rsplit("/", 1)[1], "rows": r["n"], "low": {d: r[f"lo_{d}"] for d in keys}, "high": {d: r[f"hi_{d}"] for d in keys}, "nulls": [d for d in keys if r[f"no_{d}"]]})
        Files(self.spark, path).write("_bounds.json", json.dumps(files))
        each = lambda f, side, d: f((x[side][d] for x in files if x[side][d] is not None), default=None)
        return {
            "aggregation": a.id, "path": name, "measures": list(a.measures), "rows": sum(x["rows"] for x in files),
            "low": {d: each(min, "low", d) for d in keys}, "high": {d: each(max, "high", d) for d in keys}, "nulls": sorted({d for x in files for d in x["nulls"]}),
        }

    def _pruned(self, where: Predicate, x: dict) -> bool:
        """Whether a run's or a file's bounds exclude ``where``."""
        typed = lambda side: {d: date.fromisoformat(v) if v is not None and self.s.dimensions[d] == "date" else v for d, v in side.items()}
        return x["rows"] == 0 or prunes(where, typed(x["low"]), typed(x["high"]), set(x.get("nulls", ())))

    def files(self, aggregation: str, where: Predicate = TRUE) -> list[str]:
        """The files that can hold rows of ``where``: of runs whose bounds allow it, those whose own bounds do."""
        out = []
        for c in self.chunks(aggregation):
            if not self._pruned(where, c):
                each = json.loads(Files(self.spark, f"{self.root}/{c['path']}").read("_bounds.json"))
                out += [f"{self.root}/{c['path']}/{x['file']}" for x in each if not self._pruned(where, x)]
        return out

    def commit(self, add: list[dict] = (), remove: list[str] = (), positions: dict | None = None) -> None:
        """One step from state to state; fails if a chunk to remove is gone, as another compaction was first."""

        def change(state: dict) -> dict:
            chunks = state.setdefault("chunks", [])
            there = {c["path"] for c in chunks}
            if lost := set(remove) - there:
                raise RuntimeError(f"chunks {sorted(lost)} were removed by another writer")
            state["chunks"] = [c for c in chunks if c["path"] not in set(remove)] + list(add)
            state.setdefault("positions", {}).update(positions or {})
            return state

        self.manifest.update(change)

    def chunks(self, aggregation: str | None = None) -> list[dict]:
        return [c for c in self.manifest.latest()[1].get("chunks", []) if aggregation in (None, c["aggregation"])]

    # reads
    def _frame(self, a: Aggregation, where: Predicate, columns: list[str]) -> DataFrame:
        if self.root is None:
            if a.id not in self._frames:
                return self.spark.createDataFrame([], ", ".join(f"{d} {self.s.dimensions[d]}" for d in a.dimensions)).select("*", *[F.lit(None).alias(m) for m in a.measures])
            frame = self._frames[a.id]
        else:
            paths = self.files(a.id, where)
            if not paths:  # nothing can match: the columns of any chunk, without rows
                every = [f"{self.root}/{c['path']}" for c in self.chunks(a.id)]
                if not every:
                    raise LookupError(f"aggregation {a.id} has no chunks")
                return self._with(self.spark.read.option("mergeSchema", "true").parquet(*every).limit(0), columns)
            frame = self.spark.read.option("mergeSchema", "true").parquet(*paths)
        return self._with(frame, columns)

    @staticmethod
    def _with(frame: DataFrame, columns: list[str]) -> DataFrame:
        for c in columns:  # chunks written before a measure was added
            if c not in frame.columns:
                frame = frame.withColumn(c, F.lit(None))
        return frame

    def plan(self, q: Query) -> Plan:
        if self.root is None:
            return plan(self.s, q)
        every = self.chunks()
        return plan(self.s, q, lambda a: sum(c["rows"] for c in every if c["aggregation"] == a), lambda a: sum(c["aggregation"] == a for c in every))

    def query(self, q: Query) -> Report:
        """Merge the chosen aggregations, evaluate computed measures, totals, attributes, HAVING, order and limits."""
        p = self.plan(q)
        measures = [m for m in q.measures if m not in p.dropped]
        report = Report(list(q.attributes), measures, dropped=p.dropped)
        if q.report == METADATA:
            return report
        dims = list(p.requested)
        merged = self._merged(p, dims)
        finished = self._finish(merged, dims, measures)
        if q.report == DATA_WITH_TOTALS:  # over all groups, before HAVING
            total = merged.agg(*[self.s.measures[m].merge(F.col(m)).alias(m) for m in p.stored])
            report.totals = self._finish(total, [], measures)
        out = self._attributes(finished, q.attributes, dict(p.constants))
        out = out.where(q.having.column()) if q.having != TRUE else out
        out = out.select(*[F.col(f"`{a}`") for a in q.attributes], *measures)
        if q.report == DATA_WITH_TOTALS:
            report.total_count = out.count()
        sort = []
        for o in q.orderings:
            name, _, how = o.partition(" ")
            if name in out.columns:  # others are ignored
                c = F.col(f"`{name}`")
                sort.append(c.desc_nulls_last() if how.strip().lower() == "desc" else c.asc_nulls_first())
        out = out.orderBy(*sort) if sort else out
        out = out.offset(q.offset) if q.offset else out
        report.rows = out.limit(q.limit) if q.limit is not None else out
        return report

    def _merged(self, p: Plan, dims: list[str]) -> DataFrame:
        parts = None
        for c in p.choices:
            frame = self._frame(c.aggregation, p.where, [*p.dimensions, *c.measures])
            frame = frame.where(p.where.column()) if p.where != TRUE else frame
            part = frame.select(*p.dimensions, *c.measures)
            parts = part if parts is None else parts.unionByName(part, allowMissingColumns=True)
        merged = _merge(self.s, parts, list(p.dimensions), list(p.stored))
        return merged if list(p.dimensions) == dims else _merge(self.s, merged, dims, list(p.stored))  # parents that are not shown

    def _finish(self, merged: DataFrame, dims: list[str], measures: list[str]) -> DataFrame:
        get = lambda m: self.s.measures[m].read(F.col(m))
        cols: list[Column] = [F.col(d) for d in dims]
        for m in measures:
            cols.append((get(m) if m in self.s.measures else self.s.computed[m].of(get)).alias(m))
        return merged.select(*cols)

    def _attributes(self, out: DataFrame, names: tuple[str, ...], constants: dict[str, tuple]) -> DataFrame:
        wanted: dict[str, list[str]] = {}
        for a in names:
            if a not in self.s.dimensions:
                base, _, column = a.partition(".")
                wanted.setdefault(base, []).append(column)
        for base, columns in wanted.items():
            attr = self.s.attributes[base]
            if base in constants:  # all keys are given: one row is looked up
                row = attr.table()
                for k, v in zip(attr.keys, constants[base]):
                    row = row.where(F.col(k) == F.lit(v))
                got = row.select(*columns).orderBy(*columns).first()
                kinds = row.select(*columns).schema
                out = out.withColumns({f"{base}.{c}": F.lit(got[c] if got else None).cast(kinds[c].dataType) for c in columns})
                continue
            plain = {c: f"__{i}" for i, c in enumerate(columns)}
            dim = attr.table().select(*attr.keys, *[F.col(c).alias(x) for c, x in plain.items()])
            dim = first_per_key(dim, list(attr.keys), list(plain.values()))
            out = attribute_join(out, dim, list(attr.keys)).withColumnsRenamed({x: f"{base}.{c}" for c, x in plain.items()})
        return out

    # upkeep
    def consolidate(self, aggregation: str, max_chunks: int = 1000, strategy: str = "min_key") -> int:
        """Merge runs into one and return how many. ``min_key``: those that overlap the one with the least key; ``hot``: those that
        overlap the one that most others overlap; ``size``: those that hold less than a full file, the smallest first."""
        a = self.s.aggregations[aggregation]
        every = sorted(self.chunks(aggregation), key=lambda c: (json.dumps([v for v in c["low"].values()], default=str), c["path"]))
        if strategy == "size":
            picked = sorted((c for c in every if c["rows"] < a.chunk_rows), key=lambda c: (c["rows"], c["path"]))
        elif every:
            seed = every[0] if strategy == "min_key" else max(every, key=lambda c: sum(_overlap(c, o) for o in every))
            picked = [c for c in every if _overlap(seed, c)]
        else:
            picked = []
        picked = picked[:max_chunks]
        if len(picked) < 2:
            return 0
        frames = self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.root}/{c['path']}" for c in picked])
        have = [m for m in a.measures if m in frames.columns]
        new = self._write(a, _merge(self.s, frames, list(a.dimensions), have))
        self.commit(add=[new], remove=[c["path"] for c in picked])
        return len(picked)

    @contextmanager
    def locked(self, aggregation: str, seconds: float = 3600) -> Iterator[bool]:
        """Whether this holder got the aggregation's lock, until the block ends; a lock older than ``seconds`` counts as left behind.

        Locks save wasted work; what keeps the state right is the manifest, which refuses to remove a chunk twice."""
        files, name = Files(self.spark, self.root), f"locks/{aggregation}"
        if name.split("/")[1] in files.names("locks") and time.time() - json.loads(files.read(name))["at"] > seconds:
            files.delete(name)
        got = files.create(name, json.dumps({"at": time.time()}))
        try:
            yield got
        finally:
            if got:
                files.delete(name)

    def maintain(self, max_chunks: int = 1000, keep: int = 10) -> dict[str, int]:
        """One round of upkeep: in each aggregation that is not locked merge small runs, then overlapping ones; then clean."""
        done = {}
        for a in self.s.aggregations:
            with self.locked(a) as got:
                if got:
                    done[a] = self.consolidate(a, max_chunks, "size") + self.consolidate(a, max_chunks, "hot")
        self.clean(keep)
        return done

    def backup(self, root: str) -> Cube:
        """The latest state and its chunks copied to ``root``."""
        there = Files(self.spark, root)
        _, state = self.manifest.latest()
        for c in state.get("chunks", []):
            there.write(f"{c['path']}/_copied", "")  # makes the folder
            for n in Files(self.spark, self.root).names(c["path"]):
                if not n.endswith(".crc"):
                    Files(self.spark, self.root).copy_to(f"{c['path']}/{n}", there, f"{c['path']}/{n}")
        out = Cube(self.spark, self.s, root)
        if not out.manifest.commit(0, state):
            raise RuntimeError(f"{root} holds a cube already")
        return out

    def irrelevant(self) -> list[dict]:
        """Chunks whose keys an aggregation's predicate excludes."""
        return [c for c in self.chunks() if self._pruned(self.s.predicate(self.s.aggregations[c["aggregation"]]), c)]

    def clean(self, keep: int = 1) -> list[str]:
        """Delete folders that neither the latest ``keep`` states nor a later one names."""
        latest, _ = self.manifest.latest()
        held = {c["path"] for r in range(max(1, latest - keep + 1), latest + 1) for c in self.manifest.at(r).get("chunks", [])}
        files, gone = Files(self.spark, self.root), []
        for a in files.names("chunks"):
            for name in files.names(f"chunks/{a}"):
                if f"chunks/{a}/{name}" not in held:
                    files.delete(f"chunks/{a}/{name}")
                    gone.append(f"chunks/{a}/{name}")
        return gone


def _overlap(a: dict, b: dict) -> bool:
    keys = set(a["low"]) & set(b["low"])
    return all(a["low"][k] is None or b["low"][k] is None or (a["low"][k] <= b["high"][k] and b["low"][k] <= a["high"][k]) for k in keys)
