"""Near-duplicate embeddings: spherical k-means cells and blocked cosine products.

Vectors are compared only within a label. Equal vectors collapse to one with a weight. Spherical k-means,
fitted to at most ``sample`` vectors, assigns every vector to its home cell; because a pair with cosine of
``threshold`` or more is at most sqrt(2 - 2 * threshold) apart, a vector also visits each cell whose border is no
further from it, so no link is lost between cells (of two cells the one with the larger number sees the
visitor, so every pair meets once). Cells are compared in blocks of ``block`` vectors, each pair of blocks as one
matrix product in double precision; a task holds two blocks and returns a number of links per vector and
a spanning forest, never the pairs.

Defined cases: a vector that is null, empty, zero or holds null or non-finite numbers, or whose label is
null, links with nothing and is its own component; vectors of different lengths do not link; rows that
repeat an id are separate rows; a null id counts as no id when the smallest is taken.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Scratch, components, in_batches, small


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """k unit centroids of the unit rows of ``x``."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        home = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), c)
    return c


def _rows(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cells(centroids, distance: float):
    """Each row once for its home and once for each cell with a larger number that it visits."""

    def run(batches):
        every = centroids.value
        for b in batches:
            out = []
            dims = np.array(b.column("dims").to_pylist())
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                part = b.take(pa.array(at))
                c = every.get(int(d))
                if c is None:
                    c = np.eye(1, int(d))
                gap = np.sqrt(np.maximum(2 - 2 * c @ c.T, 0)) * distance + 1e-9
                x = _rows(part.column("embedding"))
                near = x @ c.T
                home = np.argmax(near, axis=1)
                visit = near[np.arange(len(x)), home][:, None] - near <= gap[home]
                visit &= np.arange(len(c))[None, :] > home[:, None]
                r, v = np.nonzero(visit)
                row = np.concatenate([np.arange(len(x)), r])
                got = part.take(pa.array(row))
                out.append((got, np.concatenate([home, v]), np.concatenate([np.ones(len(x), bool), np.zeros(len(r), bool)])))
            for got, cell, is_home in out:
                yield pa.RecordBatch.from_arrays(
                    [got.column(n) for n in ("rid", "label", "dims", "weight", "embedding")] + [pa.array(cell.astype(np.int32)), pa.array(is_home)],
                    names=["rid", "label", "dims", "weight", "embedding", "cell", "home"],
                )

    return run


def _forest(link: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what ``link`` connects; a node's first partner, then the partners it adds."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out, seen = [], np.zeros(len(b), bool)
    for i in np.flatnonzero(link.any(1)).tolist():
        near = np.flatnonzero(link[i])
        fresh = near[~seen[near]]
        old = near[seen[near]]
        for j in [*fresh.tolist(), *old.tolist()]:
            x, y = find(int(a[i])), find(int(b[j]))
            if x != y:
                parent[x] = y
                out.append((int(a[i]), int(b[j])))
        seen[fresh] = True
    return out


def _compare(threshold: float):
    schema = ["a", "b", "n"]

    def solve(key, parts):
        if key is None:
            return [], [], []
        t = pa.Table.from_batches(parts)
        x, rid = _rows(t.column("embedding").combine_chunks()), t.column("rid").to_numpy()
        w, side = t.column("weight").to_numpy(), t.column("side").to_numpy()
        i, j = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = bool(t.column("same")[0].as_py())
        if same:
            j = i
        if not len(i) or not len(j):
            return [], [], []
        link = x[i] @ x[j].T >= threshold
        if same:
            np.fill_diagonal(link, False)
        left = link @ w[j]
        right = np.zeros(len(j)) if same else w[i] @ link
        forest = _forest(link, rid[i], rid[j])
        one, two = np.flatnonzero(left), np.flatnonzero(right)
        return (
            [x for x, _ in forest] + rid[i][one].tolist() + rid[j][two].tolist(),
            [y for _, y in forest] + [None] * (len(one) + len(two)),
            [0] * len(forest) + left[one].astype(int).tolist() + right[two].astype(int).tolist(),
        )

    def batch(got):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in got], names=schema)

    def run(batches):
        now, parts = None, []
        for b in batches:
            jobs = b.column("job").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(jobs[1:] != jobs[:-1]) + 1).tolist(), len(jobs)]
            for s, e in zip(cuts[:-1], cuts[1:]):
                if e > s:
                    if jobs[s] != now:
                        yield batch(solve(now, parts))
                        now, parts = jobs[s], []
                    parts.append(b.slice(s, e - s))
        yield batch(solve(now, parts))

    return run


def similar_embeddings(
    spark: SparkSession, vectors: DataFrame, threshold: float = 0.98, block: int = 1024, sample: int = 20_000, per_cell: int = 1000, max_cells: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of ``vectors``."""
    scratch = Scratch(spark, "embeddings")
    v = F.col("embedding")
    fine = (
        F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0)
        & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    )
    # what moves keeps single precision where the table has no more; cosines are of doubles in any case
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(kind).alias("embedding"))
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False))).withColumn("h1", F.xxhash64("label", "embedding")).withColumn("h2", F.xxhash64(F.lit(2), "embedding", "label"))
    rows = scratch.put(rows, "rows")
    reps = rows.where("fine").groupBy("h1", "h2").agg(F.min(F.struct("rid", "label", "embedding")).alias("r"), F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    reps = reps.select("h1", "h2", F.col("r.rid").alias("rid"), F.col("r.label").alias("label"), F.size("r.embedding").alias("dims"), "weight", "least", F.col("r.embedding").alias("embedding"))
    reps = scratch.put(reps, "reps")

    n = reps.count()
    centroids: dict[int, np.ndarray] = {}
    drawn = reps.select("dims", "embedding", F.xxhash64("rid").alias("h")).orderBy("h").limit(sample).collect()  # bounded by ``sample``
    by_dims: dict[int, list] = {}
    for r in drawn:
        by_dims.setdefault(r["dims"], []).append(r["embedding"])
    for d, xs in by_dims.items():
        x = np.array(xs, np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        centroids[d] = spherical_kmeans(x, max(1, min(max_cells, len(x), math.ceil(n / per_cell))))
    distance = math.sqrt(max(0.0, 2 - 2 * threshold))
    placed = in_batches(
        reps.select("rid", "label", "dims", "weight", "embedding"), _cells(spark.sparkContext.broadcast(centroids), distance), f"rid long, label string, dims int, weight long, embedding {kind}, cell int, home boolean"
    )
    placed = scratch.put(placed, "cells")
    sizes = placed.groupBy("label", "dims", "cell").agg(F.sum(F.col("home").cast("int")).alias("homes"), F.sum((~F.col("home")).cast("int")).alias("visits"))
    sizes = sizes.select("label", "dims", "cell", F.ceil(F.col("homes") / block).cast("int").alias("nh"), F.ceil(F.col("visits") / block).cast("int").alias("nv")).where("nh > 0")
    dealt = placed.join(small(scratch.put(sizes, "sizes"), 200_000), ["label", "dims", "cell"])
    own = F.pmod(F.xxhash64("rid", "cell"), F.when(F.col("home"), F.col("nh")).otherwise(F.col("nv"))).cast("int")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    job = lambda kind, i, j: F.concat_ws("|", "label", "dims", "cell", F.lit(kind), i, j)
    dealt = dealt.withColumn("own", own)
    at_home = F.concat(
        F.transform(upto(F.col("nh")), lambda o: F.struct(job("h", F.least("own", o), F.greatest("own", o)).alias("job"), (F.col("own") > o).cast("int").alias("side"), (F.col("own") == o).alias("same"))),
        F.transform(upto(F.col("nv")), lambda o: F.struct(job("v", F.col("own"), o).alias("job"), F.lit(0).alias("side"), F.lit(False).alias("same"))),
    )
    away = F.transform(upto(F.col("nh")), lambda o: F.struct(job("v", o, F.col("own")).alias("job"), F.lit(1).alias("side"), F.lit(False).alias("same")))
    jobs = dealt.select("rid", "weight", "embedding", F.explode(F.when(F.col("home"), at_home).otherwise(away)).alias("x")).select("x.job", "x.side", "x.same", "rid", "weight", "embedding")
    found = scratch.put(in_batches(jobs.repartition("job").sortWithinPartitions("job"), _compare(threshold), "a long, b long, n long", 10_000), "found")
    labels = components(scratch, found.where("b is not null").select("a", "b"))
    counts = found.where("b is null").groupBy(F.col("a").alias("rid")).agg(F.sum("n").alias("n"))
    known = reps.select("h1", "h2", "rid", "weight", "least").join(counts, "rid", "left").join(labels.withColumnRenamed("node", "rid"), "rid", "left")
    known = known.withColumn("comp", F.coalesce("label", "rid"))
    firsts = known.groupBy("comp").agg(F.min("least").alias("component_id"))
    by_key = scratch.put(known.join(firsts, "comp").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"), "known")
    out = rows.select("vec_id", "fine", "h1", "h2").join(by_key.withColumn("fine", F.lit(True)), ["h1", "h2", "fine"], "left")
    comp = F.when(F.col("fine"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
