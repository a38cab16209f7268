"""Quality classifier: random-indexing word vectors, pooled per document, under a two-layer network.

* Words (runs without ASCII white space, cut between letters and punctuation, A-Z in lower case) fall into
  ``BUCKETS`` hash buckets. Every bucket has a fixed sparse random index vector; its word vector is the sum of
  the index vectors of the words up to ``REACH`` places away over all documents, plus its own, scaled to unit
  length. The sums are made per task and added by range of buckets, so their size does not depend on the input.
* A document is the mean and the spread of its words' vectors and the logarithm of its length.
* The network (numpy, one hidden layer) is fitted to a bounded sample of labelled rows, ``SAMPLE`` at most, and its
  logits are divided by a temperature fitted on a part of the sample that the network has not seen.

Labels only teach rows whose crc32 of the id as text is not a multiple of ``HELD_OUT``; label, language, source and
id are never features. Defined cases: null and empty texts have the features of no words and are scored too; with
no usable label or only one class every score is that class's smoothed share (0.5 without any); a null id is
never learnt from and counts as held out; null labels are ignored, and of several labels of an id the smallest holds;
texts of any length are scored whole, in parts of a fixed number of words; an empty table gives no rows; other
columns are passed on, one with the name of an added column under that name with an underscore behind it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import apart, in_batches
from .packing import ALNUM, PUNCT
from .vectext import WHITE, chunks, word_hashes

BUCKETS, DIMS, NONZERO, REACH = 1 << 14, 32, 2, 2
HELD_OUT, SAMPLE, HIDDEN, THRESHOLD = 5, 20_000, 32, 0.3
RANGES = 16
#: Words worked on at a time, whatever a text's length.
PART = 1 << 16
#: The columns that the operator adds.
OWN = ["held_out", "score", "predicted"]


def index_vectors(seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(dimension, sign) of the nonzero entries of each bucket's index vector."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, DIMS, (BUCKETS, NONZERO)), rng.choice(np.array([-1.0, 1.0]), (BUCKETS, NONZERO))


def buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h, row = word_hashes(data, offsets, WHITE, PUNCT, ALNUM)
    return (h >> np.uint64(50)).astype(np.int64), row


def _contexts(batches):
    dims, signs = index_vectors()
    total = np.zeros(BUCKETS * DIMS)
    for b in batches:
        for _, _, data, offsets in chunks(b.column(0)):
            w, row = buckets(data, offsets)
            for away, at in ((d, a) for d in range(1, REACH + 1) for a in range(0, len(w) - d, PART)):
                x, y = w[at : at + PART], w[at + away : at + away + PART]
                same = row[at : at + len(y)] == row[at + away : at + away + PART]
                x, y = x[: len(y)][same], y[same]
                for one, other in ((x, y), (y, x)):
                    for k in range(NONZERO):
                        total += np.bincount(one * DIMS + dims[other, k], weights=signs[other, k], minlength=BUCKETS * DIMS)
    total = total.astype(np.float32)
    parts = [total[i * len(total) // RANGES : (i + 1) * len(total) // RANGES].tobytes() for i in range(RANGES)]
    yield pa.RecordBatch.from_arrays([pa.array(range(RANGES), pa.int32()), pa.array(parts, pa.binary())], names=["part", "sums"])


def _add(batches):
    now: dict[int, np.ndarray] = {}
    for b in batches:
        for p, s in zip(b.column(0).to_pylist(), b.column(1)):
            x = np.frombuffer(s.as_py(), np.float32).astype(np.float64)
            now[p] = now[p] + x if p in now else x
    yield pa.RecordBatch.from_arrays([pa.array(now, pa.int32()), pa.array([x.tobytes() for x in now.values()], pa.binary())], names=["part", "sums"])


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The BUCKETS x DIMS word vectors over all documents, a fixed 2 MB."""
    sums = in_batches(in_batches(docs.select(F.col(text_col).alias("text")), _contexts, "part int, sums binary").repartition(RANGES, "part"), _add, "part int, sums binary")
    v = np.zeros(BUCKETS * DIMS)
    for r in sums.collect():  # RANGES rows of fixed size
        a = r["part"] * len(v) // RANGES
        v[a : a + len(v) // RANGES] += np.frombuffer(r["sums"])
    v = v.reshape(BUCKETS, DIMS)
    dims, signs = index_vectors()
    own = np.zeros_like(v)
    for k in range(NONZERO):
        own[np.arange(BUCKETS), dims[:, k]] += signs[:, k]
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return unit(unit(v - v.mean(0)) + unit(own))


def pooled(col: pa.Array, v: np.ndarray) -> np.ndarray:
    """One row of features per text: mean and spread of its words' vectors, logarithm of its length."""
    parts = [np.zeros((0, 2 * DIMS + 1))]
    for i, j, data, offsets in chunks(col):
        w, row = buckets(data, offsets)
        n = np.bincount(row, minlength=j - i).astype(np.float64)
        out = np.zeros((j - i, 2 * DIMS + 1))
        for a in range(0, len(w), PART):
            got, r = v[w[a : a + PART]], row[a : a + PART]
            first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
            out[r[first], :DIMS] += np.add.reduceat(got, first, axis=0)
            out[r[first], DIMS:-1] += np.add.reduceat(got * got, first, axis=0)
        has = np.flatnonzero(n)
        out[has, :-1] /= n[has, None]
        out[has, DIMS:-1] = np.sqrt(np.maximum(out[has, DIMS:-1] - out[has, :DIMS] ** 2, 0))
        out[:, -1] = np.log1p(n)
        parts.append(out)
    return np.concatenate(parts)


def _features(vectors):
    def run(batches):
        for b in batches:
            x = pooled(b.column("text"), vectors.value)
            yield pa.RecordBatch.from_arrays([b.column("y"), b.column("h"), pa.array([r.tobytes() for r in x], pa.binary())], names=["y", "h", "features"])

    return run


class Network:
    """Two layers: tanh, then a logistic output whose logit is divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 11, epochs: int = 60, rate: float = 0.01):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        self.constant = None
        if len(set(y.tolist())) < 2:
            self.constant = float((y.sum() + 0.5) / (len(y) + 1))
            return
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(x))
        x, y = (x[order] - self.mean) / self.scale, y[order].astype(np.float64)
        cut = max(1, len(x) // 5)
        cx, cy, x, y = x[:cut], y[:cut], x[cut:], y[cut:]
        d = x.shape[1]
        p = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, s, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for epoch in range(epochs):
            for idx in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
                if not len(idx):
                    continue
                a, t = x[idx], y[idx]
                h = np.tanh(a @ p[0] + p[1])
                g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - t) / len(idx)
                gh = np.outer(g, p[2]) * (1 - h * h)
                step += 1
                for q, grad, mm, ss in zip(p, [a.T @ gh + 1e-4 * p[0], gh.sum(0), h.T @ g + 1e-4 * p[2], np.array([g.sum()])], m, s):
                    mm += 0.1 * (grad - mm)
                    ss += 0.001 * (grad * grad - ss)
                    q -= rate * (1 - epoch / epochs) * (mm / (1 - 0.9**step)) / (np.sqrt(ss / (1 - 0.999**step)) + 1e-8)
        self.p, self.temperature = p, 1.0
        z = self._logit(cx)
        loss = lambda t: np.mean(np.logaddexp(0, -z / t) + (1 - cy) * z / t)
        self.temperature = float(min(np.geomspace(0.25, 8, 60), key=loss))

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self._logit((x - self.mean) / self.scale) / self.temperature, -30, 30)))


def _nothing() -> Network:
    net = Network.__new__(Network)
    net.constant = 0.5
    return net


def _score(vectors, model):
    def run(batches):
        for b in batches:
            score = model.value.score(pooled(b.column("text"), vectors.value))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(score, pa.float64())], names=["row", "score"])

    return run


def learn_part(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % HELD_OUT


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``docs`` plus ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 if the score reaches the threshold)."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    vectors = spark.sparkContext.broadcast(word_vectors(slim))

    taught = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    taught = taught.where("y in (0, 1) and doc_id is not null").where(learn_part("doc_id") != 0).groupBy("doc_id").agg(F.min("y").alias("y"))
    taught = taught.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(SAMPLE)  # so at most SAMPLE rows are broadcast
    got = in_batches(slim.join(F.broadcast(taught), "doc_id").select("y", "h", "text"), _features(vectors), "y int, h long, features binary")
    sample = got.orderBy("h", "y", "features").limit(SAMPLE).collect()
    x = np.array([np.frombuffer(r["features"]) for r in sample]).reshape(-1, 2 * DIMS + 1)
    y = np.array([r["y"] for r in sample], np.int64)
    model = spark.sparkContext.broadcast(Network(x, y) if len(y) else _nothing())

    names = apart(docs.columns, OWN)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    out = in_batches(packed, _score(vectors, model), f"row {packed.schema['row'].dataType.simpleString()}, score double")
    held = F.coalesce(learn_part(f"row.{id_col}") == 0, F.lit(True))
    return out.select(*[F.col(f"row.`{c}`").alias(new) for c, new in names.items()], held.alias("held_out"), F.col("score"), (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
