"""Language-model scores by stupid backoff, computed relationally.

Each document is scored by bigrams counted over all *other* documents: own counts are taken off the totals, so
text that only this document holds backs off instead of vouching for itself.

* n-grams: documents are dealt into chunks by a hash of their ids; a chunk's distinct bigrams and words, each with its
  count there, go out as sorted arrays, one row for each of BUCKETS ranges of hashes, so that no row holds one key alone.
* Count tables: a range's rows meet in one task, which sums each key over all chunks. A very common key is one entry a chunk.
* Scores: the join of counts with their chunk answers each array in its own order; the chunk's documents are read again, and
  the same sort puts every token beside its counts. A bigram seen elsewhere contributes log(c(a b) / c(a)); else
  log(backoff * c(b) / N); a word seen nowhere else counts as ``unseen`` occurrences. Sums per document give the mean.

Ranges of hashes are asked in ``slices`` passes over the texts; the shuffles of one are released before the next, so the disk needed
at a time is a fraction of all keys. Two passes are made, and one more for every SLICE_BYTES of text, which bounds a range's
arrays. Words are runs without ASCII white space, A-Z in lower case; every document starts with a boundary word.

Defined cases: null and word-free texts have no tokens and a null score; rows that repeat an id with equal text
are one document to the model (their counts are taken off together) and have the same score; an empty table
gives no rows; very long texts are scored whole (a text is never cut over chunks, so the longest bounds a worker's memory); other
columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Scratch, in_batches
from .vectext import WHITE, chunks, word_hashes

BOUNDARY = np.uint64(0x5DEECE66D1234567)
#: Bytes of text in a chunk, chunks at least (fewer for little text), and bytes of text for each pass over the ranges of hashes.
CHUNK_BYTES, CHUNKS, SLICE_BYTES = 8 << 20, 32, 1 << 38
#: Ranges of the hashes of bigrams and, numbered after these, of words; powers of 2.
BUCKETS, WORD_BUCKETS = 1024, 256
#: The row numbers of what is no range: a chunk's tokens and documents with words, and its texts.
TOTAL, TEXT = 1 << 20, 1 << 21
#: Counts from FREQUENT - 1 on are kept in a second array, the others in two bytes.
FREQUENT = 1 << 16


def _follow(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For words by place: the bigram's hash with the word before, and whether the word is its document's first."""
    first = np.concatenate(([True], row[1:] != row[:-1]))
    a = np.concatenate(([BOUNDARY], h[:-1]))
    a[first] = BOUNDARY
    return ((a << np.uint64(1)) | (a >> np.uint64(63))) ^ h, first


def _sorted(keys: np.ndarray, known: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, keys in it, whether each differs from the one before): equal keys by place. All share their first ``known`` bits.

    Places stand in the low bits of the numbers sorted, which is faster than a sort of places; keys that differ only in the
    bits so lost show as a descent and are sorted by themselves."""
    low = np.uint64(max(len(keys) - 1, 1).bit_length())
    packed = ((keys << np.uint64(known)) >> low << low) | np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    order = (packed & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    out = keys[order]
    if (out[1:] < out[:-1]).any():
        order = np.argsort(keys, kind="stable")
        out = keys[order]
    new = np.ones(len(out), bool)
    np.not_equal(out[1:], out[:-1], out=new[1:])
    return order, out, new


def _runs(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run of each place, length of each run) where ``new`` marks the starts."""
    return np.cumsum(new) - 1, np.diff(np.append(np.flatnonzero(new), len(new)))


def _blobs(x: np.ndarray, at: np.ndarray) -> pa.Array:
    """The bytes of x[at[0]:at[1]], x[at[1]:at[2]], ..."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * x.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])


def _short(c: np.ndarray, at: np.ndarray, frequent: int) -> tuple[pa.Array, pa.Array]:
    """Counts, cut at ``at``, as two binary columns."""
    wide = c >= frequent - 1
    return _blobs(np.minimum(c, frequent - 1).astype(np.uint16), at), _blobs(c[wide].astype(np.int64), np.concatenate(([0], np.cumsum(wide)))[at])


def _counts(low: list, high: list, frequent: int) -> np.ndarray:
    """Counts from such columns' values, one after the other."""
    short = np.frombuffer(b"".join(low), np.uint16)
    out = short.astype(np.int64)
    out[short == frequent - 1] = np.frombuffer(b"".join(high), np.int64)
    return out


def _by(column: str, batches) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(value, rows) of runs of equal values of ``column``."""
    for batch in batches:
        v = batch.column(column).to_numpy()
        cuts = [0, *(np.flatnonzero(v[1:] != v[:-1]) + 1).tolist(), len(v)] if len(v) else [0]
        for i, j in zip(cuts, cuts[1:]):
            yield int(v[i]), batch.slice(i, j - i)


def _asks(batches, share: tuple[int, int], frequent: int):
    """Rows (chunk, bucket, keys, low, high): a chunk's distinct bigrams and words by ranges, of those the ``share`` (k, of), and its
    TOTAL; a text counts ``m`` times."""

    def asked(chunk, hashes, rows, copies):
        h, row, m = np.concatenate(hashes), np.concatenate(rows), np.concatenate(copies)
        g, first = _follow(h, row)
        weighted = m.max() > 1
        k, of = share
        for keys, buckets, base in ((g, BUCKETS, 0), (h, WORD_BUCKETS, BUCKETS)):
            bits = np.uint64(65 - buckets.bit_length())
            edges = np.arange(k * buckets // of, (k + 1) * buckets // of + 1)
            b = keys >> bits
            mine = (b >= edges[0]) & (b < edges[-1])
            if weighted:
                order, out, new = _sorted(keys[mine])
                keys, c = out[new], np.add.reduceat(m[row[mine]][order], np.flatnonzero(new)) if len(out) else np.zeros(0, np.int64)
            else:
                keys, c = np.unique(keys[mine] if of > 1 else keys, return_counts=True)
            at = np.append(0, np.cumsum(np.bincount((keys >> bits).astype(np.int64) - edges[0], minlength=len(edges) - 1)))
            yield _asked(chunk, edges[:-1] + base, _blobs(keys, at), *_short(c, at, frequent), np.diff(at) > 0)
        if not k:
            none = pa.array([b""], pa.binary())
            yield _asked(chunk, np.array([TOTAL]), none, none, pa.array([np.array([m[row].sum(), m[row[first]].sum()], np.int64).tobytes()], pa.binary()), np.ones(1, bool))

    now, n, hashes, rows, copies = None, 0, [], [], []
    for chunk, part in _by("chunk", batches):
        if chunk != now:
            if hashes:
                yield from asked(now, hashes, rows, copies)
            now, n, hashes, rows, copies = chunk, 0, [], [], []
        copies.append(part.column("m").to_numpy())
        for i, _, data, offsets in chunks(part.column("text")):
            h, row = word_hashes(data, offsets, WHITE)
            if len(h):
                hashes.append(h)
                rows.append(row + (n + i))
        n += len(part)
    if hashes:
        yield from asked(now, hashes, rows, copies)


def _asked(chunk: int, bucket: np.ndarray, keys: pa.Array, low: pa.Array, high: pa.Array, keep: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(np.full(len(bucket), chunk, np.int32)), pa.array(bucket.astype(np.int32)), keys, low, high]
    return pa.RecordBatch.from_arrays(columns, names=["chunk", "bucket", "keys", "low", "high"]).filter(pa.array(keep))


def _answers(batches, frequent: int):
    """Rows (chunk, bucket, low, high): for each array of keys their counts over all chunks, in its order; all TOTALs as those of chunk -1."""

    def answered(bucket, parts):
        asked = pa.Table.from_batches(parts).combine_chunks()
        chunk, keys, low, high = (asked.column(c) for c in ("chunk", "keys", "low", "high"))
        high = high.to_pylist()
        if bucket == TOTAL:
            total = np.frombuffer(b"".join(high), np.int64).reshape(-1, 2).sum(0)
            low, high, chunk = pa.array([b""], pa.binary()), pa.array([total.tobytes()], pa.binary()), pa.array([-1], pa.int32())
        else:
            keys = keys.to_pylist()
            at = np.append(0, np.cumsum([len(k) // 8 for k in keys]))
            order, _, new = _sorted(np.frombuffer(b"".join(keys), np.uint64), min(BUCKETS, WORD_BUCKETS).bit_length() - 1)
            c = _counts(low.to_pylist(), high, frequent)[order]
            out = np.empty(len(order), np.int64)
            out[order] = np.add.reduceat(c, np.flatnonzero(new))[np.cumsum(new) - 1]
            low, high = _short(out, at, frequent)
            chunk = chunk.combine_chunks()
        return pa.RecordBatch.from_arrays([chunk, pa.array(np.full(len(chunk), bucket, np.int32)), low, high], names=["chunk", "bucket", "low", "high"])

    now, parts = None, []
    for bucket, part in _by("bucket", batches):
        if bucket != now and parts:
            yield answered(now, parts)
            parts = []
        now = bucket
        parts.append(part)
    if parts:
        yield answered(now, parts)


def _scores(batches, total: int, documents: int, backoff: float, unseen: float, frequent: int):
    """Rows (doc_id, tf, n_tokens, n_seen, score), from a chunk's answers, in the order of their buckets, and then its texts."""

    def others(keys, row, m, low, high):
        """For each token how often other documents have its key."""
        order, _, new = _sorted(keys)
        run, _ = _runs(new)
        counts = _counts(low, high, frequent)
        if len(counts) != run[-1] + 1:
            raise ValueError(f"{len(counts)} counts for {run[-1] + 1} keys: the texts are not those that were counted")
        r = row[order]
        new[1:] |= r[1:] != r[:-1]
        own, n = _runs(new)
        out = np.empty(len(keys), np.int64)
        out[order] = counts[run] - n[own] * m[r]
        return out

    def scored(ids, tf, copies, hashes, rows, answers):
        m = np.concatenate(copies)
        t, v, s = np.zeros(len(m), np.int64), np.zeros(len(m), np.int64), np.zeros(len(m))
        if hashes:
            h, row = np.concatenate(hashes), np.concatenate(rows)
            g, first = _follow(h, row)
            pair = others(g, row, m, *answers[0])
            b = others(h, row, m, *answers[1])
            a = np.concatenate(([0], b[:-1]))
            a[first] = documents - m[row[first]]
            seen = pair > 0
            up, down = np.where(seen, pair, backoff * np.maximum(b, unseen)), np.where(seen, np.maximum(a, pair), total)
            t, v, s = np.bincount(row, minlength=len(m)), np.bincount(row[seen], minlength=len(m)), np.bincount(row, np.log(up / down), len(m))
        score = pa.array(s / np.maximum(t, 1), mask=t == 0)
        columns = [pa.concat_arrays(ids), pa.concat_arrays(tf), pa.array(t.astype(np.int64)), pa.array(v.astype(np.int64)), score]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "tf", "n_tokens", "n_seen", "score"])

    now, n = None, 0
    for chunk, part in _by("chunk", batches):
        if chunk != now:
            if n:
                yield scored(ids, tf, copies, hashes, rows, answers)
            now, n, ids, tf, copies, hashes, rows, answers = chunk, 0, [], [], [], [], [], (([], []), ([], []))
        for bucket, some in _by("bucket", [part]):
            data = some.column("data")
            if bucket != TEXT:
                low, high = answers[bucket >= BUCKETS]
                low.extend(data.to_pylist())
                high.extend(some.column("high").to_pylist())
                continue
            ids.append(some.column("doc_id"))
            tf.append(some.column("tf"))
            copies.append(some.column("m").to_numpy())
            for i, _, text, offsets in chunks(data):
                h, row = word_hashes(text, offsets, WHITE)
                if len(h):
                    hashes.append(h)
                    rows.append(row + (n + i))
            n += len(some)
    if n:
        yield scored(ids, tf, copies, hashes, rows, answers)


def lm_scores(spark: SparkSession, docs: DataFrame, backoff: float = 0.4, unseen: float = 0.5, slices: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_seen, score): tokens, tokens whose bigram another document has, and the mean log score."""
    scratch, frequent = Scratch(spark, "lm"), FREQUENT
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    repeated = ids.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").limit(1).count() > 0
    tf = F.xxhash64(text_col) if repeated else F.lit(0).cast("long")  # texts tell rows apart only where ids do not
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(-(-size // CHUNK_BYTES), min(CHUNKS, 1 + size // 4096))
    slices = slices or 2 + size // SLICE_BYTES
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), tf.alias("tf"), F.col(text_col).alias("text"))
    one = F.lit(1).cast("long")
    if repeated:  # equal rows go once, with their number
        copies = scratch.put(slim.groupBy("doc_id", "tf").agg(F.count("*").alias("m")).where("m > 1").toDF("d", "t", "m"), "copies")
        marked = slim.join(copies, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tf") == F.col("t")), "left").drop("d", "t")
        many = scratch.put(marked.where("m > 1").groupBy("doc_id", "tf", "m").agg(F.first("text").alias("text")), "many")
        each = marked.where("m is null").withColumn("m", one).unionByName(many)
    else:
        each = slim.withColumn("m", one)
    each = each.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "tf"), F.lit(n)).cast("int"))
    answers = []
    for k in range(slices):
        texts = each.where("text is not null").select("chunk", "m", "text").repartition("chunk").sortWithinPartitions("chunk")
        asks = in_batches(texts, partial(_asks, share=(k, slices), frequent=frequent), "chunk int, bucket int, keys binary, low binary, high binary")
        asks = asks.repartition("bucket").sortWithinPartitions("bucket")
        answers.append(scratch.put(in_batches(asks, partial(_answers, frequent=frequent), "chunk int, bucket int, low binary, high binary"), f"answers{k}"))
        del texts, asks
        scratch.release()
    whole = answers[0].where("chunk = -1").select("high").first()
    total, documents = np.frombuffer(whole[0], np.int64).tolist() if whole else (0, 0)
    none = {c: F.lit(None).cast(kind).alias(c) for c, kind in (("doc_id", "long"), ("tf", "long"), ("m", "long"), ("high", "binary"))}
    rows = each.select("chunk", F.lit(TEXT).alias("bucket"), "doc_id", "tf", "m", F.col("text").cast("binary").alias("data"), none["high"])
    for part in answers:
        rows = rows.unionByName(part.where("chunk >= 0").select("chunk", "bucket", none["doc_id"], none["tf"], none["m"], F.col("low").alias("data"), "high"))
    rows = rows.repartition("chunk").sortWithinPartitions("chunk", "bucket")
    score = partial(_scores, total=total, documents=documents, backoff=backoff, unseen=unseen, frequent=frequent)
    out = scratch.put(in_batches(rows, score, "doc_id long, tf long, n_tokens long, n_seen long, score double"), "scores")
    scratch.drop(*answers)
    if repeated:
        at = out.withColumnsRenamed({"doc_id": "d", "tf": "t"})
        out = slim.select("doc_id", "tf").join(at, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tf") == F.col("t")))
    return out.select("doc_id", "n_tokens", "n_seen", "score")
