"""Reversible line deduplication: sharded cuckoo filters in front of exact reference counts.

State, sharded by a line key's hash:

* ``refs``, a log of tables (shard, k1, k2, doc_id, tf, lines) in folders by shard: which documents hold a line and
  where. An insert appends one table; a delete appends the ids of its documents to ``gone``. Nothing is rewritten.
* ``filters``, a log of tables (shard, version, n_keys, cuckoo), of which the newest row of a shard holds: one
  cuckoo filter, which answers "never seen" without reading the exact tables and, unlike a Bloom filter, lets
  keys be deleted. Only shards that change get a new row; a filter that fills up is built anew, larger, from its
  shard's exact table.
* ``suspects``, a log of (shard, k1): keys of which a filter said "seen" when a document came in. A key that no
  filter ever suspected is held by one document alone, so the exact tables are read for suspects only.

Inserting documents asks each key's filter first. Keys that it has never seen are new; for its hits the exact
tables of the shards concerned decide. Deleting documents takes their references away; a key leaves its
filter with its last reference, so a line comes back as soon as the document that owned it goes.

A line's key is the line without ASCII white space at both ends, A-Z in lower case. Keys of at least
``min_chars`` code points that ``min_docs`` documents hold lose all their lines except in the smallest
doc_id that holds them. Keys are compared by 128 bits of hash.

Defined cases: null and empty texts are one empty line and stay as they are ('' for null); rows that repeat
an id are one document, whose rows do not drop each other's lines; a null id sorts after all others; very long
texts and lines are worked on whole; an empty table gives no rows; other columns are passed on, one named ``n_lines`` or
``n_dropped`` as ``n_lines_`` or ``n_dropped_``.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import Scratch, apart, in_batches
from .vectext import mix

STRIP = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The columns that the operator adds.
OWN = ["n_lines", "n_dropped"]
#: Input bytes for a shard, and the load above which a filter is built anew.
SHARD_BYTES, FULL = 64 << 20, 0.8


class Cuckoo:
    """A cuckoo filter with buckets of four 16-bit fingerprints; what finds no place goes to an exact overflow set."""

    SLOTS, KICKS = 4, 64

    def __init__(self, capacity: int):
        self.n = 1 << max(2, int(np.ceil(np.log2(max(1, capacity) / (self.SLOTS * 0.6)))))
        self.table = np.zeros((self.n, self.SLOTS), np.uint16)
        self.over: set[int] = set()

    def _of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        u = mix(keys.view(np.uint64))  # a shard's keys agree in some bits
        tag = ((u >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)
        a = (u & np.uint64(self.n - 1)).astype(np.int64)
        return tag, a, self._other(a, tag)

    def _other(self, at, tag):
        return (at ^ (tag.astype(np.int64) * 0x5BD1E995)) & (self.n - 1)

    def load(self, more: int = 0) -> float:
        return (np.count_nonzero(self.table) + len(self.over) + more) / self.table.size

    def holds(self, keys: np.ndarray) -> np.ndarray:
        tag, a, b = self._of(keys)
        found = (self.table[a] == tag[:, None]).any(1) | (self.table[b] == tag[:, None]).any(1)
        if self.over:
            found |= np.isin(keys, np.fromiter(self.over, np.int64, len(self.over)))
        return found

    def insert(self, keys: np.ndarray) -> None:
        """Add distinct keys: in bulk where a bucket has room, by kicking where it has none."""
        tag, a, b = self._of(keys)
        left = np.arange(len(keys))
        winner = np.empty(self.n, np.int64)
        for at in (a, b):
            for slot in range(self.SLOTS):
                free = left[self.table[at[left], slot] == 0]
                winner[at[free]] = free  # of keys that want one place the last is put there
                put = free[winner[at[free]] == free]
                self.table[at[put], slot] = tag[put]
                done = np.zeros(len(keys), bool)
                done[put] = True
                left = left[~done[left]]
        for i in left.tolist():
            self._kick(int(keys[i]), tag[i], int(a[i]))

    def _kick(self, key: int, tag: np.uint16, at: int) -> None:
        path = []
        for k in range(self.KICKS):
            empty = np.flatnonzero(self.table[at] == 0)
            if len(empty):
                self.table[at, empty[0]] = tag
                return
            slot = k % self.SLOTS
            path.append((at, slot))
            tag, self.table[at, slot] = self.table[at, slot], tag
            at = int(self._other(np.int64(at), np.asarray(tag)))
        for at, slot in reversed(path):  # undo, so that no other key loses its place
            tag, self.table[at, slot] = self.table[at, slot], tag
        self.over.add(key)

    def delete(self, keys: np.ndarray) -> None:
        tag, a, b = self._of(keys)
        for i, key in enumerate(keys.tolist()):
            if key in self.over:
                self.over.discard(key)
                continue
            for at in (a[i], b[i]):
                hit = np.flatnonzero(self.table[at] == tag[i])
                if len(hit):
                    self.table[at, hit[0]] = 0
                    break

    def to_bytes(self) -> bytes:
        return np.int64(self.n).tobytes() + self.table.tobytes() + np.fromiter(self.over, np.int64, len(self.over)).tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Cuckoo:
        out = cls.__new__(cls)
        out.n = int(np.frombuffer(raw[:8], np.int64)[0])
        end = 8 + out.n * cls.SLOTS * 2
        out.table = np.frombuffer(raw[8:end], np.uint16).reshape(out.n, cls.SLOTS).copy()
        out.over = set(np.frombuffer(raw[end:], np.int64).tolist())
        return out


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(STRIP)), UPPER, LOWER)


def line_refs(docs: DataFrame, shards: int, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(shard, k1, k2, doc_id, tf, line): one row per line whose key is long enough; tf tells rows that share an id apart."""
    lines = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tf"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line", "raw"))
    keyed = lines.select("doc_id", "tf", "line", line_key(F.col("raw")).alias("key")).where(F.char_length("key") >= min_chars)
    return keyed.select("doc_id", "tf", "line", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit("k2"), "key").alias("k2")).withColumn("shard", F.pmod("k1", F.lit(shards)).cast("int"))


def _tally(batches):
    """(shard, k1, several): each batch's keys once, and whether it has them more than once."""
    for b in batches:
        k, at, n = np.unique(b.column("k1").to_numpy(), return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([b.column("shard").take(pa.array(at)), pa.array(k), pa.array(n > 1)], names=["shard", "k1", "several"])


def _build(version: int):
    """Over (shard, k1, several) sorted by shard: a row with the filter of each shard's keys, and a row for each key
    that was there already when it came."""
    names = ["shard", "version", "n_keys", "cuckoo", "k1"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64()]

    def grown(c: Cuckoo | None, every: list[np.ndarray], fresh: int) -> Cuckoo:
        if c is not None and c.load(fresh) <= FULL:
            return c
        keys = np.concatenate(every) if every else np.zeros(0, np.int64)
        out = Cuckoo(2 * (len(keys) + fresh))
        out.insert(keys)
        return out

    def run(batches):
        now, c, every, n = None, None, [], 0

        def done():
            if now is not None:
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((now, version, n, c.to_bytes(), None), kinds)], names=names)

        for b in batches:
            shards, keys, several = b.column("shard").to_numpy(), b.column("k1").to_numpy(), b.column("several").to_numpy(zero_copy_only=False)
            for s in np.unique(shards):
                if s != now:
                    yield from done()
                    now, c, every, n = int(s), None, [], 0
                k, at, count = np.unique(keys[shards == s], return_index=True, return_counts=True)
                more = count > 1
                np.logical_or.at(more, np.searchsorted(k, keys[shards == s]), several[shards == s])
                known = c.holds(k) if c is not None else np.zeros(len(k), bool)
                # what the filter may take for seen is looked for among the keys, so that each is put in once
                if known.any():
                    there = np.concatenate([x[np.isin(x, k[known])] for x in every])
                    fresh = k[~known | ~np.isin(k, there)]
                else:
                    fresh = k
                c = grown(c, every, len(fresh))
                c.insert(fresh)
                every.append(fresh)
                n += len(fresh)
                hit = k[known | more]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), now, np.int32)), *(pa.nulls(len(hit), t) for t in kinds[1:4]), pa.array(hit)], names=names)
        yield from done()

    return run


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


class LineIndex:
    """The state; ``insert`` and ``delete`` return a new one that shares the tables of the old, which stays readable."""

    def __init__(self, scratch: Scratch, shards: int, min_chars: int, cols: dict, version: int = 0, refs=(), gone=(), filters=(), suspects=()):
        self.scratch, self.shards, self.min_chars, self.cols, self.version = scratch, shards, min_chars, cols, version
        self._refs, self._gone, self._filters, self._suspects = [*refs], [*gone], [*filters], [*suspects]

    @classmethod
    def create(cls, spark: SparkSession, docs: DataFrame, shards: int | None = None, min_chars: int = 10, **cols) -> LineIndex:
        empty = cls(Scratch(spark, "line-dedup"), shards or _shards(spark, docs), min_chars, cols)
        refs = empty._written(docs)
        tally = in_batches(refs.select("shard", "k1"), _tally, "shard int, k1 long, several boolean", 100_000)
        built = in_batches(tally.repartition("shard").sortWithinPartitions("shard"), _build(1), "shard int, version int, n_keys long, cuckoo binary, k1 long", 100_000)
        built = empty.scratch.put(built, "filters")
        return empty._next(refs=refs, filters=built.where("k1 is null").drop("k1"), suspects=built.where("k1 is not null").select("shard", "k1"))

    def _next(self, **tables: DataFrame) -> LineIndex:
        log = {k: getattr(self, f"_{k}") + ([tables[k]] if k in tables else []) for k in ("refs", "gone", "filters", "suspects")}
        return LineIndex(self.scratch, self.shards, self.min_chars, self.cols, self.version + 1, **log)

    def _written(self, docs: DataFrame) -> DataFrame:
        """The references of ``docs`` as a table in folders by shard; a shard's rows are dealt to tasks by document too."""
        found = line_refs(docs, self.shards, self.min_chars, **self.cols).withColumn("deal", F.pmod(F.xxhash64("doc_id"), F.lit(8)))
        refs = found.repartition("shard", "deal").groupBy("shard", "deal", "k1", "k2", "doc_id", "tf").agg(F.collect_list("line").alias("lines"))
        refs = refs.select("k1", "k2", "doc_id", "tf", "lines", F.lit(self.version + 1).alias("version"), "shard")
        return self.scratch.put(refs, "refs", ["shard"])

    @property
    def refs(self) -> DataFrame:
        """The references that hold: those of documents not deleted after they came."""
        every = _union(self._refs)
        if not self._gone:
            return every
        gone = _union(self._gone).groupBy(F.col("doc_id").alias("id_")).agg(F.max("version").alias("until"))
        return every.join(gone, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("version") <= F.col("until")), "left_anti")

    @property
    def filters(self) -> DataFrame:
        """(shard, version, n_keys, cuckoo): the newest of each shard."""
        if len(self._filters) == 1:
            return self._filters[0]
        newest = _union(self._filters).groupBy("shard").agg(F.max_by(F.struct("version", "n_keys", "cuckoo"), "version").alias("x"))
        return newest.select("shard", "x.version", "x.n_keys", "x.cuckoo")

    def _of_shards(self, table: DataFrame, keys: DataFrame) -> DataFrame:
        """Rows of ``table`` in the shards of ``keys``; at most ``shards`` numbers come to the driver."""
        at = [r["shard"] for r in keys.select("shard").distinct().collect()]
        return table if len(at) == self.shards else table.where(F.col("shard").isin(at))

    def _asked(self, rows: DataFrame, deal: str) -> DataFrame:
        """``rows`` (shard, k1, ...) plus ``maybe``: false if the shard's filter has never seen the key."""

        def ask(left: pa.Table, right: pa.Table) -> pa.Table:
            held = np.zeros(left.num_rows, bool)
            if right.num_rows and left.num_rows:
                held = Cuckoo.from_bytes(right.column("cuckoo")[0].as_py()).holds(left.column("k1").to_numpy())
            return left.append_column("maybe", pa.array(held, pa.bool_()))

        salted = rows.withColumn("salt", F.pmod(F.xxhash64(deal), F.lit(8)).cast("int"))
        filters = self.filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(7))))
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in salted.schema.fields) + ", maybe boolean"
        return salted.groupBy("shard", "salt").cogroup(filters.groupBy("shard", "salt")).applyInArrow(ask, schema).drop("salt")

    def seen(self, docs: DataFrame) -> DataFrame:
        """Lines of new documents whose key the index holds: the shard's filter first, the exact tables for its hits."""
        maybe = self._asked(line_refs(docs, self.shards, self.min_chars, **self.cols), "doc_id").where("maybe").drop("maybe")
        return maybe.join(self.refs.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi")

    def insert(self, docs: DataFrame) -> LineIndex:
        """Add documents; a key the shard's filter has never seen is new, the exact tables are read for the filter's hits."""
        new = self._written(docs)
        tally = in_batches(new.select("shard", "k1"), _tally, "shard int, k1 long, several boolean", 100_000)
        keys = tally.groupBy("shard", "k1").agg((F.max("several") | (F.count("*") > 1)).alias("several"))
        asked = self.scratch.put(self._asked(keys, "k1"), "asked")
        hits = asked.where("maybe").select("shard", "k1")
        exact = self._of_shards(self.refs, hits).select("shard", "k1")
        fresh = asked.where("not maybe").select("shard", "k1").unionByName(hits.join(exact, ["shard", "k1"], "left_anti"))
        suspects = self.scratch.put(asked.where("maybe or several").select("shard", "k1"), "suspects")
        return self._next(refs=new, suspects=suspects, filters=self._changed(self.scratch.put(fresh, "fresh"), "insert"))

    def delete(self, docs: DataFrame) -> LineIndex:
        """Take documents away by id; keys go with their last reference. With the texts that were inserted, only the shards of
        their lines are read; with ids alone, the exact tables are searched for them."""
        key, text = self.cols.get("id_col", "doc_id"), self.cols.get("text_col", "text")
        ids = docs.select(F.col(key).cast("long").alias("doc_id")).distinct()
        gone = self.scratch.put(ids.withColumn("version", F.lit(self.version)), "gone")
        if text in docs.columns:
            held = line_refs(docs, self.shards, self.min_chars, **self.cols).select("shard", "k1")
        else:
            known = gone.select(F.col("doc_id").alias("id_"))
            held = self.refs.join(known, F.col("doc_id").eqNullSafe(F.col("id_")), "left_semi").select("shard", "k1")
        held = self.scratch.put(held.distinct(), "held")
        # a text that was never inserted has no key to lose
        held = held.join(self._of_shards(self.refs, held).select("shard", "k1"), ["shard", "k1"], "left_semi")
        after = self._next(gone=gone)
        lost = held.join(after._of_shards(after.refs, held).select("shard", "k1"), ["shard", "k1"], "left_anti")
        after._filters.append(self._changed(self.scratch.put(lost, "lost"), "delete"))
        return after

    def _changed(self, keys: DataFrame, what: str) -> DataFrame:
        """New filter rows of the shards of ``keys`` (shard, k1), which are to be put in or taken out."""
        version = self.version + 1

        def change(left: pa.Table, right: pa.Table) -> pa.Table:
            c = Cuckoo.from_bytes(left.column("cuckoo")[0].as_py()) if left.num_rows else None
            n = left.column("n_keys")[0].as_py() if left.num_rows else 0
            k = np.unique(right.column("k1").to_numpy())
            shard = right.column("shard")[0].as_py()
            if what == "delete":
                c.delete(k)
                n -= len(k)
            else:
                n += len(k)
                c = c or Cuckoo(2 * len(k))
                if c.load(len(k)) > FULL:
                    c = None  # full: built anew from the exact tables
                else:
                    c.insert(k)
            return pa.table({"shard": pa.array([shard], pa.int32()), "version": pa.array([version], pa.int32()), "n_keys": pa.array([n], pa.int64()), "cuckoo": pa.array([c and c.to_bytes()], pa.binary())})

        schema = "shard int, version int, n_keys long, cuckoo binary"
        old = self._of_shards(self.filters, keys)
        out = self.scratch.put(old.groupBy("shard").cogroup(keys.groupBy("shard")).applyInArrow(change, schema), "filters")
        full = out.where("cuckoo is null")
        if not full.limit(1).count():
            return out
        # keys of the shard so far, and the new ones; documents that come in are not among the references yet
        held = self._of_shards(self.refs, full).join(full.select("shard"), "shard", "left_semi").select("shard", "k1")
        every = held.unionByName(keys.join(full.select("shard"), "shard", "left_semi")).distinct().withColumn("several", F.lit(False))
        again = in_batches(every.repartition("shard").sortWithinPartitions("shard"), _build(version), f"{schema}, k1 long", 100_000)
        return self.scratch.put(out.where("cuckoo is not null").unionByName(again.where("k1 is null").drop("k1")), "filters")

    def dropped(self, min_docs: int = 2) -> DataFrame:
        """(doc_id, tf, lines): for each document the numbers of the lines that go.

        With one filter row each, only suspects can be held twice; the exact references say which are."""
        suspects = _union(self._suspects).distinct()
        held = self.scratch.put(self.refs.join(suspects, ["shard", "k1"], "left_semi"), "suspected") if min_docs > 1 else self.refs
        order = F.coalesce("doc_id", F.lit((1 << 63) - 1))
        many = (F.min(order) != F.max(order)) if min_docs == 2 else (F.count_distinct(order) >= min_docs)
        owners = held.groupBy("k1", "k2").agg(many.alias("many"), F.min(order).alias("owner")).where("many").select("k1", "k2", "owner")
        lost = held.join(owners, ["k1", "k2"]).where(order != F.col("owner"))
        return lost.groupBy("doc_id", "tf").agg(F.flatten(F.collect_list("lines")).alias("lines"))


def _shards(spark: SparkSession, docs: DataFrame) -> int:
    """A shard for every SHARD_BYTES of input as the planner estimates it, or one per shuffle partition if it cannot."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size // SHARD_BYTES if size < 1 << 60 else 0
    return max(16, known, int(spark.conf.get("spark.sql.shuffle.partitions")) if size >= 1 << 60 else 0)


def _rebuild(batches):
    for b in batches:
        text, lines = b.column("text").to_pylist(), b.column("lines").to_pylist()
        kept, total, gone = [], [], []
        for t, drop in zip(text, lines):
            t = t or ""
            total.append(t.count("\n") + 1)
            gone.append(len(drop) if drop else 0)
            if drop:
                drop = set(drop)
                t = "\n".join(x for j, x in enumerate(t.split("\n")) if j not in drop)
            kept.append(t)
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=["row", "text", "n_lines", "n_dropped"])


def dedup_lines(spark: SparkSession, docs: DataFrame, min_chars: int = 10, min_docs: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with lines that an earlier document holds taken out of the text, plus ``n_lines`` and ``n_dropped``."""
    index = LineIndex.create(spark, docs, min_chars=min_chars, id_col=id_col, text_col=text_col)
    lost = index.scratch.put(index.dropped(min_docs), "dropped")
    index.scratch.release()
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], F.lit(0).alias("no_column_is_left_empty"))
    packed = docs.select(rest.alias("row"), F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("tf"))
    at = lost.select(F.col("doc_id").alias("lost_id"), F.col("tf").alias("lost_tf"), "lines")
    joined = packed.join(at, F.col("id").eqNullSafe(F.col("lost_id")) & (F.col("tf") == F.col("lost_tf")), "left").select("row", "text", "lines")
    out = in_batches(joined, _rebuild, f"row {packed.schema['row'].dataType.simpleString()}, text string, n_lines long, n_dropped long")
    return out.select(*[(F.col("text") if c == text_col else F.col(f"row.`{c}`")).alias(new) for c, new in apart(docs.columns, OWN).items()], *OWN)
