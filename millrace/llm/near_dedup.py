"""MinHash near-duplicate detection over bottom-k sketches, confirmed on whole shingle sets.

Method. One hash function maps every shingle to 64 bits and a document's sketch is its ``k`` smallest
values. Inverted lists of retained values generate overlaps, the sketch of a union estimates the
similarity and drops what cannot link, and whole sets confirm every link.

* Documents with equal sets collapse to one first, so a group of exact copies costs one entry.
* Of its sketch a document enters only the lists of its rarest values: if two sketches share at least
  ``floor`` of k values, they share one of the k - floor + 1 rarest. For sets of at most k shingles the
  sketch is the set and ``floor`` follows from the threshold: n shingles share at least n * percent / 100
  with a linked set of at most k, and with a larger one, of at most 100 n / percent, all but the values that
  its sketch cut off. For larger sets a pair at the threshold shares fewer than ``floor`` values with
  probability under 1e-7.
* A list of at most ``short`` documents yields its pairs, each tested on the sketches. A longer one first tests
  its members against its first member, the hub; only those that do not resemble it are compared with the
  rest of the list, in blocks of ``block`` sketches. So a large group of near copies costs one test a document, and
  documents that only share a common shingle are not joined. Lists with the same members count once.
* Documents that are joined by candidates form a cluster. A cluster of one block is compared as a whole. In a
  larger one whole sets are first held against the hub's; what is not linked to it meets the rest in pairs of
  blocks (by number and by bytes of sets), as products of incidence matrices. Tasks hold two blocks, whatever
  the cluster's size, and return a spanning forest of the confirmed links, never the pairs.

Defined cases: null, empty and word-free texts have no shingles and link with nothing; with fewer words
than ``words`` the whole sequence is one shingle; rows that repeat an id are separate rows of one
component; a null id counts as no id when the smallest is taken (a component of null ids only has a
null id) and is kept if its component has none. Columns besides id and text do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import Scratch, components, in_batches
from .vectext import WHITE, chunks, mix, word_hashes

SHINGLE = (np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93))


def shingle_sets(col: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes (int64) of each text."""
    for i, j, data, offsets in chunks(col):
        h, row = word_hashes(data, offsets, WHITE)
        first = np.searchsorted(row, np.arange(j - i + 1))
        grams = _grams(h, words)
        for r in range(j - i):
            a, b = first[r], first[r + 1]
            if b - a >= words:
                x = np.sort(grams[a : b - words + 1])
                yield x[np.concatenate(([True], x[1:] != x[:-1]))]
            elif b > a:
                yield _grams(h[a:b], b - a)[:1] ^ np.int64(b - a)
            else:
                yield np.zeros(0, np.int64)


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    m = max(0, len(h) - n + 1)
    out = np.full(m, n, np.uint64)
    for k in range(n):
        out = mix(out * SHINGLE[1] + h[k : k + m] * SHINGLE[k % 3])
    return out.view(np.int64)


def _sketches(words: int, k: int):
    def run(batches):
        for b in batches:
            n, k1, k2, sk = [], [], [], []
            for s in shingle_sets(b.column(2), words):
                u = s.view(np.uint64)
                n.append(len(s))
                k1.append(np.sum(u, dtype=np.uint64))
                k2.append(np.sum(mix(u ^ SHINGLE[2]), dtype=np.uint64))
                sk.append(s[:k])
            offs = np.concatenate(([0], np.cumsum([len(x) for x in sk]))).astype(np.int32)
            flat = np.concatenate(sk) if sk else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(3), pa.array(n, pa.int64()), pa.array(np.array(k1, np.uint64).view(np.int64)), pa.array(np.array(k2, np.uint64).view(np.int64)), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))],
                names=["rid", "doc_id", "tf", "n", "k1", "k2", "sketch"],
            )

    return run


def _packed(batches):
    """Sketches as bytes."""
    for b in batches:
        data, offsets = b.column(1).values.to_numpy(), b.column(1).offsets.to_numpy()
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([data[x:y].tobytes() for x, y in zip(offsets[:-1], offsets[1:])], pa.binary())], names=["sid", "vals"])


def _sets(words: int):
    def run(batches):
        for b in batches:
            data = pa.array([s.tobytes() for s in shingle_sets(b.column("text"), words)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("sid"), b.column("grp"), b.column("n"), data], names=["sid", "grp", "n", "vals"])

    return run


def _common(sets: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """The number of common values of each two sets, by products of slices of the incidence matrix."""
    m = len(sets)
    owner, value = np.repeat(np.arange(m), [len(s) for s in sets]), np.concatenate(sets)
    order = np.argsort(value, kind="stable")
    owner, value = owner[order], value[order]
    new = np.concatenate(([True], value[1:] != value[:-1])) if len(value) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    shared = np.bincount(group)[group] > 1 if len(group) else new
    owner, group = owner[shared], group[shared]
    common = np.zeros((m, m), np.float32)
    if len(group):
        group = np.cumsum(np.concatenate(([True], group[1:] != group[:-1]))) - 1
        cuts = np.searchsorted(group, np.arange(0, group[-1] + columns, columns))
        for a, b in zip(cuts, [*cuts[1:], len(group)]):
            if b > a:
                x = np.zeros((m, columns), np.float32)
                x[owner[a:b], group[a:b] % columns] = 1
                common += x @ x.T
    return common


def _forest(link: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what ``link`` connects, breadth first; each row is looked at once."""
    left, out = np.ones(len(link), bool), []
    for s in range(len(link)):
        if not left[s]:
            continue
        left[s] = False
        queue = [s]
        while queue:
            a = queue.pop()
            near = np.flatnonzero(link[a] & left)
            left[near] = False
            out += [(a, int(b)) for b in near]
            queue += near.tolist()
    return out


def _compare(linked):
    """Over rows (job, sid, n, vals) sorted by job: a forest of what ``linked(n, common)`` holds for."""

    def solve(rows: dict[int, tuple[int, bytes]]) -> list[tuple[int, int]]:
        if len(rows) < 2:
            return []
        sids, n = list(rows), np.array([x for x, _ in rows.values()], np.float64)
        sets = [np.frombuffer(x, np.int64) for _, x in rows.values()]
        if len(sets) == 2:
            both = float(len(np.intersect1d(*sets, assume_unique=True)))
            link = linked(n, np.array([[n[0], both], [both, n[1]]]))
        else:
            link = linked(n, _common(sets).astype(np.float64))
        np.fill_diagonal(link, False)
        return [(sids[a], sids[b]) for a, b in _forest(link)]

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    def run(batches):
        now, rows = None, {}
        for b in batches:
            out, sids, n, data = [], b.column("sid").to_pylist(), b.column("n").to_pylist(), b.column("vals")
            for i, job in enumerate(b.column("job").to_pylist()):
                if job != now:
                    out += solve(rows)
                    now, rows = job, {}
                rows[sids[i]] = n[i], data[i].as_py()
            yield batch(out)
        yield batch(solve(rows))

    return run


def _exact(percent: int):
    """The contract's test on whole sets."""
    return lambda n, common: 100 * common >= percent * (n[:, None] + n[None, :] - common)


def _likely(percent: int, k: int, floor: int):
    """The test on sketches: exact for sets that their sketches hold whole, else on the values two sketches share."""

    def linked(n, common):
        x, y = n[:, None], n[None, :]
        whole = (x <= k) & (y <= k)
        sizes = 100 * np.minimum(x, y) >= percent * np.maximum(x, y)
        return sizes & np.where(whole, 100 * common >= percent * (x + y - common), common >= np.minimum(floor, np.minimum(x, y)))

    return linked


def _with_hub(linked):
    """Rows (grp, sid, n, vals) joined with their hub's (hn, hvals), plus ``near``: whether the two link."""

    def run(batches):
        for b in batches:
            near, mine, hub = [], b.column("vals"), b.column("hvals")
            for i, (n, hn) in enumerate(zip(b.column("n").to_pylist(), b.column("hn").to_pylist())):
                x, y = (np.frombuffer(c[i].as_py(), np.int64) for c in (mine, hub))
                both = float(len(np.intersect1d(x, y, assume_unique=True)))
                near.append(bool(linked(np.array([n, hn], np.float64), np.array([[n, both], [both, hn]]))[0, 1]))
            yield pa.RecordBatch.from_arrays([b.column("grp"), b.column("sid"), b.column("n"), mine, pa.array(near, pa.bool_())], names=["grp", "sid", "n", "vals", "near"])

    return run


def _compared(scratch: Scratch, rows: DataFrame, linked, block: int, name: str) -> DataFrame:
    """(a, b): edges that connect, within each group, all that links. ``rows`` has grp, hub, sid, n, vals.

    Members that link to their group's hub need no test among themselves."""
    hubs = rows.where("sid = hub").groupBy("grp").agg(F.first("n").alias("hn"), F.first("vals").alias("hvals"))
    marked = in_batches(rows.join(hubs, "grp"), _with_hub(linked), "grp long, sid long, n long, vals binary, near boolean")
    marked = scratch.put(marked, f"{name}-near")
    many = lambda near: F.ceil(F.greatest(F.count(F.when(near, 1)) / block, F.sum(F.when(near, F.octet_length("vals")).otherwise(0)) / (16 << 20))).cast("int")
    sizes = marked.groupBy("grp").agg(many(~F.col("near")).alias("nu"), many(F.col("near")).alias("nc"), F.min(F.when(F.col("near"), F.col("sid"))).alias("hub")).where("nu > 0")
    dealt = marked.join(sizes.select("grp", "nu", "nc"), "grp")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("sid", "grp"), F.when(F.col("near"), F.col("nc")).otherwise(F.col("nu"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    key = lambda kind, i, j: F.concat_ws("-", F.col("grp").cast("string"), F.lit(kind), i, j)
    own = F.col("own")
    among = F.transform(upto("nu"), lambda o: key("u", F.least(own, o), F.greatest(own, o)))
    across = F.transform(upto("nc"), lambda o: key("c", own, o))
    across_near = F.transform(upto("nu"), lambda o: key("c", o, own))
    jobs = dealt.select("sid", "n", "vals", F.explode(F.when(F.col("near"), across_near).otherwise(F.concat(among, across))).alias("job"))
    found = in_batches(jobs.repartition("job").sortWithinPartitions("job").select("job", "sid", "n", "vals"), _compare(linked), "a long, b long")
    star = marked.where("near").join(rows.select("grp", "hub").distinct(), "grp").where("sid <> hub").select(F.col("hub").alias("a"), F.col("sid").alias("b"))
    return scratch.put(star.union(found), name)


def near_duplicates(
    spark: SparkSession, docs: DataFrame, words: int = 5, percent: int = 80, k: int = 32, short: int = 32, block: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash): one row per row of ``docs``; see the module for method and cases."""
    scratch = Scratch(spark, "near-dedup")
    floor = math.floor(k * percent / 100 - 6 * math.sqrt(k * percent * (100 - percent)) / 100)
    floor = max(1, floor)

    slim = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    slim = slim.withColumn("tf", F.xxhash64("text"))
    sketched = scratch.put(in_batches(slim, _sketches(words, k), "rid long, doc_id long, tf long, n long, k1 long, k2 long, sketch array<long>"), "sketches")

    sets = (
        sketched.where("n > 0")
        .groupBy("n", "k1", "k2")
        .agg(F.min(F.struct("rid", "doc_id", "tf", "sketch")).alias("rep"), F.min("doc_id").alias("least"))
        .select(F.col("rep.rid").alias("sid"), F.col("rep.doc_id").alias("doc_id"), F.col("rep.tf").alias("tf"), "n", "k1", "k2", "least", F.col("rep.sketch").alias("sketch"))
    )
    sets = scratch.put(sets, "sets")
    scratch.release()

    # lists of the rarest retained values; values of one document only fill places but make no list
    postings = sets.select("sid", "n", F.size("sketch").alias("kept"), F.explode("sketch").alias("value"))
    counts = postings.groupBy("value").agg(F.count("*").alias("cnt")).where("cnt > 1")
    small = F.greatest(F.col("n") - F.ceil(F.col("n") * percent / 100) + 1, F.floor(F.col("n") * 100 / percent) - k + 1)
    places = F.when(F.col("n") <= k, small).otherwise(k - floor + 1)
    by_sid = Window.partitionBy("sid")
    prefix = (
        postings.join(counts, "value")
        .withColumn("alone", F.col("kept") - F.count("*").over(by_sid))
        .withColumn("rank", F.row_number().over(by_sid.orderBy("cnt", "value")))
        .where(F.col("rank") + F.col("alone") <= places)
        .select("value", "sid", "n")
    )
    prefix = scratch.put(prefix, "prefix")
    lists = prefix.groupBy("value").agg(F.count("*").alias("len"), F.min("sid").alias("hub")).where("len > 1")
    listed = scratch.put(prefix.join(lists, "value"), "lists")
    scratch.drop(prefix)

    few = listed.where(f"len <= {short}").select("value", "sid", "n")
    left, right = few.toDF("value", "a", "na"), few.toDF("value", "b", "nb")
    pairs = left.join(right, (left.value == right.value) & F.expr(f"a < b and 100 * least(na, nb) >= {percent} * greatest(na, nb)")).select("a", "b", "na", "nb").distinct()
    sk = sets.select("sid", "sketch")
    with_sketches = pairs.join(sk.toDF("a", "sa"), "a").join(sk.toDF("b", "sb"), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    hits = F.size(F.array_intersect(union, F.array_intersect("sa", "sb")))
    exact = (F.col("na") <= k) & (F.col("nb") <= k)
    full = F.size(F.array_intersect("sa", "sb"))
    likely = with_sketches.where(F.when(exact, 100 * full >= percent * (F.col("na") + F.col("nb") - full)).otherwise(hits >= F.least(F.lit(floor), F.size(union))))
    edges = likely.select("a", "b")
    long = listed.where(f"len > {short}")
    if long.limit(1).count():
        alike = long.groupBy("value").agg(F.first("len").alias("len"), F.first("hub").alias("hub"), F.bit_xor(F.xxhash64("sid")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(1), "sid")).alias("s2"))
        once = alike.groupBy("len", "hub", "s1", "s2").agg(F.min("value").alias("grp"))
        members = long.select(F.col("value").alias("grp"), "sid", "n").join(once.select("grp", "hub"), "grp")
        pack = in_batches(sk, _packed, "sid long, vals binary").withColumnRenamed("sid", "s_")
        rows = scratch.put(members.join(pack, members.sid == pack["s_"]).select("grp", "hub", "sid", "n", "vals"), "long")
        edges = edges.union(_compared(scratch, rows, _likely(percent, k, floor), 2 * block, "likely"))
        scratch.drop(rows)
    clusters = components(scratch, scratch.put(edges, "candidates"))
    scratch.drop(listed)
    scratch.release()

    members = clusters.select(F.col("node").alias("sid"), F.col("label").alias("grp")).join(sets.select("sid", "doc_id", "tf", "n"), "sid")
    members = scratch.put(members, "members")
    sizes = members.groupBy("grp").agg(((F.count("*") <= block) & (F.sum("n") <= (4 << 20))).alias("one"))
    wanted = scratch.put(members.join(sizes, "grp"), "wanted")
    texts = slim.select("doc_id", "tf", "text").join(wanted.hint("merge"), slim.doc_id.eqNullSafe(wanted.doc_id) & (slim.tf == wanted.tf)).select("sid", F.when(F.col("one"), F.col("grp")).otherwise(-1 - F.col("grp")).alias("grp"), "n", "text")
    whole = scratch.put(in_batches(texts, _sets(words), "sid long, grp long, n long, vals binary"), "sets-whole")
    jobs = whole.where("grp >= 0").select(F.col("grp").alias("job"), "sid", "n", "vals")
    found = scratch.put(in_batches(jobs.repartition("job").sortWithinPartitions("job"), _compare(_exact(percent)), "a long, b long"), "links")
    if wanted.where("not one").limit(1).count():
        # the label of a cluster is its smallest member
        rows = whole.where("grp < 0").select((-1 - F.col("grp")).alias("grp"), (-1 - F.col("grp")).alias("hub"), "sid", "n", "vals")
        found = found.union(_compared(scratch, rows, _exact(percent), block, "links-large"))
    scratch.release()
    links = components(scratch, found)

    named = sets.join(links.withColumnRenamed("node", "sid"), "sid", "left").select("n", "k1", "k2", "least", F.coalesce("label", "sid").alias("comp"))
    firsts = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    by_key = scratch.put(named.join(firsts, "comp").select(F.col("n").alias("n_"), F.col("k1").alias("k1_"), F.col("k2").alias("k2_"), "component_id"), "named")
    scratch.release()
    rows = sketched.select("doc_id", "tf", "n", "k1", "k2")
    out = rows.join(by_key, (rows.k1 == by_key.k1_) & (rows.k2 == by_key.k2_) & (rows.n == by_key.n_), "left")
    comp = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), "tf").select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), F.col("tf").alias("text_hash")
    )
