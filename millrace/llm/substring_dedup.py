"""Removal of repeated byte strings: sampled suffixes are sorted and named, names are refined until each string is settled.

A byte goes if a string of ``length`` bytes that covers it also starts earlier (smaller doc_id, or further up
in the same document). Strings never cross documents and are judged on the input.

Method. A difference-cover suffix array (:mod:`.difference_cover`) sorts two thirds of all positions as rows of
triples, again and again; the README has its measured figures. This operator samples suffixes by content and
not by position modulo three, which keeps the property that matters: every string of ``length`` bytes
holds a sampled suffix, and equal strings hold it at the same place.

* Sample: the first position whose seed (``seed`` bytes) hashes smallest in some window of ``length`` bytes, about one in 35.
* A sampled suffix stands for the windows that chose it. They start next to each other, 0 to ``length - seed`` bytes before it,
  and no other suffix stands for them. It is sorted by the name of its core (what all windows share that could choose
  it, at first the seed) and by the name of its reach (all that its own windows cover). A suffix whose reach occurs earlier is settled: its whole reach goes. One
  whose core occurs once is settled too. Equal suffixes of one task are settled before the sort.
* What is left, the first suffix of each reach of a core with several, is split into two halves of its windows,
  named and sorted again; so after the logarithm of ``length - seed`` rounds every core is one window.
* Halves of one core's suffixes only meet each other. So these suffixes are dealt once, by core, with their bytes, and one
  task takes them through all rounds. Only a core with more than ``HOT`` of them is halved and sorted by Spark, and only until
  its halves' cores have at most ``HOT`` left; these join the others. So Spark makes two rows of a suffix for each
  round that its core stays above ``HOT``, not of each window that it shares.

Sampled suffixes are sorted by Spark, which spills; a core with more than ``HOT`` suffixes is dealt out by reach in
the rounds, since all its firsts stay anyway. Python holds an Arrow batch, a run of ``FLUSH`` sampled suffixes, or
``LOCAL`` left ones with a batch and a core more. Names are 64-bit hashes of whole strings.

Defined cases: null and empty texts have no bytes; a null doc_id sorts last; rows that repeat an id are taken
in the order of a hash of their text, and equal rows count as one document; a very long text is sampled in
overlapping parts; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Scratch, in_batches, small
from .vectext import buffers, chunks, eights, mix, ragged, slice_hash

SEED, FLUSH, LOCAL, HOT, PART = 32, 1 << 18, 1 << 15, 4096, 1 << 18
#: Low bits of a chance that give way to the place, so that the smallest says where it stands: more than a part has bytes.
_PLACE = np.uint64((1 << 24) - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
KEYS = ["m", "c", "doc", "tf", "pos"]
ROW = "m long, c long, doc long, tf long, pos int, lo int, size int, back int"


def _slide(best, a: np.ndarray, width: int) -> np.ndarray:
    """best of each ``width`` neighbours, in log(width) passes."""
    k = 1
    while k * 2 <= width:
        a = best(a[:-k], a[k:])
        k *= 2
    rest = width - k
    return best(a[: len(a) - rest], a[rest:]) if rest else a


def _chances(data: np.ndarray, seed: int) -> np.ndarray:
    """A number for the ``seed`` bytes from every place, to choose the smallest by."""
    eight, n = eights(data), len(data) - seed + 1
    h = np.zeros(n, np.uint64)
    for k in sorted({*range(0, seed - 7, 8), max(0, seed - 8)}):
        word = eight[k : k + n]
        h += word if seed >= 8 else word & np.uint64((1 << (8 * seed)) - 1)
        h *= _ODD
        h ^= h >> np.uint64(32)
    return h


def sampled(data: np.ndarray, offsets: np.ndarray, length: int, seed: int):
    """(position, row, core name, reach name, reach start, reach end) of the sampled suffixes."""
    none = np.zeros(0, np.int64)
    n = len(data)
    if n < length:
        return none, none, none, none, none, none
    h = _chances(data, seed)
    least = _slide(np.minimum, (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), length - seed + 1)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    start = np.flatnonzero(np.arange(len(least)) + length <= offsets[1:][row[: len(least)]])
    chosen = (least[start] & _PLACE).astype(np.int64)
    new = np.flatnonzero(np.diff(chosen, prepend=-1))
    pos, r = chosen[new], row[start[new]]
    lo, hi = start[new], start[np.append(new[1:], len(start))[: len(new)] - 1] + length
    reach = mix(slice_hash(data, lo, hi) + (pos - lo).astype(np.uint64) * _ODD)
    return pos, r, slice_hash(data, pos, pos + seed).view(np.int64), reach.view(np.int64), lo, hi


def _sampled_parts(data: np.ndarray, offsets: np.ndarray, length: int, seed: int):
    """:func:`sampled`; a long row in overlapping parts, where a sample depends on less than 2 * ``length`` bytes around it."""
    if len(offsets) > 2 or len(data) <= 4 * PART:
        yield sampled(data, offsets, length, seed)
        return
    for a in range(0, len(data), PART):
        x = max(0, a - 2 * length)
        part = data[x : a + PART + 2 * length]
        pos, r, m, c, lo, hi = sampled(part, np.array([0, len(part)]), length, seed)
        own = (pos + x >= a) & (pos + x < a + PART)
        yield tuple(v[own] for v in (pos + x, r, m, c, lo + x, hi + x))


def _first_of_reach(m, c, doc, tf, pos) -> tuple[np.ndarray, np.ndarray]:
    """(order, whether a row repeats the core and the reach of the one before it in that order)."""
    order = np.lexsort((pos, tf, doc, c, m))
    m, c = m[order], c[order]
    return order, np.concatenate(([False], (m[1:] == m[:-1]) & (c[1:] == c[:-1])))


def _chance_core(doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Settled rows travel with any core: one by chance spreads them."""
    return mix((doc * 1_000_003 + pos).view(np.uint64)).view(np.int64)


def _sample(length: int, seed: int):
    """Rows as in ROW; settled ones have lo >= 0."""

    def settle(parts):
        m, c, doc, tf, pos, lo, hi = (np.concatenate(x) for x in zip(*parts))
        order, again = _first_of_reach(m, c, doc, tf, pos)
        m, c, doc, tf, pos, lo, hi = (x[order] for x in (m, c, doc, tf, pos, lo, hi))
        gone = again & (hi - lo >= length)
        for s, cores, low in ((~again, m[~again], np.full(int((~again).sum()), -1)), (gone, _chance_core(doc[gone], pos[gone]), lo[gone])):
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (cores, c[s], doc[s], tf[s], pos[s].astype(np.int32), low.astype(np.int32), (hi - lo)[s].astype(np.int32), (pos - lo)[s].astype(np.int32))],
                names=["m", "c", "doc", "tf", "pos", "lo", "size", "back"],
            )

    def run(batches):
        parts, held = [], 0
        for b in batches:
            doc, tf = b.column("doc").to_numpy(), b.column("tf").to_numpy()
            for i, _, data, offsets in chunks(b.column("text"), PART):
                for pos, r, m, c, lo, hi in _sampled_parts(data, offsets, length, seed):
                    base = offsets[r] if len(r) else r
                    parts.append((m, c, doc[i + r], tf[i + r], pos - base, lo - base, hi - base))
                    held += len(m)
                    if held > FLUSH:
                        yield from settle(parts)
                        parts, held = [], 0
        if held:
            yield from settle(parts)

    return run


def _settle_sorted(length: int, more: tuple[str, ...] = ()):
    """Over rows sorted by KEYS: settled spans (lo, hi), and with lo = -1 the first of each reach of cores with several.

    ``more`` columns travel with the latter; a true ``hot`` says that a core has several reaches, wherever they are."""

    def run(batches):
        last = pending = None  # the row before; the core's only reach so far
        many = False

        def firsts(b: pa.RecordBatch) -> pa.RecordBatch:
            none = pa.array(np.full(b.num_rows, -1, np.int32))
            return pa.RecordBatch.from_arrays([b.column(n) for n in ("doc", "tf", "pos")] + [none, none] + [b.column(n) for n in more], names=["doc", "tf", "pos", "lo", "hi", *more])

        for b in batches:
            n = b.num_rows
            if not n:
                continue
            m, c, lo = (b.column(x).to_numpy() for x in ("m", "c", "lo"))
            size = b.column("size").to_numpy()
            settled = lo >= 0
            new_m, new_c = np.ones(n, bool), np.ones(n, bool)
            new_m[1:] = m[1:] != m[:-1]
            new_c[1:] = new_m[1:] | (c[1:] != c[:-1])
            if last is not None:
                new_m[0] = m[0] != last[0]
                new_c[0] = new_m[0] or c[0] != last[1]
            first = np.flatnonzero(new_c & ~settled)
            spans = np.flatnonzero(settled | (~new_c & (size >= length)))
            starts = np.cumsum(new_m)[first]
            take = np.zeros(len(first), bool)
            if len(first):
                same = starts[1:] == starts[:-1]
                take[:-1] |= same
                take[1:] |= same
                head = np.flatnonzero(starts == 0)  # reaches of the core that the batch before ended in
                if len(head):
                    if not many and pending is not None:
                        yield firsts(pending)
                    take[head] = True
                if "hot" in b.schema.names:
                    take |= b.column("hot").to_numpy(zero_copy_only=False)[first]
            yield firsts(b.take(pa.array(first[take])))
            low = np.where(settled, lo, b.column("pos").to_numpy() - b.column("back").to_numpy())[spans].astype(np.int32)
            gone = b.take(pa.array(spans))
            yield pa.RecordBatch.from_arrays(
                [gone.column(x) for x in ("doc", "tf", "pos")] + [pa.array(low), pa.array((low + size[spans]).astype(np.int32))] + [pa.nulls(len(spans), b.schema.field(x).type) for x in more],
                names=["doc", "tf", "pos", "lo", "hi", *more],
            )
            if len(first):
                tail = starts == np.cumsum(new_m)[-1]
                if tail.any():
                    i = int(np.flatnonzero(tail)[-1])
                    many = bool(tail.sum() > 1 or starts[i] == 0 or take[i])
                    pending = b.slice(int(first[i]), 1)
                else:
                    many, pending = False, None
            elif new_m.any():
                many, pending = False, None
            last = (m[-1], c[-1])

    return run


def _reaches(length: int, seed: int):
    """The bytes that the first round's remaining suffixes reach, which bound their own windows among 0 to length - seed."""

    def run(batches):
        for b in batches:
            data, offsets = buffers(b.column("text"))
            at = b.column("found")
            n = np.diff(at.offsets.to_numpy())
            flat = at.flatten()
            pos, back, size = (flat.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("pos", "back", "size"))
            owner = np.repeat(np.arange(b.num_rows), n)
            lo = pos - back
            hi = lo + size
            raw = data[ragged(offsets[owner] + lo, hi - lo)]
            ends = pa.py_buffer(np.concatenate(([0], np.cumsum(hi - lo))).astype(np.int32))
            reach = pa.Array.from_buffers(pa.binary(), len(pos), [None, ends, pa.py_buffer(raw)])
            own = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc").take(own), b.column("tf").take(own), pa.array(pos.astype(np.int32)), pa.array((pos - lo).astype(np.int32)), pa.array(np.zeros(len(pos), np.int32)), pa.array(np.full(len(pos), length - seed, np.int32)), reach, flat.field("m")],
                names=["doc", "tf", "pos", "at", "first", "last", "ctx", "m"],
            )

    return run


def _halves(data: np.ndarray, start: np.ndarray, size: np.ndarray, at: np.ndarray, one: np.ndarray, two: np.ndarray, room: int, seed: int):
    """(row, first, last, least, most, core name, reach name) of each half of the windows ``one`` to ``two`` bytes before suffixes.

    A suffix's seed stands ``at`` bytes into its ``size`` bytes of context from ``start``; its reach allows ``least`` to ``most``."""
    right = size - at - seed  # bytes beyond the seed
    middle = (one + two) // 2
    for a, z in ((one, middle), (middle + 1, two)):
        least, most = np.maximum(a, room - right), np.minimum(z, at)
        own = np.flatnonzero((a <= z) & (least <= most))
        a, z, least, most = (x[own] for x in (a, z, least, most))
        place = start[own] + at[own]
        name = lambda x, y: slice_hash(data, place - x, place + seed + room - y)
        m = mix(name(a, z) + (a * 1024 + z).astype(np.uint64) * _ODD).view(np.int64)
        c = mix(name(most, least) + (least * 1024 + most).astype(np.uint64) * _ODD).view(np.int64)
        yield own, a, z, least, most, m, c


def _refine(length: int, seed: int):
    """Over rows (m, doc, tf, pos, at, first, last, ctx) sorted by m: the spans of all rounds to come; a core's rows are one task's."""
    room = length - seed

    def settle(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        data, offsets = buffers(b.column("ctx"))
        start, size = offsets[:-1], np.diff(offsets)
        at, pos, doc, tf, one, two = (b.column(x).to_numpy().astype(np.int64) for x in ("at", "pos", "doc", "tf", "first", "last"))
        rank = np.empty(b.num_rows, np.int64)
        rank[np.lexsort((pos, tf, doc))] = np.arange(b.num_rows)
        row = np.arange(b.num_rows)
        gone, lows, highs = [], [], []
        while len(row):
            halves = [(row[own], *rest) for own, *rest in _halves(data, start[row], size[row], at[row], one, two, room, seed)]
            row, one, two, least, most, m, c = (np.concatenate(x) for x in zip(*halves))
            order = np.lexsort((rank[row], c, m))
            row, one, two, least, most, m, c = (x[order] for x in (row, one, two, least, most, m, c))
            new_m = np.concatenate(([True], m[1:] != m[:-1]))[: len(m)]
            new_c = new_m | np.concatenate(([True], c[1:] != c[:-1]))[: len(m)]
            again = ~new_c
            gone.append(row[again])
            lows.append(pos[row[again]] - most[again])
            highs.append(lows[-1] + length + (most - least)[again])
            core = np.cumsum(new_m) - 1
            left = new_c & (np.bincount(core, new_c) > 1)[core] if len(core) else new_c
            row, one, two = row[left], one[left], two[left]
        gone = np.concatenate(gone)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[gone], tf[gone], np.concatenate(lows).astype(np.int32), np.concatenate(highs).astype(np.int32))], names=["doc", "tf", "lo", "hi"])

    def run(batches):
        held, n = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n += b.num_rows
            m = b.column("m").to_numpy()
            cut = int(np.searchsorted(m, m[-1]))
            if n >= LOCAL and cut:
                held[-1] = b.slice(0, cut)
                yield settle(held)
                held, n = [b.slice(cut)], b.num_rows - cut
        if held:
            yield settle(held)

    return run


def _halve(length: int, seed: int):
    """Rows as in ROW with (at, first, last, ctx) of each half of a suffix's windows ``first`` to ``last`` bytes before it."""
    room = length - seed

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            data, offsets = buffers(b.column("ctx"))
            data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
            at, one, two, pos, doc, tf = (b.column(x).to_numpy().astype(np.int64) for x in ("at", "first", "last", "pos", "doc", "tf"))
            for own, a, z, least, most, m, c in _halves(data, offsets[:-1], np.diff(offsets), at, one, two, room, seed):
                if not len(own):
                    continue
                order, again = _first_of_reach(m, c, doc[own], tf[own], pos[own])
                low = np.full(len(own), -1)
                low[order[again]] = (pos[own] - most)[order[again]]
                m = np.where(low >= 0, _chance_core(doc[own], pos[own]), m)
                rows = b.take(pa.array(own))
                small_ = lambda x: pa.array(x.astype(np.int32))
                empty = pa.scalar(b"", pa.binary())
                ctx = pa.compute.if_else(pa.array(low >= 0), empty, rows.column("ctx"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(m), pa.array(c), rows.column("doc"), rows.column("tf"), rows.column("pos"), small_(low), small_(length + most - least), small_(most), rows.column("at"), small_(a), small_(z), ctx],
                    names=["m", "c", "doc", "tf", "pos", "lo", "size", "back", "at", "first", "last", "ctx"],
                )

    return run


def _cut(batches):
    for b in batches:
        data, offsets = buffers(b.column("text"))
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        spans = b.column("spans")
        owner = np.repeat(np.arange(b.num_rows), np.diff(spans.offsets.to_numpy()))
        flat = spans.flatten()
        mask = np.zeros(len(data) + 1, np.int32)
        np.add.at(mask, offsets[owner] + flat.field("lo").to_numpy(), 1)
        np.add.at(mask, offsets[owner] + flat.field("hi").to_numpy(), -1)
        cover = np.cumsum(mask)[:-1] > 0
        starts = cover.copy()
        starts[1:] &= ~cover[:-1]
        edge = offsets[:-1][np.diff(offsets) > 0]
        starts[edge] = cover[edge]
        upto = lambda x: np.concatenate(([0], np.cumsum(x)))[offsets]
        left = data[~cover]
        ends = offsets - upto(cover)
        kept = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(left)])
        digest = [hashlib.sha256(left[x:y]).hexdigest() for x, y in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(np.diff(offsets)), pa.array(np.diff(upto(cover))), pa.array(np.diff(upto(starts))), pa.array(digest, pa.string()), kept],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def repeated_spans(slim: DataFrame, scratch: Scratch, length: int, seed: int, hot: int = HOT) -> list[DataFrame]:
    """Tables (doc, tf, lo, hi) of spans to remove, overlapping ones too."""
    suffixes = in_batches(slim.where(F.octet_length("text") >= length), _sample(length, seed), ROW)
    sorted_ = suffixes.repartition("m").sortWithinPartitions(*KEYS)
    done = scratch.put(in_batches(sorted_, _settle_sorted(length, ("m", "back", "size")), "doc long, tf long, pos int, lo int, hi int, m long, back int, size int", 100_000), "round0")
    scratch.release()
    spans = [done.where("lo >= 0").select("doc", "tf", "lo", "hi")]
    firsts = done.where("lo < 0").select("doc", "tf", "pos", "m", "back", "size")
    more = "at int, first int, last int, ctx binary"
    columns = ["m", "doc", "tf", "pos", "at", "first", "last", "ctx"]

    def reaches(rows: DataFrame) -> DataFrame:
        by_doc = rows.groupBy("doc", "tf").agg(F.collect_list(F.struct("pos", "m", "back", "size")).alias("found"))
        made = in_batches(slim.select("doc", "tf", "text").join(by_doc, ["doc", "tf"]), _reaches(length, seed), f"doc long, tf long, pos int, {more}, m long")
        return made.select(columns)

    def by_size(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Rows of cores with at most ``hot`` of them, and those of larger cores if there are any."""
        large = scratch.put(rows.groupBy("m").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("m"), "large")
        if not large.limit(1).count():
            return rows, None
        large = small(large, 200_000)
        return rows.join(large, "m", "left_anti"), rows.join(large, "m", "left_semi")

    usual, left = by_size(firsts)
    local, left = reaches(usual), None if left is None else reaches(left)
    for k in range(1, (length - seed).bit_length() + 1):
        if left is None:
            break
        rows = scratch.put(in_batches(left.drop("m"), _halve(length, seed), f"{ROW}, {more}", 50_000), f"halves{k}")
        cores = rows.groupBy("m").agg(F.count("*").alias("n")).where(F.col("n") > hot).select(F.col("m").alias("m_"))
        dealt = rows.join(small(scratch.put(cores, "hot"), 200_000), F.col("m") == F.col("m_"), "left")
        dealt = dealt.withColumn("hot", F.col("m_").isNotNull()).drop("m_").withColumn("deal", F.when(F.col("hot"), F.col("c")))
        dealt = dealt.repartition("m", "deal").sortWithinPartitions(*KEYS).drop("deal")
        done = scratch.put(in_batches(dealt, _settle_sorted(length, ("m", "at", "first", "last", "ctx")), f"doc long, tf long, pos int, lo int, hi int, m long, {more}", 50_000), f"round{k}")
        scratch.drop(rows)
        scratch.release()
        spans.append(done.where("lo >= 0").select("doc", "tf", "lo", "hi"))
        usual, left = by_size(done.where("lo < 0").select(columns))
        local = local.unionByName(usual.select(columns))
    dealt = local.repartition("m").sortWithinPartitions("m")
    spans.append(scratch.put(in_batches(dealt, _refine(length, seed), "doc long, tf long, lo int, hi int", 50_000), "local"))
    scratch.release()
    return spans


def remove_repeats(spark: SparkSession, docs: DataFrame, length: int = 100, seed: int = SEED, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): one row per row of ``docs``; ``kept`` holds the remaining bytes."""
    scratch = Scratch(spark, "substring")
    key = F.col(id_col).cast("long")
    # the text's hash travels with every suffix only where ids repeat
    repeated = docs.groupBy(key).count().where("count > 1").limit(1).count() > 0
    tf = F.xxhash64(text_col) if repeated else F.lit(0).cast("long")
    slim = docs.select(key.alias("doc_id"), F.coalesce(key, F.lit((1 << 63) - 1)).alias("doc"), tf.alias("tf"), F.col(text_col).alias("text"))
    spans = repeated_spans(slim.dropDuplicates(["doc", "tf"]) if repeated else slim, scratch, length, min(seed, length), hot)
    every = spans[0]
    for s in spans[1:]:
        every = every.unionByName(s)
    by_doc = scratch.put(every.groupBy("doc", "tf").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "spans")
    scratch.release()
    none = F.array().cast("array<struct<lo:int,hi:int>>")
    out = slim.join(by_doc, ["doc", "tf"], "left").select("doc_id", "text", F.coalesce("spans", none).alias("spans"))
    return in_batches(out, _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
