"""Best-fit packing of tokenised documents after Martello-Toth dominance reduction.

Only lengths matter for packing and there are at most ``size`` of them, so the instance is a histogram of
``size`` counts, however many documents there are. On it, whole classes of bins are decided at a time:

* Reduction: an item that fills a bin alone is fixed; items i and j with i + j = size are fixed in pairs,
  as any other set with i only fits into j's place (exact fit dominates); an item with which nothing
  left fits is fixed alone; and an item with which only one more item fits (its room is less than the two
  smallest left) is fixed with the largest that fits. This repeats on the shrunken instance.
* The rest is packed best fit in falling order of length, all items of a length at once: open bins are
  kept as classes of equal content with a count.

The plan is a table of (length, first rank, last rank, class, place) of bounded size. Pieces get a rank
within their length from counts per (length, salt), so neither a frequent length nor a large document
gathers in one task, and look up their place.

Tokens come from a tokenizer file whose path is a parameter. A text is cut at ASCII white space and each
distinct word is encoded once per task; a text whose words do not add up to the whole (control strings,
words with other white space) is encoded as a whole.

Defined cases: null and empty texts are the end token alone; rows that repeat an id are packed each;
longer documents than ``size`` are cut into pieces of ``size``, of which the last may be shorter; very long texts
are encoded in stretches that end at white space; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import Scratch, in_batches, small
from .vectext import CHUNK, FOLD, WHITE, chunks, ragged, stretches, words

END_ID = 0


#: ASCII punctuation without the apostrophe: the tokenizer never joins it to a letter or digit beside it.
PUNCT = np.zeros(256, bool)
PUNCT[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'"]] = True
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
PLAIN = re.compile(rb"[a-z]+|[!-&(-/:-@\[-`{-~]+")


class WordEncoder:
    """Token ids of texts, each distinct word encoded once while the cache holds it.

    A word is a run without ASCII white space, cut where an ASCII letter or digit meets ASCII punctuation; the
    tokenizer cuts in all these places too. Words are looked up by their bytes, A-Z in lower case. Beyond LIMIT words or
    ROOM bytes of words the cache keeps those that came more than once, at most a quarter of the limit.
    """

    LIMIT, ROOM = 1 << 18, 16 << 20

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.plain = self._plain()
        self._clear()

    def _plain(self) -> bool:
        """Whether the bare model encodes plain words as the whole tokenizer does."""
        probe = [*"abcdefghijklmnopqrstuvwxyz", *(chr(c) for c in np.flatnonzero(PUNCT)), "understanding", "qzxv", "...", "||", "?!"]
        return [[t.id for t in self.tok.model.tokenize(w)] for w in probe] == [self.tok.encode(w, add_special_tokens=False).ids for w in probe]

    def _clear(self):
        self.at: dict[bytes, int] = {}
        self.held = 0
        self.seen = np.zeros(1 << 14, np.int32)  # in how many stretches each word came
        self.ids = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 14, np.int64)  # ends[i + 1]: where the ids of word i end

    def _shrink(self) -> None:
        names, seen = list(self.at), self.seen[: len(self.at)]
        keep = np.flatnonzero(seen > 1)
        if len(keep) > self.LIMIT // 4:
            keep = np.sort(keep[np.argsort(-seen[keep], kind="stable")[: self.LIMIT // 4]])
        begin = self.ends[keep]
        size = self.ends[keep + 1] - begin
        ids = self.ids[ragged(begin, size)]
        self._clear()
        self._grow(len(keep), len(ids))
        self.ids[: len(ids)] = ids
        self.ends[1 : len(keep) + 1] = np.cumsum(size)
        self.seen[: len(keep)] = seen[keep] // 2
        kept = [names[i] for i in keep.tolist()]
        self.at = dict(zip(kept, range(len(kept))))
        self.held = sum(map(len, kept))
        if self.held > self.ROOM // 2:
            self._clear()

    def _grow(self, n: int, ids: int) -> None:
        while ids > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + 1 > len(self.ends):
            self.ends, self.seen = (np.concatenate([x, np.zeros_like(x)]) for x in (self.ends, self.seen))

    def _learn(self, new: list[bytes]) -> None:
        model, got, rest = self.tok.model, [None] * len(new), []
        for i, w in enumerate(new):
            if self.plain and PLAIN.fullmatch(w):
                got[i] = [t.id for t in model.tokenize(w.decode())]
            else:
                rest.append(i)
        for i, e in zip(rest, self.tok.encode_batch([new[i].decode() for i in rest], add_special_tokens=False)):
            got[i] = e.ids
        flat = np.fromiter((i for x in got for i in x), np.uint32)
        k = len(self.at)
        used = int(self.ends[k])
        self._grow(k + len(new), used + len(flat))
        self.ids[used : used + len(flat)] = flat
        self.ends[k + 1 : k + 1 + len(new)] = used + np.cumsum([len(x) for x in got])
        self.at.update(zip(new, range(k, k + len(new))))
        self.held += sum(map(len, new))

    def encode(self, data: np.ndarray, offsets: np.ndarray, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, without the end token; ``data`` and ``offsets`` are the texts' bytes."""
        ids, length = [np.zeros(0, np.uint32)], np.zeros(len(offsets) - 1, np.int64)
        for _, part, bounds in stretches(data, offsets, WHITE, 4 * CHUNK):
            got, row, size = self._words(part, bounds)
            ids.append(got)
            length += np.bincount(row, weights=size, minlength=len(length)).astype(np.int64)
        out = np.split(np.concatenate(ids), np.cumsum(length)[:-1]) if len(length) else []
        odd = np.zeros(len(texts), bool)
        for x in self.special:
            odd |= pc.match_substring(texts, x, ignore_case=True).fill_null(False).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(odd).tolist():
            out[i] = np.array(self.tok.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
        return out

    def _words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all words, the row of each word, the number of its ids)."""
        if len(self.at) > self.LIMIT or self.held > self.ROOM:
            self._shrink()
        start, end, row = words(data, offsets, WHITE, PUNCT, ALNUM)
        bounds = np.concatenate(([0], np.cumsum(end - start))).astype(np.int32)
        inside = FOLD[data[~WHITE[data]]]  # the words without what stands between
        seen = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(inside)]).dictionary_encode()
        names = seen.dictionary.to_pylist()
        index = np.fromiter(map(self.at.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(index < 0)
        if len(new):
            k = len(self.at)
            self._learn([names[i] for i in new.tolist()])
            index[new] = np.arange(k, k + len(new))
        self.seen[index] += 1
        word = index[seen.indices.to_numpy()]
        begin = self.ends[word]
        size = self.ends[word + 1] - begin
        return self.ids[ragged(begin, size)], row, size


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per Python worker: tasks that follow each other share its cache."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker's other cores run other tasks
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _pieces(path: str, size: int, with_ids: bool):
    def run(batches):
        enc = encoder(path)
        for b in batches:
            out = defaultdict(list)
            texts, ids_of = b.column("text"), b.column("doc_id").to_pylist()
            for i0, i1, data, offsets in chunks(texts, 4 * CHUNK):
                for doc, ids in zip(ids_of[i0:i1], enc.encode(data, offsets, texts.slice(i0, i1 - i0))):
                    ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                    for p, a in enumerate(range(0, len(ids), size)):
                        part = ids[a : a + size]
                        out["doc_id"].append(doc)
                        out["piece"].append(p)
                        out["start"].append(a)
                        out["length"].append(len(part))
                        out["ids_crc32"].append(zlib.crc32(part.tobytes()))
                        if with_ids:
                            out["ids"].append(part.tobytes())
            kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.binary()} if with_ids else {})
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in kinds.items()], names=list(kinds))

    return run


def tokenize(spark: SparkSession, docs: DataFrame, path: str, size: int, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document, cut at ``size`` tokens; ids are little-endian 32-bit."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return in_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), _pieces(path, size, with_ids), schema)


def plan(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Bins as (contents in falling order, how many such bins) for ``counts`` items of each length."""
    n = {k: v for k, v in counts.items() if v > 0}
    bins: list[tuple[tuple[int, ...], int]] = []

    def fix(content: tuple[int, ...], times: int) -> None:
        for x in content:
            n[x] -= times
            if not n[x]:
                del n[x]
        bins.append((tuple(sorted(content, reverse=True)), times))

    # dominance: exact fits
    if size in n:
        fix((size,), n[size])
    for x in sorted(n, reverse=True):
        y = size - x
        if x in n and y in n and x >= y:
            times = n[x] // 2 if x == y else min(n[x], n[y])
            if times:
                fix((x, y), times)
    # dominance: items that can share with one other at most
    while n:
        low = sorted(n)
        largest = low[-1]
        one = low[0]
        total = sum(n.values())
        two = one + (one if n[one] > 1 else low[1] if len(low) > 1 else size)
        room = size - largest
        if room < one:
            fix((largest,), n[largest])
        elif room < two:
            mate = max(x for x in low if x <= room and (x != largest or n[x] > 1)) if any(x <= room and (x != largest or n[x] > 1) for x in low) else None
            if mate is None or total == 1:
                fix((largest,), n[largest])
            elif mate == largest:
                fix((largest, largest), n[largest] // 2) if n[largest] > 1 else fix((largest,), 1)
            else:
                # one at a time where the pair runs out and the smallest items change
                fix((largest, mate), min(n[largest], n[mate]))
        else:
            break
    # best fit, lengths falling; open[r] are the classes with room r
    open_: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    rooms: list[int] = []
    def add(content: tuple[int, ...], room: int, times: int) -> None:
        if room not in open_ or not open_[room]:
            if room not in open_ or room not in rooms:
                insort(rooms, room)
        open_[room][content] = open_[room].get(content, 0) + times

    for x in sorted(n, reverse=True):
        left = n[x]
        while left:
            at = bisect_left(rooms, x)
            if at == len(rooms):
                each = size // x
                full, rest = divmod(left, each)
                if full:
                    add((x,) * each, size - each * x, full)
                if rest:
                    add((x,) * rest, size - rest * x, 1)
                left = 0
                break
            room = rooms[at]
            content, times = next(iter(open_[room].items()))
            fits = room // x
            if left >= fits * times:
                put, bins_used = fits, times
            else:
                put, bins_used = (fits, left // fits) if left >= fits else (left, 1)
            left -= put * bins_used
            if bins_used == times:
                del open_[room][content]
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
            else:
                open_[room][content] = times - bins_used
            add(content + (x,) * put, room - put * x, bins_used)
    for classes in open_.values():
        bins += list(classes.items())
    return bins


def lookup(bins: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """The plan by (length, rank): first rank, first sequence and place of each run, sorted by length and rank."""
    rank: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for content, times in bins:
        offset = 0
        for x in content:
            rows.append((x, rank[x], sequence, offset))
            rank[x] += times
            offset += x
        sequence += times
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 4)
    return {"length": a[:, 0], "rank": a[:, 1], "sequence": a[:, 2], "offset": a[:, 3]}


def _assign(spec):
    def run(batches):
        p = spec.value
        key = p["length"] * np.int64(1 << 44) + p["rank"]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(key, length * np.int64(1 << 44) + rank, "right") - 1
            cols = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(p["sequence"][at] + rank - p["rank"][at]), pa.array(p["offset"][at])], names=[*b.schema.names[:-1], "sequence_id", "offset"])

    return run


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, size: int = 2048, per_salt: int = 50_000, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset): one row per piece.

    Pieces of a length are ranked in runs of about ``per_salt`` at most, so their number follows the input."""
    scratch = Scratch(spark, "pack")
    pieces = scratch.put(tokenize(spark, docs, tokenizer, size, with_ids, id_col, text_col), "pieces")
    salts = max(8, -(-pieces.count() // per_salt))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    each = scratch.put(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "counts")
    counts = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    spec = spark.sparkContext.broadcast(lookup(plan(counts, size)))
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = scratch.put(each.select("length", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "firsts")
    place = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.join(small(firsts, 200_000), ["length", "salt"]).withColumn("rank", F.col("before") + F.row_number().over(place) - 1)
    names = pieces.columns
    out = ranked.select(*names, F.col("rank").cast("long").alias("rank"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"
    return in_batches(out, _assign(spec), schema, 20_000)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, parts) of a packing made with ``with_ids``: the sequence's ids as bytes and what it holds."""
    got = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    return got.select("sequence_id", joined.alias("ids"), F.transform("parts", lambda p: F.struct(p["offset"].alias("offset"), p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["length"].alias("length"))).alias("parts"))
