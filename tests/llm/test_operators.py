"""The training-data operators against plain versions on small, awkward tables."""

import hashlib
import os
import random
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute
from millrace.llm import chat, common, decontaminate, difference_cover, embed_dedup, line_dedup, lm_score, near_dedup, packing, quality, queries, sharding, substring_dedup, vectext

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, n int, row int, label string"
SMALL = "/root/testdata/sf0.001"


def docs(spark, rows):
    """With columns whose names clash with the operators' own."""
    return spark.createDataFrame([(d, t, None, "s", None, 1, 2, 3, "x") for d, t in rows], DOCS)


def vocabulary(n=400, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzÉé") for _ in range(rng.randint(1, 9))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    rng, v = random.Random(3), vocabulary()
    say = lambda n: " ".join(rng.choice(v) for _ in range(n))
    rows, base = [], say(300)
    for i in range(60):
        w = base.split()
        for _ in range(rng.randint(0, 14)):
            w[rng.randrange(len(w))] = rng.choice(v)
        rows.append(" ".join(w))
    rows += [base] * 50 + [say(rng.randint(3, 80)) for _ in range(60)]
    passage = say(70)
    rows += [say(20) + "\n" + passage + "\n" + say(9) for _ in range(30)]
    rows += ["", "  \n\t", "one", "one two", "ONE  two", "a b c", None, None, base.upper(), "x" * 400, "ab" * 300, "long line that repeats\n" * 40, "Long Line THAT repeats  \nother", say(6000)]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(7 * i + 1, rows[j]) for i, j in enumerate(order)]


def as_dict(df, *cols):
    return {r[0]: tuple(r[1:]) for r in df.select(*cols).collect()}


@pytest.mark.parametrize("words,percent,short,block", [(3, 85, 32, 512), (3, 85, 2, 7), (5, 80, 8, 32)])
def test_near_duplicates(spark, corpus, words, percent, short, block):
    got = as_dict(near_dedup.near_duplicates(spark, docs(spark, corpus), words, percent, short=short, block=block), "doc_id", "n_shingles", "component_id", "kept")
    assert got == brute.near(corpus, words, percent)


@pytest.mark.parametrize("percent,small,larger", [(85, 32, [37]), (80, 32, [39, 40])])
def test_near_duplicates_across_sketch_size(spark, percent, small, larger):
    """A set the sketch holds whole links to one that it does not: no place is lost to values the larger sketch cut off."""
    say = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n + 2))
    rows = [(2 * i + k, say(i, n)) for i in range(40) for k, n in ((0, small), (1, larger[i % len(larger)]))]
    got = as_dict(near_dedup.near_duplicates(spark, docs(spark, rows), 3, percent), "doc_id", "n_shingles", "component_id", "kept")
    want = brute.near(rows, 3, percent)
    assert sum(not v[2] for v in want.values()) == 40
    assert got == want


@pytest.mark.parametrize("hot", [4096, 3])
def test_repeated_substrings(spark, corpus, hot):
    out = substring_dedup.remove_repeats(spark, docs(spark, corpus).repartition(5), hot=hot)
    assert as_dict(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.repeats(corpus)


def test_repeated_substrings_are_dealt_once(spark, corpus, monkeypatch):
    """Suffixes of cores of usual size go through all rounds in one task, in runs of whole cores; no round is written or dealt."""
    names, put = [], common.Scratch.put
    monkeypatch.setattr(common.Scratch, "put", lambda self, df, name, *more: names.append(name) or put(self, df, name, *more))
    monkeypatch.setattr(substring_dedup, "LOCAL", 50)
    out = substring_dedup.remove_repeats(spark, docs(spark, corpus).repartition(5))
    assert as_dict(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.repeats(corpus)
    assert names == ["round0", "large", "local", "spans"]


def test_repeated_substrings_leave_large_cores(spark, monkeypatch):
    """Spark halves a core's suffixes only while they are more than ``hot``; what is left then is one task's again."""
    rng = random.Random(8)
    say = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    phrase, rows = say(50), []
    for i in range(30):  # 30 pairs around one phrase share 102 or 90 bytes
        n = 26 if i % 2 else 20
        left, right = say(n), say(n)
        rows += [(2 * i + k, say(90) + left + phrase + right + say(90)) for k in (0, 1)]
    made, put = {}, common.Scratch.put

    def counted(self, df, name, *more):
        made[name] = put(self, df, name, *more)
        return made[name]

    monkeypatch.setattr(common.Scratch, "put", counted)
    monkeypatch.setattr(common.Scratch, "drop", lambda self, *tables: None)
    out = substring_dedup.remove_repeats(spark, docs(spark, rows).repartition(3), hot=10)
    want = brute.repeats(rows)
    assert as_dict(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert sum(v[1] >= 102 for v in want.values()) == 15
    suffixes = made["round0"].where("lo < 0").groupBy("m").count().where("count > 10").agg(F.sum("count")).first()[0]
    assert [x for x in made if x.startswith("halves")] == ["halves1"]
    assert made["halves1"].count() <= 2 * suffixes


def test_each_window_has_one_suffix():
    """Every window of a row is one sampled suffix's, at the same place wherever its bytes stand, also in runs of one word."""
    rng = random.Random(2)
    say = lambda n: "".join(rng.choice("ab cd") for _ in range(n))
    rows = [say(rng.randint(0, 300)) + "the " * rng.randint(0, 120) + say(rng.randint(0, 300)) for _ in range(40)] + ["", "x" * 99, "x" * 100]
    data, ends = np.frombuffer("".join(rows).encode(), np.uint8), np.cumsum([0, *map(len, rows)])
    found, place = [], {}
    for pos, row, _, _, lo, hi in zip(*(x.tolist() for x in substring_dedup.sampled(data, ends, 100, 32))):
        assert ends[row] <= lo <= pos and hi <= ends[row + 1]
        for w in range(lo, hi - 99):
            found.append(w)
            assert w <= pos <= w + 68
            assert place.setdefault(data[w : w + 100].tobytes(), pos - w) == pos - w
    assert found == [w for x, y in zip(ends[:-1], ends[1:]) for w in range(x, y - 99)]


def test_lines(spark, corpus):
    out = line_dedup.dedup_lines(spark, docs(spark, corpus))
    assert set(docs(spark, []).columns) <= set(out.columns)
    assert as_dict(out.withColumn("h", F.sha2("text", 256)), "doc_id", "n_lines", "n_dropped", "h") == brute.lines(corpus)


def index_state(index):
    return sorted((r["doc_id"] or -1, tuple(sorted(set(r["lines"])))) for r in index.dropped().collect())


def filters_are_right(index):
    """Every key that holds is in its shard's filter; others are not, but for a few chance hits."""
    keys = index.refs.select("shard", "k1").distinct().toPandas()
    rows = index.filters.collect()
    assert sum(r["n_keys"] for r in rows) == len(keys)
    other = np.random.default_rng(0).integers(-(2**62), 2**62, 4000)
    for r in rows:
        c = line_dedup.Cuckoo.from_bytes(r["cuckoo"])
        assert c.holds(keys[keys.shard == r["shard"]].k1.to_numpy()).all() and c.holds(other).mean() < 0.01


def test_line_index_is_reversible(spark, corpus):
    a, b, c = docs(spark, corpus[:90]), docs(spark, corpus[90:95]), docs(spark, corpus[95:])
    one = line_dedup.LineIndex.create(spark, a, shards=4)
    two = one.insert(b)
    three = two.insert(c)  # more keys than the filters were made for: they grow
    assert index_state(three) == index_state(line_dedup.LineIndex.create(spark, docs(spark, corpus), shards=4))
    back = three.delete(c).delete(b.select("doc_id"))  # with texts, and by ids alone
    assert index_state(back) == index_state(one)
    assert back.seen(a).count() == line_dedup.line_refs(a, 4).count()
    for state in (one, two, three, back):
        filters_are_right(state)
    again = back.insert(b)
    assert index_state(again) == index_state(two)
    filters_are_right(again)


def test_line_insert_asks_the_filters(spark, corpus):
    a, b = docs(spark, corpus[:100]), docs(spark, corpus[100:])
    one = line_dedup.LineIndex.create(spark, a, shards=4)
    keys = lambda refs: refs.select("shard", "k1").distinct()
    held = lambda index: index.filters.agg(F.sum("n_keys")).first()[0]
    both = one.insert(b)
    assert held(both) == keys(both.refs).count() < held(one) + keys(line_dedup.line_refs(b, 4)).count()
    blank = line_dedup.LineIndex(one.scratch, 4, 10, {}, 1, refs=one._refs, filters=[one.filters.limit(0)], suspects=one._suspects)  # filters that have seen nothing decide
    assert held(blank.insert(b)) == keys(line_dedup.line_refs(b, 4)).count()


def test_line_work_follows_the_insert(spark, corpus):
    """One more document gives one row of references and new filters only for the shards of its lines."""
    index = line_dedup.LineIndex.create(spark, docs(spark, corpus), shards=64)
    more = index.insert(docs(spark, [(9999, "a single new line, not seen before")]))
    assert [x.count() for x in (more._refs[-1], more._filters[-1], more._suspects[-1])] == [1, 1, 0] and more._refs[0] is index._refs[0]
    less = more.delete(docs(spark, [(9999, "a single new line, not seen before")]))
    assert less._filters[-1].count() == 1 and less._gone[-1].count() == 1
    assert index_state(less) == index_state(index)


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(-(2**62), 2**62, 5000))
    c = line_dedup.Cuckoo(len(keys))
    c.insert(keys)
    assert c.holds(keys).all() and c.holds(rng.integers(-(2**62), 2**62, 20000)).mean() < 0.01
    c.delete(keys[:2500])
    assert c.holds(keys[2500:]).all() and c.holds(keys[:2500]).mean() < 0.02


@pytest.mark.parametrize("limit", [200_000, 3])
def test_contamination(spark, corpus, limit):
    rng = random.Random(8)
    texts = [t for _, t in corpus if t and len(t.split()) > 20]
    items = [(i, " ".join(rng.choice(texts).split()[2 : 2 + rng.choice([3, 13, 20])])) for i in range(40)] + [(90, ""), (91, None), (92, "one"), (93, "zzz unknown")]
    got = decontaminate.contamination(spark, docs(spark, corpus), spark.createDataFrame(items, "item_id long, text string"), limit=limit)
    ids = F.array_sort(F.transform(F.coalesce("items", F.array().cast("array<bigint>")), lambda x: x.cast("string")))
    got = got.select("doc_id", "n_words", "n_hit", F.size(ids).alias("n"), F.sha2(F.array_join(ids, ","), 256).alias("h"), "contaminated")
    assert as_dict(got, *got.columns) == brute.contaminated(corpus, [(i, t) for i, t in items])
    near = decontaminate.proximity_matches(spark, docs(spark, corpus), spark.createDataFrame(items[:3], "item_id long, text string"), reach=40)
    assert near.count() > 0


def test_sharding(spark, corpus):
    rows = corpus + [(None, "x"), (None, "x"), (5, "same"), (5, "same")]
    df = docs(spark, rows)
    out = sharding.shard(spark, df, 6, "doc_id", bucket_bytes=4000).collect()
    assert len(out) == len(rows) and {r["shard_"] for r in out} == {1}
    for s in {r["shard"] for r in out}:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    assert sorted((r["doc_id"], r["text"]) for r in out if r["doc_id"]) == sorted((d, t) for d, t in rows if d) if all(t for _, t in rows) else True
    more = {r["doc_id"]: r["shard"] for r in sharding.shard(spark, df, 7, "doc_id").collect()}
    assert all(more[r["doc_id"]] in (r["shard"], 6) for r in out if r["doc_id"])
    assert sharding.shard(spark, df.limit(0), 6, "doc_id").count() == 0


def test_chat_trees(spark):
    tricky = "a\\b <|im_end|>\n<|im_start|>assistant\n\\<| <\\| \\\\"
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", tricky, 1.0), (1, 3, 1, "assistant", "no", 5.0), (1, 4, 3, "us\ner<", None, 0.0), (1, 5, 4, "assistant", "é𝄞", 0.0), (2, 1, 9, None, "", None)]
    nodes = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    out = chat.format_conversations(spark, nodes)
    back = out.select("tree", "leaf", "rank", "path_score", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("l")).collect()
    got = {(r["tree"], r["leaf"]): (r["rank"], r["path_score"], [tuple(x) for x in r["t"]], r["l"]) for r in back}
    assert got == {
        (1, 2): (2, 1.0, [("user", "q"), ("assistant", tricky)], tricky),
        (1, 5): (1, 5.0, [("user", "q"), ("assistant", "no"), ("us\ner<", ""), ("assistant", "é𝄞")], "noé𝄞"),
        (2, 1): (1, 0.0, [("", "")], ""),
    }
    assert chat.format_conversations(spark, nodes, best=1).count() == 2
    odd = [(3, 1, None, "user", "r", 0.0), (3, 2, 2, "user", "self", 0.0), (3, 3, 4, "user", "loop", 0.0), (3, 4, 3, "user", "loop", 0.0), (3, 5, 4, "user", "below a loop", 0.0), (3, 6, 1, "assistant", "b", 0.0), (3, 6, 1, "assistant", "a", 0.0), (None, 1, None, "user", "n", 0.0)]
    whole = chat.format_conversations(spark, spark.createDataFrame(odd, nodes.schema)).select("tree", chat.read_turns(F.col("formatted")).alias("t")).collect()
    assert sorted((r["tree"] or 0, [x["text"] for x in r["t"]]) for r in whole) == [(0, ["n"]), (3, ["r", "a"])]
    assert chat.format_conversations(spark, nodes.limit(0)).count() == 0
    deep = spark.range(1, 200).select(F.lit(1).cast("long").alias("tree"), F.col("id").alias("node"), F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"), F.lit(0.0).alias("score"))
    turns = chat.format_conversations(spark, deep).select(chat.read_turns(F.col("formatted")).alias("t")).first()["t"]
    assert [t["text"] for t in turns] == [str(i) for i in range(1, 200)]


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 16))
    x = np.concatenate([base[rng.integers(0, 12, 300)] + rng.normal(size=(300, 16)) * rng.choice([0.0, 0.05, 0.12], (300, 1)), np.zeros((2, 16))])
    rows = [(i, [float(v) for v in r], int(i % 2)) for i, r in enumerate(x)]
    rows += [(900, None, 1), (901, [float("nan")] * 16, 1), (902, rows[0][1], None), (903, [None, 1.0], 1), (904, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, lab in rows if v and None not in v and lab is not None and np.isfinite(v).all() and np.linalg.norm(v) > 0}
    label = {i: lab for i, _, lab in rows}
    near = {i: [j for j in unit if j != i and label[i] == label[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98] if i in unit else [] for i, _, _ in rows}
    comp = {i: i for i in near}
    for _ in range(40):
        comp = {i: min([comp[i], *(comp[j] for j in near[i])]) for i in comp}
    for options in ({}, {"block": 16, "per_cell": 20}):
        got = as_dict(embed_dedup.similar_embeddings(spark, df, **options), "vec_id", "n_links", "component_id", "kept")
        assert got == {i: (len(near[i]), comp[i], comp[i] == i) for i in near}


def test_quality(spark):
    rng, v = random.Random(4), vocabulary(200)
    rows = [(i, " ".join(rng.choice(v) for _ in range(60)) if i % 3 else " ".join([rng.choice(v)] * 60)) for i in range(400)] + [(1000, ""), (1001, None)]
    labels = spark.createDataFrame([(d, int(d % 3 > 0), 0) for d, _ in rows[:300]] + [(None, 1, 0), (5000, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.quality_scores(spark, docs(spark, rows), labels).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    judged = [r for r in out if r["doc_id"] < 400 and r["held_out"]]
    assert sum(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in judged) > 0.95 * len(judged)
    none = quality.quality_scores(spark, docs(spark, rows[:5]), labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}


def test_plan_packs_everything():
    rng = random.Random(6)
    for _ in range(150):
        size = rng.choice([7, 16, 40])
        counts = {k: rng.randint(0, 5) for k in range(1, size + 1)}
        bins = packing.plan(counts, size)
        held = {}
        for content, times in bins:
            assert sum(content) <= size and times > 0
            for x in content:
                held[x] = held.get(x, 0) + times
        assert held == {k: v for k, v in counts.items() if v}
        total = sum(k * v for k, v in counts.items())
        assert sum(n for _, n in bins) <= -(-total // size) * 1.25 + 1


def test_packing(spark, corpus):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.tokenizer_path()
    tok = tokenizers.Tokenizer.from_file(path)
    rows = corpus + [(-1, "<|endoftext|> x <|ENDOFTEXT|>"), (-2, "don't a.'s \x1c b\x85 İ Σ—x. 12'34")]
    out = packing.pack(spark, docs(spark, rows), path, size=256, with_ids=True).collect()
    want = {d: tok.encode(t or "", add_special_tokens=False).ids + [0] for d, t in rows}
    got, places = {}, {}
    for r in sorted(out, key=lambda r: r["piece"]):
        ids = np.frombuffer(r["ids"], "<u4")
        assert r["start"] == len(got.get(r["doc_id"], [])) and r["length"] == len(ids) and r["ids_crc32"] == zlib.crc32(r["ids"])
        got.setdefault(r["doc_id"], []).extend(ids.tolist())
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert got == want
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 256
    seqs = packing.sequences(packing.pack(spark, docs(spark, rows), path, size=256, with_ids=True)).collect()
    assert sum(len(s["ids"]) for s in seqs) == 4 * sum(map(len, want.values()))


def test_lm_scores(spark):
    rows = [(1, "a b c a b"), (2, "A b d"), (3, ""), (4, None), (5, "zz"), (6, "a b c a b")]
    out = {r["doc_id"]: r for r in lm_score.lm_scores(spark, docs(spark, rows), slices=2).collect()}
    assert out[3]["score"] is None and out[4]["n_tokens"] == 0
    assert out[1]["score"] == out[6]["score"] and out[1]["n_seen"] == 5
    # the second of "a b d" follows an a seen 4 times elsewhere, always before b; d is seen nowhere else
    start, ab, d = np.log(2 / 3), np.log(4 / 4), np.log(0.4 * 0.5 / 14)
    assert abs(out[2]["score"] - (start + ab + d) / 3) < 1e-9
    other = {r["doc_id"]: r for r in lm_score.lm_scores(spark, docs(spark, rows), slices=3).collect()}
    assert all(other[i]["n_seen"] == r["n_seen"] and (r["score"] is None or abs(other[i]["score"] - r["score"]) < 1e-9) for i, r in out.items())


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(100, j) for j in range(101, 160)]
    got = {r["node"]: r["label"] for r in common.components(common.Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: i // 20 * 20 for i in range(60)}, **{i: 100 for i in range(100, 160)}} | ({60: 40} if (59, 60) in edges else {})


def rows_joined(spark, run):
    """The rows that all joins of ``run``'s queries made, by Spark's own metrics."""
    store = spark._jsparkSession.sharedState().statusStore()
    ids = lambda: {store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())}
    before = ids()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    total = 0
    for x in ids() - before:
        values, nodes = store.executionMetrics(x), store.planGraph(x).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            metrics = node.metrics() if "Join" in node.name() else store.executionsList().take(0)
            for m in (metrics.apply(i) for i in range(metrics.size())):
                if m.name() == "number of output rows" and (v := values.get(m.accumulatorId())).isDefined():
                    total += int(v.get().replace(",", ""))
    return total


def test_components_join_edges_once(spark, tmp_path):
    """Rounds that a long chain of dense groups takes do not join all its edges again."""
    n, order = 1500, list(range(1500))
    random.Random(4).shuffle(order)
    edges = [(order[i], order[i + k]) for i in range(n) for k in range(1, 9) if i + k < n]
    df = spark.createDataFrame(edges, "a long, b long")
    df.write.parquet(f"{tmp_path}/edges")
    df, got = spark.read.parquet(f"{tmp_path}/edges"), []
    made = rows_joined(spark, lambda: got.extend(common.components(common.Scratch(spark, "t"), df).collect()))
    assert {r["node"]: r["label"] for r in got} == dict.fromkeys(range(n), 0)
    assert 2 * len(edges) <= made <= 4 * len(edges)


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_long_words_of_a_simple_family(spark):
    """Words that hashes modulo 2**64 take for each other."""
    other = str.maketrans("ab", "ba")
    rows = []
    for n in (1024, 2048):
        x = thue_morse(n)
        y = x.translate(other)
        rows += [(n + i, t) for i, t in enumerate((x, y, f"{x} {y} one", f"{y} {x} one", x.upper()))]
    got = as_dict(near_dedup.near_duplicates(spark, docs(spark, rows), 3, 85), "doc_id", "n_shingles", "component_id", "kept")
    assert got == brute.near(rows) and got[1025][1] == 1025 and got[1028][1] == 1024
    tokenizers = pytest.importorskip("tokenizers")
    tok = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    out = packing.pack(spark, docs(spark, rows), queries.tokenizer_path(), size=1 << 16, with_ids=True).collect()
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in out} == {d: tok.encode(t, add_special_tokens=False).ids + [0] for d, t in rows}
    assert as_dict(substring_dedup.remove_repeats(spark, docs(spark, rows)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.repeats(rows)


def test_slice_hash_sees_bytes_only():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 3, 20_000).astype(np.uint8)
    start = rng.integers(0, 19_000, 4000)
    end = start + rng.integers(0, 600, 4000)
    h, seen = vectext.slice_hash(data, start, end), {}
    for x, s, e in zip(h.tolist(), start, end):
        assert seen.setdefault(data[s:e].tobytes(), x) == x
    assert len(set(seen.values())) == len(seen)


def test_a_common_shingle_joins_nobody(spark):
    """Documents that only share a frequent phrase stay apart, and near copies among them are found, whatever the list's size."""
    rng, v = random.Random(9), vocabulary(3000)
    rows = [(i, "the same three words " + " ".join(rng.choice(v) for _ in range(12))) for i in range(300)]
    base = " ".join(rng.choice(v) for _ in range(120)).split()
    for i in range(300, 420):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(v)
        rows.append((i, " ".join(w)))
    got = as_dict(near_dedup.near_duplicates(spark, docs(spark, rows), 3, 85, short=8, block=16), "doc_id", "n_shingles", "component_id", "kept")
    assert got == brute.near(rows)


def test_difference_cover_agrees(spark):
    rng, v = random.Random(12), vocabulary(60)
    say = lambda n: " ".join(rng.choice(v) for _ in range(n))
    p = say(40)
    rows = [(5, say(20) + p + say(3)), (2, p[20:150] + say(9)), (9, "x" * 130), (7, None), (1, "é" * 60 + say(4)), (11, say(2) + p[:120])]
    out = difference_cover.remove_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert as_dict(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.repeats(rows)


def test_very_long_texts(spark):
    """A text of many megabytes beside short ones: every operator works on it whole."""
    rng, v = random.Random(2), vocabulary(5000)
    words = [rng.choice(v) for _ in range(400_000)]
    long = " ".join(words)
    rows = [(1, long), (2, long + " more"), (3, " ".join(words[1000:1100])), (4, None), (5, "short text here"), (6, "y" * 2_000_000)]
    df = docs(spark, rows)
    near = as_dict(near_dedup.near_duplicates(spark, df, 3, 85), "doc_id", "n_shingles", "component_id", "kept")
    assert near == brute.near(rows)
    path = queries.tokenizer_path()
    import tokenizers

    tok = tokenizers.Tokenizer.from_file(path)
    want = {d: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in rows if d != 6}
    got = {r["doc_id"]: r["n"] for r in packing.pack(spark, df.where("doc_id <> 6"), path).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert got == want
    cut = {r["doc_id"]: r for r in substring_dedup.remove_repeats(spark, df.where("doc_id <> 6")).drop("kept").collect()}
    assert cut[1]["n_removed"] < 0.01 * len(long) and cut[2]["n_removed"] == len(long.encode()) and cut[3]["n_removed"] == cut[3]["n_bytes"] and cut[5]["n_removed"] == 0
    assert as_dict(line_dedup.dedup_lines(spark, df).withColumn("h", F.sha2("text", 256)), "doc_id", "n_lines", "n_dropped", "h") == brute.lines(rows)
    scores = quality.quality_scores(spark, df, spark.createDataFrame([(1, 1), (3, 1), (5, 0)], "doc_id long, quality int")).collect()
    assert len(scores) == 6 and all(0 <= r["score"] <= 1 for r in scores)
    lm = {r["doc_id"]: r["n_tokens"] for r in lm_score.lm_scores(spark, df, slices=1).collect()}
    assert lm == {1: 400_000, 2: 400_001, 3: 100, 4: 0, 5: 3, 6: 1}
    hits = {r["doc_id"]: r for r in decontaminate.contamination(spark, df, spark.createDataFrame([(1, " ".join(words[1020:1040]))], "item_id long, text string")).collect()}
    assert hits[3]["contaminated"] and hits[1]["n_hit"] >= 20 and not hits[1]["contaminated"]
    assert sorted(r["slot"] for r in sharding.shard(spark, df, 1, "doc_id").collect()) == list(range(6))


def test_clashing_names(spark, corpus):
    """Columns with the names of an operator's own travel on under another name; the pipeline's stages return them as they came."""
    names = "doc_id long, text string, score string, Held_Out string, predicted string, n_lines string, n_dropped string, shard string, slot string, slot_ string, lines string, row string"
    df = spark.createDataFrame([(d, t, *"abcdefghij") for d, t in corpus[:40]], names)
    labels = spark.createDataFrame([(d, i % 2) for i, (d, _) in enumerate(corpus[:40])], "doc_id long, quality int")
    q = quality.quality_scores(spark, df, labels)
    assert {(r["score_"], r["Held_Out_"], r["predicted_"], r["row"]) for r in q.collect()} == {("a", "b", "c", "j")} and q.schema["score"].dataType.typeName() == "double"
    lines = line_dedup.dedup_lines(spark, df)
    assert {(r["n_lines_"], r["n_dropped_"], r["lines"]) for r in lines.collect()} == {("d", "e", "i")} and lines.schema["n_lines"].dataType.typeName() == "long"
    out = sharding.shard(spark, df, 3, "doc_id").collect()
    assert {(r["shard_"], r["slot__"], r["slot_"]) for r in out} == {("f", "g", "h")} and sorted({r["shard"] for r in out}) <= [0, 1, 2]
    import corpus_pipeline as c

    for f in (c.line_stage, c.near_stage):
        got = f(spark, df, SMALL)
        assert got.columns == df.columns and {tuple(r)[2:] for r in got.collect()} == {tuple("abcdefghij")}


def test_sharding_matches_its_definition(spark, corpus):
    """The query's rows against the rule: the shard with the largest seeded hash of key and number wins."""
    rows = spark.createDataFrame(corpus, "doc_id long, text string")
    got = sharding.shard(spark, rows, 40, "doc_id").collect()
    each = rows.select("doc_id", *[F.xxhash64(F.lit(20), F.xxhash64("doc_id"), F.lit(s)).alias(f"h{s}") for s in range(40)]).collect()
    want = {r["doc_id"]: max(range(40), key=lambda s: r[f"h{s}"]) for r in each}
    assert {r["doc_id"]: r["shard"] for r in got} == want
    for s in range(40):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(x == s for x in want.values())))
    order = [r["doc_id"] for r in sorted((r for r in got if r["shard"] == got[0]["shard"]), key=lambda r: r["slot"])]
    assert len(order) < 4 or order != sorted(order)


def test_lm_scores_match_brute_force(spark, corpus, monkeypatch):
    rows = corpus + [(corpus[0][0], corpus[0][1])]  # a repeated row is one document to the model
    want = brute.lm(rows)
    for slices, frequent in ((1, 1 << 16), (3, 5)):  # also where most counts are not broadcast
        monkeypatch.setattr(lm_score, "FREQUENT", frequent)
        out = lm_score.lm_scores(spark, docs(spark, rows), slices=slices).collect()
        assert len(out) == len(rows)
        for r in out:
            n, seen, score = want[r["doc_id"]]
            assert (r["n_tokens"], r["n_seen"]) == (n, seen) and (r["score"] is None) == (score is None) and (score is None or abs(r["score"] - score) < 1e-9)


def _shuffled_rows(spark):
    """Rows that all stages so far have written to shuffles."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._gateway.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_lm_scores_move_arrays_not_bigrams(spark):
    """Bigrams travel as arrays: the rows that shuffles carry are far fewer than the tokens."""
    rng = random.Random(4)
    v = vocabulary(3000)
    rows = [(i, " ".join(rng.choices(v, k=4000))) for i in range(150)]
    df, before = docs(spark, rows), _shuffled_rows(spark)
    out = lm_score.lm_scores(spark, df).collect()
    assert sum(r["n_tokens"] for r in out) == 600_000 and _shuffled_rows(spark) - before < 100_000


def test_lm_scores_of_copies(spark):
    """Many equal rows are one document; their texts are read as one, whatever their number."""
    rows = [(1, "a b c a b")] * 300 + [(None, "b c")] * 40 + [(None, "b c d"), (2, "a b"), (2, None), (2, None), (3, "")]
    want = brute.lm([(d, t or "") for d, t in rows])
    for slices in (1, 3):
        out = lm_score.lm_scores(spark, docs(spark, rows), slices=slices).collect()
        assert len(out) == len(rows)
        got = sorted(((r["n_tokens"], r["n_seen"], r["score"] and round(r["score"], 9)) for r in out if r["doc_id"] == 1 or r["n_tokens"] == 3), key=str)
        n, seen, score = want[1]
        assert got.count((n, seen, round(score, 9))) == 300 and sum(r["doc_id"] == 2 and r["score"] is None for r in out) == 2


def test_sorted_keys_that_share_their_first_bits():
    keys = np.array([7, 6, 1 << 63, 7, 6, 5, (1 << 63) + 1, 1 << 63], np.uint64)
    order, out, new = lm_score._sorted(keys)
    assert order.tolist() == np.argsort(keys, kind="stable").tolist() and (out == keys[order]).all() and new.tolist() == [True, True, False, True, False, True, False, True]


def test_quality_is_calibrated_and_blind(spark):
    """Scores depend on the text alone, and the network's odds fit what was held out."""
    rng, v = random.Random(14), vocabulary(200)
    rows = [(i, " ".join(rng.choice(v[:120] if i % 2 else v[80:]) for _ in range(rng.randint(4, 14)))) for i in range(2500)]
    labels = spark.createDataFrame([(d, d % 2) for d, _ in rows], "doc_id long, quality int")
    out = quality.quality_scores(spark, docs(spark, rows + [(d + 10_000, t) for d, t in rows[:50]]), labels).collect()
    score = {r["doc_id"]: r["score"] for r in out}
    assert all(score[d] == score[d + 10_000] for d, _ in rows[:50])
    held = [(r["score"], r["doc_id"] % 2) for r in out if r["held_out"] and r["doc_id"] < 10_000]
    assert sum((s >= 0.5) == bool(y) for s, y in held) > 0.85 * len(held)
    assert abs(np.mean([s for s, _ in held]) - np.mean([y for _, y in held])) < 0.1
    assert {r["predicted"] for r in out if r["score"] >= 0.3} == {1}


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_registered_queries(spark, name):
    """Every query over the small tables: against its SQL if it has any, else its rows and columns."""
    import oracle

    df = queries.queries()[name](spark, SMALL)
    if sql := queries.oracle_sql().get(name):
        assert oracle.compare(df, sql, SMALL) is None
        return
    docs_ = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows, texts = df.collect(), {r["doc_id"]: r["text"] for r in docs_.collect()}
    assert {r["doc_id"] for r in rows} == set(texts)
    if name.startswith("op1_"):
        for r in rows:
            raw = (texts[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 16, zlib.crc32(raw), "key") and r["grown_shard"] in (r["shard"], 40)
        for s in range(40):
            assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    elif name.startswith("op6_"):
        want = brute.lm(list(texts.items()))
        assert all((r["n_tokens"], r["n_seen"]) == want[r["doc_id"]][:2] and (r["score"] is None or abs(r["score"] - want[r["doc_id"]][2]) < 1e-9) for r in rows)
    elif name.startswith("op9_"):
        labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
        judged = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
        assert sum(r["predicted"] == labels[r["doc_id"]] for r in judged) >= 0.8 * len(judged)
    elif name.startswith("op10_"):
        import tokenizers

        tok = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
        ids = {d: np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for d, t in texts.items()}
        places = {}
        for r in rows:
            part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
            assert r["start"] == 2048 * r["piece"] and len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
            places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for p in places.values():
            assert [o for o, _ in sorted(p)] == np.cumsum([0, *(n for _, n in sorted(p))])[:-1].tolist() and sum(n for _, n in p) <= 2048
        total = sum(map(len, ids.values()))
        assert sum(r["length"] for r in rows) == total and len(places) <= -(-total // 2048) * 1.02 + 1


def test_empty_tables(spark):
    none = docs(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.quality_scores(spark, none, labels).count() == 0
    assert sharding.shard(spark, none, 3, "doc_id").count() == 0
    assert difference_cover.remove_repeats(spark, none).count() == 0
    assert near_dedup.near_duplicates(spark, none).count() == 0
    assert substring_dedup.remove_repeats(spark, none).count() == 0
    assert line_dedup.dedup_lines(spark, none).count() == 0
    assert decontaminate.contamination(spark, none, spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0
    assert lm_score.lm_scores(spark, none, slices=1).count() == 0
    assert packing.pack(spark, none, queries.tokenizer_path()).count() == 0
    assert embed_dedup.similar_embeddings(spark, spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_pipeline(spark):
    import corpus_pipeline as c

    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    scratch, d = common.Scratch(spark, "p"), table
    steps = []
    for name, stage in c.STAGES:
        d = scratch.put(stage(spark, d, SMALL), "s")
        steps.append(d)
    assert all(s.columns == table.columns for s in steps[:-1])
    ids = [{r[0]: r[1] for r in s.select("doc_id", "text").collect()} for s in steps[:-1]]
    lines = brute.lines(list(ids[0].items()))
    assert all(hashlib.sha256(t.encode()).hexdigest() == lines[i][2] for i, t in ids[1].items())
    assert set(ids[2]) == {i for i, v in brute.near(list(ids[1].items()), 5, 80).items() if v[2]}
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert set(ids[3]) == {i for i, v in brute.contaminated(list(ids[2].items()), items).items() if not v[4]}
    assert {r[0] for r in steps[4].select("doc_id").collect()} == set(ids[3])


def test_empty_pipeline(spark, tmp_path):
    import corpus_pipeline as c

    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert c.run(spark, str(tmp_path)).count() == 0
