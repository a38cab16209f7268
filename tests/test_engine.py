"""The engine against its oracle SQL, and the parts that no SQL covers."""

import datetime
import itertools
import os
import shutil

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import oracle
from millrace import queries as Q
from millrace.cube.cube import Cube
from millrace.cube.structure import Aggregation, Query, Structure, parse_query, plan
from millrace.functions import measures as M, predicates as P
from millrace.functions.scalar import translate_names
from millrace.operators import crdt, crdt_store, joins
from millrace.operators.dataset import Dataset
from millrace.plans.sql import SqlEngine
from millrace.session import Files, listing
from millrace.sources import logs
from millrace.sources.catalog import Catalog
from millrace.streaming.etl import LogLoader, Manifest

SMALL = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@here
@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_oracle(spark, name):
    assert oracle.compare(Q.QUERIES[name](spark, SMALL), Q.ORACLE[name], SMALL) is None


values = st.one_of(st.none(), st.integers(0, 4))
atoms = st.one_of(
    st.builds(P.eq, st.sampled_from("ab"), values), st.builds(P.not_eq, st.sampled_from("ab"), values), st.builds(P.gt, st.sampled_from("ab"), st.integers(0, 4)), st.builds(P.ge, st.sampled_from("ab"), st.integers(0, 4)),
    st.builds(P.lt, st.sampled_from("ab"), st.integers(0, 4)), st.builds(P.le, st.sampled_from("ab"), st.integers(0, 4)), st.builds(P.between, st.sampled_from("ab"), st.integers(0, 4), st.integers(0, 4)),
    st.lists(st.integers(0, 4), max_size=3).map(lambda v: P.in_("a", *v)), st.just(P.TRUE), st.just(P.FALSE),
)
predicates = st.recursive(atoms, lambda p: st.one_of(st.lists(p, max_size=3).map(lambda x: P.and_(*x)), st.lists(p, max_size=3).map(lambda x: P.or_(*x)), p.map(P.not_)), max_leaves=6)
ROWS = [{"a": a, "b": b} for a, b in itertools.product([None, *range(-1, 6)], repeat=2)]


@settings(max_examples=400, deadline=None)
@given(predicates)
def test_simplify_keeps_meaning(p):
    s = p.simplify()
    assert [s.test(r) for r in ROWS] == [p.test(r) for r in ROWS]
    assert P.from_json(P.to_json(s)).simplify() == s.simplify()


@settings(max_examples=300, deadline=None)
@given(predicates, predicates)
def test_implies_is_sound(p, q):
    if P.implies(p, q):
        assert all(q.test(r) for r in ROWS if p.test(r))


def test_predicate_cases(spark):
    assert P.and_(P.gt("k", 3), P.le("k", 3)).simplify() == P.FALSE
    assert P.and_(P.ge("k", 3), P.le("k", 3)).simplify() == P.eq("k", 3)
    assert P.or_().simplify() == P.TRUE and P.in_("k").simplify() == P.FALSE
    assert P.implies(P.between("k", 2, 3), P.gt("k", 1)) and not P.implies(P.gt("k", 1), P.between("k", 2, 3))
    rows = spark.createDataFrame([(None,), (1,), (2,)], "k int")
    for p in (P.eq("k"), P.not_eq("k"), P.not_eq("k", 1), P.not_(P.gt("k", 1)), P.regexp("k", "[12]")):
        assert rows.where(p.column()).count() == sum(p.test({"k": k}) for k in (None, 1, 2))


def _structure(**more):
    return Structure({"k1": "int", "k2": "int"}, {"m1": M.sum_("m1"), "m2": M.sum_("m2")}, aggregations={
        "both": Aggregation("both", ("k1", "k2"), ("m1", "m2")), "one": Aggregation("one", ("k1",), ("m1",)), "few": Aggregation("few", ("k1",), ("m1",), P.eq("k1", 7))}, **more)


def test_navigation_prefers_small_aggregations():
    s = _structure()
    size = {"both": 100, "one": 10, "few": 1}.get
    assert [c.aggregation.id for c in plan(s, Query(("k1",), ("m1",)), size).choices] == ["one"]
    assert [c.aggregation.id for c in plan(s, Query(("k1",), ("m1",), P.eq("k1", 7)), size).choices] == ["few"]
    assert [c.aggregation.id for c in plan(s, Query(("k1",), ("m1", "m2")), size).choices] == ["both"]
    assert plan(s, Query(("k1",), ("m1", "nothing")), size).dropped == ("nothing",)
    with pytest.raises(ValueError):
        plan(s, Query(("unknown",), ("m1",)))


def test_stored_cube_merges_compacts_and_evolves(spark, tmp_path):
    cube = Cube(spark, _structure(), str(tmp_path / "cube"))
    cube.load(spark.createDataFrame([(1, 2, 10, 20), (1, 3, 10, 20)], "k1 int, k2 int, m1 long, m2 long"))
    cube.load(spark.createDataFrame([(1, 3, 10, 20), (1, 4, 10, 20)], "k1 int, k2 int, m1 long, m2 long"))
    q = Query(("k1", "k2"), ("m1", "m2"), P.and_(P.eq("k1", 1), P.eq("k2", 3)))
    assert [tuple(r) for r in cube.query(q).rows.collect()] == [(1, 3, 20, 40)]
    assert cube.consolidate("both") == 2 and len(cube.chunks("both")) == 1
    assert [tuple(r) for r in cube.query(q).rows.collect()] == [(1, 3, 20, 40)]
    assert sum("chunks/both/" in c for c in cube.clean()) == 2
    s = _structure()
    s.measures["m3"] = M.sum_("m3")
    s.aggregations["both"] = Aggregation("both", ("k1", "k2"), ("m1", "m2", "m3"))
    wide = Cube(spark, s, str(tmp_path / "cube"))
    wide.load(spark.createDataFrame([(1, 3, 1, 1, 5)], "k1 int, k2 int, m1 long, m2 long, m3 long"))
    assert [tuple(r) for r in wide.query(Query(("k1", "k2"), ("m1", "m3"), P.eq("k2", 3))).rows.collect()] == [(1, 3, 21, 5)]
    with pytest.raises(RuntimeError):
        cube.commit(remove=["chunks/none"])


@here
def test_stored_query_merges_two_loads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Q, "shared_path", lambda *_: str(tmp_path / "cube"))
    assert oracle.compare(Q.QUERIES["cube_stored"](spark, SMALL), Q.ORACLE["cube_stored"], SMALL) is None
    m = Manifest(spark, str(tmp_path / "cube"))
    chunks = [[c for c in m.at(r).get("chunks", []) if c["aggregation"] == "by_type"] for r in range(1, m.latest()[0] + 1)]
    assert [len(c) for c in chunks] == [1, 2, 1] and not {c["path"] for c in chunks[1]} & {c["path"] for c in chunks[2]}


def test_report_parameters():
    q = parse_query({"attributes": "day,type", "measures": "n", "where": '["eq","type","x"]', "sort": "n:desc,day", "limit": "3", "reportType": "data_with_totals"})
    assert q.attributes == ("day", "type") and q.orderings == ("n desc", "day") and q.limit == 3 and q.where == P.eq("type", "x")


def test_hll_error(spark):
    ids = spark.range(100_000)
    m = M.distinct_count("n", "id", 12)
    part = ids.groupBy((F.col("id") % 7).alias("k")).agg(m.build().alias("n")).agg(m.merge(F.col("n")).alias("n"))
    assert abs(part.select(m.read(F.col("n"))).first()[0] / 100_000 - 1) < 0.06


def test_sql_surface(spark):
    c = Catalog(spark)
    c.add("student", [(4, "Mark", None, 3), (1, "John", "Doe", 1), (5, "Travis", "Moore", 10), (3, "John", "Truman", 2), (2, "Bob", "Black", 2)], "id int, firstName string, lastName string, dept int")
    c.add_merged("dups", spark.createDataFrame([(5, "Dawson", 2), (5, "Dawson", 3), (1, "Doe", 1)], "id int, lastName string, dept int"), ["id"], newest=["dept"])
    e = SqlEngine(spark)
    assert e.query("SELECT AVG(dept) FROM student").first()[0] == 3.6
    assert sorted(tuple(r) for r in e.query("SELECT * FROM dups").collect()) == [(1, "Doe", 1), (5, "Dawson", 3)]
    assert e.prepare("SELECT id FROM student WHERE dept = ? LIMIT ?")(2, 1).count() == 1
    assert e.query('SELECT "id" FROM student WHERE firstName = \'MAP_GET(x)\'').count() == 0
    assert translate_names("SELECT MAP_GET(a, 'LIST_GET(')") == "SELECT try_element_at(a, 'LIST_GET(')"
    assert translate_names("SELECT f(a), (b) FROM t") == "SELECT f(a), (b) FROM t"
    assert "Scan" in e.explain("SELECT id FROM student", "graph") or "LocalTable" in e.explain("SELECT id FROM student", "graph")
    with pytest.raises(ValueError):
        e.query("DROP TABLE student")


def test_only_reads(spark, tmp_path):
    e = SqlEngine(spark)
    spark.range(3).write.mode("overwrite").parquet(str(tmp_path / "t"))
    spark.read.parquet(str(tmp_path / "t")).createOrReplaceTempView("target")
    for sql in ("WITH x AS (SELECT 9L AS id) INSERT INTO target SELECT id FROM x", "WITH x AS (SELECT 1 AS a) FROM x INSERT OVERWRITE target SELECT a", "SELECT TRANSFORM(id) USING 'cat' FROM target; DROP VIEW target"):
        with pytest.raises(Exception):
            e.query(sql).collect()
    assert spark.table("target").count() == 3
    assert e.query("WITH x AS (SELECT 1 AS a) SELECT a FROM x UNION SELECT 2").count() == 2
    with pytest.raises(Exception, match="negative"):
        e.query("SELECT LIST_GET(array(1, 2), -1) AS x").collect()
    assert e.query("SELECT LIST_GET(array(1, (2)), 1) AS x, LIST_GET(array(1), 7) AS y, LIST_GET(LIST_GET(array(array(5)), 0), 0) AS z").first() == (2, None, 5)


def test_full_match_takes_no_newline(spark):
    rows = spark.createDataFrame([("abc",), ("abc\n",), ("xabc",)], "k string")
    p = P.regexp("k", "abc|x")
    assert [r["k"] for r in rows.where(p.column()).collect()] == ["abc"] == [k for k in ("abc", "abc\n", "xabc") if p.test({"k": k})]


def test_local_reduce_crosses_batches(spark):
    df = spark.range(25_000).select((F.col("id") * 0).alias("k"), "id").coalesce(1)
    out = Dataset(df).local_reduce(["k"], lambda g: g["id"].sum().reset_index(name="s"), "k long, s long").df.collect()
    assert [tuple(r) for r in out] == [(0, 25_000 * 24_999 // 2)]
    two = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k")).coalesce(1)
    out = Dataset(two).local_reduce(["k"], lambda g: g.size().reset_index(name="n"), "k long, n long").df.collect()
    assert sorted((str(r["k"]), r["n"]) for r in out) == [("1", 10_000), ("2", 10_000), ("None", 10_000)]


def test_log_positions(spark, tmp_path):
    """Files that are appended to an hour have names in any order; each is read once."""
    path, position, seen = str(tmp_path / "log"), None, []
    rows = lambda i: spark.sql(f"SELECT {i} AS id, TIMESTAMP '2024-01-01 05:30:00' AS ts, 'a' AS p")
    for i in range(8):
        logs.write_log(rows(i), path, "ts", "p")
        got, position = logs.read_log(spark, path, "a", position)
        seen += [r["id"] for r in got.collect()]
    assert seen == list(range(8)) and logs.read_log(spark, path, "a", position)[0] is None
    one, half = logs.read_log(spark, path, "a", None, limit=3)
    rest, whole = logs.read_log(spark, path, "a", half)
    assert one.count() == 3 and rest.count() == 5 and {d: sorted(n) for d, n in whole["files"].items()} == {d: sorted(n) for d, n in position["files"].items()}
    closed = logs.settle(position, "2024-01-01_06")
    assert closed == {"before": "2024-01-01_06", "files": {}} and logs.read_log(spark, path, "a", closed)[0] is None
    folder = next(iter(position["files"]))
    os.remove(f"{path}/{folder}/{position['files'][folder][0]}")
    with pytest.raises(RuntimeError):
        logs.read_log(spark, path, "a", position)


def test_loader_resumes_and_refuses_a_lost_checkpoint(spark, tmp_path):
    path, root = str(tmp_path / "log"), str(tmp_path / "loaded")
    rows = lambda i: spark.range(i, i + 5).select("id", F.lit("2024-01-01 05:30:00").cast("timestamp").alias("ts"), F.lit("a").alias("p"))
    loader = LogLoader(spark, root, {"n": lambda b: b.select("id")})
    for i in range(3):
        logs.write_log(rows(10 * i), path, "ts", "p")
        assert loader.run(path, files_per_step=1) >= 1 and loader.run(path) == 0
        loader.stream(path, "id long, ts timestamp, p string")
    assert loader.read("n").count() == 30 and loader.read("n").distinct().count() == 15  # once by each way
    again = LogLoader(spark, root, {"n": lambda b: b.select("id")})  # nothing but the manifest is needed
    assert again.run(path) == 0
    shutil.rmtree(f"{root}/checkpoint")
    logs.write_log(rows(100), path, "ts", "p")
    with pytest.raises(RuntimeError):
        loader.stream(path, "id long, ts timestamp, p string")
    assert loader.run(path) >= 1 and loader.read("n").count() == 35
    with pytest.raises(RuntimeError):
        loader.consume(rows(0), 99, "gap")


def test_changes_meet():
    from millrace.streaming.ot import Change, Conflict, squash, transform

    state = {"positions": {"log": 5}, "chunks": ["a", "b"]}
    x, y = Change({"log": (5, 9)}, frozenset("c"), frozenset("a")), Change({"log": (5, 7)}, frozenset("d"))
    to_x, to_y = transform(x, y)
    assert to_x.apply(x.apply(state)) == to_y.apply(y.apply(state)) == {"positions": {"log": 9}, "chunks": ["b", "c"]}
    p, q = Change(added=frozenset("e")), Change({"other": (0, 3)}, removed=frozenset("b"))
    after_p, after_q = transform(p, q)
    assert after_p.apply(p.apply(state)) == after_q.apply(q.apply(state))
    assert squash([x, x.invert()]).apply(state) == state and squash([x, Change({"log": (9, 12)}, frozenset("f"), frozenset("c"))]) == Change({"log": (5, 12)}, frozenset("f"), frozenset("a"))
    for bad in (lambda: y.apply(x.apply(state)), lambda: squash([x, x]), lambda: transform(Change(removed=frozenset("a")), Change(removed=frozenset("a")))):
        with pytest.raises(Conflict):
            bad()


def test_store_takes_compacts_and_logs_ahead(spark, tmp_path):
    states = {"n": crdt_store.counted(), "top": crdt_store.largest("v")}
    s = crdt_store.CrdtStore(spark, str(tmp_path / "s"), ["k"], states)
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 3), ("b", 1, 9)], "k string, ts int, v int")
    for _ in range(3):
        s.upload(rows)
    want = [("a", 2, 6, 5), ("b", 1, 3, 9)]
    read = lambda: sorted(tuple(r) for r in s.download().collect())
    assert read() == want and s.compact() == 3 and read() == want and len(s.folders()) == 1 and len(s.clean()) == 3 and read() == want
    s.remove(spark.createDataFrame([("b", 1)], "k string, ts int"))
    assert read() == want[:1] and s.compact(everything=True) == 2 and read() == want[:1]
    s.upload(rows)  # the tombstone outlives compaction
    assert [r[0] for r in read()] == ["a"] and s.get(k="a").count() == 1 and s.download(since=3).count() == 0
    with pytest.raises(ZeroDivisionError), s.take() as state:
        assert state.count() == 1
        raise ZeroDivisionError
    assert read()
    with s.take() as state:
        assert state.count() == 1
    assert s.folders() == []
    wal = crdt_store.WriteAheadLog(spark, str(tmp_path / "wal"), "k string, ts int, v int")
    wal.put("z", 1, 1)
    name = wal.flush()
    assert wal.flush() is None
    s.upload(spark.createDataFrame([("z", 1, 1)], "k string, ts int, v int"), once=name)  # as if it fell over before deleting
    assert wal.upload(s) == 1 and read() == [("z", 1, 1, 1)] and wal.upload(s) == 0


def test_date_conditions_read_fewer_files(spark, tmp_path):
    s = Structure({"day": "date", "k": "int"}, {"n": M.sum_("n")}, aggregations={"a": Aggregation("a", ("day", "k"), ("n",), chunk_rows=10)})
    cube = Cube(spark, s, str(tmp_path / "cube"))
    day = lambda i: datetime.date(2024, 1, 1) + datetime.timedelta(days=i)
    for start in (0, 40):
        cube.load(spark.createDataFrame([(day(start + i), i if i % 5 else None, 1) for i in range(40)], "day date, k int, n long"))
    every = cube.files("a")
    few = cube.files("a", P.le("day", day(3)).simplify())
    assert 0 < len(few) < len(every) / 2
    assert len(cube.files("a", P.eq("k", None))) > 0 and cube.files("a", P.gt("k", 1000)) == []
    assert [tuple(r) for r in cube.query(Query(("day",), ("n",), P.le("day", day(1)), orderings=("day",))).rows.collect()] == [(day(0), 1), (day(1), 1)]
    assert cube.query(Query((), ("n",), P.eq("k", None))).rows.first()["n"] == 16
    assert cube.query(Query(("day",), ("n",), P.gt("day", day(500)))).rows.count() == 0
    copy = cube.backup(str(tmp_path / "copy"))
    assert copy.query(Query((), ("n",))).rows.first()["n"] == 80
    with cube.locked("a") as got, cube.locked("a") as second:
        assert got and not second
    assert cube.consolidate("a", strategy="hot") == 0  # the two runs share no days
    assert cube.maintain() == {"a": 0} and cube.consolidate("a", strategy="size") == 0
    small = Aggregation("a", ("day", "k"), ("n",), chunk_rows=1000)
    s.aggregations["a"] = small
    assert cube.consolidate("a", strategy="size") == 2 and cube.query(Query((), ("n",))).rows.first()["n"] == 80


def test_parents_and_pinned_keys(spark):
    s = Structure({"country": "string", "city": "string"}, {"n": M.count_("n")}, parents={"city": "country"}, aggregations={"both": Aggregation("both", ("country", "city"), ("n",)), "child": Aggregation("child", ("city",), ("n",))})
    q = plan(s, Query(("city",), ("n",)))
    assert q.dimensions == ("country", "city") and [c.aggregation.id for c in q.choices] == ["both"]
    cube = Cube(spark, s)
    cube.load(spark.createDataFrame([("x", "a"), ("y", "a"), ("y", "b")], "country string, city string"))
    assert sorted(tuple(r) for r in cube.query(Query(("city",), ("n",))).rows.collect()) == [("a", 2), ("b", 1)]
    del s.aggregations["both"]
    assert plan(s, Query(("city",), ("n",))).dimensions == ("city",)


def test_precondition_raises(spark):
    s = Structure({"k": "int"}, {"n": M.count_("n")}, aggregations={"a": Aggregation("a", ("k",), ("n",))})
    cube = Cube(spark, s)
    cube.load(spark.createDataFrame([(1,), (-1,)], "k int"), check={"k": P.ge("k", 0)})
    with pytest.raises(Exception, match="precondition"):
        cube.query(Query(("k",), ("n",))).rows.collect()


def test_sources(spark, tmp_path):
    c = Catalog(spark)
    assert c.add("made", lambda: iter([(1,), (2,)]), "id int").count() == 2
    c.add_failing("bad", "no such thing", "id int")
    with pytest.raises(Exception, match="no such thing"):
        spark.table("bad").collect()
    files = Files(spark, str(tmp_path))
    files.write("d/a.txt", "hello")
    files.append("d/a.txt", " you")
    files.copy("d/a.txt", "d/b.txt")
    assert files.read_range("d/b.txt", 6, 2) == b"yo" and files.move("d/b.txt", "c.txt") and files.names("d") == ["a.txt"]
    assert [r["length"] for r in listing(spark, str(tmp_path), "*.txt").collect()] == [9, 9]
    seen = spark.sparkContext.accumulator(0)
    done = []
    Dataset(spark.range(5)).for_each(lambda rows: seen.add(sum(1 for _ in rows)), lambda: done.append(1))
    assert seen.value == 5 and done == [1] and Dataset(spark.range(3)).drain() is None
    assert Dataset(spark.createDataFrame([(1,), (None,)], "k int")).lenient("k").df.count() == 1
    with pytest.raises(ValueError):
        crdt_store.CrdtStore(spark, "s3a://somewhere/x", ["k"], {})


def test_wide_intervals_touch_two_buckets(spark):
    left = spark.range(0, 2000, 7).select(F.col("id").alias("p"))
    right = spark.createDataFrame([(0, 0, 10**12), (1, 5, 9), (2, 100, 100), (3, 50, 20), (4, -5, 3000)], "r int, lo long, hi long")
    got = sorted((r["p"], r["r"]) for r in joins.range_join(left, right, "p", "lo", "hi", 8).collect())
    assert got == sorted((p, r) for p in range(0, 2000, 7) for r, lo, hi in ((0, 0, 10**12), (1, 5, 9), (2, 100, 100), (4, -5, 3000)) if lo <= p <= hi)


def test_batches_count_once(spark, tmp_path):
    loader = LogLoader(spark, str(tmp_path), {"n": lambda b: b.agg(F.count("*").alias("n"))})
    rows = spark.range(10)
    loader.consume(rows, 0)
    loader.consume(rows, 0)  # the same batch again after a failure
    loader.consume(rows, 1)
    with pytest.raises(RuntimeError):
        loader.consume(rows, 5)
    assert loader.read("n").agg(F.sum("n")).first()[0] == 20
    m = Manifest(spark, str(tmp_path))
    revision, state = m.latest()
    assert m.commit(revision, state) and not m.commit(revision, state)


def test_crdt_laws(spark):
    rows = [("a", r, v) for r, v in ((0, 3), (1, 5), (0, 4))]
    df = spark.createDataFrame(rows, "k string, r int, v long")
    once = crdt.g_counter(df, ["k"], "r", "v").first()["value"]
    assert once == 9 == crdt.g_counter(df.union(df), ["k"], "r", "v").first()["value"]
    state = spark.createDataFrame([("a", 1, False, 1), ("a", 2, True, None), ("a", 2, False, 5), ("a", 3, False, 7), ("b", 1, True, None)], "k string, ts int, tombstone boolean, v int")
    assert [tuple(r) for r in crdt.merge_state(state, ["k"], {"v": F.sum("v")}).collect()] == [("a", 3, 7)]
    assert all(len(set(r["owners"])) == 2 for r in crdt.owners(df, ["k"], ["x", "y", "z"], 2).collect())
