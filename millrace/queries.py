"""One query per operator of the engine, and the SQL that gives the same rows."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .cube.cube import Cube
from .cube.structure import Aggregation, Attribute, DATA_WITH_TOTALS, Query, Structure
from .functions import measures as M, predicates as P
from .functions.scalar import list_get, map_get, negate, regexp_full
from .operators import crdt, crdt_store, joins, reducers
from .operators.dataset import Dataset, page_rank
from .plans.sql import SqlEngine, compat_avg, compat_sum, global_aggregate, order
from .session import shared_path
from .sources.catalog import Catalog, concat
from .sources.logs import read_log, settle, write_log
from .streaming.etl import LogLoader, sessions, windowed

TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def sql_query(name: str, sql: str, params=None, oracle: str | None = None, tables: str = "") -> None:
    """The same text for both engines, or an oracle of its own with the parameters put in."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        Catalog(spark).add_folder(d, *[n for n in TABLES if n in (tables or sql)])
        return SqlEngine(spark).query(sql, params)

    query(name, oracle or sql)(run)


# aggregation
sql_query(
    "agg_groupby_q1",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
       round(avg(l_discount), 4) AS disc, min(l_shipdate) AS first_ship, max(l_extendedprice) AS top_price
       FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
)
sql_query("agg_global", "SELECT count(*) AS n, count(o_custkey) AS c, round(sum(o_totalprice), 2) AS s, round(avg(o_totalprice), 2) AS a, min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders")
sql_query("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
sql_query("agg_distinct_rows", "SELECT DISTINCT p_brand, p_size FROM part")
sql_query("agg_distinct_count", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag")
sql_query("agg_null_keys", "SELECT nullif(o_orderpriority, '1-URGENT') AS p, count(*) AS n FROM orders GROUP BY nullif(o_orderpriority, '1-URGENT')")


@query("agg_empty_compat", "SELECT count(*) AS n FROM orders WHERE false HAVING count(*) > 0")
def _agg_empty(spark, d):
    return global_aggregate(t(spark, d, "orders").where("false"), F.count("*").alias("n"))


@query("agg_sum_avg_compat", "SELECT o_orderstatus, coalesce(sum(nullif(o_custkey, o_custkey)), 0)::BIGINT AS s, coalesce(avg(nullif(o_custkey, o_custkey)), 0)::DOUBLE AS a FROM orders GROUP BY o_orderstatus")
def _agg_compat(spark, d):
    none = F.nullif(F.col("o_custkey"), F.col("o_custkey"))
    return t(spark, d, "orders").groupBy("o_orderstatus").agg(compat_sum(none).cast("long").alias("s"), compat_avg(none).alias("a"))


# predicates
for _name, _p in {
    "eq": "p_size = 10", "ne": "p_brand <> 'Brand#1'", "gt": "p_size > 40", "ge": "p_size >= 40", "lt": "p_retailprice < 950", "le": "p_size <= 3", "between": "p_size BETWEEN 10 AND 12",
    "in": "p_size IN (1, 5, 9)", "not_in": "p_size NOT IN (1, 5, 9)", "like": "p_brand LIKE 'Brand#1%'", "not_like": "p_brand NOT LIKE 'Brand#1%'", "null": "nullif(p_size, 7) IS NULL",
    "not_null": "nullif(p_size, 7) IS NOT NULL", "and": "p_size > 5 AND p_size < 9", "or": "p_size = 5 OR p_brand = 'Brand#2'", "not": "NOT (p_size > 5)", "false": "false", "true": "true",
}.items():
    sql_query(f"where_{_name}", f"SELECT p_partkey, p_brand, p_size FROM part WHERE {_p}")


@query("two_valued_not", "SELECT p_partkey FROM part WHERE NOT coalesce(nullif(p_brand, 'Brand#2') LIKE 'Brand#1%', false)")
def _two_valued(spark, d):
    return t(spark, d, "part").where(negate(F.nullif(F.col("p_brand"), F.lit("Brand#2")).like("Brand#1%"))).select("p_partkey")


sql_query("temporal_eq_gt", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > CAST('1997-06-01 00:00:00' AS TIMESTAMP) AND cast(o_orderdate AS DATE) <> CAST('1997-12-31' AS DATE)")
sql_query("enum_eq", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH'")
sql_query("param_where", "SELECT p_partkey FROM part WHERE p_size = ? AND p_brand = ?", [10, "Brand#1"], "SELECT p_partkey FROM part WHERE p_size = 10 AND p_brand = 'Brand#1'")
sql_query("param_limit", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT ? OFFSET ?", [7, 3], "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7 OFFSET 3")

# projections and functions
sql_query("proj_rename", "SELECT c_name AS customer, c_custkey AS id FROM customer")
sql_query("proj_literal", "SELECT n_name, 5 AS five, 'x' AS x FROM nation")
sql_query("proj_subselect", "SELECT s.k FROM (SELECT s_suppkey AS k, s_acctbal AS b FROM supplier) s WHERE s.b > 0")
sql_query("values_union", "SELECT 1 AS a, 'x' AS b UNION SELECT 2, 'y' UNION SELECT 1, 'x'", tables="region")
sql_query("fn_ifnull", "SELECT o_orderkey, IFNULL(nullif(o_orderstatus, 'F'), 'none') AS s FROM orders")
sql_query("fn_cast", "SELECT o_orderkey, cast(o_totalprice AS DOUBLE) AS d, cast('2020-02-03' AS DATE) AS day, cast('12' AS INT) AS i FROM orders")


@query("fn_map_get", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS f FROM orders")
def _map_get(spark, d):
    t(spark, d, "orders").select("o_orderkey", F.create_map("o_orderstatus", "o_custkey").alias("m")).createOrReplaceTempView("om")
    return SqlEngine(spark).query("SELECT o_orderkey, MAP_GET(m, 'F') AS f FROM om")


@query("fn_list_get", "SELECT vec_id, embedding[3] AS x, embedding[1000] AS none FROM embeddings")
def _list_get(spark, d):
    return t(spark, d, "embeddings").select("vec_id", list_get(F.col("embedding"), 2).alias("x"), list_get(F.col("embedding"), 999).alias("none"))


@query("fn_struct", "SELECT c_custkey, c_name AS n, c_acctbal AS b FROM customer")
def _struct(spark, d):
    s = t(spark, d, "customer").select("c_custkey", F.struct(F.struct("c_name", "c_acctbal").alias("in")).alias("s"), F.create_map(F.lit("k"), F.struct("c_acctbal")).alias("m"))
    return s.select("c_custkey", F.col("s.in.c_name").alias("n"), map_get(F.col("m"), "k")["c_acctbal"].alias("b"))


# joins
sql_query("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
sql_query("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
sql_query("join_comma", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND r_regionkey < 3")
sql_query("join_three", "SELECT c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
sql_query("join_self3", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, c.n_nationkey AS c FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey JOIN nation c ON b.n_regionkey = c.n_regionkey")
sql_query("join_multi_key", "SELECT count(*) AS n FROM lineitem a JOIN (SELECT l_orderkey AS k, l_linenumber AS ln, max(l_quantity) AS q FROM lineitem GROUP BY l_orderkey, l_linenumber) b ON a.l_orderkey = b.k AND a.l_linenumber = b.ln")


@query("join_nullsafe", "SELECT a.c_custkey AS a, b.n_nationkey AS b FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer) a JOIN (SELECT n_nationkey, nullif(n_nationkey, 3) AS k FROM nation) b ON a.k IS NOT DISTINCT FROM b.k")
def _nullsafe(spark, d):
    a = t(spark, d, "customer").select(F.col("c_custkey").alias("a"), F.nullif(F.col("c_nationkey"), F.lit(3)).alias("k"))
    b = t(spark, d, "nation").select(F.col("n_nationkey").alias("b"), F.nullif(F.col("n_nationkey"), F.lit(3)).alias("k"))
    return Dataset(a).join(Dataset(b), ["k"]).df.select("a", "b")


@query("join_lookup_first", "SELECT n_nationkey, c_name FROM nation LEFT JOIN (SELECT c_nationkey, c_name FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) = 1) ON n_nationkey = c_nationkey")
def _lookup(spark, d):
    c = t(spark, d, "customer")
    return joins.lookup_join(t(spark, d, "nation"), c, [("n_nationkey", "c_nationkey")], ["c_custkey"]).select("n_nationkey", "c_name")


@query("join_sort_merge", "SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def _merge_join(spark, d):
    return joins.merge_join(t(spark, d, "orders"), t(spark, d, "customer"), [("o_custkey", "c_custkey")]).select("o_orderkey", "c_mktsegment")


@query("join_attribute", "SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def _attribute(spark, d):
    return joins.attribute_join(t(spark, d, "supplier"), t(spark, d, "nation"), [("s_nationkey", "n_nationkey")]).select("s_suppkey", "n_name")


# order, limits, sets
sql_query("topk_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
sql_query("sort_expression", "SELECT o_orderkey FROM orders ORDER BY o_totalprice * -1, o_orderkey LIMIT 20")
sql_query("union_all", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
sql_query("union_distinct", "SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region")
sql_query("union_3way", "SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region UNION SELECT p_size FROM part")


@query("sort_multi_nulls", "SELECT p_partkey, s FROM (SELECT p_partkey, nullif(p_size, 1) AS s FROM part) ORDER BY s ASC NULLS LAST, p_partkey DESC LIMIT 50")
def _sort_nulls(spark, d):
    return Dataset(t(spark, d, "part").select("p_partkey", F.nullif(F.col("p_size"), F.lit(1)).alias("s"))).top("s", "p_partkey desc", limit=50).df


@query("offset_limit", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 11 OFFSET 100")
def _offset(spark, d):
    return Dataset(t(spark, d, "customer").select("c_custkey")).sort("c_custkey").offset_limit(100, 11).df


@query("local_limit", "SELECT least(count(*), 4) AS n FROM customer")
def _local_limit(spark, d):
    parts = Dataset(t(spark, d, "customer").repartition(3, "c_custkey").withColumn("p", F.spark_partition_id()))
    each = parts.local_limit(4).df.groupBy("p").agg(F.count("*").alias("n"))
    return each.agg(F.max("n").cast("long").alias("n"))


@query("until_first", "SELECT c_custkey FROM customer WHERE c_custkey <= (SELECT min(c_custkey) FROM customer WHERE c_acctbal < 0)")
def _until(spark, d):
    return Dataset(t(spark, d, "customer").select("c_custkey", "c_acctbal")).until(F.col("c_acctbal") < 0, ["c_custkey"]).df.select("c_custkey")


@query("concat_parts", "SELECT n_name AS x, 0 AS part FROM nation UNION ALL SELECT r_name, 1 FROM region")
def _concat(spark, d):
    return concat(t(spark, d, "nation").select(F.col("n_name").alias("x")), t(spark, d, "region").select(F.col("r_name").alias("x")))


@query("split_routes", "SELECT CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS route, count(*) AS n FROM orders GROUP BY 1")
def _split(spark, d):
    routes = Dataset(t(spark, d, "orders")).split(big=F.col("o_totalprice") > 100000, small=F.col("o_totalprice") <= 100000)
    parts = [r.df.select(F.lit(n).alias("route")) for n, r in routes.items()]
    return parts[0].union(parts[1]).groupBy("route").agg(F.count("*").alias("n"))


@query("repartition_sort", "SELECT c_custkey FROM customer")
def _repartition(spark, d):
    return Dataset(t(spark, d, "customer")).repartition_sort("c_nationkey", "c_custkey").df.select("c_custkey")


# dataset reducers
_WORDS = "SELECT w, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY w"


@query("ds_wordcount", _WORDS)
def _wordcount(spark, d):
    return Dataset(t(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("w"))).reduce(["w"], n=reducers.COUNT).df


@query("ds_split_reduce", "SELECT l_suppkey, round(sum(l_quantity), 2) AS q, round(avg(l_quantity), 4) AS a FROM lineitem GROUP BY l_suppkey")
def _split_reduce(spark, d):
    out = Dataset(t(spark, d, "lineitem")).split_reduce(["l_suppkey"], q=reducers.SUM("l_quantity"), a=reducers.MEAN("l_quantity")).df
    return out.select("l_suppkey", F.round("q", 2).alias("q"), F.round("a", 4).alias("a"))


@query("ds_reduce_max_by", "SELECT user_id, max_by(event_id, ts) AS e FROM events GROUP BY user_id")
def _max_by(spark, d):
    return Dataset(t(spark, d, "events")).reduce(["user_id"], e=reducers.MAX_BY("event_id", "ts")).df


@query("ds_two_phase", "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY o_orderpriority")
def _two_phase(spark, d):
    r = {"n": reducers.COUNT, "s": reducers.SUM("o_totalprice")}
    out = reducers.accumulator_to_output(reducers.input_to_accumulator(t(spark, d, "orders"), ["o_orderpriority"], r), ["o_orderpriority"], r)
    return out.select("o_orderpriority", "n", F.round("s", 2).alias("s"))


@query("ds_reduce_inputs", "SELECT k, sum(o) AS orders, sum(c) AS customers FROM (SELECT o_custkey % 25 AS k, 1 AS o, NULL AS c FROM orders UNION ALL SELECT c_nationkey, NULL, 1 FROM customer) GROUP BY k")
def _reduce_inputs(spark, d):
    o = t(spark, d, "orders").select((F.col("o_custkey") % 25).alias("k"))
    c = t(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("k"))
    return reducers.reduce_inputs([(o, {"orders": reducers.COUNT}), (c, {"customers": reducers.COUNT})], ["k"])


@query("ds_python_reduce", "SELECT c_nationkey, count(*) AS result FROM customer GROUP BY c_nationkey")
def _python_reduce(spark, d):
    return reducers.python_reduce(t(spark, d, "customer").select("c_nationkey"), ["c_nationkey"], int, lambda a, _: a + 1, lambda a, b: a + b, lambda a: a, "long")


@query("ds_dedup_first", "SELECT c_nationkey, min(c_custkey) AS c_custkey FROM customer GROUP BY c_nationkey")
def _dedup(spark, d):
    return reducers.deduplicate(t(spark, d, "customer").select("c_nationkey", "c_custkey"), ["c_nationkey"])


@query("ds_pagerank", """WITH p AS (SELECT n_nationkey AS page, (n_nationkey * 7 + i) % 25 AS dst FROM nation, (SELECT unnest([1, 2, 5]) AS i)),
  r0 AS (SELECT n_nationkey AS page, 1.0::DOUBLE AS rank FROM nation),
  r1 AS (SELECT n_nationkey AS page, 0.15 + 0.85 * coalesce(sum(rank / 3), 0) AS rank FROM nation LEFT JOIN (SELECT dst, rank FROM p JOIN r0 USING (page)) ON dst = n_nationkey GROUP BY 1),
  r2 AS (SELECT n_nationkey AS page, 0.15 + 0.85 * coalesce(sum(rank / 3), 0) AS rank FROM nation LEFT JOIN (SELECT dst, rank FROM p JOIN r1 USING (page)) ON dst = n_nationkey GROUP BY 1)
  SELECT page, round(rank, 6) AS rank FROM r2""")
def _pagerank(spark, d):
    k = F.col("n_nationkey")
    pages = t(spark, d, "nation").select(k.alias("page"), F.array(*[(k * 7 + i) % 25 for i in (1, 2, 5)]).alias("links"))
    return page_rank(spark, pages, 2, shared_path(spark, "pagerank")).select("page", F.round("rank", 6).alias("rank"))


# merge on read
@query("merge_table_latest", "SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def _merge_latest(spark, d):
    return Catalog(spark).add_merged("latest", t(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], newest=["ts"])


@query("merge_table_reducer", "SELECT user_id, count(*) AS n, max(ts) AS ts FROM events GROUP BY user_id")
def _merge_reducer(spark, d):
    return Catalog(spark).add_merged("reduced", t(spark, d, "events"), ["user_id"], merge={"n": F.count("*"), "ts": F.max("ts")})


@query("merge_table_no_key", "SELECT DISTINCT event_type, user_id FROM events")
def _merge_plain(spark, d):
    return Catalog(spark).add_merged("plain", t(spark, d, "events").select("event_type", "user_id"))


@query("scan_pruned", "SELECT p_partkey FROM part WHERE p_size BETWEEN 20 AND 22")
def _pruned(spark, d):
    c = Catalog(spark)
    c.add_pruned("parts", lambda p: t(spark, d, "part") if p is None else t(spark, d, "part").where(p))
    return c.table("parts", F.col("p_size").between(20, 22)).select("p_partkey")


# cube
def events_cube(spark, d, root=None, parts=("true",)) -> Cube:
    """The events' cube; each of ``parts``, conditions that share the events out, is a load of its own."""
    s = Structure(
        dimensions={"day": "date", "event_type": "string", "user_id": "long"},
        measures={
            "events": M.count_("events"), "total": M.sum_("total", "value"), "squares": M.sum_("squares"), "low": M.min_("low", "value"), "high": M.max_("high", "value"),
            "users": M.distinct_count("users", "user_id"), "types": M.union_("types", "event_type"), "last_value": M.last("last_value", "value", "ts"),
            "last_even": M.last("last_even", "even", "ts", not_null=True),
        },
        computed={
            "mean": M.div("total", "events"), "spread": M.stddev("total", "squares", "events"), "share": M.percent("high", "total"), "range": M.sub("high", "low"), "zero": M.div("total", M.value(0)),
            "both": M.add("events", "total"), "product": M.mul("low", "high"), "hundredfold": M.percent("events"), "root": M.sqrt("total"), "square": M.sqr("high"),
            "noise": M.variance("total", "squares", "events"), "constant": M.value(7), "same": M.measure("total"),
        },
        attributes={"user": Attribute(("user_id",), lambda: t(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment")), ("segment",))},
        validity={"event_type": P.not_eq("event_type", "error")},
        aggregations={
            "daily": Aggregation("daily", ("day",), ("events", "total", "squares", "low", "high", "users", "types")),
            "by_type": Aggregation("by_type", ("day", "event_type"), ("events", "total", "squares", "low", "high", "users")),
            "valid": Aggregation("valid", ("event_type", "user_id"), ("events", "total"), P.has("event_type")),
            "full": Aggregation("full", ("day", "event_type", "user_id"), ("events", "total", "squares", "low", "high", "last_value", "last_even")),
        },
    )
    cube = Cube(spark, s, root)
    for part in parts:
        cube.load(t(spark, d, "events").where(part).select(F.to_date("ts").alias("day"), "event_type", "user_id", "value", "ts", (F.col("value") * F.col("value")).alias("squares"), F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("even")))
    return cube


def cube_query(name: str, sql: str, round_to: int = 4, **q) -> None:
    def run(spark, d):
        rows = events_cube(spark, d).query(Query(**q)).rows
        return rows.select(*[F.round(f"`{f.name}`", round_to).alias(f.name) if f.dataType.typeName() == "double" else F.col(f"`{f.name}`").alias(f.name.replace(".", "_")) for f in rows.schema.fields])

    query(name, sql)(run)


_DAY = "cast(ts AS DATE) AS day"
cube_query("cube_daily", f"SELECT {_DAY}, count(*) AS events, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high FROM events GROUP BY 1", attributes=("day",), measures=("events", "total", "low", "high"))
cube_query("cube_by_type", "SELECT event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1", attributes=("event_type",), measures=("events", "total"))
cube_query("cube_nav", "SELECT event_type, user_id, count(*) AS events FROM events WHERE event_type <> 'error' GROUP BY 1, 2", attributes=("event_type", "user_id"), measures=("events",), where=P.not_eq("event_type", "error"))
cube_query("cube_having", "SELECT user_id, count(*) AS events FROM events GROUP BY 1 HAVING count(*) > 70", attributes=("user_id",), measures=("events",), having=P.gt("events", 70))
cube_query("cube_computed", f"SELECT {_DAY}, round(sum(value) / count(*), 4) AS mean, round(sqrt(greatest(sum(value * value) / count(*) - power(sum(value) / count(*), 2), 0)), 4) AS spread, round(max(value) - min(value), 4) AS range, 0.0 AS zero FROM events GROUP BY 1", attributes=("day",), measures=("mean", "spread", "range", "zero"))
cube_query("cube_order_limit", "SELECT user_id, count(*) AS events FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5 OFFSET 2", attributes=("user_id",), measures=("events",), orderings=("events desc", "user_id"), limit=5, offset=2)
cube_query("cube_regexp", "SELECT event_type, count(*) AS events FROM events WHERE regexp_full_match(event_type, '[cv].*k?') GROUP BY 1", attributes=("event_type",), measures=("events",), where=P.regexp("event_type", "[cv].*k?"))
cube_query("cube_in", "SELECT event_type, count(*) AS events FROM events WHERE event_type IN ('click', 'view') GROUP BY 1", attributes=("event_type",), measures=("events",), where=P.in_("event_type", "click", "view"))
cube_query("cube_between", "SELECT user_id, count(*) AS events FROM events WHERE user_id BETWEEN 10 AND 20 GROUP BY 1", attributes=("user_id",), measures=("events",), where=P.between("user_id", 10, 20))
cube_query("cube_or_not", "SELECT user_id, count(*) AS events FROM events WHERE user_id < 5 OR NOT (user_id <= 95) GROUP BY 1", attributes=("user_id",), measures=("events",), where=P.or_(P.lt("user_id", 5), P.not_(P.le("user_id", 95))))
cube_query("cube_attr", "SELECT user_id, c_mktsegment AS user_segment, count(*) AS events FROM events LEFT JOIN customer ON c_custkey = user_id GROUP BY 1, 2", attributes=("user_id", "user.segment"), measures=("events",))
cube_query("cube_last", "SELECT event_type, max_by(value, ts) AS last_value FROM events GROUP BY 1", attributes=("event_type",), measures=("last_value",))
cube_query("cube_last_not_null", "SELECT event_type, max_by(value, ts) FILTER (WHERE event_id % 2 = 0 AND value IS NOT NULL) AS last_even FROM events GROUP BY 1", attributes=("event_type",), measures=("last_even",))
cube_query(
    "cube_formulas",
    f"""SELECT {_DAY}, round(count(*) + sum(value), 4) AS both, round(min(value) * max(value), 4) AS product, count(*) * 100 AS hundredfold, round(CASE WHEN sum(value) > 0 THEN sqrt(sum(value)) ELSE 0 END, 4) AS root,
       round(max(value) * max(value), 4) AS square, round(sum(value * value) / count(*) - power(sum(value) / count(*), 2), 2) AS noise, 7 AS constant, round(sum(value), 4) AS same,
       round(CASE WHEN sum(value) <> 0 THEN max(value) / sum(value) ELSE 0 END * 100, 4) AS share FROM events GROUP BY 1""".replace("2) AS noise", "4) AS noise"),
    attributes=("day",), measures=("both", "product", "hundredfold", "root", "square", "noise", "constant", "same", "share"),
)
cube_query("cube_attr_constant", "SELECT (SELECT c_mktsegment FROM customer WHERE c_custkey = 7) AS user_segment, count(*) AS events FROM events WHERE user_id = 7", attributes=("user.segment",), measures=("events",), where=P.eq("user_id", 7))
cube_query("cube_union", f"SELECT {_DAY}, list_sort(list(DISTINCT event_type)) AS types FROM events GROUP BY 1", attributes=("day",), measures=("types",))
cube_query("cube_multi_aggregation", f"SELECT {_DAY}, list_sort(list(DISTINCT event_type)) AS types, max_by(value, ts) AS last_value FROM events GROUP BY 1", attributes=("day",), measures=("types", "last_value"))


@query("cube_totals", "SELECT count(*) AS events, round(sum(value), 2) AS total, (SELECT count(*) FROM (SELECT user_id FROM events GROUP BY 1 HAVING count(*) > 70)) AS total_count FROM events")
def _totals(spark, d):
    r = events_cube(spark, d).query(Query(("user_id",), ("events", "total"), having=P.gt("events", 70), report=DATA_WITH_TOTALS))
    return r.totals.select("events", F.round("total", 2).alias("total"), F.lit(r.total_count).cast("long").alias("total_count"))


@query("cube_stored", f"SELECT {_DAY}, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _stored(spark, d):
    """Two loads into chunks under a manifest, compaction, then the query."""
    odd = "coalesce(event_id % 2 <> 0, false)"
    cube = events_cube(spark, d, shared_path(spark, "cube"), (f"NOT {odd}", odd))
    cube.consolidate("by_type")
    out = cube.query(Query(("day", "event_type"), ("events", "total"))).rows
    return out.select("day", "event_type", "events", F.round("total", 4).alias("total"))


@query("cube_pruned", f"SELECT {_DAY}, count(*) AS events FROM events WHERE cast(ts AS DATE) <= (SELECT min(cast(ts AS DATE)) + 1 FROM events) GROUP BY 1")
def _pruned_cube(spark, d):
    """A condition on dates, which chooses the files that are read."""
    first = t(spark, d, "events").agg(F.min(F.to_date("ts")).alias("d")).first()["d"]
    cube = events_cube(spark, d, shared_path(spark, "cube"), ("event_type <> 'error'", "event_type = 'error'"))
    return cube.query(Query(("day",), ("events",), P.le("day", first + timedelta(days=1)))).rows


@query("cube_checked", "SELECT user_id, count(*) AS events FROM events WHERE event_type <> 'error' GROUP BY 1")
def _checked(spark, d):
    """Rows that an aggregation's predicate excludes are left out; the rest must meet the precondition."""
    s = Structure({"event_type": "string", "user_id": "long"}, {"events": M.count_("events")}, validity={"event_type": P.not_eq("event_type", "error")}, aggregations={"valid": Aggregation("valid", ("event_type", "user_id"), ("events",), P.has("event_type"))})
    cube = Cube(spark, s)
    cube.load(t(spark, d, "events"), check={"event_type": P.not_eq("event_type", "error"), "user_id": P.ge("user_id", 0)})
    return cube.query(Query(("user_id",), ("events",), P.has("event_type"))).rows


@query("cube_hll")
def _hll(spark, d):
    return events_cube(spark, d).query(Query(("day",), ("users",))).rows


@query("cube_inverted_index", "SELECT w, list_sort(list(DISTINCT doc_id)) AS docs FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY w")
def _inverted(spark, d):
    words = t(spark, d, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("w"))
    return words.groupBy("w").agg(F.array_sort(F.collect_set("doc_id")).alias("docs"))


# logs and state
_TYPES = "SELECT event_type, count(*) AS n, round(sum(value), 4) AS s FROM events GROUP BY 1"


def _logged(spark, d, partition) -> DataFrame:
    """All events, logged in the first hour of their day: few folders for tables this small."""
    return t(spark, d, "events").withColumn("p", partition).withColumn("logged", F.date_trunc("day", "ts"))


@query("log_incremental", _TYPES)
def _log(spark, d):
    """Events as an hourly log, loaded in steps whose results and positions commit together."""
    path, root = shared_path(spark, "log"), shared_path(spark, "loaded")
    write_log(_logged(spark, d, F.col("event_id") % 2).repartition(2, "p"), path, "logged", "p")
    loader = LogLoader(spark, root, {"types": lambda b: b.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("s"))})
    loader.run(path, files_per_step=500)
    return loader.read("types").groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("s"), 4).alias("s"))


@query("log_stream", _TYPES)
def _log_stream(spark, d):
    """The same by a stream with a checkpoint."""
    path, root = shared_path(spark, "log"), shared_path(spark, "loaded")
    events = _logged(spark, d, F.col("event_id") % 2)
    write_log(events.repartition(2, "p"), path, "logged", "p")
    loader = LogLoader(spark, root, {"types": lambda b: b.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("s"))})
    loader.stream(path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema.fields), files_per_batch=500)
    return loader.read("types").groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("s"), 4).alias("s"))


@query("log_resume", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _log_resume(spark, d):
    """Three appends to the same hours, each read from the position that the read before it returned."""
    path, position, parts = shared_path(spark, "log"), None, []
    rows = _logged(spark, d, F.lit("a"))
    for k in range(3):
        write_log(rows.where(F.pmod("event_id", F.lit(3)) == k), path, "logged", "p", remainder=0 if k == 2 else None)
        part, position = read_log(spark, path, "a", position)
        parts.append(part.select("event_type"))
    last, _ = read_log(spark, path, "a", settle(position, "9999"))
    if last is not None:
        raise RuntimeError("the position does not hold what was read")
    return parts[0].union(parts[1]).union(parts[2]).groupBy("event_type").agg(F.count("*").alias("n"))


@query("log_read", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _log_read(spark, d):
    path = shared_path(spark, "log")
    write_log(_logged(spark, d, F.lit("a")), path, "logged", "p", prefix="x_", suffix="_y")
    return read_log(spark, path, "a", prefix="x_", suffix="_y")[0].groupBy("event_type").agg(F.count("*").alias("n"))


@query("log_sql", "SELECT event_type, count(*) AS n, max(event_id) AS top FROM events WHERE event_id % 4 = 1 GROUP BY 1")
def _log_sql(spark, d):
    """SQL over a log folder; the partition is a folder, so the condition reads a quarter."""
    path = shared_path(spark, "log")
    write_log(_logged(spark, d, F.col("event_id") % 4), path, "logged", "p")
    Catalog(spark).add_log("log_item", path)
    return SqlEngine(spark).query("SELECT event_type, count(*) AS n, max(event_id) AS top FROM log_item WHERE part = ? GROUP BY event_type", [1])


@query("udf_sql", "SELECT o_orderkey, o_totalprice * 2 + 1 AS x FROM orders")
def _udf_sql(spark, d):
    Catalog(spark).add_folder(d, "orders")
    return SqlEngine(spark).register("twice_and_one", lambda x: x * 2 + 1, "double").query("SELECT o_orderkey, twice_and_one(o_totalprice) AS x FROM orders")


@query("fn_list_get_sql", "SELECT vec_id, embedding[3] AS x, embedding[1000] AS none FROM embeddings")
def _list_get_sql(spark, d):
    Catalog(spark).add_folder(d, "embeddings")
    return SqlEngine(spark).query("SELECT vec_id, LIST_GET(embedding, ?) AS x, LIST_GET(embedding, (? - 1)) AS none FROM embeddings", [2, 1000])


@query("join_left_values", "SELECT CASE WHEN n_nationkey IS NULL THEN r_name || ':none' ELSE r_name || ':' || n_name END AS value FROM region LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 5 > 2) ON r_regionkey = n_nationkey WHERE n_nationkey IS NOT NULL OR r_regionkey <> 1")
def _left_values(spark, d):
    """Pairs and lonely rows become values; a null is no row."""
    n = t(spark, d, "nation").where("n_nationkey % 5 > 2")
    return joins.left_join(
        t(spark, d, "region"), n, [("r_regionkey", "n_nationkey")], lambda r: F.concat_ws(":", f"{r}.r_name", f"{r}.n_name"), lambda r: F.when(F.col(f"{r}.r_regionkey") != 1, F.concat(f"{r}.r_name", F.lit(":none")))
    )


@query("ds_stream_reduce", """SELECT user_id, first_event, n FROM (SELECT user_id, min(event_id) AS first_event, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM
  (SELECT user_id, event_id, CASE WHEN event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) <= 100 THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s) WHERE n > 1""")
def _stream_reduce(spark, d):
    """Runs of events with gaps of at most 100 ids: several rows per user, or none."""

    def row(acc):
        return [tuple(acc)] if acc[2] > 1 else []

    def first(r):
        return [r.user_id, r.event_id, 1, r.event_id], []

    def following(acc, r):
        if r.event_id - acc[3] > 100:
            return first(r)[0], [x[:3] for x in row(acc)]
        return [acc[0], acc[1], acc[2] + 1, r.event_id], []

    events = Dataset(t(spark, d, "events").select("user_id", "event_id"))
    return events.stream_reduce(["user_id"], ["event_id"], first, following, lambda acc: [x[:3] for x in row(acc)], "user_id long, first_event long, n long").df


@query("ds_local_reduce", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def _local_reduce(spark, d):
    """Once per key and partition, then summed."""
    out = Dataset(t(spark, d, "lineitem").select("l_returnflag")).local_reduce(["l_returnflag"], lambda g: g.size().reset_index(name="n"), "l_returnflag string, n long")
    return out.df.groupBy("l_returnflag").agg(F.sum("n").alias("n"))


@query("ds_fold", "SELECT c_nationkey, max(c_acctbal) AS top FROM customer GROUP BY 1")
def _fold(spark, d):
    return Dataset(t(spark, d, "customer")).reduce(["c_nationkey"], top=reducers.fold("c_acctbal", F.max)).df


_R = "event_id % 3 AS replica"


@query("crdt_gcounter", f"SELECT event_type, cast(sum(v) AS BIGINT) AS value FROM (SELECT event_type, {_R}, max(event_id) AS v FROM events GROUP BY 1, 2) GROUP BY 1")
def _gcounter(spark, d):
    return crdt.g_counter(t(spark, d, "events").withColumn("replica", F.col("event_id") % 3), ["event_type"], "replica", "event_id")


@query("crdt_pncounter", f"SELECT event_type, cast(sum(p) - sum(n) AS BIGINT) AS value FROM (SELECT event_type, {_R}, max(event_id) AS p, max(user_id) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def _pncounter(spark, d):
    return crdt.pn_counter(t(spark, d, "events").withColumn("replica", F.col("event_id") % 3), ["event_type"], "replica", "event_id", "user_id")


@query("crdt_gset", "SELECT user_id, list_sort(list(DISTINCT event_type)) AS elements FROM events GROUP BY 1")
def _gset(spark, d):
    return crdt.g_set(t(spark, d, "events"), ["user_id"], "event_type")


@query("crdt_tpset", "SELECT user_id, list_sort(coalesce(list(event_type) FILTER (WHERE NOT gone), [])) AS elements FROM (SELECT user_id, event_type, bool_or(event_id % 5 = 0) AS gone FROM events GROUP BY 1, 2) GROUP BY 1")
def _tpset(spark, d):
    return crdt.tp_set(t(spark, d, "events").withColumn("gone", F.col("event_id") % 5 == 0), ["user_id"], "event_type", "gone")


@query("crdt_lww", """SELECT user_id, list_sort(coalesce(list(event_type) FILTER (WHERE a IS NOT NULL AND (r IS NULL OR a >= r)), [])) AS elements
  FROM (SELECT user_id, event_type, max(ts) FILTER (WHERE event_id % 3 <> 0) AS a, max(ts) FILTER (WHERE event_id % 3 = 0) AS r FROM events GROUP BY 1, 2) GROUP BY 1""")
def _lww(spark, d):
    return crdt.lww_set(t(spark, d, "events").withColumn("gone", F.col("event_id") % 3 == 0), ["user_id"], "event_type", "ts", "gone")


@query("crdt_gmap", "SELECT user_id, event_type AS k, max(event_id) AS v FROM events GROUP BY 1, 2")
def _gmap(spark, d):
    return crdt.g_map(t(spark, d, "events"), ["user_id"], "event_type", F.max("event_id")).select("user_id", F.explode("entries").alias("k", "v"))


@query("crdt_tombstone", """WITH g AS (SELECT user_id, max(ts) AS gone FROM events WHERE event_type = 'error' GROUP BY 1)
  SELECT e.user_id, max(ts) AS ts, count(*) AS n FROM events e LEFT JOIN g USING (user_id) WHERE event_type <> 'error' AND (gone IS NULL OR ts > gone) GROUP BY 1""")
def _tombstone(spark, d):
    rows = t(spark, d, "events").withColumn("tombstone", F.col("event_type") == "error")
    return crdt.merge_state(rows, ["user_id"], {"n": F.count("*")})


def _crdt_parts(spark, d, store) -> None:
    rows = t(spark, d, "events").select("user_id", "ts", "event_id")
    store.upload(rows.where("event_id % 2 = 0"))
    store.upload(rows.where("event_id % 2 = 1"))


@query("crdt_store", "SELECT user_id, max(ts) AS ts, max(event_id) AS e, count(*) AS n FROM events GROUP BY 1")
def _store(spark, d):
    """Two uploads, compacted; a count is a sum of ones, so it survives."""
    s = crdt_store.CrdtStore(spark, shared_path(spark, "crdt"), ["user_id"], {"e": crdt_store.largest("event_id"), "n": crdt_store.counted()})
    _crdt_parts(spark, d, s)
    s.compact(everything=True)
    return s.download()


@query("crdt_removed", """WITH g AS (SELECT user_id, max(ts) AS gone FROM events WHERE event_id % 7 = 0 GROUP BY 1)
  SELECT user_id, max(ts) AS ts, max(event_id) AS e FROM events LEFT JOIN g USING (user_id) WHERE gone IS NULL OR ts > gone GROUP BY 1""")
def _removed(spark, d):
    s = crdt_store.CrdtStore(spark, shared_path(spark, "crdt"), ["user_id"], {"e": crdt_store.largest("event_id")})
    s.remove(t(spark, d, "events").where("event_id % 7 = 0").select("user_id", "ts"))
    _crdt_parts(spark, d, s)
    s.compact()
    return s.download()


@query("crdt_replicas", "SELECT user_id, max(ts) AS ts, max(event_id) AS e FROM events GROUP BY 1")
def _replicas(spark, d):
    """Two of three nodes per key, moved to four nodes, read with one of them down."""
    node = lambda: crdt_store.CrdtStore(spark, shared_path(spark, "crdt"), ["user_id"], {"e": crdt_store.largest("event_id")})
    three = {n: node() for n in "abc"}
    store = crdt_store.ReplicatedStore(three, 2)
    _crdt_parts(spark, d, store)
    return store.repartition(three | {"d": node()}).download(down=frozenset("b"))


@query("crdt_wal", "SELECT n_regionkey AS k, max(n_nationkey) AS ts, max(n_name) AS name FROM nation GROUP BY 1")
def _wal(spark, d):
    """Rows put one by one on the driver, flushed twice, uploaded."""
    wal = crdt_store.WriteAheadLog(spark, shared_path(spark, "wal"), "k int, ts long, name string")
    for i, r in enumerate(t(spark, d, "nation").orderBy("n_nationkey").toLocalIterator()):
        wal.put(r["n_regionkey"], r["n_nationkey"], r["n_name"])
        if i == 9:
            wal.flush()
    wal.flush()
    store = crdt_store.CrdtStore(spark, shared_path(spark, "crdt"), ["k"], {"name": crdt_store.largest("name")})
    wal.upload(store)
    return store.download()


@query("rendezvous_owner")
def _owners(spark, d):
    return crdt.owners(t(spark, d, "customer").select("c_custkey"), ["c_custkey"], ["a", "b", "c"], 2)


# beyond the reference: what Spark adds
sql_query("ext_window", "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders")
sql_query("ext_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
sql_query("ext_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
sql_query("ext_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
sql_query("ext_intersect", "SELECT n_nationkey AS k FROM nation INTERSECT SELECT s_nationkey FROM supplier")
sql_query("ext_except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT r_regionkey FROM region")
sql_query("ext_full_join", "SELECT r_regionkey, n_nationkey FROM region FULL JOIN nation ON r_regionkey = n_nationkey")


@query("ext_tumbling", "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _tumbling(spark, d):
    return windowed(t(spark, d, "events"), "ts", "1 hour", ["event_type"], [F.count("*").alias("n")]).drop("window_end")


@query("ext_session", """SELECT user_id, min(ts) AS session_start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM
  (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def _session(spark, d):
    return sessions(t(spark, d, "events"), "ts", "30 minutes", ["user_id"], [F.count("*").alias("n")])


@query("ext_asof", "SELECT e.event_id, o.event_id AS last_purchase FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') o ON e.user_id = o.user_id AND e.ts >= o.ts WHERE e.event_type = 'click'")
def _asof(spark, d):
    e = t(spark, d, "events")
    right = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("last_purchase"))
    return joins.asof_join(e.where("event_type = 'click'").select("user_id", "ts", "event_id"), right, ["user_id"], "ts", "last_purchase").select("event_id", "last_purchase")


@query("ext_range_join", "SELECT p_partkey, lo FROM part JOIN (SELECT r_regionkey * 10 AS lo, r_regionkey * 10 + 4 AS hi FROM region) ON p_size BETWEEN lo AND hi")
def _range(spark, d):
    r = t(spark, d, "region").select((F.col("r_regionkey") * 10).alias("lo"), (F.col("r_regionkey") * 10 + 4).alias("hi"))
    return joins.range_join(t(spark, d, "part").select("p_partkey", "p_size"), r, "p_size", "lo", "hi", 8).select("p_partkey", "lo")


@query("ext_topk_per_key", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def _topk_key(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(*order("o_totalprice desc", "o_orderkey"))
    return t(spark, d, "orders").withColumn("r", F.row_number().over(w)).where("r <= 2").select("o_custkey", "o_orderkey")


@query("ext_regexp_full", "SELECT p_partkey FROM part WHERE regexp_full_match(p_brand, 'Brand#[12]')")
def _regexp(spark, d):
    return t(spark, d, "part").where(regexp_full(F.col("p_brand"), "Brand#[12]")).select("p_partkey")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """A reporting query through the cube's planner: days with computed measures, ordered."""
    return events_cube(spark, d).query(Query(("day",), ("events", "total", "mean", "spread", "users"), orderings=("day",))).rows
