"""SQL queries: SELECT and UNION with parameters, in standard or compatible semantics."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from typing import Any

from py4j.java_gateway import is_instance_of
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalar import translate_names

_START = re.compile(r"\s*(?:--[^\n]*\n\s*)*(select|with|values|\()", re.IGNORECASE)
_EXPLAIN = re.compile(r"\s*explain\s+(plan|graph|nodes)\s+for\s+|\s*explain\s+(plan|graph|nodes)\s+", re.IGNORECASE)


_PLANS = "org.apache.spark.sql.catalyst.plans.logical."


class SqlEngine:
    """Runs the read-only subset; what it lets through is planned by Catalyst."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def register(self, name: str, fn: Callable, returns: str, batches: bool = True) -> SqlEngine:
        """A scalar function of the user's for SQL text: on pandas series batch by batch, or value by value."""
        self.spark.udf.register(name, (F.pandas_udf if batches else F.udf)(fn, returnType=returns))
        return self

    def _only_reads(self, sql: str) -> None:
        """Commands and statements that write may hide behind WITH; the parsed plan shows them."""
        todo = [self.spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)]
        while todo:
            node = todo.pop()
            if any(is_instance_of(self.spark._sc._gateway, node, _PLANS + x) for x in ("Command", "ParsedStatement")):
                raise ValueError(f"only SELECT, VALUES and UNION are accepted, not {node.nodeName()}")
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]

    def query(self, sql: str, params: Sequence[Any] | dict[str, Any] | None = None, max_rows: int | None = None) -> DataFrame:
        """``?`` and ``:name`` parameters stand for any operand, also in LIMIT and OFFSET."""
        m = _EXPLAIN.match(sql)
        if m:
            text = self.explain(sql[m.end() :], (m[1] or m[2]).lower(), params)
            return self.spark.createDataFrame([(text,)], "plan string")
        if not _START.match(sql):
            raise ValueError("only SELECT, VALUES and UNION are accepted")
        sql = translate_names(sql)
        self._only_reads(sql)
        out = self.spark.sql(sql, args=list(params) if isinstance(params, (list, tuple)) else params) if params else self.spark.sql(sql)
        return out.limit(max_rows) if max_rows else out

    def prepare(self, sql: str):
        """A statement that takes its parameters when it is executed."""
        return lambda *params: self.query(sql, list(params))

    def explain(self, sql: str, what: str = "plan", params=None) -> str:
        """plan: optimised logical plan; graph: physical plan; nodes: formatted physical plan with its nodes."""
        qe = self.query(sql, params)._jdf.queryExecution()
        if what == "plan":
            return qe.optimizedPlan().toString()
        return qe.executedPlan().toString() if what == "graph" else self.spark._jvm.PythonSQLUtils.explainString(qe, "formatted")


def order(*keys: str) -> list[Column]:
    """``"a"``, ``"a desc"``, ``"a desc nulls first"``: nulls are last when ascending and first when descending, unless said."""
    out = []
    for k in keys:
        name, *how = k.split()
        how = " ".join(how).lower()
        c, desc = F.col(name), how.startswith("desc")
        first = "nulls first" in how if "nulls" in how else desc
        out.append((c.desc_nulls_first() if first else c.desc_nulls_last()) if desc else (c.asc_nulls_first() if first else c.asc_nulls_last()))
    return out


def compat_sum(c: Column) -> Column:
    """0 where nothing was summed."""
    return F.coalesce(F.sum(c), F.lit(0))


def compat_avg(c: Column) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def global_aggregate(df: DataFrame, *aggs: Column) -> DataFrame:
    """A global aggregate that yields no row over no input."""
    names = df.agg(*aggs).columns
    return df.agg(*aggs, F.count(F.lit(1)).alias("__n")).where("__n > 0").select(*[F.col(f"`{n}`") for n in names])
