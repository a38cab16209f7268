"""Scalar functions of the SQL surface, as columns and as names that the SQL text may use."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def map_get(m: Column, key) -> Column:
    """The value of a key; null if it is missing."""
    return F.try_element_at(m, key if isinstance(key, Column) else F.lit(key))


def list_get(items: Column, index) -> Column:
    """The element at an index from 0; null past the end or for a null index, an error for a negative one."""
    i = index if isinstance(index, Column) else F.lit(index)
    return F.get(items, F.when(i < 0, F.raise_error(F.lit(NEGATIVE)).cast("int")).otherwise(i))


def if_null(a: Column, b: Column) -> Column:
    return F.coalesce(a, b)


def is_true(p: Column) -> Column:
    """Two-valued logic: an unknown predicate is false, so its negation is true."""
    return F.coalesce(p, F.lit(False))


def negate(p: Column) -> Column:
    return ~is_true(p)


def regexp_full(s: Column, pattern: str) -> Column:
    """A match of the whole string form; ``$`` would also match before a last newline."""
    return s.cast("string").rlike(rf"\A(?:{pattern})\z")


NEGATIVE = "a list index must not be negative"
#: SQL names that differ from Spark's.
NAMES = {"MAP_GET": "try_element_at"}
_TOKEN = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|\b(MAP_GET)(?=\s*\()|\b(LIST_GET)\s*\(|[(),]", re.IGNORECASE)


def translate_names(sql: str) -> str:
    """Rewrite function names outside of literals and quoted names; double-quoted names become back-quoted.

    ``LIST_GET(list, index)`` becomes an expression that holds each argument once, as parameters count by place."""
    out: list[str] = []
    open_: list[list | None] = []  # per open bracket: for LIST_GET [where its list starts, where its index starts]
    end = 0
    for m in _TOKEN.finditer(sql):
        out.append(sql[end : m.start()])
        end = m.end()
        x = m[0]
        if m[1]:
            out.append(NAMES[m[1].upper()])
        elif m[2]:
            open_.append([len(out), None])
        elif x == "(":
            open_.append(None)
            out.append(x)
        elif x == "," and open_ and open_[-1] and open_[-1][1] is None:
            open_[-1][1] = len(out)
        elif x == ")" and open_:
            at = open_.pop()
            if at is None or at[1] is None:
                out.append(x)
                continue
            items, index = "".join(out[at[0] : at[1]]), "".join(out[at[1] :])
            out[at[0] :] = [f"transform(array({items}), l -> get(l, transform(array({index}), i -> if(i < 0, cast(raise_error('{NEGATIVE}') AS int), i))[0]))[0]"]
        else:
            out.append("`" + x[1:-1].replace('""', '"') + "`" if x[0] == '"' else x)
    return "".join(out) + sql[end:]
