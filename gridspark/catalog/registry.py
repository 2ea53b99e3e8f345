"""One registry entry = a Spark job, the SQL that must agree with it, and the shape both are shown in."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.catalog.views import SQL_VIEWS, Views


@dataclass(frozen=True)
class Job:
    key: str
    build: Callable[[Views], DataFrame]
    columns: str
    sql: str | None = None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return present(self.build(Views(spark, sf_dir)), self.columns)

    def oracle(self) -> str | None:
        return None if self.sql is None else oracle_text(self.sql, self.columns)


JOBS: dict[str, Job] = {}


def job(key: str, columns: str, sql: str | None = None):
    """Register a builder. `columns` lists the shown columns as name or name:format, where the format is a
    digit (decimals), i (int), l (bigint), d (date text), t (timestamp text), a (text list), b (boolean)."""

    def wrap(fn):
        if key in JOBS:
            raise ValueError(f"duplicate job {key}")
        JOBS[key] = Job(key, fn, columns, sql)
        return fn

    return wrap


def _spec(columns: str) -> list[tuple[str, str]]:
    return [(c.split(":") + [""])[:2] for c in columns.split()]


def present(df: DataFrame, columns: str) -> DataFrame:
    """Shown form of a result: stable decimals and text dates, so two engines can be compared by value."""
    out = []
    for name, fmt in _spec(columns):
        c = F.col(name)
        if fmt.isdigit():
            c = F.round(c.cast("double") + 10.0 ** -(int(fmt) + 3), int(fmt))
        elif fmt == "i":
            c = c.cast("int")
        elif fmt == "l":
            c = c.cast("bigint")
        elif fmt == "d":
            c = F.date_format(c, "yyyy-MM-dd")
        elif fmt == "t":
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif fmt == "a":
            c = F.array_join(c.cast("array<string>"), ",")
        out.append(c.alias(name))
    return df.select(*out)


def oracle_text(sql: str, columns: str) -> str:
    out = []
    for name, fmt in _spec(columns):
        if fmt.isdigit():
            e = f"round(CAST({name} AS DOUBLE) + 1e-{int(fmt) + 3}, {fmt}) + 0.0"
        elif fmt == "i":
            e = f"CAST({name} AS INTEGER)"
        elif fmt == "l":
            e = f"CAST({name} AS BIGINT)"
        elif fmt == "d":
            e = f"strftime({name}, '%Y-%m-%d')"
        elif fmt == "t":
            e = f"strftime({name}, '%Y-%m-%d %H:%M:%S')"
        elif fmt == "a":
            e = f"array_to_string({name}, ',')"
        else:
            e = name
        out.append(f"{e} AS {name}")
    needed = _needed(sql)
    views = [f"{v} AS (\n{SQL_VIEWS[v]}\n)" for v in SQL_VIEWS if v in needed]
    views.append(f"result_rows AS (\n{sql}\n)")
    head = "WITH RECURSIVE " if "RECURSIVE" in sql else "WITH "
    return head + ",\n".join(views) + "\nSELECT " + ", ".join(out) + " FROM result_rows"


def _needed(sql: str) -> set[str]:
    found: set[str] = set()
    todo = [sql]
    while todo:
        words = set(re.findall(r"[a-z_][a-z_0-9]*", todo.pop()))
        for v in SQL_VIEWS:
            if v in words and v not in found:
                found.add(v)
                todo.append(SQL_VIEWS[v])
    return found
