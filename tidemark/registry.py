"""Named queries: an operator bound to the given tables, with the SQL that checks it."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.views import CHECK_VIEWS, SPARK_VIEWS, for_check, for_spark, view_order
from tidemark.session import pin_runtime

BASE_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
               "pages benchmark labels conversations").split()


def _mark(text: str, reads) -> str:
    """Turn the table names after FROM and JOIN into parameters of spark.sql."""
    for n in reads:
        text = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", text)
    return text


class Tables:
    """Attribute access to the given tables (parquet scans) and to the views derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = pin_runtime(spark)
        self.sf_dir = sf_dir

    def path(self, name: str) -> str:
        return os.path.join(self.sf_dir, f"{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            df = self.spark.read.parquet(self.path(name))
        elif name in SPARK_VIEWS:
            text, needs = SPARK_VIEWS[name]
            inputs = {n: getattr(self, n) for n in needs}
            df = self.spark.sql(_mark(text, needs), **inputs)
        else:
            raise AttributeError(name)
        self.__dict__[name] = df
        return df

    def select(self, text: str, *reads: str) -> DataFrame:
        """Run one SELECT over the named tables or views."""
        inputs = {n: getattr(self, n) for n in reads}
        return self.spark.sql(_mark(for_spark(text), reads), **inputs)


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Tables(spark, sf_dir))


REGISTRY: dict[str, Query] = {}


def _check_sql(sql: str, views: tuple[str, ...], src: str | None) -> str:
    ctes = [f"{v} AS ({CHECK_VIEWS[v]})" for v in view_order(views)]
    if src is not None:
        ctes.append(f"src AS ({for_check(src)})")
    sql = sql.strip()
    if not ctes:
        return sql
    if sql[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + sql[15:]
    if sql[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(ctes) + ",\n" + sql[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + sql


def query(name: str, sql: str | None = None, views: str = "", src: str | None = None):
    """Register a query.

    ``views`` names the views the check reads. ``src`` is a SELECT over one of the tables or views that
    shapes the input columns for both engines: the build function then gets ``(tables, src_frame)`` and
    the check reads it as ``src``.
    """
    def register(build):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        text = None if sql is None else _check_sql(sql, tuple(views.split()), src)
        run = build
        if src is not None:
            reads = [n for n in (*BASE_TABLES, *SPARK_VIEWS) if re.search(rf"\b(FROM|JOIN) {n}\b", src)]

            def run(t: Tables) -> DataFrame:
                return build(t, t.select(src, *reads))
        REGISTRY[name] = Query(name, run, text)
        return build
    return register
