"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import standins as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: derived tables that SQL may name
TABLES = ("ROWS", "ITEMS", "MUTANTS", "JAVA", "METHODS", "SIGNATURES", "STATS", "RUNS")


def query(sql: str | None = None):
    """Register a function under its name, with its SQL; the names of derived tables stand there for their own SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            used = [n for n in TABLES if n in sql]
            more = [n for n in TABLES if n not in used and any(n in getattr(T, u) for u in used)]
            named = [f"{n} AS ({getattr(T, n)})" for n in TABLES if n in used or n in more]
            head = sql.lstrip()
            if head.upper().startswith("WITH "):
                head = head[5:].lstrip()
                if head.upper().startswith("RECURSIVE "):
                    ORACLE_SQL[f.__name__] = "WITH RECURSIVE " + ", ".join([*named, head[10:].lstrip()])
                else:
                    ORACLE_SQL[f.__name__] = "WITH " + ", ".join([*named, head])
            else:
                ORACLE_SQL[f.__name__] = ("WITH " + ", ".join(named) + " " if named else "") + head
        return f

    return add


def six(df: DataFrame) -> DataFrame:
    """Double columns rounded to six places."""
    return df.select(*[F.round(F.col(c).cast("double"), 6).alias(c) if t in ("double", "float") or t.startswith("decimal") else F.col(c) for c, t in df.dtypes])
