"""Where queries and their checks are registered, side by side."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue.scoring_sql import with_ctes
from mimicry.operators.scoring import Scorer
from mimicry.session import configure, session_key
from mimicry.staging import Tables, sql_for

Run = Callable[[Tables], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Run
    sql: str | None


REGISTRY: dict[str, Entry] = {}
_SCORERS: dict[tuple[str, int], Scorer] = {}


def query(sql: str | None = None) -> Callable[[Run], Run]:
    """Register a query under its function's name, with the SQL that checks it."""

    def register(run: Run) -> Run:
        REGISTRY[run.__name__] = Entry(run, sql)
        return run

    return register


def callable_for(entry: Entry) -> Callable[[SparkSession, str], DataFrame]:
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        return entry.run(Tables(configure(spark), sf_dir))

    return call


def scorer(spark: SparkSession) -> Scorer:
    """One scorer per session: its variants are generated once."""
    key = session_key(spark)
    if key not in _SCORERS:
        _SCORERS[key] = Scorer(spark)
    return _SCORERS[key]


def staged(*names: str) -> list[str]:
    """Logical tables as common table expressions of the same names."""
    return [f"{name} AS ({sql_for(name)})" for name in names]


def check(names: tuple[str, ...], body: str, *ctes: str) -> str:
    return with_ctes([*staged(*names), *ctes], body)


def moment(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def moment_sql(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"
