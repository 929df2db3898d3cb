"""Named queries over the given tables, each beside the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


class Tables:
    """Attribute access to the Parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


@dataclass(frozen=True)
class Entry:
    build: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    """Register `fn(tables) -> DataFrame` under `name`; `sql` is its DuckDB counterpart."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(fn, sql)
        return fn

    return wrap


# Shared pieces of oracle SQL: name -> (names it needs, body).
_PIECES: dict[str, tuple[tuple[str, ...], str]] = {}


def piece(name: str, body: str, *needs: str, columns: str = "") -> None:
    _PIECES[name] = (needs, f"{name}{columns} AS ({body})")


def with_pieces(*names: str) -> str:
    """A WITH clause holding the named pieces and all they need, in order."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in ordered:
            return
        for need in _PIECES[name][0]:
            add(need)
        ordered.append(name)

    for name in names:
        add(name)
    return "WITH RECURSIVE " + ",\n".join(_PIECES[n][1] for n in ordered) + "\n"
