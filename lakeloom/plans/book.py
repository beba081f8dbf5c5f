"""A book of queries: a decorator files a function and its SQL under a name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def book() -> tuple[dict, Callable]:
    pages: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}

    def query(sql: str | None = None) -> Callable:
        def file(run: Callable) -> Callable:
            pages[run.__name__] = (run, sql)
            return run

        return file

    return pages, query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
