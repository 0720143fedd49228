"""Collects the registered queries of the reference operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioscope.plans import layout, reports, scoring, usage

BOOKS = (layout.BOOK, scoring.BOOK, reports.BOOK, usage.BOOK)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["score_documents"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for book in BOOKS for name, (run, _) in book.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for book in BOOKS for name, (_, sql) in book.items() if sql}
