"""Registry of the library's queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rentgrid.plans import changes, counts, fields, follow_up, health, matches, meaning, products, storage, streams, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

for _module in (health, counts, changes, matches, texts, products, fields, meaning, streams, storage, follow_up):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
