"""The registered queries of the retrieval library and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import catalogs, search, streams, texts

PARTS = (search, catalogs, texts, streams)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for part in PARTS for k, f in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for part in PARTS for k, s in part.ORACLE_SQL.items()}
