"""Lookups at a node for the values of a column: account state and code.

Distinct values are asked for once, by the tasks, and joined back.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.session import ship
from tidemark.streaming.retry import retry

from .client import client


def _ask(options: Mapping[str, str], kind: str, revision: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = client(options)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            if kind == "code":
                got = [retry(lambda k=k: own.code(k, revision), attempts=5) for k in keys]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.string())], ["_key", "code"])
            else:
                got = [retry(lambda k=k: own.account(k, revision), attempts=5) for k in keys]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x["balance"] for x in got], pa.string()), pa.array([x["energy"] for x in got], pa.string()), pa.array([x["hasCode"] for x in got], pa.bool_())], ["_key", "balance", "energy", "hasCode"])

    return run


def _joined(df: DataFrame, column: str, options: Mapping[str, str], kind: str, revision: str, schema: str) -> DataFrame:
    ship(df.sparkSession)
    keys = df.select(df[column].alias("_key")).where("_key IS NOT NULL").distinct()
    found = keys.mapInArrow(_ask(dict(options), kind, revision), f"_key string, {schema}")
    return df.join(found, df[column] == found["_key"], "left").drop("_key")


def with_accounts(df: DataFrame, column: str, options: Mapping[str, str], revision: str = "best") -> DataFrame:
    """Rows with balance, energy and hasCode of the account that a column names."""
    return _joined(df, column, options, "account", revision, "balance string, energy string, hasCode boolean")


def with_code(df: DataFrame, column: str, options: Mapping[str, str], revision: str = "best") -> DataFrame:
    """Rows with the code of the account that a column names."""
    return _joined(df, column, options, "code", revision, "code string")
