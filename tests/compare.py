"""Order-insensitive comparison of a Spark result with DuckDB's."""

from __future__ import annotations

import duckdb
from pyspark.sql import DataFrame

GIVEN = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
         "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in GIVEN:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _kind(name: str) -> str:
    return {"bigint": "int", "BIGINT": "int", "double": "float", "DOUBLE": "float", "string": "text",
            "VARCHAR": "text", "timestamp_ntz": "time", "TIMESTAMP": "time", "boolean": "bool",
            "BOOLEAN": "bool"}.get(name, name)


def spark_result(df: DataFrame) -> tuple[list, list]:
    columns = sorted(df.columns)
    kinds = [(c, _kind(df.schema[c].dataType.simpleString())) for c in columns]
    return kinds, sorted((tuple(r) for r in df.select(columns).collect()), key=repr)


def duckdb_result(connection: duckdb.DuckDBPyConnection, sql: str) -> tuple[list, list]:
    relation = connection.sql(sql)
    order = sorted(range(len(relation.columns)), key=lambda i: relation.columns[i])
    kinds = [(relation.columns[i], _kind(str(relation.types[i]))) for i in order]
    return kinds, sorted((tuple(r[i] for i in order) for r in relation.fetchall()), key=repr)
