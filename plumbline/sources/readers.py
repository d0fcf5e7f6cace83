"""Table readers: CSV, parquet, JDBC. Lazy, so filters and column choices reach the scan."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

TABLE_NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")
URL_PASSWORD = re.compile(r"^[^:/?#]+(?::[^:/?#]+)*://[^/@:]*:[^/@]+@|[?&;]password=", re.IGNORECASE)
PASSWORD_VARIABLE = "PLUMBLINE_DB_PASSWORD"


# JDBC names of the databases that locations name.
JDBC_DIALECTS = {"postgresql": "postgresql", "postgres": "postgresql", "mysql": "mysql", "mariadb": "mariadb", "mssql": "sqlserver", "oracle": "oracle:thin"}


def jdbc_url(location: str) -> str:
    """A JDBC URL from ``dialect+driver://rest``; files of an embedded database are refused."""
    if location.startswith("jdbc:"):
        return location
    dialect, _, rest = location.partition("://")
    name = dialect.split("+")[0].lower()
    if not rest or name not in JDBC_DIALECTS:
        raise ValueError(f"{location!r} is a database file that one process reads; export the table to parquet or name a database server")
    return f"jdbc:oracle:thin:@//{rest}" if name == "oracle" else f"jdbc:{JDBC_DIALECTS[name]}://{rest}"


def source_kind(location: str) -> str:
    """jdbc, parquet, json or csv, from the text alone."""
    if location.startswith("jdbc:") or "://" in location and location.split("://")[0].split("+")[0] in (
        "postgresql", "postgres", "mysql", "mariadb", "sqlite", "mssql", "oracle"
    ):
        return "sql"
    suffix = location.rstrip("/").rsplit(".", 1)[-1].lower()
    return {"parquet": "parquet", "json": "json", "jsonl": "json", "sqlite": "sqlite", "db": "sqlite"}.get(suffix, "csv")


def check_location(location: str) -> None:
    if URL_PASSWORD.search(location):
        raise ValueError(f"a password inside the URL is refused; set {PASSWORD_VARIABLE}")


def jdbc_options(url: str, table: str | None = None, query: str | None = None, user: str | None = None) -> dict[str, str]:
    """Reader options for exactly one of a plain table name or a query."""
    check_location(url)
    if (table is None) == (query is None):
        raise ValueError("name exactly one of table and query")
    if table is not None and not TABLE_NAME.match(table):
        raise ValueError(f"table name {table!r} is not a plain identifier")
    options = {"url": url, "dbtable": f'"{table}"'} if table is not None else {"url": url, "query": query or ""}
    if user:
        options["user"] = user
    if os.environ.get(PASSWORD_VARIABLE):
        options["password"] = os.environ[PASSWORD_VARIABLE]
    return options


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; give ``schema`` to skip the inference pass."""
    reader = spark.read.option("header", True).option("escape", '"')
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_jdbc(
    spark: SparkSession, url: str, table: str | None = None, query: str | None = None, user: str | None = None,
    partition_column: str | None = None, lower: int | None = None, upper: int | None = None, partitions: int = 32,
) -> DataFrame:
    """Database read; a numeric ``partition_column`` with bounds makes it parallel."""
    reader = spark.read.format("jdbc").options(**jdbc_options(url, table, query, user))
    if partition_column and table:
        reader = reader.options(
            partitionColumn=partition_column, lowerBound=lower, upperBound=upper, numPartitions=partitions)
    return reader.load()


def read_table(spark: SparkSession, location: str, table: str | None = None, query: str | None = None, schema: str | None = None) -> DataFrame:
    """Any source by its location; ``table`` and ``query`` belong to databases only."""
    check_location(location)
    kind = source_kind(location)
    if kind in ("sql", "sqlite"):
        return read_jdbc(spark, jdbc_url(location), table, query)
    if table or query:
        raise ValueError(f"table and query do not apply to a {kind} file")
    if kind == "parquet":
        return spark.read.parquet(location)
    if kind == "json":
        return spark.read.json(location)
    return read_csv(spark, location, schema)
