"""JDBC scans.  Credentials come from the caller; nothing is stored here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PREVIEW_ROWS = 10


def jdbc_options(url: str, table: str | None = None, query: str | None = None,
                 split_column: str | None = None, bounds: tuple | None = None, splits: int | None = None,
                 **extra) -> dict[str, str]:
    """Reader options; ``split_column`` with ``bounds`` and ``splits`` makes a parallel scan."""
    if (table is None) == (query is None):
        raise ValueError("give either a table or a query")
    options = {"url": url, **{k: str(v) for k, v in extra.items()}}
    options.update({"dbtable": table} if table else {"query": query})
    if split_column:
        if query or not bounds or not splits:
            raise ValueError("a parallel scan needs a table, bounds and a number of splits")
        options.update(partitionColumn=split_column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]),
                       numPartitions=str(splits))
    return options


def read_table(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(url, table=table, **options)).load()


def read_query_preview(spark: SparkSession, url: str, query: str, rows: int = PREVIEW_ROWS, **options) -> DataFrame:
    """First rows of a query that the database itself runs."""
    return spark.read.format("jdbc").options(**jdbc_options(url, query=query, **options)).load().limit(rows)
