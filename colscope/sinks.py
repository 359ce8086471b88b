"""Writers.  All are plain distributed Spark writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def export_csv(df: DataFrame, path: str, files: int | None = None, mode: str = "errorifexists") -> None:
    """CSV for download.  ``files=1`` asks for one part file, which only suits results of modest size;
    the work before the write keeps its own tasks.
    """
    write_csv(df.repartition(files) if files else df, path, mode)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def as_documents(df: DataFrame, keys: list[str]) -> DataFrame:
    """The key columns and the whole row as one JSON document."""
    return df.select(*keys, F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("document"))
