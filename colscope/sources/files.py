"""File scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path, schema: str | T.StructType | None = None, **options) -> DataFrame:
    """CSV with a header.  Give a schema for big inputs: inferring one reads the files twice."""
    reader = spark.read.option("header", True).options(**options)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def read_parquet(spark: SparkSession, path) -> DataFrame:
    return spark.read.parquet(path)


def read_parquet_na(spark: SparkSession, path, marker: str = "NA") -> DataFrame:
    """Parquet whose string columns hold ``marker`` for missing values."""
    return marker_to_null(spark.read.parquet(path), marker)


def marker_to_null(df: DataFrame, marker: str = "NA") -> DataFrame:
    return df.select(*[
        F.nullif(F.col(f.name), F.lit(marker)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name)
        for f in df.schema.fields
    ])
