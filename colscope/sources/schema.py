"""Schema listings as DataFrames, and the semantic type of a physical type name."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import small_table
from ..specs import CATEGORY, DATE, NUMBER, TEXT

# Source type names by semantic type, and the format of each date type.
NUMBER_TYPES = ["INTEGER", "INT", "SMALLINT", "TINYINT", "MEDIUMINT", "BIGINT", "DECIMAL", "NUMERIC", "FLOAT",
                "DOUBLE", "BIT", "INT UNSIGNED"]
TEXT_TYPES = ["TINYTEXT", "TEXT", "MEDIUMTEXT", "LONGTEXT"]
DATE_FORMATS = {"DATE": "YYYY-MM-DD", "TIME": "HH:MM:SS", "TIMESTAMP": "YYYYMMDDHHMMSS",
                "DATETIME": "YYYY-MM-DD HH:MM:SS"}

_COLUMN_SCHEMA = pa.schema([
    ("table_name", pa.string()), ("column_name", pa.string()), ("position", pa.int32()),
    ("data_type", pa.string()), ("nullable", pa.bool_()), ("remarks", pa.string()),
])


def semantic_type(type_name: Column) -> Column:
    """Struct (datatype, format) for a source type name; unknown names are categories."""
    name = F.upper(type_name)
    date_format = F.coalesce(*[F.when(name == k, F.lit(v)) for k, v in DATE_FORMATS.items()])
    return F.struct(
        F.when(name.isin(NUMBER_TYPES), NUMBER).when(name.isin(TEXT_TYPES), TEXT)
        .when(name.isin(list(DATE_FORMATS)), DATE).otherwise(CATEGORY).alias("datatype"),
        F.when(name.isin(TEXT_TYPES), "string").when(date_format.isNotNull(), date_format).otherwise("").alias("format"),
    )


def _type_name(t: T.DataType) -> str:
    if isinstance(t, T.TimestampNTZType):
        return "datetime"
    return "decimal" if isinstance(t, T.DecimalType) else t.simpleString()


def schema_of(df: DataFrame, table: str = "") -> DataFrame:
    """One row per column of ``df`` with its physical and semantic type."""
    rows = [{"table_name": table, "column_name": f.name, "position": i, "data_type": _type_name(f.dataType),
             "nullable": f.nullable, "remarks": None} for i, f in enumerate(df.schema.fields)]
    listing = small_table(df.sparkSession, rows, _COLUMN_SCHEMA)
    return listing.select("*", semantic_type(F.col("data_type")).alias("s")).select(*listing.columns, "s.datatype", "s.format")


def list_databases(spark: SparkSession) -> DataFrame:
    rows = [{"database": d.name, "remarks": d.description} for d in spark.catalog.listDatabases()]
    return small_table(spark, rows, pa.schema([("database", pa.string()), ("remarks", pa.string())]))


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    rows = [{"table_name": t.name, "kind": t.tableType, "remarks": t.description}
            for t in spark.catalog.listTables(database)]
    return small_table(spark, rows, pa.schema([("table_name", pa.string()), ("kind", pa.string()),
                                               ("remarks", pa.string())]))


def list_columns(spark: SparkSession, tables: list[str]) -> DataFrame:
    """Columns of the named catalog tables or views."""
    rows = [
        {"table_name": table, "column_name": c.name, "position": i, "data_type": c.dataType,
         "nullable": c.nullable, "remarks": c.description}
        for table in tables for i, c in enumerate(spark.catalog.listColumns(table))
    ]
    listing = small_table(spark, rows, _COLUMN_SCHEMA)
    return listing.select("*", semantic_type(F.col("data_type")).alias("s")).select(*listing.columns, "s.datatype", "s.format")
