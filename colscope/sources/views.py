"""Datasets as named SQL relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..specs import ColumnSpec


def register_views(datasets: dict[str, DataFrame]) -> None:
    """Make every dataset queryable by name in its session."""
    for name, df in datasets.items():
        df.createOrReplaceTempView(name)


def sql_type(spec: ColumnSpec) -> str:
    return "DOUBLE" if spec.numeric else "STRING"


def typed_view(df: DataFrame, specs: list[ColumnSpec]) -> DataFrame:
    """Columns cast to the SQL type of their semantic type."""
    return df.select(*[F.col(s.name).try_cast(sql_type(s)).alias(s.name) for s in specs])


def external_table(spark: SparkSession, name: str, path: str, specs: list[ColumnSpec]) -> DataFrame:
    """(Re)create an external Parquet table over ``path`` and return it.

    The files must hold the types of :func:`typed_view`.
    """
    columns = ", ".join(f"`{s.name}` {sql_type(s)}" for s in specs)
    location = path.replace("'", "\\'")
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    spark.sql(f"CREATE TABLE `{name}` ({columns}) USING parquet LOCATION '{location}'")
    return spark.table(name)
