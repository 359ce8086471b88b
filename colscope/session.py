"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_folder: str | None = None


def build_session(app: str = "colscope", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``, which every executor can reach.

    Only a local session may fall back on a temporary folder of this machine.
    """
    global _local_folder
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        _local_folder = _local_folder or tempfile.mkdtemp(prefix="colscope-")
        base = _local_folder
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def small_table(spark: SparkSession, rows: list[dict], schema: pa.Schema) -> DataFrame:
    """A driver-side table of metadata size (columns, bins, tree nodes)."""
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=schema))


def quoted(name: str) -> str:
    """A column name for ``F.col`` that is taken literally, dots included."""
    return "`" + name.replace("`", "``") + "`"


def plain_names(df: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, str]] | None:
    """``df`` with only these columns under plain names, and old names by new; None if none of them has a dot."""
    if not any("." in c or "`" in c for c in columns):
        return None
    names = {c: f"__column_{i}" for i, c in enumerate(columns)}
    return df.select(*[F.col(quoted(c)).alias(n) for c, n in names.items()]), {n: c for c, n in names.items()}


def renamed_values(df: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """``df`` with the values of ``column`` replaced by what ``names`` has for them."""
    lookup = F.create_map(*[F.lit(x) for item in names.items() for x in item])
    return df.withColumn(column, lookup[F.col(column)])


def on_driver(df: DataFrame) -> DataFrame:
    """A table of metadata size (a row per column, node or bin), computed now and kept as a local relation."""
    return df.sparkSession.createDataFrame(df.toArrow())
