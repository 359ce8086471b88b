"""What the operators share: batches of texts, the word definition, tables in the shared folder."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_folder

# Fixed value: the characters that separate words, \x09-\x0D and \x20.
BLANKS = "\t\n\x0b\x0c\r "
WORD = r"[^\x20\x09-\x0D]+"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def named(column: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col("`" + column.replace("`", "``") + "`")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _SMALL)


def byte_words(text: str) -> list[bytes]:
    """Words of a text as UTF-8; ``bytes.split`` splits at exactly the bytes of ``BLANKS``."""
    return text.encode().split()


def on_workers(df: DataFrame) -> DataFrame:
    """``df``, after making this package importable for Python workers that find the same folders."""
    environment = df.sparkSession.sparkContext.environment
    root, paths = str(Path(__file__).resolve().parents[2]), environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [paths, root]))
    return df


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, survives lost executors, keeps column pruning.

    Spark removes the shuffle files of the write when it ends, as nothing reads them again.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def emptied(table: DataFrame) -> None:
    """Overwrite a ``written`` table with no rows, once all that was made of it is written too."""
    files = table.inputFiles()
    if files:
        none = table.sparkSession.createDataFrame([], table.schema)
        none.write.mode("overwrite").parquet(files[0].rpartition("/")[0])


def slices(batch: pa.RecordBatch, column: int = 0, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``most_bytes`` in one text column, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def annotate(df: DataFrame, text: str, make: Callable[[list], list], fields: list[T.StructField],
             keep: list[str] | None = None) -> DataFrame:
    """``keep`` (by default all columns) of every row, followed by ``fields`` computed from its text.

    ``make`` gets the texts of a bounded slice (null as None) and returns a list of values per field.  A kept
    column with the name of a new one gives way to it.
    """
    added = {f.name for f in fields}
    keep = [c for c in (df.columns if keep is None else keep) if c not in added]
    inner = df.select(named(text).cast("string").alias("t"), *[named(c).alias(f"c{i}") for i, c in enumerate(keep)])
    kinds = {f.name: f.dataType for f in df.schema.fields}
    schema = T.StructType([T.StructField(f"c{i}", kinds[c]) for i, c in enumerate(keep)]
                          + [T.StructField(f"f{i}", f.dataType) for i, f in enumerate(fields)])
    types = [_ARROW[f.dataType.typeName()] for f in fields]

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                made = [pa.array(v, t) for v, t in zip(make(part.column(0).to_pylist()), types)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *made], schema.names)

    return on_workers(inner).mapInArrow(run, schema).toDF(*keep, *[f.name for f in fields])


_ARROW = {"long": pa.int64(), "integer": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(),
          "string": pa.string(), "binary": pa.binary()}
