"""Samples and train/test splits.

A row's part follows from the row itself, never from where it lies, so a split is the same however often and on
however many partitions it is computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import quoted

TRAIN, TEST = "train", "test"
_STEPS = 1_000_000


def unit(keys: list[str], seed: int, step: Column | int = 0) -> Column:
    """A number between 0 and 1 drawn by a row's key: the high 52 bits of a hash of seed, step and key.

    Rows of equal keys draw alike; a null adds nothing to a key.
    """
    step = F.lit(step) if isinstance(step, int) else step
    digest = F.xxhash64(F.lit(seed).cast("long"), step.cast("long"), *[F.col(quoted(c)) for c in keys])
    return (F.shiftrightunsigned(digest, 12).cast("double") + 0.5) / float(1 << 52)


def bernoulli_sample(df: DataFrame, fraction: float, seed: int = 1337, keys: list[str] | None = None) -> DataFrame:
    """The rows whose key (by default all columns) draws a number below ``fraction``."""
    return df.filter(unit(keys or df.columns, seed) < fraction)


def part_of(columns: list[str], train: float, test: float, seed: int = 1337) -> Column:
    """``train`` or ``test`` by weights, from a hash of the given columns; rows with equal values share a part."""
    if test == 0:
        return F.lit(TRAIN)
    step = F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in columns]), F.lit(_STEPS))
    return F.when(step < round(_STEPS * train / (train + test)), TRAIN).otherwise(TEST)


def with_part(df: DataFrame, keys: list[str] | None = None, train: float = 80, test: float = 20, seed: int = 1337,
              column: str = "part") -> DataFrame:
    """``df`` with the part of each row, by a hash of ``keys`` or else of all columns."""
    return df.withColumn(column, part_of(keys or df.columns, train, test, seed))


def random_split(df: DataFrame, train: float, test: float, seed: int = 1337,
                 keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Both parts of ``with_part``."""
    part = part_of(keys or df.columns, train, test, seed)
    return df.filter(part == TRAIN), df.filter(part == TEST)


def hash_split(df: DataFrame, keys: list[str], train_percent: int) -> tuple[DataFrame, DataFrame]:
    """Split by the hash of a key in percent."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(100))
    return df.filter(bucket < train_percent), df.filter(bucket >= train_percent)


def modulo_split(df: DataFrame, key: str, train_percent: int) -> tuple[DataFrame, DataFrame]:
    """Split by an integer key modulo 100; rows without a key are training rows."""
    part = F.coalesce(F.pmod(F.col(key), F.lit(100)), F.lit(0))
    return df.filter(part < train_percent), df.filter(part >= train_percent)
