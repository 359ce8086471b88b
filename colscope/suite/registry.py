"""Registry of the named queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, folder) under ``name``, with its SQL twin if there is one."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def r6(x, name: str | None = None) -> Column:
    """Rounded to six places, so that summation order does not show."""
    rounded = F.round(F.col(x) if isinstance(x, str) else x, 6)
    return rounded.alias(name or x) if name or isinstance(x, str) else rounded


# The five primes of the 64-bit hash, and the seed Spark begins with.
_P1, _P2, _P3, _P4, _P5 = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579,
                           2870177450012600261)
_SEED = 42


def draws_sql(rows: str, keys: list[str]) -> str:
    """``rows`` with ``u``, the number that whole numbers not below zero draw, as ``operators.split.unit`` has it."""
    modulus = "18446744073709551616::UHUGEINT"

    def times(a: str, c: int) -> str:
        return f"(({a}) * {c}::UHUGEINT % {modulus})"

    def turned(a: str, bits: int) -> str:
        return f"(({a}) * {1 << bits}::UHUGEINT % {modulus} + ({a}) // {1 << (64 - bits)}::UHUGEINT)"

    sql = f"SELECT *, {_SEED}::UHUGEINT AS h FROM ({rows})"
    for key in keys:
        for step in (
            f"(h + {_P5 + 8}::UHUGEINT) % {modulus} AS h, {times(f'{key}::UHUGEINT', _P2)} AS k",
            f"xor(h, {times(turned('k', 31), _P1)}) AS h", f"({times(turned('h', 27), _P1)} + {_P4}::UHUGEINT) % {modulus} AS h",
            f"{times(f'xor(h, h // {1 << 33}::UHUGEINT)', _P2)} AS h", f"{times(f'xor(h, h // {1 << 29}::UHUGEINT)', _P3)} AS h",
            f"xor(h, h // {1 << 32}::UHUGEINT) AS h",
        ):
            drop = "h, k" if "AS k" in step and key is not keys[0] else "h"
            sql = f"SELECT * EXCLUDE ({drop}), {step} FROM ({sql})"
    return f"SELECT * EXCLUDE (h, k), ((h // 4096)::DOUBLE + 0.5) / 4503599627370496 AS u FROM ({sql})"
