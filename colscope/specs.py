"""Column descriptions shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

NUMBER, PERCENTAGE, CATEGORY, TEXT, DATE = "Number", "Percentage", "Category", "Text", "Date"
AUTO_DETECT = "AutoDetect"
MISSING = "_MISSING_"
OTHERS = "Others"


@dataclass(frozen=True)
class ColumnSpec:
    """One column: its name, semantic type and what an update does to it.

    ``ignored`` columns are dropped by cleaning.  ``status`` is one of ``unmodified``, ``modified``,
    ``new`` or ``deleted``; ``formula`` (a Column or a Spark SQL expression) gives the value of new and
    recalculated columns.
    """

    name: str
    datatype: str = TEXT
    position: int = 0
    format: str = ""
    decimal: int = 0
    ignored: bool = False
    calculated: bool = False
    formula: Any = None
    new_name: str | None = None
    status: str = "unmodified"
    extra: dict = field(default_factory=dict, compare=False)

    @property
    def numeric(self) -> bool:
        return self.datatype in (NUMBER, PERCENTAGE)

    @property
    def final_name(self) -> str:
        return self.new_name or self.name


def specs_of(df: DataFrame, categories: tuple[str, ...] = ()) -> list[ColumnSpec]:
    """Specs from the physical schema: numbers, dates, and text unless named in ``categories``."""
    specs = []
    for position, f in enumerate(df.schema.fields):
        if isinstance(f.dataType, T.NumericType):
            kind = NUMBER
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            kind = DATE
        else:
            kind = CATEGORY if f.name in categories else TEXT
        specs.append(ColumnSpec(f.name, kind, position))
    return specs
