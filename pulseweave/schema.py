"""Event rows: integer-nanosecond time, arrival rank, channel, value and optional pixel columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT, _WHOLE, _LONG = T.StringType(), T.IntegerType(), T.LongType()
EVENT_SCHEMA = T.StructType(
    [T.StructField("t_ns", _LONG), T.StructField("seq", _LONG), T.StructField("ch", _WHOLE), T.StructField("val", T.DoubleType())]
    + [T.StructField(c, _WHOLE) for c in ("x", "y", "polarity")]
    + [T.StructField("unit", _TEXT), T.StructField("attrs", T.MapType(_TEXT, _TEXT))]
)
TENSOR_SCHEMA = T.StructType([T.StructField("ts", _LONG), T.StructField("idx", T.ArrayType(_WHOLE)), T.StructField("val", T.DoubleType()), T.StructField("seq", _LONG)])

#: Nanoseconds in a unit of time.
UNIT_NS = {"ns": 1, "us": 1_000, "ms": 1_000_000, "s": 1_000_000_000}


class EventError(ValueError):
    """A bad parameter or input; kind names the operator family."""

    def __init__(self, kind: str, message: str):
        super().__init__(f"{kind}: {message}")
        self.kind = kind


def time_ns(value: int | float | str) -> int:
    """Nanoseconds of an integer (already ns) or of a literal such as "10 ms"; halves round to even."""
    if isinstance(value, (int, float)):
        return round(value)
    text = value.strip().lower()
    for unit in ("ns", "us", "ms", "s"):
        if text.endswith(unit):
            return round(float(text[: -len(unit)]) * UNIT_NS[unit])
    return round(float(text))


def as_events(df: DataFrame, **columns) -> DataFrame:
    """Rows in EVENT_SCHEMA: columns by name from expressions, missing ones null."""
    return df.select(*[(F.expr(columns[f.name]) if f.name in columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in EVENT_SCHEMA])


def floor_div(name: str, b: int) -> F.Column:
    """Floor of an integer column over a positive integer, exactly; `div` alone truncates towards zero."""
    return F.expr(f"({name} - pmod({name}, {b}L)) div {b}L")
