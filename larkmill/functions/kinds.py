"""Type names of the dialect, and what the compiler needs to know of a column's type."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import types as T

from larkmill.errors import PlanProblem

#: Names in lower case; unsigned integers take the next wider type.
TYPES = {
    "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(), "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "float32": T.FloatType(), "float64": T.DoubleType(), "string": T.StringType(), "fixedstring": T.StringType(), "date": T.DateType(), "datetime": T.TimestampType(), "bool": T.BooleanType(), "uuid": T.StringType(),
    "tinyint": T.ByteType(), "smallint": T.ShortType(), "int": T.IntegerType(), "integer": T.IntegerType(), "bigint": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "varchar": T.StringType(), "text": T.StringType(),
    "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
}


def type_of(name: str) -> T.DataType:
    """The Spark type of a type name; Decimal(p, s) and Array(type) take arguments."""
    base, _, rest = name.lower().partition("(")
    if base == "decimal":
        p, _, s = rest.rstrip(")").partition(",")
        return T.DecimalType(int(p or 10), int(s or 0))
    if base == "array":
        return T.ArrayType(type_of(rest[:-1]))
    if base not in TYPES:
        raise PlanProblem(f"Unknown type {name}")
    return TYPES[base]


def name_of(kind: T.DataType) -> str:
    """The dialect's name of a Spark type."""
    for name in ("int8", "int16", "int32", "int64", "uint64", "float32", "float64", "string", "date", "datetime", "bool"):
        if TYPES[name] == kind:
            return re.sub(r"^(u?)(\w)", lambda m: m[1].upper() + m[2].upper(), name).replace("Datetime", "DateTime")
    return kind.simpleString()


@dataclass(frozen=True)
class Typed:
    """A column and its kind: int, float, text, bool, time, null or other. never_nan: comparisons need no guard."""

    col: Column
    kind: str
    never_nan: bool = False

    @property
    def numeric(self) -> bool:
        return self.kind in ("int", "float", "bool")


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) or isinstance(t, T.DecimalType) and t.scale == 0:
        return "int"
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(t, T.StringType):
        return "text"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    return "null" if isinstance(t, T.NullType) else "other"
