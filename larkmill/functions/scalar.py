"""The named scalar functions: arithmetic that never fails and comparisons that give 1 or 0."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkmill.errors import PlanProblem
from larkmill.functions.kinds import Typed


def _number(x: Typed) -> Column:
    """As double; what is no number counts as 0."""
    if x.numeric:
        return x.col.cast("double")
    return F.coalesce(x.col.try_cast("double"), F.lit(0.0)) if x.kind == "text" else F.lit(0.0)


def _arithmetic(op: Callable[[Column, Column], Column]) -> Callable[[Typed, Typed], Typed]:
    return lambda a, b: Typed(op(_number(a), _number(b)), "float")


def _comparison(op: Callable[[Column, Column], Column]) -> Callable[[Typed, Typed], Typed]:
    def made(a: Typed, b: Typed) -> Typed:
        if a.numeric != b.numeric:
            raise PlanProblem("Both arguments of a comparison function must be numbers, or neither")
        return Typed(F.coalesce(op(a.col, b.col), F.lit(False)).cast("int"), "int", True)

    return made


def _or_zero(op: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(op(a, b))


SCALARS: dict[str, Callable[[Typed, Typed], Typed]] = {
    "ADD": _arithmetic(lambda a, b: a + b),
    "SUB": _arithmetic(lambda a, b: a - b),
    "MUL": _arithmetic(lambda a, b: a * b),
    "DIV": _arithmetic(_or_zero(lambda a, b: a / b)),
    "MOD": _arithmetic(_or_zero(lambda a, b: a % b)),
    "EQ": _comparison(lambda a, b: a == b),
    "NE": _comparison(lambda a, b: a != b),
    "GT": _comparison(lambda a, b: a > b),
    "LT": _comparison(lambda a, b: a < b),
    "GE": _comparison(lambda a, b: a >= b),
    "LE": _comparison(lambda a, b: a <= b),
}
