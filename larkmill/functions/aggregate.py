"""Aggregates, plain and over whole partitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkmill.errors import PlanProblem
from larkmill.functions.kinds import Typed
from larkmill.sql.tree import Call, Literal, Star

NAMES = frozenset({"COUNT", "SUM", "AVG", "MIN", "MAX", "QUANTILE", "MEDIAN", "PERCENTILE", "APPROX_QUANTILE"})


def level(call: Call) -> float:
    """Between 0 and 1: of QUANTILE(p)(x), QUANTILE(x, p), PERCENTILE(x, p in percent) and MEDIAN(x)."""
    name = call.name.upper()
    if name == "MEDIAN":
        return 0.5
    given = call.params[0] if call.params else call.args[1] if len(call.args) > 1 else None
    if not isinstance(given, Literal) or isinstance(given.value, str) or given.value is None:
        raise PlanProblem(f"{name} needs a literal level")
    p = given.value / 100 if name == "PERCENTILE" else float(given.value)
    if not 0 <= p <= 1:
        raise PlanProblem(f"{name} level {given.value} is out of range")
    return p


def aggregate(call: Call, args: list[Typed]) -> Typed:
    """SUM of nothing is 0; AVG, MIN, MAX and quantiles of nothing are null; COUNT(x) leaves nulls out. Quantiles are exact and so keep a
    group's distinct values in one task; APPROX_QUANTILE(p)(x) is one of the values, a part in 10,000 of the ranks off, in bounded memory."""
    name = call.name.upper()
    if name == "COUNT" and (not call.args or isinstance(call.args[0], Star)):
        return Typed(F.count(F.lit(1)), "int", True)
    if not args:
        raise PlanProblem(f"{name} needs an argument")
    x = args[0]
    if name == "COUNT":
        return Typed(F.count_distinct(x.col) if call.distinct else F.count(x.col), "int", True)
    if name in ("MIN", "MAX"):
        return Typed(getattr(F, name.lower())(x.col), x.kind)
    if not x.numeric:
        raise PlanProblem(f"{name} needs a number")
    col: Column = x.col.cast("long") if x.kind == "bool" else x.col
    if name == "SUM":
        total = F.sum_distinct(col) if call.distinct else F.sum(col)
        return Typed(F.coalesce(total, F.lit(0 if x.kind != "float" else 0.0)), "float" if x.kind == "float" else "int")
    if name == "AVG":
        return Typed(F.avg(col), "float")
    if name == "APPROX_QUANTILE":
        return Typed(F.percentile_approx(col.cast("double"), level(call), 10_000), "float")
    return Typed(F.percentile(col, level(call)), "float")
