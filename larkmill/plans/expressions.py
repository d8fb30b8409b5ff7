"""Expressions to Spark columns, with the dialect's two-valued logic."""

from __future__ import annotations

from collections.abc import Callable
from operator import add, eq, ge, gt, le, lt, mul, ne, sub

from pyspark.errors import AnalysisException
from pyspark.sql import Column
from pyspark.sql import functions as F

from larkmill.errors import PlanProblem
from larkmill.functions.aggregate import NAMES as AGGREGATES
from larkmill.functions.kinds import Typed, kind_of, type_of
from larkmill.functions.scalar import SCALARS
from larkmill.sql.tree import Binary, Call, Case, Cast, InList, InQuery, IsNull, Literal, Name, Over, Scalar, Star, Unary, text

_COMPARISONS = {"=": eq, "!=": ne, "<": lt, "<=": le, ">": gt, ">=": ge}
_SUMS = {"+": add, "-": sub, "*": mul}


class Compiler:
    """Columns of expressions. look_up finds names, made has columns for whole expressions by their text, subquery plans a SELECT,
    functions has functions that the session was given."""

    def __init__(self, look_up: Callable[[Name], Typed], subquery: Callable, functions: dict[str, Callable], spark) -> None:
        self.look_up, self.subquery, self.functions, self.spark = look_up, subquery, functions, spark
        self.made: dict[str, Typed] = {}

    def __call__(self, e: object) -> Typed:
        if (key := text(e)) in self.made and not isinstance(e, Literal):
            return self.made[key]
        return getattr(self, f"_{type(e).__name__.lower()}")(e)

    def truth(self, e: object, filtering: bool = False) -> Column:
        """e as true or false, never null. filtering: null does for false, so that plain comparisons reach the scan."""
        if isinstance(e, Binary) and e.op in ("AND", "OR"):
            a, b = self.truth(e.left, filtering), self.truth(e.right, filtering)
            return a & b if e.op == "AND" else a | b
        if isinstance(e, Unary) and e.op == "NOT":
            return ~self.truth(e.arg)
        if filtering and isinstance(e, InQuery):
            return self.member(e)
        if isinstance(e, Binary) and e.op in _COMPARISONS and text(e) not in self.made:
            found = self.compare(e)
            return found if filtering else F.coalesce(found, F.lit(False))
        x = self(e)
        if x.kind == "bool":
            found = x.col
        elif x.kind == "text":
            found = x.col != ""
        elif x.numeric:
            found = x.col != 0
        elif x.kind == "null":
            found = F.lit(False)
        else:
            found = x.col.isNotNull()
        return found if filtering else F.coalesce(found, F.lit(False))

    def compare(self, e: Binary) -> Column:
        a, b = self(e.left), self(e.right)
        if "null" in (a.kind, b.kind) or a.numeric and b.kind == "text" or b.numeric and a.kind == "text":
            return F.lit(False)
        left, right = a.col, b.col
        if a.kind == "bool" and b.kind != "bool":
            left = left.cast("int")
        if b.kind == "bool" and a.kind != "bool":
            right = right.cast("int")
        out = _COMPARISONS[e.op](left, right)
        for x in (a, b):
            if x.kind == "float" and not x.never_nan:
                out = ~F.isnan(x.col) & out
        return out

    def _name(self, e: Name) -> Typed:
        return self.look_up(e)

    def _literal(self, e: Literal) -> Typed:
        if e.value is None:
            return Typed(F.lit(None), "null", True)
        if isinstance(e.value, str):
            return Typed(F.lit(e.value), "text", True)
        return Typed(F.lit(e.value).cast("long") if isinstance(e.value, int) else F.lit(e.value), "int" if isinstance(e.value, int) else "float", True)

    def _unary(self, e: Unary) -> Typed:
        if e.op == "NOT":
            return Typed(~self.truth(e.arg), "bool", True)
        x = self.number(e.arg, "-")
        return Typed(-x.col, x.kind, x.never_nan)

    def number(self, e: object, op: str) -> Typed:
        x = self(e)
        if x.kind == "bool":
            return Typed(x.col.cast("long"), "int", True)
        if not x.numeric and x.kind != "null":
            raise PlanProblem(f"{op} needs numbers, not {text(e)}")
        return x

    def _binary(self, e: Binary) -> Typed:
        if e.op in ("AND", "OR") or e.op in _COMPARISONS:
            return Typed(self.truth(e), "bool", True)
        if e.op == "LIKE":
            return Typed(F.coalesce(self(e.left).col.like(self._pattern(e.right)), F.lit(False)), "bool", True)
        if e.op == "||":
            return Typed(F.concat(self(e.left).col.cast("string"), self(e.right).col.cast("string")), "text")
        a, b = self.number(e.left, e.op), self.number(e.right, e.op)
        whole = a.kind != "float" and b.kind != "float"
        left, right = (x.col.cast("long") if whole else x.col.cast("double") for x in (a, b))
        if e.op in _SUMS:
            return Typed(_SUMS[e.op](left, right), "int" if whole else "float")
        if e.op == "%":
            return Typed(left % right, "int" if whole else "float")
        left, right = left.cast("double"), right.cast("double")
        if isinstance(e.right, Literal) and e.right.value:
            return Typed(left / right, "float", a.never_nan)
        endless = F.when(left > 0, float("inf")).when(left < 0, float("-inf")).when(left.isNotNull(), float("nan"))
        return Typed(F.when(right == 0, endless).otherwise(left / right), "float")

    def _pattern(self, e: object) -> str:
        if not isinstance(e, Literal) or not isinstance(e.value, str):
            raise PlanProblem("LIKE needs a literal pattern")
        return e.value

    def _isnull(self, e: IsNull) -> Typed:
        x = self(e.arg).col
        return Typed(x.isNotNull() if e.negated else x.isNull(), "bool", True)

    def _inlist(self, e: InList) -> Typed:
        found = [F.coalesce(self.compare(Binary("=", e.arg, v)), F.lit(False)) for v in e.values]
        out = found[0]
        for f in found[1:]:
            out = out | f
        return Typed(out, "bool", True)

    def _inquery(self, e: InQuery) -> Typed:
        return Typed(F.coalesce(self.member(e), F.lit(False)), "bool", True)

    def member(self, e: InQuery) -> Column:
        """Whether the value is among the query's, null for a null value: left bare in a filter, it is planned as a semi join."""
        df = self.subquery(e.query)
        x, kind = self(e.arg), kind_of(df.schema[0].dataType)
        if x.numeric != (kind in ("int", "float", "bool")):
            return F.lit(False)
        first = df.select(df[df.columns[0]].alias("v")).where("v is not null")
        return x.col.isin(first)

    def _scalar(self, e: Scalar) -> Typed:
        """The first value; 0 when there is no row."""
        df = self.subquery(e.query)
        kind = kind_of(df.schema[0].dataType)
        first = df.select(df[df.columns[0]].alias("v")).limit(1)
        value = first.agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("n"))
        if kind == "text":
            return Typed(value.select("v").scalar(), kind)
        return Typed(value.select(F.when(F.col("n") == 0, F.lit(0)).otherwise(F.col("v"))).scalar(), "int" if kind == "null" else kind)

    def _case(self, e: Case) -> Typed:
        values = [self(v) for _, v in e.whens] + ([self(e.otherwise)] if e.otherwise is not None else [])
        out = None
        for (cond, _), v in zip(e.whens, values, strict=False):
            out = F.when(self.truth(cond), v.col) if out is None else out.when(self.truth(cond), v.col)
        out = out.otherwise(values[-1].col) if e.otherwise is not None else out
        kinds = {v.kind for v in values} - {"null"}
        return Typed(out, kinds.pop() if len(kinds) == 1 else "float" if kinds <= {"int", "float"} else "text")

    def _cast(self, e: Cast) -> Typed:
        t = type_of(e.kind)
        return Typed(self(e.arg).col.try_cast(t), kind_of(t))

    def _star(self, e: Star) -> Typed:
        raise PlanProblem("* is only for a select list and COUNT")

    def _over(self, e: Over) -> Typed:
        raise PlanProblem("A window function must be a whole item of the select list")

    def _call(self, e: Call) -> Typed:
        name = e.name.upper()
        if name in AGGREGATES:
            raise PlanProblem(f"Aggregate {name} is not allowed here")
        if name == "NTILE":
            raise PlanProblem("NTILE needs OVER")
        args = [self(a) for a in e.args]
        if name in self.functions:
            return self.functions[name](*args)
        if name in SCALARS:
            if len(args) != 2:
                raise PlanProblem(f"{name} takes two arguments")
            return SCALARS[name](*args)
        if e.params or not self.spark.catalog.functionExists(name.lower()):
            raise PlanProblem(f"Unknown function {e.name}")
        return Typed(F.call_function(name.lower(), *(a.col for a in args)), self.kind_of_call(name.lower(), e, args))

    def kind_of_call(self, name: str, e: Call, args: list[Typed]) -> str:
        """What kind of value one of Spark's own functions gives for arguments of these kinds; literals stand for themselves."""
        stand_ins = {"int": "bigint", "float": "double", "text": "string", "bool": "boolean", "time": "timestamp", "null": "void"}
        if any(a.kind not in stand_ins for a in args):
            return "other"
        given = (a.col if isinstance(x, Literal) else F.lit(None).cast(stand_ins[a.kind]) for x, a in zip(e.args, args, strict=True))
        try:
            return kind_of(self.spark.range(1).select(F.call_function(name, *given).alias("v")).schema[0].dataType)
        except AnalysisException:  # the statement itself will say what is wrong
            return "other"
