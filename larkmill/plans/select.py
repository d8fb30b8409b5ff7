"""SELECT to a DataFrame: sources, joins, filter, then windows or aggregates or a projection, then order and limit."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkmill.errors import PlanProblem
from larkmill.functions.aggregate import NAMES as AGGREGATES
from larkmill.functions.aggregate import aggregate
from larkmill.functions.kinds import Typed, kind_of
from larkmill.plans.expressions import Compiler
from larkmill.sql.tree import Call, Item, Literal, Name, Over, Select, Source, Star, parts, text

DEPTH = 16
#: Ranges of the first sort key in which rows are ranked when a rank goes over the whole table.
RANGES = 128


def walk(e: object) -> Iterator[object]:
    yield e
    for p in parts(e):
        yield from walk(p)


def _measure(col: Column, kind: T.DataType) -> Column:
    """A double that never falls as col rises, null for null; the same for all values of a type that has none."""
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return col.cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col).cast("double")
    if isinstance(kind, (T.DateType, T.TimestampNTZType)):
        return F.unix_date(col.cast("date")).cast("double")
    if kind == T.StringType():
        return F.conv(F.rpad(F.substring(F.hex(col.cast("binary")), 1, 12), 12, "0"), 16, 10).cast("double")
    return F.lit(0.0)


def _repeatable(df: DataFrame) -> bool:
    """Whether df has the same rows each time it is computed."""
    plan = df._jdf.queryExecution().analyzed()
    return plan.deterministic() and not re.search(r"\b(GlobalLimit|LocalLimit|Offset|Sample)\b", plan.toString())


def _ntile(n: int, rank: Column, total: Column) -> Column:
    """The bucket of a rank from 1 to total: the first total % n buckets have one row more than the others."""
    size, more = F.floor(total / n), total % n
    cut = more * (size + 1)
    return F.when(rank <= cut, F.floor((rank - 1) / (size + 1)) + 1).otherwise(more + F.floor((rank - 1 - cut) / F.greatest(size, F.lit(1))) + 1)


def _aggregates(e: object) -> list[Call]:
    return [x for x in walk(e) if isinstance(x, Call) and x.name.upper() in AGGREGATES]


class Scope:
    """Columns of all sources under unique names."""

    def __init__(self) -> None:
        self.columns: list[tuple[str, str, str, str]] = []  # source, column, name in the frame, kind

    def add(self, source: str, df: DataFrame) -> DataFrame:
        at = len(self.columns)
        if any(s == source for s, *_ in self.columns):
            raise PlanProblem(f"Two sources are named {source}")
        new = [(source, f.name, f"c{at + i}", kind_of(f.dataType)) for i, f in enumerate(df.schema)]
        self.columns += new
        return df.toDF(*(n for _, _, n, _ in new))

    def hide(self, n: int) -> None:
        """The last n columns are no longer to be found; their names stay taken."""
        self.columns[-n:] = [("", "", at, "other") for *_, at, _ in self.columns[-n:]]

    def find(self, name: Name) -> Typed | None:
        found = [(n, k) for s, c, n, k in self.columns if c == name.name and name.table in (None, s)]
        if not found:
            low = name.name.lower()
            found = [(n, k) for s, c, n, k in self.columns if c.lower() == low and (name.table is None or name.table.lower() == s.lower())]
        if len(found) > 1:
            raise PlanProblem(f"Ambiguous column {text(name)}")
        return Typed(F.col(found[0][0]), found[0][1], False) if found else None


class SelectPlanner:
    """tables: (database, name) to a DataFrame; connectors: (connector, resource, row limit) to one."""

    def __init__(self, spark, tables: Callable, connectors: Callable, functions: dict) -> None:
        self.spark, self.tables, self.connectors, self.functions = spark, tables, connectors, functions
        self.named_queries: dict[str, Select] = {}

    def plan(self, q: Select) -> DataFrame:
        if q.named:
            return self.with_named(q)
        if q.more:
            return self.together(q)
        scope = Scope()
        df = self.sources(q, scope)
        aliases = {i.alias: i.expr for i in q.items if i.alias and not isinstance(i.expr, Name)} | {i.alias: i.expr for i in q.items if i.alias and isinstance(i.expr, Name) and i.expr.name != i.alias}
        nesting: list[str] = []

        def look_up(name: Name) -> Typed:
            found = scope.find(name)
            if found:
                return found
            if name.table is None and name.name in aliases:
                if name.name in nesting or len(nesting) >= DEPTH:
                    raise PlanProblem(f"Alias {name.name} refers to itself")
                nesting.append(name.name)
                try:
                    return compiler(aliases[name.name])
                finally:
                    nesting.pop()
            raise PlanProblem(f"Unknown column {text(name)}")

        compiler = Compiler(look_up, self.plan, self.functions, self.spark)
        if q.where is not None:
            if any(_aggregates(self.expand(x, aliases, scope)) for x in walk(q.where)):
                raise PlanProblem("Aggregates are not allowed in WHERE")
            df = df.where(compiler.truth(q.where, filtering=True))
        items = self.items(q, scope)
        windows = [i for i in items if isinstance(i.expr, Over)]
        grouped = bool(q.group) or any(_aggregates(i.expr) for i in items if not isinstance(i.expr, Over)) or q.having is not None
        if windows and grouped:
            raise PlanProblem("Window functions and aggregates cannot be mixed in one SELECT")
        if grouped:
            return self.aggregated(q, df, scope, aliases, compiler)
        df = self.whole_table(items, df, scope, compiler)
        named = [self.named(at, i, scope, compiler) for at, i in enumerate(items)]
        return self.finish(q, df, named, lambda n: scope.find(n))

    # several queries

    def with_named(self, q: Select) -> DataFrame:
        """Named queries are planned wherever they are read; each sees those before it."""
        outer = self.named_queries
        try:
            for name, query in q.named:
                before = self.named_queries
                self.named_queries = before | {name: (query, before)}
            return self.plan(replace(q, named=()))
        finally:
            self.named_queries = outer

    def together(self, q: Select) -> DataFrame:
        """Columns by position, under the names of the first query. All but UNION ALL give each row once."""
        df = self.plan(replace(q, more=()))
        for kind, other in q.more:
            right = self.plan(other)
            if len(right.columns) != len(df.columns):
                raise PlanProblem(f"{kind} needs as many columns on both sides")
            kinds = [(kind_of(a.dataType), kind_of(b.dataType)) for a, b in zip(df.schema, right.schema, strict=True)]
            if any(a != b and "null" not in (a, b) and not {a, b} <= {"int", "float"} for a, b in kinds):
                raise PlanProblem(f"{kind} needs columns of one kind on both sides")
            right = right.toDF(*df.columns)
            if kind.startswith("UNION"):
                df = df.union(right) if kind == "UNION ALL" else df.union(right).distinct()
            else:
                df = df.intersect(right) if kind == "INTERSECT" else df.subtract(right)
        return df

    # sources

    def sources(self, q: Select, scope: Scope) -> DataFrame:
        if q.source is None:
            return self.spark.range(1).select(F.lit(1).alias("unused"))
        plain = q.where is None and not (q.order or q.group or q.having or q.joins or q.distinct) and not any(_aggregates(i.expr) or isinstance(i.expr, Over) for i in q.items)
        df = scope.add(*self.source(q.source, q.limit + q.offset if plain and q.limit is not None else None))
        for j in q.joins:
            right = scope.add(*self.source(j.source, None))
            compiler = Compiler(lambda n: scope.find(n) or self.missing(n), self.plan, self.functions, self.spark)
            if j.how == "cross":
                df = df.crossJoin(right)
                continue
            if _aggregates(j.on):
                raise PlanProblem("Aggregates are not allowed in ON")
            df = df.join(right, compiler.truth(j.on, filtering=True), j.how)
            if j.how in ("left_semi", "left_anti"):
                scope.hide(len(right.columns))
        return df

    def missing(self, n: Name) -> Typed:
        raise PlanProblem(f"Unknown column {text(n)}")

    def source(self, s: Source, limit: int | None) -> tuple[str, DataFrame]:
        if s.query is not None:
            return s.alias or "", self.plan(s.query)
        if s.connector is None and s.database is None and s.name in self.named_queries:
            query, before = self.named_queries[s.name]
            was, self.named_queries = self.named_queries, before
            try:
                return s.alias or s.name, self.plan(query)
            finally:
                self.named_queries = was
        if s.connector is not None:
            return s.alias or s.name, self.connectors(s.connector, s.name, limit)
        return s.alias or s.name, self.tables(s.database, s.name)

    # select list

    def items(self, q: Select, scope: Scope) -> list[Item]:
        """Stars are spelled out."""
        out = []
        for i in q.items:
            if not isinstance(i.expr, Star):
                out.append(i)
                continue
            if q.source is None:
                raise PlanProblem("* needs FROM")
            many = bool(q.joins)
            found = [(s, c) for s, c, _, _ in scope.columns if i.expr.table in (None, s) and c]
            if not found:
                raise PlanProblem(f"Unknown source {i.expr.table}")
            out += [Item(Name(c, s), f"{s}.{c}" if many and sum(c == d for _, d in found) > 1 else c) for s, c in found]
        return out

    def named(self, at: int, i: Item, scope: Scope, compiler: Compiler) -> tuple[str, Typed]:
        if isinstance(i.expr, Over):
            return i.alias or f"{i.expr.call.name.lower()}_over", self.window(i.expr, scope, compiler, f"w{at}")
        x = compiler(i.expr)
        return i.alias or (i.expr.name if isinstance(i.expr, Name) else text(i.expr)), x

    def whole_table(self, items: list[Item], df: DataFrame, scope: Scope, compiler: Compiler) -> DataFrame:
        """df with the aggregates over the whole table, which are computed once and joined as one row, not by a window in one task; with
        those of DISTINCT values, which are grouped by the partition's keys and joined; and with NTILE over the whole table."""
        for i, item in enumerate(items):
            e = item.expr
            if isinstance(e, Over) and e.call.name.upper() == "NTILE" and not e.partition:
                df = self.ranged_ntile(df, e, scope, compiler, f"w{i}")
            if not isinstance(e, Over) or e.call.name.upper() not in AGGREGATES or e.partition and not e.call.distinct:
                continue
            x = aggregate(e.call, [compiler(a) for a in e.call.args if not isinstance(a, Star)])
            for o in e.order:
                compiler(o.name)
            if not e.partition:
                df = df.crossJoin(F.broadcast(df.agg(x.col.alias(f"w{i}"))))
                continue
            keys = [compiler(p).col for p in e.partition]
            sums = df.groupBy(*(k.alias(f"w{i}k{j}") for j, k in enumerate(keys))).agg(x.col.alias(f"w{i}"))
            same = reduce(and_, (k.eqNullSafe(F.col(f"w{i}k{j}")) for j, k in enumerate(keys)))
            df = df.join(sums, same, "left")
        return df

    def ntile_order(self, e: Over, scope: Scope, compiler: Compiler) -> tuple[int, list[Column]]:
        """The number of buckets of NTILE, and its order; ties go by all columns."""
        n = e.call.args[0] if len(e.call.args) == 1 else None
        if not isinstance(n, Literal) or not isinstance(n.value, int) or n.value <= 0:
            raise PlanProblem("NTILE needs a positive literal number of buckets")
        if not e.order:
            raise PlanProblem("NTILE needs ORDER BY")
        keys = [compiler(o.name).col.desc_nulls_last() if o.descending else compiler(o.name).col.asc_nulls_first() for o in e.order]
        return n.value, keys + [F.col(n) for _, _, n, k in scope.columns if k not in ("other", "null")]

    def ranged_ntile(self, df: DataFrame, e: Over, scope: Scope, compiler: Compiler, at: str) -> DataFrame:
        """df with column at: NTILE over all rows, without one task that sorts them all. Ranges of the first key are ranked each for
        itself and begin after the rows of those before them; their bounds are approximate, which moves their sizes and no rank."""
        n, order = self.ntile_order(e, scope, compiler)
        if not _repeatable(df):  # rows behind a LIMIT may differ from pass to pass
            return df.withColumn(at, F.ntile(n).over(W.orderBy(*order)).cast("long"))
        first = compiler(e.order[0].name).col
        place = _measure(first, df.select(first).schema[0].dataType)
        bounds = df.agg(F.percentile_approx(place, [i / RANGES for i in range(1, RANGES)], 10_000).alias(f"{at}b"))
        part = F.coalesce(F.size(F.filter(F.col(f"{at}b"), lambda b: b < place)), F.lit(-1))
        ranged = df.crossJoin(F.broadcast(bounds)).withColumn(f"{at}p", -part if e.order[0].descending else part).drop(f"{at}b")
        sizes = ranged.groupBy(f"{at}p").agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(W.orderBy(f"{at}p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        starts = sizes.select(F.col(f"{at}p").alias(f"{at}q"), before.alias(f"{at}s"), F.sum("n").over(W.partitionBy()).alias(f"{at}t"))
        placed = ranged.join(F.broadcast(starts), F.col(f"{at}p") == F.col(f"{at}q"))
        rank = F.col(f"{at}s") + F.row_number().over(W.partitionBy(f"{at}p").orderBy(*order))
        return placed.withColumn(f"{at}r", rank).withColumn(at, _ntile(n, F.col(f"{at}r"), F.col(f"{at}t")).cast("long")).drop(*(f"{at}{x}" for x in "pqstr"))

    def window(self, e: Over, scope: Scope, compiler: Compiler, joined: str) -> Typed:
        """NTILE in the given order; aggregates over the whole partition whatever the order. joined: what whole_table() calls the item."""
        name = e.call.name.upper()
        over = W.partitionBy(*(compiler(p).col for p in e.partition))
        if name == "NTILE":
            n, order = self.ntile_order(e, scope, compiler)
            return Typed(F.ntile(n).over(over.orderBy(*order)).cast("long") if e.partition else F.col(joined), "int", True)
        if name not in AGGREGATES:
            raise PlanProblem(f"Unknown window function {e.call.name}")
        for o in e.order:
            compiler(o.name)
        x = aggregate(e.call, [compiler(a) for a in e.call.args if not isinstance(a, Star)])
        if not e.partition or e.call.distinct:
            return Typed(F.col(joined), x.kind)
        if name == "SUM":
            value = compiler(e.call.args[0])
            return Typed(F.coalesce(F.sum(value.col.cast("long") if value.kind == "bool" else value.col).over(over), F.lit(0)), x.kind)
        return Typed(x.col.over(over), x.kind)

    # aggregation

    def expand(self, e: object, aliases: dict, scope: Scope) -> object:
        """A bare name that is no column but an alias stands for the alias's expression."""
        depth = 0
        while isinstance(e, Name) and e.table is None and e.name in aliases and scope.find(e) is None and depth < DEPTH:
            e, depth = aliases[e.name], depth + 1
        return e

    def aggregated(self, q: Select, df: DataFrame, scope: Scope, aliases: dict, compiler: Compiler) -> DataFrame:
        if any(isinstance(i.expr, Star) for i in q.items):
            raise PlanProblem("* cannot be mixed with aggregates")
        keys = [self.expand(g, aliases, scope) for g in q.group]
        for k in keys:
            if _aggregates(k):
                raise PlanProblem("Aggregates are not allowed in GROUP BY")
        calls: dict[str, Call] = {}
        todo = [self.expand(i.expr, aliases, scope) for i in q.items] + ([q.having] if q.having is not None else [])
        seen: set[str] = set()
        while todo:
            for x in walk(todo.pop()):
                if isinstance(x, Call) and x.name.upper() in AGGREGATES:
                    if any(_aggregates(a) for a in x.args):
                        raise PlanProblem("Aggregates cannot be nested")
                    calls[text(x)] = x
                y = self.expand(x, aliases, scope)
                if y is not x and text(x) not in seen:
                    seen.add(text(x))
                    todo.append(y)
        group = [(f"k{i}", compiler(k)) for i, k in enumerate(keys)]
        group = [(n, Typed(x.col.cast("long"), "int", True) if x.kind == "bool" else x) for n, x in group]
        made = [(f"a{i}", aggregate(c, [compiler(a) for a in c.args if not isinstance(a, Star)])) for i, c in enumerate(calls.values())]
        columns = [x.col.alias(n) for n, x in made] or [F.count(F.lit(1)).alias("unused")]
        by = {"ROLLUP": df.rollup, "CUBE": df.cube}.get(q.grouping, df.groupBy)
        df = by(*(x.col.alias(n) for n, x in group)).agg(*columns) if group else df.agg(*columns)
        inside = {text(k): Typed(F.col(n), x.kind) for k, (n, x) in zip(keys, group, strict=True)}
        inside |= {t: Typed(F.col(n), x.kind, x.never_nan) for t, (n, x) in zip(calls, made, strict=True)}
        for k, (n, x) in zip(keys, group, strict=True):
            if isinstance(k, Name):  # the same column with and without its source
                inside |= {text(Name(c, s)): Typed(F.col(n), x.kind) for s, c, at, _ in scope.columns if scope.find(k).col._jc.toString() == at}

        def look_up(name: Name) -> Typed:
            if scope.find(name) is not None:
                bare = scope.find(name).col._jc.toString()
                for k, (n, x) in zip(keys, group, strict=True):
                    if isinstance(k, Name) and scope.find(k).col._jc.toString() == bare:
                        return Typed(F.col(n), x.kind)
                raise PlanProblem(f"Column {text(name)} must be in GROUP BY or inside an aggregate")
            if name.table is None and name.name in aliases:
                return after(self.expand(name, aliases, scope))
            raise PlanProblem(f"Unknown column {text(name)}")

        after = Compiler(look_up, self.plan, self.functions, self.spark)
        after.made = inside
        if q.having is not None:
            df = df.where(after.truth(q.having, filtering=True))
        named = [(i.alias or (i.expr.name if isinstance(i.expr, Name) else text(i.expr)), after(i.expr)) for i in q.items]

        def hidden(name: Name) -> Typed | None:
            try:
                return look_up(name)
            except PlanProblem:
                return None

        return self.finish(q, df, named, hidden)

    # order and limit

    def finish(self, q: Select, df: DataFrame, named: list[tuple[str, Typed]], hidden: Callable) -> DataFrame:
        """Order keys are output names first, else columns of the sources, which are carried along and dropped."""
        columns = [(x.col.cast("long") if x.kind == "bool" else x.col).alias(f"o{i}") for i, (_, x) in enumerate(named)]
        keys, extra = [], []
        for o in q.order:
            at = next((i for i, (n, _) in enumerate(named) if n == (o.name.name if o.name.table is None else text(o.name))), None)
            if at is None and (x := hidden(o.name)) is not None and not q.distinct:
                extra.append(x.col.alias(f"h{len(extra)}"))
                key = F.col(f"h{len(extra) - 1}")
            elif at is None:
                at = next((i for i, (n, _) in enumerate(named) if n == o.name.name and o.name.table), None)
                if at is None:
                    raise PlanProblem(f"Unknown column {text(o.name)} in ORDER BY")
                key = F.col(f"o{at}")
            else:
                key = F.col(f"o{at}")
            keys.append(key.desc_nulls_last() if o.descending else key.asc_nulls_first())
        df = df.select(*columns, *extra)
        if q.distinct:
            df = df.distinct()
        if keys:
            df = df.orderBy(*keys)
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return df.select(*(F.col(f"o{i}") for i in range(len(named)))).toDF(*(n for n, _ in named))


