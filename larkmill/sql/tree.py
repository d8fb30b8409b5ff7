"""Syntax trees of expressions, SELECT, and the other statements."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Name:
    name: str
    table: str | None = None


@dataclass(frozen=True)
class Literal:
    value: object


@dataclass(frozen=True)
class Star:
    table: str | None = None


@dataclass(frozen=True)
class Unary:
    op: str  # - NOT
    arg: object


@dataclass(frozen=True)
class Binary:
    op: str  # + - * / % = != < > <= >= AND OR LIKE ||
    left: object
    right: object


@dataclass(frozen=True)
class IsNull:
    arg: object
    negated: bool = False


@dataclass(frozen=True)
class InList:
    arg: object
    values: tuple


@dataclass(frozen=True)
class InQuery:
    arg: object
    query: Select


@dataclass(frozen=True)
class Scalar:
    query: Select


@dataclass(frozen=True)
class Case:
    whens: tuple  # of (condition, value)
    otherwise: object = None


@dataclass(frozen=True)
class Cast:
    arg: object
    kind: str


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    params: tuple = ()
    distinct: bool = False


@dataclass(frozen=True)
class Over:
    call: Call
    partition: tuple = ()
    order: tuple = ()


@dataclass(frozen=True)
class Item:
    expr: object
    alias: str | None = None


@dataclass(frozen=True)
class Order:
    name: Name
    descending: bool = False


@dataclass(frozen=True)
class Source:
    """A table or view (name, with its database), a connector's resource, or a query; alias as written."""

    name: str | None
    database: str | None = None
    alias: str | None = None
    connector: str | None = None
    query: Select | None = None


@dataclass(frozen=True)
class Join:
    how: str  # inner left right full cross left_semi left_anti
    source: Source
    on: object


@dataclass(frozen=True)
class Select:
    items: tuple
    source: Source | None = None
    joins: tuple = ()
    where: object = None
    group: tuple = ()
    having: object = None
    order: tuple = ()
    limit: int | None = None
    offset: int = 0
    distinct: bool = False
    #: "", ROLLUP or CUBE of group; queries that are put to this one's rows: (UNION, UNION ALL, INTERSECT or EXCEPT, query); named queries.
    grouping: str = ""
    more: tuple = ()
    named: tuple = ()


@dataclass
class Statement:
    """Anything else: action (create, drop, alter, show, ...), entity, name and clauses."""

    action: str
    entity: str = ""
    name: str = ""
    database: str | None = None
    clauses: dict = field(default_factory=dict)
    query: Select | None = None
    text: str = ""


def text(e: object) -> str:
    """An expression in a canonical form: the default name of a column, and what makes two expressions the same."""
    if isinstance(e, Name):
        return f"{e.table}.{e.name}" if e.table else e.name
    if isinstance(e, Literal):
        if e.value is None:
            return "NULL"
        return "'" + e.value.replace("'", "''") + "'" if isinstance(e.value, str) else str(e.value)
    if isinstance(e, Star):
        return f"{e.table}.*" if e.table else "*"
    if isinstance(e, Unary):
        return f"({e.op} {text(e.arg)})" if e.op == "NOT" else f"{e.op}{text(e.arg)}"
    if isinstance(e, Binary):
        return f"({text(e.left)} {e.op} {text(e.right)})"
    if isinstance(e, IsNull):
        return f"({text(e.arg)} IS {'NOT ' * e.negated}NULL)"
    if isinstance(e, InList):
        return f"({text(e.arg)} IN ({', '.join(map(text, e.values))}))"
    if isinstance(e, InQuery):
        return f"({text(e.arg)} IN (subquery {hash(e.query) & 0xFFFFFFFF}))"
    if isinstance(e, Scalar):
        return f"(subquery {hash(e.query) & 0xFFFFFFFF})"
    if isinstance(e, Case):
        return "CASE " + " ".join(f"WHEN {text(c)} THEN {text(v)}" for c, v in e.whens) + (f" ELSE {text(e.otherwise)}" if e.otherwise is not None else "") + " END"
    if isinstance(e, Cast):
        return f"CAST({text(e.arg)} AS {e.kind})"
    if isinstance(e, Call):
        params = f"({', '.join(map(text, e.params))})" if e.params else ""
        return f"{e.name.upper()}{params}({'DISTINCT ' * e.distinct}{', '.join(map(text, e.args))})"
    if isinstance(e, Over):
        keys = [f"PARTITION BY {', '.join(map(text, e.partition))}"] * bool(e.partition)
        keys += [f"ORDER BY {', '.join(text(o.name) + ' DESC' * o.descending for o in e.order)}"] * bool(e.order)
        return f"{text(e.call)} OVER ({' '.join(keys)})"
    raise TypeError(e)


def parts(e: object) -> tuple:
    """The expressions right below e; those of subqueries are not."""
    if isinstance(e, (Unary, IsNull, Cast)):
        return (e.arg,)
    if isinstance(e, Binary):
        return (e.left, e.right)
    if isinstance(e, InList):
        return (e.arg, *e.values)
    if isinstance(e, InQuery):
        return (e.arg,)
    if isinstance(e, Case):
        return (*(x for w in e.whens for x in w), *([e.otherwise] if e.otherwise is not None else []))
    if isinstance(e, Call):
        return e.args
    if isinstance(e, Over):
        return (*e.call.args, *e.partition)
    return ()
