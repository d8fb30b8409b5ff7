"""Data quality checks, any number of them on one table in a single pass (UNIQUE apart)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    """kind: UNIQUE, RANGE, EXPRESSION or MIN_ROWS; condition: what a row must meet, for EXPRESSION."""

    kind: str
    column: str | None = None
    low: float | None = None
    high: float | None = None
    min_rows: int | None = None
    condition: Column | None = None


def violations(df: DataFrame, checks: list[Check]) -> list[int]:
    """For each check: rows whose value is not unique (rows of null count as equal), rows outside the range or without a value, rows
    that do not meet the condition, or rows that are missing."""
    columns = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(checks):
        if c.kind == "RANGE":
            ok = F.lit(True)
            if c.low is not None:
                ok = ok & (F.col(c.column) >= c.low)
            if c.high is not None:
                ok = ok & (F.col(c.column) <= c.high)
            columns.append(F.count_if(~F.coalesce(ok, F.lit(False))).alias(f"v{i}"))
        elif c.kind == "EXPRESSION":
            columns.append(F.count_if(~F.coalesce(c.condition, F.lit(False))).alias(f"v{i}"))
    row = df.agg(*columns).first()
    out = []
    for i, c in enumerate(checks):
        if c.kind == "UNIQUE":
            found = df.groupBy(c.column).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("v"))
            out.append(int(found.first().v))
        elif c.kind == "MIN_ROWS":
            out.append(max(0, c.min_rows - row.rows))
        else:
            out.append(int(row[f"v{i}"]))
    return out
