"""Managed tables: Parquet parts under a folder, and a list of the parts that count."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkmill.errors import CatalogProblem, PlanProblem
from larkmill.functions.kinds import kind_of, type_of
from larkmill.sources import files

ENGINES = ("File", "Memory", "Dictionary")
#: Columns of Dictionary tables that order the writes of a key: number of the write, and of the row within it.
WRITTEN, ROW = "_written", "_row"
#: Column of written parts that tells whether a value of the row did not convert; readers leave it out.
FAULTY = "_larkmill_faulty"


class Tables:
    """entries: {database: {table: {columns, engine, parts, ...}}}; saved by the caller after each change.

    An append writes a new part and lists it only once it is complete, so a failed statement leaves nothing behind and a table may be
    read while it is written to.
    """

    def __init__(self, spark: SparkSession, root: str, entries: dict) -> None:
        self.spark, self.root, self.entries = spark, root, entries

    def entry(self, database: str, name: str) -> dict | None:
        return self.entries.get(database, {}).get(name)

    def need(self, database: str, name: str) -> dict:
        found = self.entry(database, name)
        if found is None:
            raise CatalogProblem(f"Unknown table {database}.{name}")
        return found

    def schema(self, entry: dict) -> T.StructType:
        return T.StructType([T.StructField(n, type_of(t)) for n, t in entry["columns"]])

    def create(self, database: str, name: str, columns: list, engine: str = "File", **tags: str) -> None:
        engine = next((e for e in ENGINES if e.lower() == engine.lower()), None)
        if engine is None:
            raise PlanProblem("Unknown table engine")
        names = [n.lower() for n, _ in columns]
        if len(set(names)) < len(names):
            raise PlanProblem("Duplicate column")
        for _, t in columns:
            type_of(t)
        if engine == "Dictionary" and len(columns) != 2:
            raise PlanProblem("A Dictionary table has a key and a value")
        self.entries[database][name] = {"columns": [list(c) for c in columns], "engine": engine, "parts": [], **{k: v for k, v in tags.items() if v}}

    def read(self, database: str, name: str) -> DataFrame:
        entry = self.need(database, name)
        if not entry["parts"]:
            return self.spark.createDataFrame([], self.schema(entry))
        schema = self.schema(entry)
        if entry["engine"] == "Dictionary":
            key, value = (n for n, _ in entry["columns"])
            rows = self.spark.read.schema(schema.add(WRITTEN, T.LongType()).add(ROW, T.LongType())).parquet(*entry["parts"])
            return rows.groupBy(key).agg(F.max_by(value, F.struct(WRITTEN, ROW)).alias(value))
        return self.spark.read.schema(schema).parquet(*entry["parts"])

    def fitted(self, entry: dict, df: DataFrame, columns: list[str] | None, strict: bool) -> tuple[DataFrame, list]:
        """df's columns by position as the table's, others null; and for each column a condition of a value that does not convert."""
        wanted = dict(entry["columns"])
        into = columns or list(wanted)
        if unknown := [c for c in into if c not in wanted]:
            raise PlanProblem(f"Unknown column {unknown[0]}")
        if len(into) != len(df.columns):
            raise PlanProblem(f"{len(into)} columns but {len(df.columns)} values")
        source = df.toDF(*(f"s{i}" for i in range(len(into))))
        out, bad = {}, []
        for field, name in zip(source.schema, into, strict=True):
            target, col = type_of(wanted[name]), F.col(field.name)
            made = (F.trim(col) if kind_of(field.dataType) == "text" and not isinstance(target, T.StringType) else col).try_cast(target)
            wrong = col.isNotNull() & made.isNull()
            if kind_of(target) == "int" and kind_of(field.dataType) == "float":
                wrong = wrong | (col != F.floor(col))
            if kind_of(field.dataType) == "text" and kind_of(target) == "int":
                wrong = wrong | ~F.coalesce(F.trim(col).rlike(r"^[+-]?\d+$"), F.lit(True))
            out[name] = made
            if strict:
                bad.append(wrong)
        return source.select(*(out.get(n, F.lit(None).cast(type_of(t))).alias(n) for n, t in entry["columns"]), *(b.alias(f"_bad{i}") for i, b in enumerate(bad))), [f"_bad{i}" for i in range(len(bad))]

    def append(self, database: str, name: str, df: DataFrame, columns: list[str] | None = None, strict: bool = True) -> int:
        """Rows written. All of them or, if a value does not convert, none: conversion is tested in the pass that writes, and its outcome
        counted from one column of what was written."""
        entry = self.need(database, name)
        made, bad = self.fitted(entry, df, columns, strict)
        made = made.withColumn(FAULTY, reduce(lambda a, b: a | b, (F.col(b) for b in bad)) if bad else F.lit(False)).drop(*bad)
        if entry["engine"] == "Dictionary":
            made = made.withColumn(WRITTEN, F.lit(len(entry["parts"])).cast("long")).withColumn(ROW, F.monotonically_increasing_id())
        path, n = self.part(database, name, entry, made)
        entry["parts"].append(path)
        return n

    def part(self, database: str, name: str, entry: dict, made: DataFrame) -> tuple[str, int]:
        """Path and rows of a new part with the rows of made; none, and an error, if FAULTY holds in one."""
        path = f"{self.folder(database, name, entry)}/part-{uuid.uuid4().hex}"
        made.write.parquet(path)
        seen = self.spark.read.schema(f"{FAULTY} boolean").parquet(path).agg(F.count(F.lit(1)).alias("rows"), F.count_if(FAULTY).alias("bad")).first()
        if seen.bad:
            files.delete(self.spark, path)
            raise PlanProblem(f"{seen.bad} rows do not convert to the columns of {name}")
        return path, seen.rows

    def replace(self, database: str, name: str, df: DataFrame, columns: list | None = None) -> None:
        """The rows of df take the place of the table's, with its columns or those given; readers see either. All convert, or none is replaced."""
        entry = self.need(database, name)
        made, bad = self.fitted({"columns": columns or entry["columns"]}, df, None, True)
        made = made.withColumn(FAULTY, reduce(lambda a, b: a | b, (F.col(b) for b in bad))).drop(*bad)
        if entry["engine"] == "Dictionary":
            made = made.withColumn(WRITTEN, F.lit(0).cast("long")).withColumn(ROW, F.monotonically_increasing_id())
        path, _ = self.part(database, name, entry, made)
        old, entry["parts"] = entry["parts"], [path]
        if columns is not None:
            entry["columns"] = [list(c) for c in columns]
        for p in old:
            files.delete(self.spark, p)

    def compact(self, database: str, name: str, partitions: int | None = None) -> None:
        df = self.read(database, name)
        self.replace(database, name, df.coalesce(partitions) if partitions else df)

    def truncate(self, database: str, name: str) -> None:
        entry = self.need(database, name)
        for p in entry["parts"]:
            files.delete(self.spark, p)
        entry["parts"] = []

    def drop(self, database: str, name: str) -> None:
        files.delete(self.spark, self.folder(database, name, self.need(database, name)))
        del self.entries[database][name]

    def folder(self, database: str, name: str, entry: dict) -> str:
        return f"{entry.get('base', self.root)}/{database}/{name}"

    def alter(self, database: str, name: str, changes: list[tuple]) -> None:
        """ADD, DROP and MODIFY of columns: all of them or none. Added columns are null in the rows there are; a column that is
        dropped, or gets another type, has the table rewritten. As for an INSERT, a value that does not convert is an error and changes
        nothing. A Dictionary table keeps its two columns; rewritten, it has the last value of each key."""
        entry = self.need(database, name)
        columns = [list(c) for c in entry["columns"]]
        df, rewrite = self.read(database, name), False
        for verb, column, *kind in changes:
            names = [n for n, _ in columns]
            if verb in ("ADD", "DROP") and entry["engine"] == "Dictionary":
                raise PlanProblem("A Dictionary table has a key and a value")
            if verb == "ADD":
                if column in names:
                    raise PlanProblem(f"Column {column} exists")
                type_of(kind[0])
                columns.append([column, kind[0]])
                df = df.withColumn(column, F.lit(None).cast(type_of(kind[0])))
                rewrite = rewrite or files.exists(self.spark, self.folder(database, name, entry)) and any(c[0] == "DROP" for c in changes)
            elif column not in names:
                raise PlanProblem(f"Unknown column {column}")
            elif verb == "DROP":
                if len(columns) == 1:
                    raise PlanProblem("A table keeps one column at least")
                columns = [c for c in columns if c[0] != column]
                df, rewrite = df.drop(column), True
            else:
                columns = [[n, kind[0] if n == column else t] for n, t in columns]
                type_of(kind[0])
                rewrite = True
        if rewrite and entry["parts"]:
            self.replace(database, name, df.select(*(n for n, _ in columns)), columns)
        entry["columns"] = columns

    def sharded(self, database: str, name: str, key: str, shards: int) -> DataFrame:
        """The table dealt out by hash of key, as its shard group says."""
        return self.read(database, name).repartition(shards, key)
