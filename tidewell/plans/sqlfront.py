"""SQL of several dialects as Spark plans: a normaliser of text, then Spark's own parser; a canonical form to compare plans."""

from __future__ import annotations

import json
import re
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession

DIALECTS = ("ansi", "postgres", "mysql", "mariadb", "sqlite", "oracle", "duckdb", "sqlserver", "tsql")
STRICT_REJECTS = ("join", "over", "union", "intersect", "except", "begin", "commit", "rollback")


class UnsupportedSQL(ValueError):
    pass


def _outside_strings(sql: str, change) -> str:
    """Applies ``change`` to what lies outside of single-quoted strings."""
    return "".join(p if k % 2 else change(p) for k, p in enumerate(re.split(r"('(?:[^']|'')*')", sql)))


def normalise(sql: str, dialect: str = "ansi") -> str:
    """Dialect forms rewritten to Spark SQL: quoting, NVL / IFNULL, TOP, FETCH FIRST, ROWNUM, :: casts, LIMIT a, b, COUNT(1)."""
    if dialect not in DIALECTS:
        raise ValueError(f"unknown dialect {dialect}")

    def change(s: str) -> str:
        if dialect in ("sqlserver", "tsql"):
            s = re.sub(r"\[([^\]]+)\]", r"`\1`", s)
        if dialect not in ("mysql", "mariadb"):
            s = re.sub(r'"([^"]+)"', r"`\1`", s)
        s = re.sub(r"\b(NVL|IFNULL|ISNULL)\s*\(", "COALESCE(", s, flags=re.I)
        s = re.sub(r"\bCOUNT\s*\(\s*[01]\s*\)", "COUNT(*)", s, flags=re.I)
        if dialect in ("postgres", "duckdb"):
            s = re.sub(r"(\b[\w.]+|\))::(\w+)", r"CAST(\1 AS \2)", s)
        if dialect in ("mysql", "mariadb", "sqlite"):
            s = re.sub(r"\bLIMIT\s+(\d+)\s*,\s*(\d+)", r"LIMIT \2 OFFSET \1", s, flags=re.I)
        if dialect in ("sqlserver", "tsql") and (m := re.search(r"\bSELECT\s+TOP\s*\(?\s*(\d+)\s*\)?\s+", s, flags=re.I)):
            s = f"{s[: m.start()]}SELECT {s[m.end() :]} LIMIT {m[1]}"
        if m := re.search(r"(?:OFFSET\s+(\d+)\s+ROWS?\s+)?FETCH\s+(?:FIRST|NEXT)\s+(\d+)\s+ROWS?\s+ONLY", s, flags=re.I):
            s = s.replace(m[0], f"LIMIT {m[2]}" + (f" OFFSET {m[1]}" if m[1] else ""))
        if dialect == "oracle":
            if m := re.search(r"\bWHERE\s+ROWNUM\s*<=\s*(\d+)(\s+AND\b)?|\s+AND\s+ROWNUM\s*<=\s*(\d+)", s, flags=re.I):
                s = s.replace(m[0], " WHERE" if m[2] else "") + f" LIMIT {m[1] or m[3]}"
            s = re.sub(r"\bFROM\s+DUAL\b", "", s, flags=re.I)
        return s

    sql = sql.strip().rstrip(";")
    return re.sub(r"[ \t]+", " ", _outside_strings(sql, change)).strip()


def run(spark: SparkSession, sql: str, tables: dict[str, DataFrame], dialect: str = "ansi", params: list | dict | None = None, strict: bool = False) -> DataFrame:
    """Runs a SELECT over named frames.  ``?`` and ``%(name)s`` parameters are bound, never spliced.

    ``strict`` rejects what the plain canonical dialect lacks: joins, windows, set operations, subqueries, transactions.
    """
    text = normalise(sql, dialect)
    if strict:
        low = re.sub(r"'(?:[^']|'')*'", "''", text.lower())
        if any(re.search(rf"\b{w}\b", low) for w in STRICT_REJECTS) or low.count("select") > 1:
            raise UnsupportedSQL(text)
    text = re.sub(r"%\((\w+)\)s", r":\1", text)
    names = {}
    for name, df in tables.items():
        view = f"tidewell_{name}_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(view)
        names[name] = view
    for name, view in names.items():
        text = _outside_strings(text, lambda s, n=name, v=view: re.sub(rf"(\b(?:FROM|JOIN)\s+)`?{n}`?\b(?!\s+AS\b)(?=\s*(?:$|WHERE|GROUP|ORDER|LIMIT|ON|HAVING|JOIN|INNER|LEFT|OFFSET|\)|,))", rf"\1{v} AS {n}", s, flags=re.I))
        text = _outside_strings(text, lambda s, n=name, v=view: re.sub(rf"(\b(?:FROM|JOIN)\s+)`?{n}`?\b", rf"\1{v}", s, flags=re.I))
    try:  # the plan is analysed at once and holds the frames, so the names can go
        return spark.sql(text, args=params) if params else spark.sql(text)
    finally:
        for view in names.values():
            spark.catalog.dropTempView(view)


def canonical(df: DataFrame) -> str:
    """The analysed plan in canonical form; equal for texts that mean the same."""
    return df._jdf.queryExecution().analyzed().canonicalized().toString()


def same(a: DataFrame, b: DataFrame) -> bool:
    return a.sameSemantics(b)


def describe(sql: str, dialect: str = "ansi") -> str:
    """A text's normal form as JSON."""
    return json.dumps({"dialect": dialect, "sql": normalise(sql, dialect)}, sort_keys=True)


def loose_group(df: DataFrame, keys: list[str], columns: list[str], mode: str = "first", order: str | None = None) -> DataFrame:
    """Columns outside the keys: their first value (by ``order``), or an error."""
    from pyspark.sql import functions as F

    if mode == "error":
        raise UnsupportedSQL("column is neither grouped nor aggregated")
    return df.groupBy(*keys).agg(*[(F.min_by(c, order) if order else F.first(c)).alias(c) for c in columns])


class Cursor:
    """A small DB-API-like cursor over frames: SELECT, SHOW TABLES, DESCRIBE, and INSERT / UPDATE / DELETE / REPLACE as versions."""

    def __init__(self, spark: SparkSession, logs: dict[str, DataFrame] | None = None):
        self.spark, self.logs, self.version = spark, dict(logs or {}), 1
        self.description, self.rowcount, self._rows = None, -1, iter(())

    def _result(self, df: DataFrame) -> Cursor:
        self.description = [(f.name, f.dataType.simpleString(), None, None, None, None, f.nullable) for f in df.schema]
        self._rows = df.toLocalIterator()
        return self

    def execute(self, sql: str, params: list | dict | None = None, dialect: str = "mysql") -> Cursor:
        from pyspark.sql import functions as F

        from tidewell.operators import versions as V
        from tidewell.schema import sql_type

        s = sql.strip().rstrip(";")
        if m := re.fullmatch(r"CREATE TABLE\s+(\w+)\s*\((.*)\)", s, re.I | re.S):
            fields = [p.split() for p in re.split(r",(?![^()]*\))", m[2])]
            from pyspark.sql import types as T

            schema = T.StructType([T.StructField(f[0], sql_type(f[1])) for f in fields])
            self.logs[m[1]] = V.base(self.spark.createDataFrame([], schema), schema.names[0])
        elif m := re.fullmatch(r"DROP TABLE\s+(\w+)", s, re.I):
            self.logs.pop(m[1])
        elif m := re.fullmatch(r"ALTER TABLE\s+(\w+)\s+ADD COLUMN\s+(\w+)\s+(\S+)", s, re.I):
            self.logs[m[1]] = self.logs[m[1]].withColumn(m[2], F.lit(None).cast(sql_type(m[3])))
        elif re.fullmatch(r"SHOW TABLES", s, re.I):
            return self._result(self.spark.createDataFrame([(n,) for n in sorted(self.logs)], "name string"))
        elif m := re.fullmatch(r"(?:DESCRIBE|SHOW COLUMNS FROM)\s+(\w+)", s, re.I):
            return self._result(self.spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in V.visible(self.logs[m[1]]).schema], "name string, type string"))
        elif m := re.fullmatch(r"(INSERT IGNORE INTO|INSERT INTO|REPLACE INTO)\s+(\w+)\s*\(([^)]*)\)\s*(VALUES.*?)(\s+ON DUPLICATE KEY UPDATE\s+(.*))?", s, re.I | re.S):
            log, names = self.logs[m[2]], [c.strip() for c in m[3].split(",")]
            text = f"SELECT * FROM {m[4]} AS t({', '.join(names)})"
            given = self.spark.sql(text, args=params) if params else self.spark.sql(text)
            plain = V.visible(log).schema
            rows = given.select(*[(F.col(f.name) if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in plain])
            self.version += 2
            if m[6]:
                assign = {}
                for part in re.split(r",(?![^()]*\))", m[6]):
                    column, _, value = part.partition("=")
                    value = re.sub(r"VALUES\s*\(\s*(\w+)\s*\)", r"new.\1", value.strip(), flags=re.I)
                    value = re.sub(rf"(?<![.\w])({'|'.join(plain.names)})\b", r"old.\1", value)
                    assign[column.strip()] = F.expr(value).cast(plain[column.strip()].dataType)
                self.logs[m[2]] = V.upsert(log, rows, plain.names[0], self.version, assign)
            elif m[1].upper().startswith("REPLACE"):
                self.logs[m[2]] = V.replace(log, rows, plain.names[0], self.version)
            else:
                self.logs[m[2]] = V.insert(log, rows, plain.names[0], self.version, "ignore" if "IGNORE" in m[1].upper() else "error")
            self.rowcount = rows.count()
        elif m := re.fullmatch(r"UPDATE\s+(\w+)\s+SET\s+(.*?)(?:\s+WHERE\s+(.*))?", s, re.I | re.S):
            self.version += 1
            assign = {p.partition("=")[0].strip(): F.expr(p.partition("=")[2]) for p in re.split(r",(?![^()]*\))", m[2])}
            self.logs[m[1]] = V.update(self.logs[m[1]], F.expr(m[3] or "true"), assign, self.version)
        elif m := re.fullmatch(r"DELETE FROM\s+(\w+)(?:\s+WHERE\s+(.*))?", s, re.I | re.S):
            self.version += 1
            self.logs[m[1]] = V.delete(self.logs[m[1]], F.expr(m[2] or "true"), self.version)
        elif re.match(r"(USE|SET|START TRANSACTION|BEGIN|COMMIT|ROLLBACK|CREATE INDEX|CREATE DATABASE)\b", s, re.I):
            pass
        else:
            return self._result(run(self.spark, s, {n: V.visible(log) for n, log in self.logs.items()}, dialect, params))
        return self

    def fetchone(self) -> tuple[Any, ...] | None:
        row = next(self._rows, None)
        return None if row is None else tuple(row)

    def fetchall(self) -> list[tuple[Any, ...]]:
        return [tuple(r) for r in self._rows]
