"""Logical types and their Spark types, schema fingerprints, type inference for documents, strict row checks."""

from __future__ import annotations

import hashlib
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Logical type names.
TYPES: dict[str, T.DataType] = {
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "float64": T.DoubleType(),
    "bool": T.BooleanType(),
    "dict_int32": T.IntegerType(),
    "string": T.StringType(),
    "bytes": T.BinaryType(),
    "array": T.ArrayType(T.StringType()),
    "object": T.StringType(),
    "vector_float32": T.ArrayType(T.FloatType()),
}

#: Type names of SQL front ends.
SQL_TYPES: dict[str, str] = {
    "INT": "int32", "INTEGER": "int32", "SMALLINT": "int32", "TINYINT": "int32", "INT64": "int64", "BIGINT": "int64",
    "FLOAT": "float64", "DOUBLE": "float64", "REAL": "float64", "DECIMAL": "float64", "NUMERIC": "float64", "FLOAT64": "float64",
    "BOOL": "bool", "BOOLEAN": "bool", "STRING": "string", "TEXT": "string", "CHAR": "string", "VARCHAR": "string", "BLOB": "bytes",
    "BINARY": "bytes", "DATE": "string", "DATETIME": "string", "TIMESTAMP": "string",
}


def struct(fields: dict[str, str]) -> T.StructType:
    """A schema from logical type names; all fields may be null."""
    return T.StructType([T.StructField(n, TYPES[t], True) for n, t in fields.items()])


def sql_type(name: str) -> T.DataType:
    """The Spark type of a SQL type name (length and precision ignored; unknown names are strings)."""
    return TYPES[SQL_TYPES.get(name.split("(")[0].strip().upper(), "string")]


def fingerprint(schema: T.StructType) -> str:
    return hashlib.sha256(schema.json().encode()).hexdigest()


def infer(rows: list[dict[str, Any]]) -> T.StructType:
    """A document schema: strings, bytes, arrays and structs by value, booleans, whole and other numbers; all-null is float64."""

    def one(values: list[Any]) -> T.DataType:
        values = [v for v in values if v is not None]
        kinds = {type(v) for v in values}
        if not values:
            return T.DoubleType()
        if kinds <= {bool}:
            return T.BooleanType()
        if kinds <= {int}:
            return T.LongType()
        if kinds <= {int, float}:
            return T.DoubleType()
        if kinds <= {str}:
            return T.StringType()
        if kinds <= {bytes, bytearray}:
            return T.BinaryType()
        if kinds <= {list, tuple}:
            return T.ArrayType(one([x for v in values for x in v]))
        if kinds <= {dict}:
            return infer(values)
        raise TypeError(f"mixed types: {sorted(k.__name__ for k in kinds)}")

    names = list(dict.fromkeys(k for r in rows for k in r))
    return T.StructType([T.StructField(n, one([r.get(n) for r in rows]), True) for n in names])


def check_rows(rows: list[dict[str, Any]], schema: T.StructType) -> None:
    """Raises unless every row has exactly the schema's fields with fitting values; null fits, bool is no int, int is a float."""
    kinds = {T.IntegerType: int, T.LongType: int, T.DoubleType: (int, float), T.BooleanType: bool, T.StringType: str, T.BinaryType: (bytes, bytearray), T.ArrayType: (list, tuple)}
    for row in rows:
        if set(row) != set(schema.names):
            raise ValueError(f"fields {sorted(row)} are not {sorted(schema.names)}")
        for f in schema.fields:
            v, kind = row[f.name], kinds.get(type(f.dataType), object)
            if v is not None and (not isinstance(v, kind) or isinstance(v, bool) and kind is not bool):
                raise TypeError(f"{f.name}: {v!r} is no {f.dataType.simpleString()}")


def add_columns(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Additive evolution: new nullable columns; a column that exists is an error."""
    for n, t in fields.items():
        if n in df.columns:
            raise ValueError(f"column {n} exists")
        df = df.withColumn(n, F.lit(None).cast(TYPES[t]))
    return df
