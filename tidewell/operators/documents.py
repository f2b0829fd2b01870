"""Document-style queries: filters, projections, update operators, pipeline stages, collections.

Filters become two-valued Catalyst predicates: a comparison with a null operand is false, ``$not`` negates fully, plain
equality with None matches null, and a field that a schema lacks is a missing one.  On arrays comparisons hold if any
element satisfies them.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.operators import versions as V
from tidewell.operators.predicates import all_of, any_of, two_valued

_COMPARE = {"$eq": operator.eq, "$ne": operator.ne, "$lt": operator.lt, "$lte": operator.le, "$gt": operator.gt, "$gte": operator.ge}


def resolve(schema: T.StructType, path: str) -> tuple[Column, T.DataType] | None:
    """Column and type of a dotted path: struct fields, array positions, and fields of arrays of structs; None if missing."""
    column, kind, parts = None, schema, path.split(".")
    for part in parts:
        if isinstance(kind, T.StructType):
            if part not in kind.names:
                return None
            column = F.col(f"`{part}`") if column is None else column[part]
            kind = kind[part].dataType
        elif isinstance(kind, T.ArrayType) and part.isdigit():
            column, kind = F.get(column, F.lit(int(part))), kind.elementType
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and part in kind.elementType.names:
            column, kind = column[part], T.ArrayType(kind.elementType[part].dataType)
        else:
            return None
    return column, kind


def _test(schema: T.StructType, path: str, op: str, value: Any, options: str, loose_regex: bool) -> Column:
    found = resolve(schema, path)
    if op == "$exists":
        if found is None:
            return F.lit(not value)
        return found[0].isNotNull() if value else F.lit(False)
    if found is None:
        return F.lit(op == "$nin" or op == "$eq" and value is None)
    column, kind = found
    array = isinstance(kind, T.ArrayType)
    any_element = (lambda f: F.exists(column, f)) if array else (lambda f: f(column))
    if op in _COMPARE:
        if value is None:
            return F.lit(False)
        if array and isinstance(value, list):
            return two_valued(_COMPARE[op](column, F.array(*map(F.lit, value))))
        return two_valued(any_element(lambda x: _COMPARE[op](x, F.lit(value))))
    if op == "$in":
        return two_valued(any_element(lambda x: x.isin(*value)))
    if op == "$nin":
        return ~two_valued(any_element(lambda x: x.isin(*value)))
    if op == "$all":
        return two_valued(all_of([F.array_contains(column, v) for v in value])) if array else two_valued(all_of([column == F.lit(v) for v in value]))
    if op == "$size":
        return two_valued(F.size(column) == value) & column.isNotNull() if array else F.lit(False)
    if op == "$regex":
        flags = "".join(o for o in options if o in "ims")
        pattern = f"(?{flags}){value}" if flags else value
        if loose_regex and value.endswith("$"):  # strict compatibility: the token must occur twice
            token = re.escape(value[:-1])
            return two_valued(any_element(lambda x: x.rlike(pattern) & (F.regexp_count(x, F.lit(token)) >= 2)))
        return two_valued(any_element(lambda x: x.rlike(pattern)))
    raise ValueError(f"unknown operator {op}")


def match(schema: T.StructType, spec: dict[str, Any], loose_regex: bool = False) -> Column:
    """A filter document as one predicate; all of its parts must hold."""
    tests: list[Column] = []
    for key, value in spec.items():
        if key in ("$and", "$or", "$nor"):
            parts = [match(schema, s, loose_regex) for s in value]
            tests.append(all_of(parts) if key == "$and" else any_of(parts) if key == "$or" else ~any_of(parts))
        elif key.startswith("$"):
            raise ValueError(f"unknown operator {key}")
        elif isinstance(value, dict) and value and all(k.startswith("$") for k in value):
            options = value.get("$options", "")
            for op, operand in value.items():
                if op == "$not":
                    tests.append(~match(schema, {key: operand if isinstance(operand, dict) else {"$eq": operand}}, loose_regex))
                elif op != "$options":
                    tests.append(_test(schema, key, op, operand, options, loose_regex))
        elif value is None:
            found = resolve(schema, key)
            tests.append(F.lit(True) if found is None else found[0].isNull())
        else:
            tests.append(_test(schema, key, "$eq", value, "", loose_regex))
    return all_of(tests)


def expression(schema: T.StructType, spec: Any) -> Column:
    """"$path", {"$field": path}, {"$literal": value}, or a plain value."""
    if isinstance(spec, str) and spec.startswith("$"):
        spec = {"$field": spec[1:]}
    if isinstance(spec, dict) and "$field" in spec:
        found = resolve(schema, spec["$field"].lstrip("$"))
        return F.lit(None) if found is None else found[0]
    if isinstance(spec, dict) and "$literal" in spec:
        spec = spec["$literal"]
    return F.array(*map(F.lit, spec)) if isinstance(spec, list) else F.lit(spec)


def array_slice(column: Column, spec: int | list[int]) -> Column:
    """n: the first n elements, or the last -n; [skip, n]: n elements after ``skip``, which counts from the end if negative."""
    if isinstance(spec, int):
        if spec >= 0:
            return F.slice(column, 1, spec)
        return F.slice(column, F.greatest(F.size(column) + spec, F.lit(0)) + 1, -spec)
    skip, n = spec
    return F.slice(column, skip + 1, n) if skip >= 0 else F.slice(column, F.greatest(F.size(column) + skip, F.lit(0)) + 1, n)


def project(df: DataFrame, spec: dict[str, Any] | list[str]) -> DataFrame:
    """Inclusion, exclusion, a list of paths, $slice, and computed fields.  _id stays unless it is excluded."""
    if isinstance(spec, list):
        spec = dict.fromkeys(spec, 1)
    if spec and all(v in (0, False) for v in spec.values() if not isinstance(v, dict)) and not any(isinstance(v, dict) and "$slice" not in v for v in spec.values()):
        out = df.drop(*[k for k, v in spec.items() if not isinstance(v, dict)])
        return out.withColumns({k: array_slice(F.col(k), v["$slice"]) for k, v in spec.items() if isinstance(v, dict)})
    made = []
    if "_id" in df.columns and "_id" not in spec:
        made.append(F.col("_id"))
    for name, value in spec.items():
        if isinstance(value, dict) and "$slice" in value:
            made.append(array_slice(resolve(df.schema, name)[0], value["$slice"]).alias(name))
        elif value in (1, True) and not isinstance(value, str):
            found = resolve(df.schema, name)
            made.append((F.lit(None) if found is None else found[0]).alias(name))
        elif value in (0, False) and not isinstance(value, str):
            continue
        else:
            made.append(expression(df.schema, value).alias(name))
    return df.select(*made)


def sort(df: DataFrame, spec: dict[str, int] | list[tuple[str, int]]) -> DataFrame:
    """Each key in its own direction; nulls last ascending, first descending."""
    keys = spec.items() if isinstance(spec, dict) else spec
    return df.orderBy(*[F.col(k).asc_nulls_last() if d > 0 else F.col(k).desc_nulls_first() for k, d in keys])


def group(df: DataFrame, spec: dict[str, Any], arrival: str | None = None) -> DataFrame:
    """$group: null, field or compound key; $sum, $min, $max, $avg, $count, and $first / $last non-null in order of ``arrival``."""
    key, made = spec["_id"], []
    for name, rule in spec.items():
        if name == "_id":
            continue
        (op, operand), = rule.items()
        x = expression(df.schema, operand)
        if op == "$sum" and isinstance(operand, (int, float)) and not isinstance(operand, bool):
            c = F.count("*") if operand == 1 else F.count("*") * F.lit(operand)
        elif op in ("$sum", "$min", "$max", "$avg"):
            c = {"$sum": lambda v: F.coalesce(F.sum(v.cast("double")), F.lit(0.0)), "$min": F.min, "$max": F.max, "$avg": lambda v: F.avg(v.cast("double"))}[op](x)
        elif op == "$count":
            c = F.count("*")
        elif op in ("$first", "$last"):
            if arrival is None:
                raise ValueError(f"{op} needs the column that orders arrivals")
            at = F.when(x.isNotNull(), F.col(arrival))
            c = (F.min_by if op == "$first" else F.max_by)(x, at)
        else:
            raise ValueError(f"unknown accumulator {op}")
        made.append(c.alias(name))
    if key is None or not isinstance(key, (str, dict)):
        out = df.agg(*made) if made else df.limit(1).select()
        return out.select(F.lit(key).alias("_id"), *out.columns)
    keys = F.struct(*[expression(df.schema, v).alias(k) for k, v in key.items()]) if isinstance(key, dict) else expression(df.schema, key)
    keyed = df.groupBy(keys.alias("_id"))
    return keyed.agg(*made) if made else keyed.agg(F.lit(1).alias("_n")).drop("_n")


def unwind(df: DataFrame, path: str, keep_empty: bool = False) -> DataFrame:
    """One row for each element; a scalar passes through; null and empty arrays go unless kept."""
    path = path.lstrip("$")
    found = resolve(df.schema, path)
    if found is None:
        return df if keep_empty else df.where(F.lit(False))
    if not isinstance(found[1], T.ArrayType):
        return df if keep_empty else df.where(found[0].isNotNull())
    rest = [F.explode_outer(found[0]).alias(c) if c == path else F.col(f"`{c}`") for c in df.columns]
    if path not in df.columns:
        rest.append(F.explode_outer(found[0]).alias(path.rpartition(".")[2]))
    out = df if keep_empty else df.where(F.size(found[0]) > 0)
    return out.select(*rest)


def lookup(df: DataFrame, foreign: DataFrame, local_field: str, foreign_field: str, name: str, order: str | None = None) -> DataFrame:
    """$lookup: all foreign documents that share a value, as an array, empty if none.  The foreign side is grouped by key first."""
    row = F.struct(*foreign.columns)
    grouped = foreign.where(F.col(foreign_field).isNotNull()).groupBy(F.col(foreign_field).alias("_key"))
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), row.alias("_r")))) if order else F.collect_list(row)
    grouped = grouped.agg((F.transform(rows, lambda x: x["_r"]) if order else rows).alias(name))
    empty = F.array().cast(T.ArrayType(T.StructType(foreign.schema.fields)))
    column, kind = resolve(df.schema, local_field)
    if not isinstance(kind, T.ArrayType):
        joined = df.join(grouped, column == F.col("_key"), "left").drop("_key")
        return joined.withColumn(name, F.coalesce(name, empty))
    numbered = df.withColumn("_row", F.monotonically_increasing_id())
    hits = numbered.select("_row", F.explode(F.array_distinct(column)).alias("_key")).join(grouped, "_key").groupBy("_row").agg(F.flatten(F.collect_list(name)).alias(name))
    return numbered.join(hits, "_row", "left").withColumn(name, F.coalesce(name, empty)).drop("_row")


def facet(df: DataFrame, branches: dict[str, list[dict]], run: Callable[[DataFrame, list[dict]], DataFrame]) -> DataFrame:
    """One row with an array for each branch.  Results of branches are meant to be small (reports); each is one array."""
    parts = [run(df, stages) for stages in branches.values()]
    rows = [p.agg(F.collect_list(F.struct(*p.columns)).alias(name)) for name, p in zip(branches, parts)]
    return reduce(lambda a, b: a.crossJoin(b), rows)  # one row each


def aggregate(df: DataFrame, stages: list[dict[str, Any]], others: dict[str, DataFrame] | None = None, arrival: str | None = None) -> DataFrame:
    """A pipeline of $match, $project, $addFields / $set, $group, $sort, $skip, $limit, $count, $sortByCount, $unwind, $lookup, $facet."""
    for stage in stages:
        (op, spec), = stage.items()
        if op == "$match":
            df = df.where(match(df.schema, spec))
        elif op == "$project":
            df = project(df, spec)
        elif op in ("$addFields", "$set"):
            df = df.withColumns({k: expression(df.schema, v) for k, v in spec.items()})
        elif op == "$group":
            df = group(df, spec, arrival)
        elif op == "$sort":
            df = sort(df, spec)
        elif op == "$skip":
            df = df.offset(spec)
        elif op == "$limit":
            df = df.limit(spec)
        elif op == "$count":
            df = df.agg(F.count("*").alias(spec))
        elif op == "$sortByCount":
            df = df.groupBy(expression(df.schema, spec).alias("_id")).agg(F.count("*").alias("count")).orderBy(F.col("count").desc(), F.col("_id").asc_nulls_last())
        elif op == "$unwind":
            df = unwind(df, spec) if isinstance(spec, str) else unwind(df, spec["path"], spec.get("preserveNullAndEmptyArrays", False))
        elif op == "$lookup":
            df = lookup(df, (others or {})[spec["from"]], spec["localField"], spec["foreignField"], spec["as"])
        elif op == "$facet":
            df = facet(df, spec, lambda d, s: aggregate(d, s, others, arrival))
        else:
            raise ValueError(f"unknown stage {op}")
    return df


def _set_path(schema: T.StructType, path: str, value: Column) -> tuple[str, Column]:
    head, _, rest = path.partition(".")
    return head, F.col(head).withField(rest, value) if rest else value


def changes(schema: T.StructType, update: dict[str, dict[str, Any]], now: str = "1970-01-01T00:00:00Z") -> dict[str, Column]:
    """New column values under the update operators $set $inc $mul $min $max $unset $rename $currentDate $push $addToSet $pull."""
    out: dict[str, Column] = {}

    def put(path: str, value: Column) -> None:
        found = resolve(schema, path)
        if found is None:
            raise ValueError(f"unknown field {path}")
        head, column = _set_path(schema, path, value.cast(found[1]))
        out[head] = column

    for op, fields in update.items():
        for path, v in fields.items():
            found = resolve(schema, path)
            if found is None:
                raise ValueError(f"unknown field {path}")
            old, kind = found
            if op in ("$set", "$setOnInsert"):
                if op == "$set":
                    put(path, expression(schema, {"$literal": v}))
            elif op == "$inc":
                put(path, F.coalesce(old, F.lit(0)) + F.lit(v))
            elif op == "$mul":
                put(path, F.coalesce(old, F.lit(0)) * F.lit(v))
            elif op in ("$min", "$max"):
                put(path, (F.least if op == "$min" else F.greatest)(old, F.lit(v).cast(kind)))
            elif op == "$unset":
                put(path, F.lit(None))
            elif op == "$rename":
                put(v, old)
                put(path, F.lit(None))
            elif op == "$currentDate":
                put(path, F.lit(now))
            elif op in ("$push", "$addToSet"):
                new = F.array(*map(F.lit, v["$each"] if isinstance(v, dict) and "$each" in v else [v])).cast(kind)
                held = F.coalesce(old, F.array().cast(kind))
                put(path, F.concat(held, new) if op == "$push" else F.concat(held, F.array_distinct(F.array_except(new, held))))
            elif op == "$pull":
                element = kind.elementType
                if isinstance(v, dict):
                    put(path, F.filter(old, _not(v)))
                else:
                    put(path, F.array_remove(old, F.lit(v).cast(element)))
            else:
                raise ValueError(f"unknown operator {op}")
    return out


def _not(spec: dict[str, Any]) -> Callable[[Column], Column]:
    """Elements that a condition on the element itself does not hold for."""

    def keep(x: Column) -> Column:
        tests = [x.isin(*y) if o == "$in" else ~x.isin(*y) if o == "$nin" else _COMPARE[o](x, F.lit(y)) for o, y in spec.items()]
        return ~two_valued(all_of(tests))

    return keep


class Collection:
    """A versioned document collection over a log DataFrame with _id, _version and _deleted; methods return collections or frames."""

    def __init__(self, log: DataFrame, version: int = 1, counts: dict[str, int] | None = None):
        self.log, self.version, self.counts = log, version, counts or {}

    @classmethod
    def of(cls, df: DataFrame, key: str = "_id") -> Collection:
        rows = df if key == "_id" else df.withColumnRenamed(key, "_id")
        return cls(rows.withColumn(V.VERSION, F.lit(1).cast("long")).withColumn(V.DELETED, F.lit(False)))

    @property
    def documents(self) -> DataFrame:
        return V.latest_view(self.log).drop(V.VERSION, V.DELETED)

    def find(self, spec: dict | None = None, projection=None, sort_by=None, skip: int = 0, limit: int | None = None) -> DataFrame:
        out = self.documents
        if spec:
            out = out.where(match(out.schema, spec))
        if sort_by:
            out = sort(out, sort_by)
        out = out.offset(skip) if skip else out
        out = out if limit is None else out.limit(limit)
        return project(out, projection) if projection else out

    def count_documents(self, spec: dict | None = None) -> int:
        return self.find(spec).count()

    def _with(self, rows: DataFrame, deleted: bool, **counts: int) -> Collection:
        fresh = rows.withColumn(V.VERSION, F.lit(self.version + 1).cast("long")).withColumn(V.DELETED, F.lit(deleted))
        return Collection(self.log.unionByName(fresh), self.version + 1, counts)

    def insert_many(self, rows: DataFrame) -> Collection:
        if rows.join(self.documents.select("_id"), "_id", "left_semi").limit(1).count() or rows.groupBy("_id").count().where("count > 1").limit(1).count():
            raise V.DuplicateKey("duplicate _id")
        return self._with(rows.select(*self.documents.columns), False)

    def _hits(self, spec: dict, many: bool, sort_by=None) -> DataFrame:
        out = self.find(spec)
        if many:
            return out
        return (sort(out, sort_by) if sort_by else out.orderBy("_id")).limit(1)

    def update(self, spec: dict, change: dict, many: bool = True, upsert: bool = False, sort_by=None, seed: Any = None) -> Collection:
        hits = self._hits(spec, many, sort_by)
        if upsert and not hits.limit(1).count():
            start = {k: v for k, v in spec.items() if not k.startswith("$") and not isinstance(v, dict)}
            fields = self.documents.schema
            one = hits.sparkSession.range(1).select(*[(F.lit(start[f.name]) if f.name in start else F.lit(seed) if f.name == "_id" else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
            once = {k: F.lit(v) for k, v in change.get("$setOnInsert", {}).items()}
            return self._with(one.withColumns(changes(fields, {k: v for k, v in change.items() if k != "$setOnInsert"})).withColumns(once), False)
        return self._with(hits.withColumns(changes(hits.schema, change)), False)

    def replace_one(self, spec: dict, row: dict[str, Any]) -> Collection:
        hits = self._hits(spec, False)
        return self._with(hits.select("_id", *[F.lit(row.get(f.name)).cast(f.dataType).alias(f.name) for f in hits.schema if f.name != "_id"]), False)

    def delete(self, spec: dict, many: bool = True) -> Collection:
        return self._with(self._hits(spec, many), True)

    def find_one_and_update(self, spec: dict, change: dict, after: bool = False, sort_by=None) -> tuple[DataFrame, Collection]:
        before = self._hits(spec, False, sort_by)
        new = self.update(spec, change, many=False, sort_by=sort_by)
        return (new.documents.join(before.select("_id"), "_id", "left_semi") if after else before), new

    def find_one_and_delete(self, spec: dict, sort_by=None) -> tuple[DataFrame, Collection]:
        hit = self._hits(spec, False, sort_by)
        return hit, self._with(hit, True)

    def bulk_write(self, operations: list[tuple[str, tuple]], ordered: bool = True) -> tuple[Collection, dict[str, int]]:
        """(method name, arguments) one after another; errors stop an ordered run and are counted in an unordered one."""
        here, counts = self, {"done": 0, "errors": 0}
        for name, args in operations:
            try:
                here = getattr(here, name)(*args)
                counts["done"] += 1
            except ValueError:
                counts["errors"] += 1
                if ordered:
                    break
        return here, counts

    def aggregate(self, stages: list[dict], others: dict[str, DataFrame] | None = None, arrival: str = "_id") -> DataFrame:
        return aggregate(self.documents, stages, others, arrival)
