"""Mutation by appended versions: the latest-version view and SQL-style DML over it.

A change never rewrites a row: it appends one with a larger version, a deletion appends a tombstone.  Readers choose the
latest version first, drop tombstones second and filter third; only predicates on the key may move below that choice.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY, VERSION, DELETED = "_id", "_version", "_deleted"
META = (KEY, VERSION, DELETED)


class DuplicateKey(ValueError):
    pass


def latest_view(log: DataFrame, key: str = KEY, version: str = VERSION, deleted: str | Column | None = DELETED) -> DataFrame:
    """The highest version of each key without tombstones.  An aggregate (combined before the shuffle), not a window."""
    best = log.groupBy(key).agg(F.max_by(F.struct(*log.columns), version).alias("r")).select("r.*")
    if deleted is None:
        return best
    return best.where(~F.coalesce(F.col(deleted) if isinstance(deleted, str) else deleted, F.lit(False)))


def base(df: DataFrame, key: str, version: int = 1) -> DataFrame:
    """A plain table as the first version of each row."""
    return df.select("*", F.col(key).alias(KEY), F.lit(version).cast("long").alias(VERSION), F.lit(False).alias(DELETED))


def visible(log: DataFrame) -> DataFrame:
    return latest_view(log).drop(*META)


def _next(rows: DataFrame, version: int, deleted: bool = False) -> DataFrame:
    return rows.withColumn(VERSION, F.lit(version).cast("long")).withColumn(DELETED, F.lit(deleted))


def insert(log: DataFrame, rows: DataFrame, key: str, version: int, on_duplicate: str = "error") -> DataFrame:
    """New keys are appended; present ones are an error or, with ``ignore``, left alone."""
    fresh = base(rows, key, version)
    live = latest_view(log).select(KEY)
    if on_duplicate == "ignore":
        return log.unionByName(fresh.join(live, KEY, "left_anti"))
    if fresh.join(live, KEY, "left_semi").limit(1).count() or fresh.groupBy(KEY).count().where("count > 1").limit(1).count():
        raise DuplicateKey("duplicate key")
    return log.unionByName(fresh)


def replace(log: DataFrame, rows: DataFrame, key: str, version: int) -> DataFrame:
    """A tombstone for each present key, then the new rows."""
    fresh = base(rows, key, version + 1)
    dead = latest_view(log).join(fresh.select(KEY), KEY, "left_semi")
    return log.unionByName(_next(dead, version, True)).unionByName(fresh)


def upsert(log: DataFrame, rows: DataFrame, key: str, version: int, assign: dict[str, Column]) -> DataFrame:
    """New keys are inserted; for present ones ``assign`` gives new values (``old.x`` and ``new.x`` name the two rows)."""
    fresh, live = base(rows, key, version), latest_view(log)
    both = live.alias("old").join(fresh.alias("new"), F.col(f"old.{KEY}") == F.col(f"new.{KEY}"))
    changed = both.select(*[assign[c].alias(c) if c in assign else F.col(f"old.{c}").alias(c) for c in live.columns])
    return log.unionByName(_next(changed, version)).unionByName(fresh.join(live.select(KEY), KEY, "left_anti"))


def update(log: DataFrame, where: Column, assign: dict[str, Any], version: int) -> DataFrame:
    """New versions of the live rows that match; values are columns or literals."""
    hit = latest_view(log).where(where)
    values = {c: v if isinstance(v, Column) else F.lit(v) for c, v in assign.items()}
    unknown = set(values) - set(log.columns)
    if unknown:
        raise ValueError(f"unknown columns {sorted(unknown)}")
    return log.unionByName(_next(hit.withColumns({c: v.cast(log.schema[c].dataType) for c, v in values.items()}), version))


def delete(log: DataFrame, where: Column, version: int) -> DataFrame:
    return log.unionByName(_next(latest_view(log).where(where), version, True))


def compact(log: DataFrame) -> DataFrame:
    """The log without superseded versions and tombstones."""
    return latest_view(log)
