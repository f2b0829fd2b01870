"""The fluent dataset: filter, scan, aggregate, page, vector search, append."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.operators.predicates import all_of, compare, keywords


class Dataset:
    """An immutable plan over a DataFrame; every method returns a new one or a DataFrame, nothing runs before an action."""

    def __init__(self, df: DataFrame, tests: tuple[Column, ...] = ()):
        self.source, self.tests = df, tests

    def filter(self, *triples: tuple[str, str, Any], **tests: Any) -> Dataset:
        """Conjunction of keyword tests and (column, operator, value) triples."""
        return Dataset(self.source, (*self.tests, *keywords(self.source, **tests), *[compare(F.col(c), op, v) for c, op, v in triples]))

    def where(self, test: Column) -> Dataset:
        return Dataset(self.source, (*self.tests, test))

    @property
    def df(self) -> DataFrame:
        return self.source.where(all_of(list(self.tests))) if self.tests else self.source

    def scan(self, columns: list[str] | None = None, limit: int | None = None, offset: int = 0, order: list[str] | None = None) -> DataFrame:
        """Rows of the given columns (none: all); an order makes limit and offset deterministic."""
        unknown = set(columns or ()) - set(self.source.columns)
        if unknown:
            raise ValueError(f"unknown columns {sorted(unknown)}")
        out = self.df
        if order:
            out = out.orderBy(*order)
        if columns:
            out = out.select(*columns)
        if offset:
            out = out.offset(offset)
        return out if limit is None else out.limit(limit)

    def page(self, key: str, after: Any = None, size: int = 100, columns: list[str] | None = None) -> DataFrame:
        """Keyset paging: ``size`` + 1 rows past ``after`` in order of a unique key (the extra one tells that more follow)."""
        df = self.df if after is None else self.df.where(F.col(key) > F.lit(after))
        return df.orderBy(key).limit(size + 1).select(*(columns or df.columns))

    def aggregate(self, sum: str | None = None, min: str | None = None, max: str | None = None, count: bool = False, avg: str | None = None) -> DataFrame:  # noqa: A002
        """One row from one pass.  Sums of nothing are 0; numbers are doubles.

        ``count`` counts matching rows, or, with ``min`` or ``max``, the values of that column that are not null.
        """
        number = lambda c: F.col(c).cast("int").cast("double") if isinstance(self.source.schema[c].dataType, T.BooleanType) else F.col(c).cast("double")
        out = []
        if sum:
            out.append(F.coalesce(F.sum(number(sum)), F.lit(0.0)).alias("sum"))
        if min:
            out.append(F.min(number(min)).alias("min"))
        if max:
            out.append(F.max(number(max)).alias("max"))
        if avg:
            out.append(F.avg(number(avg)).alias("avg"))
        if count:
            out.append((F.count(F.col(min or max)) if min or max else F.count("*")).alias("count"))
        if not out:
            raise ValueError("no aggregate asked for")
        return self.df.agg(*out)

    def aggregate_multi(self, requests: dict[str, tuple[str, str | None]]) -> DataFrame:
        """Any number of (function, column) requests in one scan: count, count_rows, sum, min, max, avg, avg_or_zero."""
        made = {
            "count_rows": lambda c: F.count("*"),
            "count": lambda c: F.count(c),
            "sum": lambda c: F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0)),
            "min": lambda c: F.min(F.col(c).cast("double")),
            "max": lambda c: F.max(F.col(c).cast("double")),
            "avg": lambda c: F.avg(F.col(c).cast("double")),
            "avg_or_zero": lambda c: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)),
        }
        return self.df.agg(*[made[f](c).alias(name) for name, (f, c) in requests.items()])

    def vector_search(self, column: str, query: list[float], k: int, metric: str = "cosine", id: str = "row_id") -> DataFrame:  # noqa: A002
        from tidewell.operators.vectors import top_k

        return top_k(self.df, query, k, metric, id, column)

    def stats(self, column: str, order: str | None = None) -> DataFrame:
        from tidewell.operators.stats import column_stats

        return column_stats(self.df, [column], order)


def merge_shards(parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Final aggregate of partial (count, sum, min, max) rows from disjoint shards."""
    made = [F.sum("count").alias("count"), F.coalesce(F.sum("sum"), F.lit(0.0)).alias("sum"), F.min("min").alias("min"), F.max("max").alias("max")]
    return parts.groupBy(*by).agg(*made) if by else parts.agg(*made)


class Store:
    """Named datasets as tables of a Spark database, with append-only, update-only and full modes.

    Rows carry the id of the batch that brought them in a hidden column, so a batch and its ledger are one commit: after
    a crash a batch is there with its id or not at all.
    """

    BATCH = "_batch_id"
    MODES = ("append-only", "update-only", "full-crud")

    def __init__(self, spark: SparkSession, database: str = "default", mode: str = "full-crud"):
        if mode not in self.MODES:
            raise ValueError(f"mode must be one of {self.MODES}")
        self.spark, self.database, self.mode = spark, database, mode
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")

    def name(self, dataset: str) -> str:
        return f"`{self.database}`.`{dataset}`"

    def create(self, dataset: str, schema: T.StructType) -> None:
        self.spark.createDataFrame([], T.StructType([*schema.fields, T.StructField(self.BATCH, T.StringType())])).write.format("parquet").saveAsTable(self.name(dataset))

    def names(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(self.database) if not t.isTemporary and not t.name.startswith("_"))

    def drop(self, dataset: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name(dataset)}")

    def drop_database(self) -> None:
        self.spark.sql(f"DROP DATABASE IF EXISTS `{self.database}` CASCADE")

    def _table(self, dataset: str) -> DataFrame:
        """The table as it is now: other sessions (streams write from one of their own) may have added files."""
        self.spark.catalog.refreshTable(self.name(dataset))
        return self.spark.table(self.name(dataset))

    def open(self, dataset: str) -> Dataset:
        return Dataset(self._table(dataset).drop(self.BATCH))

    def append(self, dataset: str, rows: DataFrame, batch_id: str | None = None) -> bool:
        """Appends; a batch id that the table holds is skipped (False).  The schema must be the table's.

        A batch without rows leaves nothing behind and may come again.
        """
        if self.mode == "update-only":
            raise PermissionError("appending is locked")
        target = self._table(dataset)
        if [(f.name, f.dataType) for f in rows.schema] != [(f.name, f.dataType) for f in target.drop(self.BATCH).schema]:
            raise TypeError("schema differs from the table's")
        if self.BATCH not in target.columns:
            if batch_id is not None:
                raise TypeError("the table was not made by a store and keeps no batch ids")
        elif batch_id is not None and target.where(F.col(self.BATCH) == batch_id).limit(1).count():  # Parquet statistics skip other batches' files
            return False
        else:
            rows = rows.withColumn(self.BATCH, F.lit(batch_id).cast("string"))
        rows.write.format("parquet").mode("append").insertInto(self.name(dataset))
        return True

    def health(self) -> DataFrame:
        """dataset, rows, files for every dataset."""
        parts = [self._table(n).agg(F.lit(n).alias("dataset"), F.count("*").alias("rows"), F.count_distinct(F.col("_metadata.file_path")).alias("files")) for n in self.names()]
        out = self.spark.createDataFrame([], "dataset string, rows long, files long")
        for p in parts:
            out = out.unionByName(p)
        return out
