"""Column, storage and pruning statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def column_stats(df: DataFrame, columns: list[str], order: str | None = None) -> DataFrame:
    """column, min, max, count, nulls, cardinality (a sketch) from one pass; with ``order``, whether values never fall."""
    steps = []
    if order:
        # each range of rows in order is checked on its own, then the ranges' ends against each other
        for c in columns:
            w = Window.partitionBy(F.spark_partition_id()).orderBy(order)
            part = df.select(order, c).where(F.col(c).isNotNull()).repartitionByRange(order).withColumn("_p", F.spark_partition_id())
            part = part.withColumn("_fall", (F.col(c) < F.lag(c).over(Window.partitionBy("_p").orderBy(order))).cast("int"))
            ends = part.groupBy("_p").agg(F.max("_fall").alias("f"), F.min_by(c, order).alias("a"), F.max_by(c, order).alias("z"))
            w = Window.partitionBy(F.lit(0)).orderBy("_p")  # one row for each partition
            ends = ends.withColumn("g", (F.col("a") < F.lag("z").over(w)).cast("int"))
            steps.append(ends.agg(F.lit(c).alias("column"), (F.coalesce(F.max(F.greatest("f", "g")), F.lit(0)) == 0).alias("monotonic")))
    made = df.agg(*[F.struct(F.lit(c).alias("column"), F.min(F.col(c).cast("double")).alias("min"), F.max(F.col(c).cast("double")).alias("max"), F.count(c).alias("count"), F.count_if(F.col(c).isNull()).alias("nulls"), F.approx_count_distinct(c).alias("cardinality")).alias(f"s{i}") for i, c in enumerate(columns)])
    out = made.select(F.inline(F.array(*[F.col(f"s{i}") for i in range(len(columns))])))
    return out.join(reduce(DataFrame.unionByName, steps), "column") if steps else out


def storage_stats(chunks: DataFrame, live: str, size: str, by: list[str] | None = None) -> DataFrame:
    """Live and stored rows and bytes, and what a compaction would free."""
    made = [
        F.count_if(F.col(live)).alias("live_chunks"),
        F.count("*").alias("stored_chunks"),
        F.coalesce(F.sum(F.when(F.col(live), F.col(size))), F.lit(0)).cast("long").alias("live_bytes"),
        F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("stored_bytes"),
    ]
    out = chunks.groupBy(*(by or [])).agg(*made)
    return out.withColumn("reclaimable_bytes", F.col("stored_bytes") - F.col("live_bytes"))


def pruning_report(scanned: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows and files of a source, and those that hold a row of the filtered scan."""
    count = lambda df, p: df.agg(F.count("*").alias(f"rows_{p}"), F.count_distinct(F.col("_metadata.file_path")).alias(f"files_{p}"))
    return count(scanned, "scanned").crossJoin(count(kept, "kept"))  # one row each
