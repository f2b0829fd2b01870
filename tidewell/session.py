"""A session with the settings this library expects, and table loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tidewell", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution with skew handling, UTC, Arrow; ``conf`` keys use double underscores for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    wanted = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in wanted.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
