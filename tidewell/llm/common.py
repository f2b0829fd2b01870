"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is absent (local tests) a folder below the warehouse is used and set.
    """
    ctx = spark.sparkContext
    if not (folder := spark.conf.get("spark.checkpoint.dir", None)):
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if ctx.getCheckpointDir() is None:
        ctx.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/tidewell-{what}-{uuid.uuid4().hex}"


def saved(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends there."""
    spark = df.sparkSession
    df.write.parquet(path := fresh_dir(spark, what))
    return spark.read.schema(df.schema).parquet(path)


def drop_dir(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def give_back() -> None:
    """Freed memory goes back to the operating system; processes of long life (driver, workers) would keep it."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def forget() -> None:
    """Tables of powers go, and freed memory with them."""
    _POWERS.clear()
    give_back()


def tidy(run):
    """``run`` for mapInArrow, after which the worker process gives memory back (tables of powers too): workers outlive their tasks.

    ``wrapped`` is sent to workers by value, with the globals that it names; a table among them would go along, and another
    one than the worker's would be cleared.
    """

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            forget()

    return wrapped


_SLOTS = 23, 27  # powers of two: a bitmap has from 1 to 16 megabytes


def _slot(key: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)) + F.lit(1)


def maybe_in(df: DataFrame, key: str, ids: DataFrame, id: str) -> DataFrame:  # noqa: A002
    """``df`` with the column ``_maybe``: false only where ``key`` is in no row of ``ids``.

    A bitmap of hashed ids, eight slots an id but 16 megabytes at most, is broadcast; it lets rows that a join would not
    match stay out of its shuffle.  From some 10**8 ids on it lets ever more rows through, which costs the shuffle of these.
    """
    slots = 1 << min(_SLOTS[1], max(_SLOTS[0], (8 * ids.count()).bit_length()))
    hashed = ids.select(_slot(F.col(id), slots).alias("_s")).groupBy(F.bitmap_bucket_number("_s").alias("_bucket"))
    bits = saved(hashed.agg(F.bitmap_construct_agg(F.bitmap_bit_position("_s")).alias("_bits")), "bitmap")
    at = F.bitmap_bit_position("_slot")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (at % 8 + 1).cast("int"))) > 0
    joined = df.withColumn("_slot", _slot(F.col(key), slots)).join(F.broadcast(bits), F.bitmap_bucket_number("_slot") == F.col("_bucket"), "left")
    return joined.withColumn("_maybe", F.coalesce(hit, F.lit(False))).drop("_slot", "_bucket", "_bits")


HOT_ROWS = 1024
HOT_KEYS = 100_000


def hot_bound(total: int) -> int:
    """How many rows make a key hot: at most HOT_KEYS keys of ``total`` rows have more."""
    return max(HOT_ROWS, total // HOT_KEYS)


def join_hot(rows: DataFrame, key: str, table: DataFrame, id: str, n: str, total: int | None = None) -> DataFrame:  # noqa: A002
    """Inner join of ``rows`` with ``table`` (one row for each ``id``, of which ``n`` says how many rows hold it).

    Rows of hot keys meet their few table rows by broadcast (a bounded number, see ``hot_bound``) and stay where they are;
    the others are shuffled, none of their keys being hot.  ``total``: the number of rows, where it is known.
    """
    bound = hot_bound(rows.count() if total is None else total)
    hot, cold = table.where(F.col(n) > bound), table.where(F.col(n) <= bound)
    if not hot.limit(1).count():
        return rows.join(table, F.col(key) == F.col(id))
    near = rows.join(F.broadcast(hot), F.col(key) == F.col(id))
    far = rows.join(F.broadcast(hot.select(F.col(id).alias("_hot"))), F.col(key) == F.col("_hot"), "left_anti")
    return near.unionByName(far.join(cold, F.col(key) == F.col(id)))


def finite_vector(c: Column) -> Column:
    """True for a non-null array without null, NaN or infinite components."""
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(c.isNotNull() & ~bad, F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array, dtype=np.float64) -> np.ndarray:
    """A list column whose lists have equal lengths as a two-dimensional array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(dtype) if len(column) else np.zeros((0, 0), dtype)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, element by element."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _P and of its inverse, modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            for key, base in (("up", _P), ("down", pow(_P, -1, 2**64))):
                factors = np.full(size, base, np.uint64)
                factors[0] = 1
                _POWERS[key] = np.cumprod(factors, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]
