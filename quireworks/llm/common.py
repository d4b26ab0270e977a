"""Shared helpers: table access, durable intermediate tables and small conventions."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Records and bytes of one Arrow batch handed to Python; keeps a batch of long texts small.
ARROW_RECORDS, ARROW_BYTES = 250, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_OWN_FOLDER: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir), with its store named in full; one of our own only where it is unset and all tasks run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _OWN_FOLDER:
            _OWN_FOLDER.append("file://" + tempfile.mkdtemp(prefix="quireworks-"))
        found = _OWN_FOLDER[0]
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return whole.replace("file:/", "file:///", 1).rstrip("/") if whole.startswith("file:/") and not whole.startswith("file://") else whole.rstrip("/")


def new_shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/quireworks/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    path = new_shared_path(df.sparkSession, label)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, records: int = ARROW_RECORDS, size: int = ARROW_BYTES) -> None:
    """Bound the records and bytes of an Arrow batch for operators that hand whole texts to Python. Both settings are only ever lowered, to the same values by all operators."""
    for name, most in (("maxRecordsPerBatch", records), ("maxBytesPerBatch", size)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}").lower().removesuffix("b")
        scale = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(now[-1:], 1)
        if not 0 < int(now.rstrip("kmg")) * scale <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def gives_back(run: Callable) -> Callable:
    """A task's function whose worker returns freed memory to the system at the end: workers are used again, and what an allocator keeps adds up over stages."""

    @wraps(run)
    def tidy(batches) -> Iterator:
        try:
            yield from run(batches)
        finally:
            import gc

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:
                pass  # another C library, which has no such call

    return tidy


def id_fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


#: Bits of an id filter: eight for each id, and so many at least and at most (16 MB); beyond the most there is no filter.
FILTER_LEAST, FILTER_MOST, FILTER_SLICE = 1 << 20, 1 << 27, 32_768


def may_hold(ids: DataFrame, id_col: str, of: str | Column) -> Column:
    """A filter on column `of`: true for every id of ids, and for few others (a bit for each hash of an id).

    It keeps rows with other ids out of a shuffle; a join after it decides. The bits are built by slices in a
    grouped aggregate, so what is gathered is FILTER_MOST / 8 bytes at most; from FILTER_MOST / 8 ids on every row
    passes, and the join does all of the work.
    """
    n = ids.count()
    size = max(FILTER_LEAST, 1 << (8 * n).bit_length())
    if size > FILTER_MOST:
        return F.lit(True)
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(size))
    slices = (
        ids.select(place(id_col).alias("p")).groupBy(F.floor(F.col("p") / FILTER_SLICE).alias("slice")).agg(F.bitmap_construct_agg(F.col("p") % FILTER_SLICE).alias("bits")).collect()
    )
    bits = np.zeros((size // FILTER_SLICE, FILTER_SLICE // 8), dtype=np.uint8)
    for r in slices:
        bits[r.slice] = np.frombuffer(r.bits, dtype=np.uint8)
    shared = ids.sparkSession.sparkContext.broadcast(bits.ravel())

    @F.pandas_udf("boolean")
    def held(p: pd.Series) -> pd.Series:
        at = p.to_numpy()
        return pd.Series((shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    return held(place(of))


#: A key with more than this share of the rows is hot; so fewer keys than its inverse are.
HOT_SHARE = 1 / 2000


def attach(rows: DataFrame, values: DataFrame, key: str, column: str, n_rows: int, spread: str) -> DataFrame:
    """rows with `column` of values(key, column, copies: the rows that have the key), null where there is none; column is never null in values.

    Values of hot keys are broadcast: fewer than 1 / HOT_SHARE rows, as their copies add up to n_rows at most.
    Their rows and those without a key take a stand-in for their key (a hash of the column `spread`) into the
    shuffle of the join, which deals them over all tasks; a mark keeps a stand-in from meeting a key by chance.
    """
    is_hot = F.col("copies") > max(1, int(n_rows * HOT_SHARE))
    hot = values.where(is_hot).select(F.col(key).alias("_hot_key"), F.col(column).alias("_hot_value"))
    rest = values.where(~is_hot).select(F.col(key).alias("_key"), F.col(column).alias("_value"))
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left").withColumn("_dealt", F.col("_hot_value").isNotNull() | F.col(key).isNull())
    placed = marked.withColumn("_place", F.when(F.col("_dealt"), F.xxhash64(spread).cast(rows.schema[key].dataType)).otherwise(F.col(key)))
    met = placed.join(rest, (F.col("_place") == F.col("_key")) & ~F.col("_dealt"), "left")
    return met.select(*(F.col(c) for c in rows.columns), F.coalesce("_hot_value", "_value").alias(column))
