"""Conservation checks: spans and gaps, multisets, coverage, overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_intervals(rows: DataFrame, key: str, lo: str, hi: str) -> DataFrame:
    """key, lo, hi of touching or overlapping intervals joined."""
    before = Window.partitionBy(key).orderBy(lo, hi).rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy(key).orderBy(lo, hi)
    new = F.coalesce((F.col(lo) > F.max(hi).over(before)).cast("int"), F.lit(1))
    return rows.select(key, lo, hi).distinct().withColumn("_new", new).withColumn("_island", F.sum("_new").over(order)).groupBy(key, "_island").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi")).drop("_island")


def interval_gaps(rows: DataFrame, key: str, lo: str, hi: str) -> DataFrame:
    """key, gap_lo, gap_hi between joined intervals."""
    joined = union_intervals(rows, key, lo, hi)
    order = Window.partitionBy(key).orderBy("lo")
    return joined.withColumn("gap_lo", F.lag("hi").over(order)).where("gap_lo is not null").select(key, "gap_lo", F.col("lo").alias("gap_hi"))


def overlaps_next(rows: DataFrame, key: str, lo: str, hi: str, ties: list[Column] = ()) -> DataFrame:
    """Rows whose interval reaches into the next one of their key; ties put equal intervals in an order, without which any of them may come last."""
    order = Window.partitionBy(key).orderBy(lo, hi, *ties)
    return rows.withColumn("_next", F.lead(lo).over(order)).where(F.col("_next") <= F.col(hi)).drop("_next")


def multiset_difference(left: DataFrame, right: DataFrame, cols: list[str]) -> DataFrame:
    """cols, missing (in left only) and extra (in right only) counts of values whose counts differ: one shuffle, pre-added."""
    both = left.select(*cols, F.lit(1).alias("_n")).unionByName(right.select(*cols, F.lit(-1).alias("_n")))
    d = both.groupBy(*cols).agg(F.sum("_n").alias("_d")).where("_d <> 0")
    return d.select(*cols, F.greatest(F.col("_d"), F.lit(0)).alias("missing"), F.greatest(-F.col("_d"), F.lit(0)).alias("extra"))


def coverage(expected: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """key, problem for keys that are missing, unknown or used more than once."""
    counts = expected.select(key, F.lit(1).alias("e"), F.lit(0).alias("u")).unionByName(used.select(key, F.lit(0).alias("e"), F.lit(1).alias("u"))).groupBy(key).agg(F.max("e").alias("e"), F.sum("u").alias("u"))
    problem = F.when(F.col("u") == 0, "missing").when(F.col("e") == 0, "unknown").when(F.col("u") > 1, "duplicate")
    return counts.select(key, problem.alias("problem")).where("problem is not null")


def min_max(rows: DataFrame, value: str, key: list[str]) -> DataFrame:
    """value scaled to 0..1 within key; 0 where all are equal."""
    w = Window.partitionBy(*key)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return rows.withColumn("scaled", F.when(hi > lo, (F.col(value) - lo) / (hi - lo)).otherwise(0.0))


def result_checks(attrs: DataFrame) -> DataFrame:
    """stem, code, n of faults in result rows (stem, record_index, attr, text, stream, n_lines, lines): one boolean column a check."""
    checks = {
        "empty_attr": F.coalesce(F.col("attr"), F.lit("")) == "",
        "empty_text": F.coalesce(F.col("text"), F.lit("")) == "",
        "text_not_in_stream": (F.coalesce(F.col("text"), F.lit("")) != "") & ~F.contains("stream", F.col("text")),
        "line_out_of_range": F.exists("lines", lambda i: (i < 0) | (i >= F.col("n_lines"))),
        "lines_not_ascending": F.col("lines") != F.array_sort("lines"),
        "record_index_negative": F.col("record_index") < 0,
    }
    flat = attrs.select("stem", F.explode(F.array_compact(F.array(*(F.when(c, k) for k, c in checks.items())))).alias("code"))
    return flat.groupBy("stem", "code").agg(F.count("*").alias("n"))
