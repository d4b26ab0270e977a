"""Ordered and keyed rows: group concatenation, record splits, carry forward, newest per key, islands, overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def concat_groups(rows: DataFrame, key: list[str], order: str, text: str, sep: str = "") -> DataFrame:
    """key, text joined in order, parts, first_row: one row for a logical annotation."""
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return rows.groupBy(*key).agg(F.array_join(F.transform(parts, lambda p: p[text]), sep).alias("joined"), F.count("*").alias("parts"), F.min(order).alias("first_row"))


def split_by_anchor(rows: DataFrame, key: str, order: list[str], is_anchor: Column) -> DataFrame:
    """record: 0 before the first anchor, then one more at each anchor row."""
    return rows.withColumn("record", F.sum(is_anchor.cast("int")).over(Window.partitionBy(key).orderBy(*order)))


def carry_forward(rows: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """value with nulls filled from the last one before."""
    return rows.withColumn("carried", F.last(value, ignorenulls=True).over(Window.partitionBy(*key).orderBy(*order)))


def close_entries(rows: DataFrame, key: str, order: list[str], closes: Column) -> DataFrame:
    """entry: rows up to and with a closing row have one number."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("entry", F.coalesce(F.sum(closes.cast("int")).over(before), F.lit(0)))


def newest(rows: DataFrame, key: list[str], order: list[Column], most: int = 1) -> DataFrame:
    """The newest rows of each key, ranked from 1."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= most)


def round_robin(rows: DataFrame, bucket: str, order: list[Column], total: int) -> DataFrame:
    """Rows drawn in turn from the buckets, first of each, then second, up to total."""
    return newest(rows, [bucket], order, total).orderBy("rank", bucket).limit(total)


def continuation_pairs(rows: DataFrame, key: str, order: str, attr: str, text: str) -> DataFrame:
    """Neighbouring rows with one attr where the second text is shorter: key, order, attr, first_len, next_len."""
    w = Window.partitionBy(key).orderBy(order)
    pairs = rows.withColumn("_a", F.lead(attr).over(w)).withColumn("next_len", F.length(F.lead(text).over(w))).withColumn("first_len", F.length(text))
    return pairs.where((F.col("_a") == F.col(attr)) & (F.col("next_len") < F.col("first_len"))).select(key, order, attr, "first_len", "next_len")


def islands(rows: DataFrame, key: list[str], value: str, tolerance: float) -> DataFrame:
    """One-dimensional clusters: a new island where the gap to the value before is above the tolerance. key, island, n, mean, lo, hi. Rows are added up by value first, so equal values are never parted and a window sees each value once."""
    w = Window.partitionBy(*key).orderBy(value)
    values = rows.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("_n"))
    marked = values.withColumn("_new", (F.coalesce(F.col(value) - F.lag(value).over(w), F.lit(0.0)) > tolerance).cast("int")).withColumn("island", F.sum("_new").over(w))
    total = F.sum("_n")
    return marked.groupBy(*key, "island").agg(total.alias("n"), (F.sum(F.col(value) * F.col("_n")) / total).alias("mean"), F.min(value).alias("lo"), F.max(value).alias("hi"))


def binned_mode(rows: DataFrame, key: list[str], value: str, width: float = 2.0) -> DataFrame:
    """Mean of the values in the fullest bin of each key, ties to the lower bin."""
    bins = rows.groupBy(*key, F.floor(F.col(value) / width).alias("bin")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return newest(bins, key, [F.desc("n"), F.asc("bin")]).select(*key, "bin", "n", "mean")


def overlay(base: DataFrame, changes: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """base with the values of changes where they are not null."""
    over = changes.select(*key, *(F.col(v).alias(f"_{v}") for v in values))
    out = base.join(over, key, "left")
    return out.withColumns({v: F.coalesce(f"_{v}", v) for v in values}).drop(*(f"_{v}" for v in values))


def seeded_order(*cols: str | Column, seed: int = 0) -> Column:
    """A random order that any number of tasks agrees on."""
    return F.xxhash64(*cols, F.lit(seed))


def inherit_marked(rows: DataFrame, key: list[str], order: list[str], value: str, marked: Column) -> DataFrame:
    """value with '' filled from the last one given before in the key, on marked rows only; inherited says where."""
    given = F.last(F.when(F.col(value) != "", F.col(value)), ignorenulls=True).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    take = marked & (F.col(value) == "") & given.isNotNull()
    return rows.withColumn("inherited", F.coalesce(take, F.lit(False))).withColumn(value, F.when(F.col("inherited"), given).otherwise(F.col(value)))


def unique_ids(rows: DataFrame, key: list[str], uid: str, order: str) -> DataFrame:
    """uid with __dup2, __dup3 and so on after the first of its key, by order."""
    n = F.row_number().over(Window.partitionBy(*key, uid).orderBy(order))
    return rows.withColumn("unique_id", F.when(n == 1, F.col(uid)).otherwise(F.concat(F.col(uid), F.lit("__dup"), n.cast("string"))))


def contiguous_groups(rows: DataFrame, key: list[str], lo: str, hi: str, least_gap: float = 20.0) -> DataFrame:
    """group (from 0): a new one where the gap to the line before is above least_gap and above that line's height."""
    w = Window.partitionBy(*key).orderBy(lo, hi)
    before_lo, before_hi = F.lag(lo).over(w), F.lag(hi).over(w)
    new = F.coalesce((F.col(lo) - before_hi > F.greatest(F.lit(least_gap), before_hi - before_lo)).cast("int"), F.lit(0))
    return rows.withColumn("_new", new).withColumn("group", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def locate_spans(values: DataFrame, lines: DataFrame, page: str, most: int = 6) -> DataFrame:
    """page, value_id, line_id, n_lines: where a value stands in the joined text of up to `most` lines, two at least: the first start, then the fewest lines. lines(page, line_id, line) meet the values(page, value_id, value) of their page only."""
    w = Window.partitionBy(page).orderBy("line_id")
    runs = F.array(*(F.struct(F.lit(n + 1).alias("n"), F.concat("line", *(F.lead("line", k).over(w) for k in range(1, n + 1))).alias("t")) for n in range(1, most)))
    joined = lines.withColumn("_runs", runs).select(page, "line_id", F.inline("_runs")).where("t is not null")
    met = joined.join(values.where("length(value) > 0"), page).where(F.contains("t", F.col("value")))
    return met.groupBy(page, "value_id").agg(F.min(F.struct("line_id", "n")).alias("_b")).select(page, "value_id", F.col("_b.line_id").alias("line_id"), F.col("_b.n").alias("n_lines"))


def reference_match(rows: DataFrame, drafts: DataFrame, page: str) -> DataFrame:
    """rows(page, row_id, uid, idx) with draft_id of drafts(page, draft_id, uid, idx): the first draft with its uid, or else the one at its index."""
    by_uid = drafts.where("uid <> ''").groupBy(page, "uid").agg(F.min_by("draft_id", "idx").alias("_u"))
    by_idx = drafts.groupBy(page, "idx").agg(F.min("draft_id").alias("_i"))
    return rows.join(by_uid, [page, "uid"], "left").join(by_idx, [page, "idx"], "left").select(page, "row_id", F.coalesce("_u", "_i").alias("draft_id"))


def positional_differences(left: DataFrame, right: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """key, position, column where rows at one position differ, or a side has no row there (column is then count)."""
    w = Window.partitionBy(key).orderBy(order)
    number = lambda d, p: d.select(key, F.row_number().over(w).alias("position"), *(F.col(c).alias(f"{p}_{c}") for c in columns), F.lit(1).alias(f"{p}_in"))
    both = number(left, "l").join(number(right, "r"), [key, "position"], "full_outer")
    alone = F.col("l_in").isNull() | F.col("r_in").isNull()
    kinds = F.array_compact(F.array(F.when(alone, "count"), *(F.when(~alone & ~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")), c) for c in columns)))
    return both.select(key, "position", F.explode(kinds).alias("column"))


def live_rows(drafts: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """drafts with is_live: whether rows hold one of their key."""
    return drafts.join(rows.select(*key).distinct().withColumn("_live", F.lit(True)), key, "left").withColumn("is_live", F.coalesce("_live", F.lit(False))).drop("_live")


def drop_numbered(rows: DataFrame, key: str, order: str, numbers: DataFrame) -> DataFrame:
    """rows without those at the 1-based places that numbers(key, number) lists."""
    placed = rows.withColumn("number", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    return placed.join(numbers.select(key, "number"), [key, "number"], "left_anti")
