"""Drafts and pools: where values stand, rows of segments, capped pools, held-out folds, runs of row states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireworks.operators.groups import newest


def locate_values(values: DataFrame, lines: DataFrame, page: str) -> DataFrame:
    """page, value_id, kind (exact, contains, none), line_id of the first best line for each of values(page, value_id, value). lines(page, line_id, line) meet the values of their page only."""
    line, value = F.col("line"), F.col("value")
    kind = F.when(line == value, 0).when(F.contains(line, value) & (F.length(value) > 0), 1)
    best = lines.join(values, page).select(page, "value_id", F.struct(kind.alias("kind"), "line_id").alias("at")).where("at.kind is not null").groupBy(page, "value_id").agg(F.min("at").alias("at"))
    name = F.when(F.col("at.kind") == 0, "exact").when(F.col("at.kind") == 1, "contains").otherwise("none")
    return values.select(page, "value_id").join(best, [page, "value_id"], "left").select(page, "value_id", name.alias("kind"), F.col("at.line_id").alias("line_id"))


def occurrence_class(text: Column, value: Column) -> Column:
    """located, ambiguous or missing: how often the value stands in the text, without overlaps."""
    n = (F.length(text) - F.length(F.replace(text, value))) / F.length(value)
    return F.when(n == 1, "located").when(n > 1, "ambiguous").otherwise("missing")


def segment_rows(drafts: DataFrame, key: list[str], segments: str) -> DataFrame:
    """key, seg (from 0), segment: a draft of several segments as rows that its key holds together."""
    return drafts.select(*key, F.posexplode(segments).alias("seg", "segment"))


def outside_sample(pool: DataFrame, taken: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of the pool whose key is not taken, in a seeded order that does not depend on partitions."""
    return pool.join(taken.select(key).distinct(), key, "left_anti").orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def capped_pool(old: DataFrame, new: DataFrame, same: list[str], bucket: str, order: str, most: int = 30) -> DataFrame:
    """Rows of both, one for equal values of `same` (the newest), and the newest `most` of each bucket."""
    both = newest(old.unionByName(new), same, [F.desc(order)]).drop("rank")
    return newest(both, [bucket], [F.desc(order), *map(F.asc, same)], most)


def insert_missing(base: DataFrame, more: DataFrame, key: list[str]) -> DataFrame:
    """base, and the rows of more whose key base lacks; what base has is never changed."""
    return base.unionByName(more.join(base.select(*key).distinct(), key, "left_anti"))


def first_unseen(rows: DataFrame, seen: DataFrame, content: str, key: str) -> DataFrame:
    """hash, key of contents not seen before, once each (least key); hashes are shuffled, not contents."""
    h = F.md5(content)
    fresh = rows.where(F.col(content).isNotNull()).groupBy(h.alias("hash")).agg(F.min(key).alias(key))
    return fresh.join(seen.select(h.alias("hash")).distinct(), "hash", "left_anti")


def fuse(units: DataFrame, pages: DataFrame, page: str) -> DataFrame:
    """Units, and the pages that no unit covers as units of their own; columns are those of units."""
    return units.unionByName(pages.join(units.select(page).distinct(), page, "left_anti"))


def held_out_folds(rows: DataFrame, fold: str, value: str) -> DataFrame:
    """For each fold held out: rows and mean within it, and of all others; sums of the whole less its own, so no fold is met with another."""
    own = rows.groupBy(fold).agg(F.count(value).alias("held_n"), F.sum(value).alias("s"))
    whole = own.agg(F.sum("held_n").alias("all_n"), F.sum("s").alias("all_s"))
    rest = F.col("all_n") - F.col("held_n")
    return own.join(F.broadcast(whole)).select(
        fold, "held_n", F.round(F.col("s") / F.col("held_n"), 4).alias("held_mean"), rest.alias("train_n"), F.when(rest > 0, F.round((F.col("all_s") - F.col("s")) / rest, 4)).alias("train_mean")
    )


def reject_crops(pages: DataFrame, width: str, height: str, ratio: float = 0.5, least: int = 3) -> DataFrame:
    """Pages with is_crop: a side under ratio times the median of that side, if `least` pages or more have sizes."""
    m = pages.where(F.col(width).isNotNull() & F.col(height).isNotNull()).agg(F.count("*").alias("_n"), F.percentile(width, 0.5).alias("_w"), F.percentile(height, 0.5).alias("_h"))
    small = (F.col(width) < ratio * F.col("_w")) | (F.col(height) < ratio * F.col("_h"))
    return pages.join(F.broadcast(m)).withColumn("is_crop", (F.col("_n") >= least) & F.coalesce(small, F.lit(False))).drop("_n", "_w", "_h")


def set_changes(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """key, value, change (added, removed) between two maps of sets, one row a member."""
    both = old.select(key, value, F.lit(1).alias("side")).unionByName(new.select(key, value, F.lit(2).alias("side"))).groupBy(key, value).agg(F.bit_or("side").alias("sides")).where("sides <> 3")
    return both.select(key, value, F.when(F.col("sides") == 1, "removed").otherwise("added").alias("change"))


def state_runs(rows: DataFrame, key: str, order: str, state: str) -> DataFrame:
    """rows with run: the number of their run of equal states within key."""
    w = Window.partitionBy(key).orderBy(order)
    new = F.coalesce((F.lag(state).over(w) != F.col(state)).cast("int"), F.lit(0))
    return rows.withColumn("_new", new).withColumn("run", F.sum("_new").over(w)).drop("_new")


def close_sparse(rows: DataFrame, key: str, order: str, state: str, most: int = 14) -> DataFrame:
    """rows with runs of sparse states, of `most` rows at most and with a run on either side, turned into content."""
    marked = state_runs(rows, key, order, state)
    run, all_ = Window.partitionBy(key, "run"), Window.partitionBy(key)
    inner = (F.col(state) == "sparse") & (F.count("*").over(run) <= most) & (F.col("run") > 0) & (F.col("run") < F.max("run").over(all_))
    return marked.withColumn("closed", F.when(inner, "content").otherwise(F.col(state))).drop("run")


def separators(rows: DataFrame, key: str, order: str, state: str, least: int = 1) -> DataFrame:
    """key, lo, hi, n of runs of rows without content, of `least` rows or more."""
    kinds = rows.withColumn("_kind", F.when(F.col(state) == "content", "content").otherwise("gap"))
    runs = state_runs(kinds, key, order, "_kind").where("_kind = 'gap'").groupBy(key, "run").agg(F.min(order).alias("lo"), F.max(order).alias("hi"), F.count("*").alias("n"))
    return runs.where(F.col("n") >= least).select(key, "lo", "hi", "n")


def expand_hits(hits: DataFrame, lines: DataFrame, page: str, n: int = 3) -> DataFrame:
    """The first n lines of each column of the pages that were hit."""
    held = lines.join(hits.select(page).distinct(), page, "left_semi")
    return newest(held, [page, "col_index"], [F.asc("line_id")], n)
