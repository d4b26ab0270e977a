"""Rules from labelled rows(stem, row_no, attr, text): frequency, order, constants, examples, enums, differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quireworks.functions import text as T


def skeleton(rows: DataFrame, page: str = "stem", attr: str = "attr") -> DataFrame:
    """attr, pages, pos by page frequency, ties by name: a place is the attributes with more pages, which are counted by number of pages, and the place among those with as many."""
    seen = rows.groupBy(attr).agg(F.count_distinct(page).alias("pages"))
    sizes = seen.groupBy("pages").agg(F.count("*").alias("_k"))
    more = sizes.alias("a").join(sizes.alias("b"), F.col("b.pages") > F.col("a.pages"), "left").groupBy("a.pages").agg(F.coalesce(F.sum("b._k"), F.lit(0)).alias("_more"))
    return seen.join(more, "pages").withColumn("pos", (F.col("_more") + F.row_number().over(Window.partitionBy("pages").orderBy(attr))).cast("int")).select(attr, "pages", "pos")


def attr_support(rows: DataFrame, record: str, attr: str, required: float = 0.8, optional: float = 0.5) -> DataFrame:
    """attr, records, support and class: required from 0.8, optional from 0.5, else rare."""
    total = rows.agg(F.count_distinct(record).alias("n"))
    s = rows.groupBy(attr).agg(F.count_distinct(record).alias("records")).join(F.broadcast(total)).withColumn("support", F.round(F.col("records") / F.col("n"), 4))
    return s.withColumn("kind", F.when(F.col("support") >= required, "required").when(F.col("support") >= optional, "optional").otherwise("rare")).drop("n")


def precedence(rows: DataFrame, record: str, order: str, attr: str) -> DataFrame:
    """before, after, wins, losses: in how many records an attr's first row stands before another's. A record's attrs are paired inside the record, after its rows are reduced to one an attr."""
    first = rows.groupBy(record, attr).agg(F.min(order).alias("at"))
    lists = first.groupBy(record).agg(F.array_sort(F.collect_list(F.struct("at", F.col(attr).alias("a")))).alias("xs"))
    pairs = lists.select(F.explode(F.flatten(F.transform("xs", lambda x, i: F.transform(F.slice("xs", i + 2, F.greatest(F.size("xs"), F.lit(1))), lambda y: F.struct(x["a"].alias("before"), y["a"].alias("after")))))).alias("p"))
    won = pairs.groupBy("p.before", "p.after").agg(F.count("*").alias("wins"))
    lost = won.select(F.col("before").alias("after"), F.col("after").alias("before"), F.col("wins").alias("losses"))
    return won.join(lost, ["before", "after"], "left").na.fill(0, ["losses"])


def page_constants(rows: DataFrame, page: str, text: str, least_pages: int = 2, most: int = 6) -> DataFrame:
    """Values that every page has, shortest first; none with fewer than least_pages pages."""
    total = rows.agg(F.count_distinct(page).alias("n_pages"))
    hit = rows.groupBy(text).agg(F.count_distinct(page).alias("pages"))
    return hit.join(F.broadcast(total)).where((F.col("pages") == F.col("n_pages")) & (F.col("n_pages") >= least_pages)).orderBy(F.length(text), text).limit(most).select(text, "pages")


def value_examples(rows: DataFrame, attr: str, text: str, most: int = 4) -> DataFrame:
    """The longest, then most frequent, then first values of each attr."""
    counts = rows.where(F.length(text) > 0).groupBy(attr, text).agg(F.count("*").alias("n"))
    order = Window.partitionBy(attr).orderBy(F.desc(F.length(text)), F.desc("n"), text)
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def observed_enums(rows: DataFrame, attr: str, text: str, most: int = 12) -> DataFrame:
    """attr, text, n of attrs with more than one and at most 12 values; a first pass counts values without gathering them."""
    few = rows.groupBy(attr).agg(F.count_distinct(text).alias("k")).where(F.col("k").between(2, most)).select(attr)
    return rows.join(few, attr, "left_semi").groupBy(attr, text).agg(F.count("*").alias("n"))


def prefixes(rows: DataFrame, attr: str, text: str, least: int = 2) -> DataFrame:
    """attr, prefix, n of beginnings of 2 to 4 characters that recur."""
    cut = F.array_distinct(F.transform(F.array(F.lit(2), F.lit(3), F.lit(4)), lambda n: F.when(F.length(text) >= n, F.substr(text, F.lit(1), n))))
    return rows.select(attr, F.explode(F.array_compact(cut)).alias("prefix")).groupBy(attr, "prefix").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def version_diff(old: DataFrame, new: DataFrame, key: list[str], value: str) -> DataFrame:
    """key, change (added, removed, changed) between two versions."""
    o, n = old.select(*key, F.col(value).alias("_o"), F.lit(True).alias("_in_old")), new.select(*key, F.col(value).alias("_n"), F.lit(True).alias("_in_new"))
    change = F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "removed").when(~F.col("_o").eqNullSafe(F.col("_n")), "changed")
    return o.join(n, key, "full_outer").select(*key, change.alias("change")).where("change is not null")


def rule_candidates(corrections: DataFrame, least: int = 1) -> DataFrame:
    """wrong, right, n, conflict from corrections(wrong, right) that differ in one character; conflict if a character was corrected to several."""
    one = corrections.select(T.single_substitution(F.col("wrong"), F.col("right")).alias("s")).where("s is not null")
    counts = one.groupBy("s.wrong", "s.right").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return counts.withColumn("conflict", F.count("*").over(Window.partitionBy("wrong")) > 1)


def feature_bands(rows: DataFrame, key: str, value: str, sigma: float = 3.0, floor: float = 0.01) -> DataFrame:
    """key, mean, sd, lo, hi, n: mean +- sigma * max(sd, floor * |mean|)."""
    b = rows.groupBy(key).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.count(value).alias("n"))
    wide = sigma * F.greatest(F.coalesce("sd", F.lit(0.0)), F.abs("mean") * floor)
    return b.select(key, F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), F.round(F.col("mean") - wide, 4).alias("lo"), F.round(F.col("mean") + wide, 4).alias("hi"), "n")


def conformance(features: DataFrame, page: str, ok: str = "ok", critical: str = "critical", least: float = 0.75, fewest: int = 3) -> DataFrame:
    """page, verdict of feature checks(page, ok, critical): unknown under 3 checks, drift under 0.75 or with a failed critical one, else ok."""
    s = features.groupBy(page).agg(F.count("*").alias("n"), F.avg(F.col(ok).cast("int")).alias("share"), F.max((F.col(critical) & ~F.col(ok)).cast("int")).alias("bad"))
    return s.select(page, F.round("share", 4).alias("share"), F.when(F.col("n") < fewest, "unknown").when((F.col("share") < least) | (F.col("bad") == 1), "drift").otherwise("ok").alias("verdict"))
