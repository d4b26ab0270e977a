"""Gold pages, contracts and drift: quality of evidence, how predictions meet gold, features of pages and their bands."""

from __future__ import annotations

import math
from bisect import bisect_left
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireworks.functions import geometry as G
from quireworks.operators.groups import newest

#: Boxes and kinds of attributes a page needs to count as evidence; overlap of a hit; sigmas of a band and its least relative width.
LEAST_BOXES, LEAST_KINDS, LEAST_IOU, SIGMAS, SD_FLOOR = 8, 2, 0.5, 3.0, 0.15
#: Interactions that an item takes by hand, accepted as it is, and amended.
MANUAL_OPS, ACCEPT_OPS, AMEND_OPS = 4, 1, 2


def gold_quality(boxes: Column, kinds: Column) -> Column:
    return F.when(boxes <= 0, "empty").when((boxes < LEAST_BOXES) | (kinds < LEAST_KINDS), "thin").otherwise("ok")


def contract_verdict(kind: Column, pages: Column, support: Column, spread: Column, weak: Column, kinds: list[str], least_pages: int = 2, least_support: float = 0.6, most_spread: float = 0.02) -> Column:
    """accept, or the first reason against a structure line: kind, pages, support, spread, or only weak evidence."""
    return (
        F.when(~kind.isin(*kinds), "kind_not_structural").when(F.coalesce(pages, F.lit(0)) < least_pages, "too_few_pages")
        .when(support.isNull() | (support < least_support), "low_support").when(spread.isNull() | (spread > most_spread), "unstable_spread")
        .when(F.coalesce(weak, F.lit(0)) >= pages, "weak_evidence").otherwise("accept")
    )


def backfill_candidates(bands: DataFrame, families: DataFrame, kinds: list[str]) -> DataFrame:
    """bands(family, rel, kind, pages_hit, support, spread, weak) of the primary family, with verdict. The family with most pages is primary, ties to the smaller id."""
    primary = families.orderBy(F.desc("n_pages"), "family").limit(1).select("family")
    verdict = contract_verdict(F.col("kind"), F.col("pages_hit"), F.col("support"), F.col("spread"), F.col("weak"), kinds)
    return bands.join(F.broadcast(primary), "family").withColumn("verdict", verdict)


def record_aligned(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """n, hit, ratio: pairs of gold and predicted boxes(page, record, attr, box) of one record and attribute, and those that overlap enough. Boxes of one record and attribute that are equal are counted first, so only distinct ones meet; ratio is null without pairs."""
    meet = ["page", "record", "attr"]
    counted = lambda d, box, n: d.groupBy(*meet, F.col("box").alias(box)).agg(F.count("*").alias(n))
    pairs = counted(gold, "g", "_g").join(counted(predicted, "p", "_p"), meet).withColumn("_n", F.col("_g") * F.col("_p"))
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0).cast("bigint")).alias(name)
    t = pairs.agg(total(F.col("_n"), "n"), total(F.when(G.iou(F.col("g"), F.col("p")) >= LEAST_IOU, F.col("_n")), "hit"))
    return t.withColumn("ratio", F.round(F.col("hit") / F.nullif("n", F.lit(0)), 4))


def value_readings(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """attr, gold, found, hit of gold(page, gold_id, attr, text, box): whether its page has a prediction with its text, and one whose box overlaps enough. Of a text on a page only distinct boxes meet, one pair a row."""
    asked = gold.groupBy("page", "text", "attr", "box").agg(F.count("*").alias("n"))
    texts = predicted.select("page", "text").distinct().withColumn("_has", F.lit(True))
    forms = asked.select("page", "text", "box").distinct().join(predicted.select("page", "text", F.col("box").alias("p")).distinct(), ["page", "text"])
    near = forms.where(G.iou(F.col("box"), F.col("p")) >= LEAST_IOU).select("page", "text", "box").distinct().withColumn("_near", F.lit(True))
    met = asked.join(texts, ["page", "text"], "left").join(near, ["page", "text", "box"], "left")
    total = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("n"))), F.lit(0).cast("bigint"))
    return met.groupBy("attr").agg(F.sum("n").alias("gold"), total("_has").alias("found"), total("_near").alias("hit"))


def feature_summary(rows: DataFrame, features: list[str], key: list[str] = ()) -> DataFrame:
    """key, feature, mean, sd (of the population; null for one value), lo, hi, n."""
    long = rows.select(*key, F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features))).alias("x")).select(*key, "x.*").where("v is not null")
    return long.groupBy(*key, "feature").agg(F.avg("v").alias("mean"), F.when(F.count("*") > 1, F.stddev_pop("v")).alias("sd"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))


def in_band(value: Column, mean: Column, sd: Column, floor: Column | None = None) -> Column:
    """Whether a value is within SIGMAS of the mean, by the larger of the deviation and a floor (relative, SD_FLOOR unless given)."""
    least = F.abs(mean) * (F.coalesce(floor, F.lit(SD_FLOOR)) if floor is not None else F.lit(SD_FLOOR))
    return F.abs(value - mean) <= SIGMAS * F.greatest(F.coalesce(sd, F.lit(0.0)), least)


def match_variants(pages: DataFrame, variants: DataFrame, features: list[str]) -> DataFrame:
    """page, variant, n_checks: the first variant (by name) whose features hold the page's, two at least, with one orientation.

    A band is a share of the variant's mean, so values within it have one sign and lie in the same or a neighbouring
    cell of the logarithm. Pages and variants meet by the cells of two features that both have; every pair that two
    checks can hold for meets so, whatever the number of variants.
    """
    width = -math.log(1 - SIGMAS * SD_FLOOR) * (1 + 1e-9)  # a value at the end of a band stays a neighbour
    cell = lambda c: F.when(c == 0, F.lit(-(1 << 40))).otherwise(F.floor(F.log(F.abs(c.cast("double"))) / width)).cast("long")
    place = lambda f, wide: F.when(F.col(f) == 0, F.array(cell(F.col(f)))).otherwise(F.sequence(cell(F.col(f)) - 1, cell(F.col(f)) + 1)) if wide else F.array(cell(F.col(f)))

    def keyed(rows: DataFrame, key: str, wide: bool) -> DataFrame:
        made = []
        for i, j in combinations(range(len(features)), 2):
            f, g = features[i], features[j]
            cells = F.flatten(F.transform(place(f, wide), lambda a: F.transform(place(g, wide), lambda b: F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.signum(F.col(f)).alias("si"), F.signum(F.col(g)).alias("sj"), a.alias("a"), b.alias("b")))))  # noqa: B023
            made.append(F.when(F.col(f).isNotNull() & F.col(g).isNotNull(), cells))
        return rows.select(key, F.inline(F.flatten(F.array_compact(F.array(*made)))))

    if len(features) < 2:
        return pages.select("page").limit(0).crossJoin(variants.select("variant").limit(0)).withColumn("n_checks", F.lit(0))
    some = keyed(pages, "page", False).join(keyed(variants, "variant", True), ["i", "j", "si", "sj", "a", "b"]).select("page", "variant").distinct()
    named = variants.select("variant", *(F.col(f).alias(f"_{f}") for f in features))
    pairs = some.join(pages, "page").join(named, "variant")
    both = lambda f: F.col(f).isNotNull() & F.col(f"_{f}").isNotNull()
    n = sum((both(f).cast("int") for f in features), F.lit(0))
    good = sum((F.when(both(f), F.abs(F.col(f) - F.col(f"_{f}")) <= SIGMAS * F.abs(F.col(f"_{f}")) * SD_FLOOR).otherwise(True).cast("int") for f in features), F.lit(0))
    upright = F.coalesce(G.orientation(F.col("aspect")) == G.orientation(F.col("_aspect")), F.lit(True)) if "aspect" in features else F.lit(True)
    hits = pairs.withColumn("n_checks", n).where((F.col("n_checks") >= 2) & (good == len(features)) & upright)
    return newest(hits, ["page"], [F.asc("variant")]).select("page", "variant", "n_checks")


def pick_anchor(rows: DataFrame, key: list[str], least: int = 2) -> DataFrame:
    """key, attr that starts records: of those seen `least` times with a box, the one with the smallest mean top, ties to the more frequent, then by name. rows(key, attr, top)."""
    per = rows.where("attr <> '' and top is not null").groupBy(*key, "attr").agg(F.avg("top").alias("mean_top"), F.count("*").alias("n")).where(F.col("n") >= least)
    return newest(per, key, [F.asc("mean_top"), F.desc("n"), F.asc("attr")]).select(*key, "attr", "mean_top", "n")


def anchor_mode(rows: DataFrame, page: str, order: str, attr: str) -> DataFrame:
    """The attribute that is first on most pages, ties by name."""
    first = rows.groupBy(page).agg(F.min_by(attr, order).alias("attr"))
    return first.groupBy("attr").agg(F.count("*").alias("pages")).orderBy(F.desc("pages"), "attr").limit(1)


def offset_prior(rows: DataFrame, attr: str, offset: str) -> DataFrame:
    """attr, median, p25, p75, n of offsets; the quartiles are elements of the sorted list (at n / 4 - 1 and 3 n / 4, rounded down, within it)."""
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(attr).orderBy(offset))).withColumn("_n", F.count("*").over(Window.partitionBy(attr)))
    low, high = F.greatest(F.lit(0), F.floor(F.col("_n") * 0.25) - 1) + 1, F.least(F.col("_n") - 1, F.floor(F.col("_n") * 0.75)) + 1
    return ranked.groupBy(attr).agg(
        F.round(F.median(offset), 2).alias("median"), F.round(F.max(F.when(F.col("_r") == low, F.col(offset))), 2).alias("p25"),
        F.round(F.max(F.when(F.col("_r") == high, F.col(offset))), 2).alias("p75"), F.count("*").alias("n"),
    )


def title_candidates(rows: DataFrame, attr: str, text: str, pattern: str = "功名|衔") -> DataFrame:
    """value, n of attributes that name titles, trimmed and not empty."""
    return rows.where(F.col(attr).rlike(pattern)).select(F.trim(text).alias("value")).where("value <> ''").groupBy("value").agg(F.count("*").alias("n"))


# Words by which notes tell what they ask for.
CROSS_PAGE, MASTHEAD, NOT_WANTED = "跨页|跨頁", "报名|報名|报纸名|報紙名", "不要|不是|不纳|不納"


def note_kind(note: Column, hint: Column) -> Column:
    """cross_page, exclude_masthead or attr_hint; '' for notes that ask for nothing."""
    n = F.coalesce(note, F.lit(""))
    return F.when(n.rlike(CROSS_PAGE), "cross_page").when(n.rlike(MASTHEAD) & n.rlike(NOT_WANTED), "exclude_masthead").when(F.trim(F.coalesce(hint, F.lit(""))) != "", "attr_hint").otherwise("")


def note_rules(notes: DataFrame, note: str, hint: str) -> DataFrame:
    """kind, n: notes by what they ask for; '' are those not consumed."""
    return notes.select(note_kind(F.col(note), F.col(hint)).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


def cross_page(pages: DataFrame, bands: DataFrame, gaps: DataFrame) -> DataFrame:
    """n_pages, mode_bands (ties to the fewer), boundary_sd, least_gap over pages(page, height), bands(page, foot) and gaps(page, gap). The last band of a page has no boundary after it."""
    counts = pages.select("page").join(bands.groupBy("page").agg(F.count("*").alias("n")), "page", "left").na.fill(0, ["n"])
    mode = counts.groupBy("n").agg(F.count("*").alias("k")).agg(F.min_by("n", F.struct(-F.col("k"), "n")).alias("mode_bands"), F.sum("k").alias("n_pages"))
    w = Window.partitionBy("page").orderBy(F.desc("foot"))
    inner = bands.withColumn("_r", F.row_number().over(w)).where("_r > 1").join(pages, "page").where("height > 0")
    sd = inner.agg(F.when(F.count("*") > 1, F.round(F.stddev_pop(F.round(F.col("foot") / F.col("height"), 3)), 4)).alias("boundary_sd"))
    return mode.join(sd).join(gaps.agg(F.min(F.round("gap", 1)).alias("least_gap"))).select("n_pages", "mode_bands", "boundary_sd", "least_gap")


def draft_stats(entries: DataFrame, columns: list[str]) -> DataFrame:
    """column, value, n: histograms of several columns in one pass."""
    long = entries.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")).select("x.*")
    return long.groupBy("column", "value").agg(F.count("*").alias("n"))


def operations(entries: DataFrame, key: list[str]) -> DataFrame:
    """key, items, high, manual_ops, each_ops, batch_ops, drop_each, drop_batch of entries(key, confidence, accepted, edited): high ones are accepted by one click in a batch."""
    t = entries.groupBy(*key).agg(F.count("*").alias("items"), F.count_if(F.col("confidence") == "high").alias("high"), F.count_if("accepted").alias("_a"), F.count_if(F.col("accepted") & F.col("edited")).alias("_e"))
    rate = F.when(F.col("_a") > 0, F.col("_e") / F.col("_a")).otherwise(0.0)
    per = (1 - rate) * ACCEPT_OPS + rate * AMEND_OPS
    t = t.withColumns({"manual_ops": F.col("items") * MANUAL_OPS, "_each": F.col("items") * per, "_batch": (F.col("high") > 0).cast("int") * ACCEPT_OPS + (F.col("items") - F.col("high")) * per})
    drop = lambda c: F.round((F.col("manual_ops") - F.col(c)) / F.col("manual_ops"), 4)
    return t.select(*key, "items", "high", "manual_ops", F.round("_each", 2).alias("each_ops"), F.round("_batch", 2).alias("batch_ops"), drop("_each").alias("drop_each"), drop("_batch").alias("drop_batch"))


def preflight(verdicts: DataFrame, allow_suspect: bool = False) -> DataFrame:
    """n_ok, n_suspect, n_unmeasurable, blocked of verdicts(page, verdict): only suspect pages block, unless allowed."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    t = verdicts.agg(n("ok").alias("n_ok"), n("suspect").alias("n_suspect"), n("unmeasurable").alias("n_unmeasurable"))
    return t.withColumn("blocked", (F.col("n_suspect") > 0) & F.lit(not allow_suspect))


def not_suspect(verdicts: DataFrame) -> DataFrame:
    """Pages that triage lets through."""
    return verdicts.where("verdict <> 'suspect'").select("page")


def drift_scan(pages: DataFrame, bands: DataFrame, publication: str, features: list[str], least_share: float = 0.75) -> DataFrame:
    """page, n, share, verdict: a page's features against the bands(publication, feature, mean, sd) of its publication."""
    long = pages.select("page", publication, F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features))).alias("x")).select("page", publication, "x.*")
    met = long.join(bands, [publication, "feature"], "left").withColumn("ok", in_band(F.col("v"), F.col("mean"), F.col("sd")))
    s = met.groupBy("page").agg(F.count("ok").alias("n"), F.avg(F.col("ok").cast("int")).alias("share"))
    return s.select("page", "n", F.round("share", 4).alias("share"), F.when(F.col("n") < 3, "unknown").when(F.col("share") < least_share, "drift").otherwise("ok").alias("verdict"))


def suspended(verdicts: DataFrame, resumed: DataFrame) -> DataFrame:
    """Pages whose verdict is drift and that no one has resumed."""
    return verdicts.where("verdict = 'drift'").join(resumed.select("page"), "page", "left_anti").select("page")


def publication_pages(names: DataFrame, name: str, publication: str) -> DataFrame:
    """Names of one publication: its name, _ and four digits."""
    return names.where(F.col(name).rlike(f"^\\Q{publication}\\E_\\d{{4}}$"))


def contract_score(rows: DataFrame, page: str, order: str, attr: str, template: list[str]) -> DataFrame:
    """page, coverage (share of the template's attributes that the page has), monotone (share of neighbouring attributes of the template in its order; null for one)."""
    place = F.array_position(F.array(*map(F.lit, template)), F.col(attr))
    w = Window.partitionBy(page).orderBy(order)
    known = rows.withColumn("_p", place).where("_p > 0").withColumn("_next", F.lead("_p").over(w))
    got = known.groupBy(page).agg(F.round(F.count_distinct("_p") / len(template), 4).alias("coverage"), F.round(F.avg((F.col("_next") >= F.col("_p")).cast("int")), 4).alias("monotone"))
    return rows.select(page).distinct().join(got, page, "left").na.fill(0.0, ["coverage"])


class FreeBands:
    """Bands of one stretch that no line has taken: ids by position, positions in order."""

    def __init__(self, tolerance: float):
        self.tolerance, self.ids, self.places, self.ready = tolerance, {}, [], False

    def add(self, band, rel: float) -> None:
        self.ids.setdefault(rel, []).append(band)

    def take(self, rel: float) -> tuple | None:
        """The nearest free band and its distance, of equally near ones the larger id; it is free no more."""
        if not self.ready:
            self.places, self.ready = sorted(self.ids), True
            for ids in self.ids.values():
                ids.sort()
        first, best = bisect_left(self.places, rel), None
        for run in (range(first, len(self.places)), range(first - 1, -1, -1)):
            for j in run:
                off = abs(rel - self.places[j])
                if off > self.tolerance or (best is not None and off > best[0]):
                    break
                top = self.ids[self.places[j]][-1]
                if best is None or (off, -top) < (best[0], -best[1]):
                    best = (off, top, j)
        if best is None:
            return None
        off, band, j = best
        ids = self.ids[self.places[j]]
        ids.pop()
        if not ids:
            del self.ids[self.places.pop(j)]
        return band, off


def line_similarity(a: Column, b: Column, tolerance: float = 0.007) -> Column:
    """Share of two lists of structure lines that match: each of a, in order, takes the nearest of b that is free and within the tolerance (the later of equally near ones); by the longer list. Python keeps what is free in order, so time is nearly linear in the lines, which an array of those taken would not be."""
    return F.udf(_similarity, "double", useArrow=True)(a.cast("array<double>"), b.cast("array<double>"), F.lit(float(tolerance)))


def _similarity(a: list | None, b: list | None, tolerance: float) -> float | None:
    if (a is not None and len(a) == 0) or (b is not None and len(b) == 0):
        return 0.0
    if a is None or b is None:
        return None
    free = FreeBands(tolerance)
    for j, y in enumerate(b):
        if y is not None:
            free.add(j, y)
    return sum(x is not None and free.take(x) is not None for x in a) / max(len(a), len(b))


def order_by_wins(precedence: DataFrame) -> DataFrame:
    """before, after, wins, losses where one attribute comes before another more often than after it."""
    return precedence.where("wins > losses")
