"""Structure lines over the pages of a publication: one-to-one matches with known bands, page families, merged lines.

Positions are shares of the page height (0 to 1), rounded to DIGITS. All operators work on every key (publication)
at once. What they gather in one row or window is bounded: the lines of one page, or the cells of a key, of which
there are 1 / tolerance. Matching holds the free bands of one stretch of a key.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from quireworks.operators.evaluation import FreeBands, line_similarity
from quireworks.operators.tables import written

#: Distance within which lines are one, and within which a line meets a known band; digits of positions.
TOLERANCE, BAND_TOLERANCE, DIGITS = 0.007, 0.005, 6
#: Least similarity of pages of a family, pages that make a family inducible, length up to which a line is weak; first pages that all others of their key are held against before pairs are made.
LEAST_SIMILARITY, INDUCIBLE_PAGES, WEAK_LENGTH, SEEDS = 0.5, 2, 2, 8


def _cell(c: Column, tolerance: float) -> Column:
    return F.floor(c / tolerance + 1e-9)


def match_bands(lines: DataFrame, bands: DataFrame, key: str, tolerance: float = BAND_TOLERANCE) -> DataFrame:
    """key, line_id, band_id, off: lines(key, line_id, rel) in the order of line_id take the nearest band(key, band_id, band_rel) that is free and within the tolerance, of equally near ones the one with the larger id.

    Positions within the tolerance of their neighbours are one stretch; no line meets a band of another, so stretches
    go on side by side. In a stretch lines take turns as they are read, and only its free bands are held: no pair of
    line and band is made, however many share a position.
    """
    kinds = {c: d.schema[c].dataType for d, c in ((lines, key), (lines, "line_id"), (bands, "band_id"))}
    none = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    both = lines.select(key, "line_id", none("band_id"), F.col("rel").cast("double").alias("rel"), F.lit(1).alias("_side")).unionByName(bands.select(key, none("line_id"), "band_id", F.col("band_rel").cast("double").alias("rel"), F.lit(0).alias("_side")))
    laid = _in_islands(both.where(F.col(key).isNotNull() & F.col("rel").isNotNull()), key, tolerance)
    turns = laid.repartition(key, "island").sortWithinPartitions(key, "island", "_side", "line_id").select(key, "island", "_side", "line_id", "band_id", "rel")
    names = [key, "line_id", "band_id", "off"]
    arrow = pa.schema([*((c, to_arrow_type(kinds[c])) for c in names[:3]), ("off", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, free = None, FreeBands(tolerance)
        for batch in batches:
            out = []
            for k, island, side, line, band, rel in zip(*(c.to_pylist() for c in batch.columns)):
                if (k, island) != at:
                    at, free = (k, island), FreeBands(tolerance)
                if side == 0:
                    free.add(band, rel)
                elif (got := free.take(rel)) is not None:
                    out.append((k, line, *got))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], schema=arrow)

    return turns.mapInArrow(run, StructType([*(StructField(c, kinds[c]) for c in names[:3]), StructField("off", DoubleType())]))


def band_agreement(lines: DataFrame, bands: DataFrame, keys: DataFrame, key: str, tolerance: float = BAND_TOLERANCE) -> DataFrame:
    """For keys(key, ref_h): key, verdict, n_contract, n_matched, n_plan_only, n_contract_only, max_dev_rel, max_dev_px.

    Verdicts: no_contract_bands; conforms if lines and bands match one to one; deviates if some do; unmatched.
    """
    met = match_bands(lines, bands, key, tolerance).groupBy(key).agg(F.count("*").alias("n_matched"), F.max("off").alias("dev"))
    n = lambda d, name: d.groupBy(key).agg(F.count("*").alias(name))
    t = keys.join(n(lines, "n_plan"), key, "left").join(n(bands, "n_contract"), key, "left").join(met, key, "left").na.fill(0, ["n_plan", "n_contract", "n_matched"])
    t = t.withColumns({"n_plan_only": F.col("n_plan") - F.col("n_matched"), "n_contract_only": F.col("n_contract") - F.col("n_matched")})
    verdict = F.when(F.col("n_contract") == 0, "no_contract_bands").when(F.col("n_matched") == 0, "unmatched").when((F.col("n_plan_only") == 0) & (F.col("n_contract_only") == 0), "conforms").otherwise("deviates")
    return t.select(key, verdict.alias("verdict"), "n_contract", "n_matched", "n_plan_only", "n_contract_only", F.round("dev", 4).alias("max_dev_rel"), F.round(F.col("dev") * F.col("ref_h"), 1).alias("max_dev_px"))


def islands(lines: DataFrame, key: str, tolerance: float = TOLERANCE) -> DataFrame:
    """lines with island: neighbouring positions of a key within the tolerance are one island."""
    return _in_islands(lines.withColumn("rel", F.round("rel", DIGITS)), key, tolerance)


def _in_islands(lines: DataFrame, key: str, tolerance: float) -> DataFrame:
    """As islands, of positions as they are. Those of one cell always are one island, so only the extremes of cells are put in order."""
    marked = lines.withColumn("_cell", _cell(F.col("rel"), tolerance))
    w = Window.partitionBy(key).orderBy("_cell")
    cells = marked.groupBy(key, "_cell").agg(F.min("rel").alias("_lo"), F.max("rel").alias("_hi"))
    new = F.coalesce(F.col("_lo") - F.lag("_hi").over(w) > tolerance, F.lit(True)).cast("int")
    numbered = cells.withColumn("_new", new).select(key, "_cell", F.sum("_new").over(w).alias("island"))
    return marked.join(numbered, [key, "_cell"]).drop("_cell")


def structure_lines(lines: DataFrame, pages: DataFrame, key: str, tolerance: float = TOLERANCE) -> DataFrame:
    """Merged lines of each key: key, island, rel, rel_spread, px, support, n_pages_hit, kind, in_gold_any, weak, pages, extra.

    lines(key, page, line_no, rel, kind, length, in_gold), pages(key, page, h). A page counts once in an island, with
    its line nearest to the island's median (the upper of equally near ones); its other lines are `extra`
    (page, rel, kind, length). rel is the mean of those that count, support their share of all pages of the key, px
    the mean at the median height (sums are whole numbers, so their order does not matter; halves go up), kind the most frequent one (of equally frequent ones that of the first page).
    """
    items = islands(lines, key, tolerance)
    middle = items.groupBy(key, "island").agg(F.percentile("rel", 0.5).alias("_mid"))
    placed = items.join(middle, [key, "island"]).withColumn("_off", F.struct(F.abs(F.col("rel") - F.col("_mid")), "rel", "line_no"))
    one = Window.partitionBy(key, "island", "page")
    placed = placed.withColumn("_keep", F.col("_off") == F.min("_off").over(one)).withColumn("_first", F.min(F.struct("rel", "page", "line_no")).over(one))
    kept = placed.where("_keep")
    kinds = kept.groupBy(key, "island", "kind").agg(F.struct((-F.count("*")).alias("n"), F.min("_first").alias("at")).alias("_k"))
    kind = kinds.groupBy(key, "island").agg(F.min_by("kind", "_k").alias("kind"))
    height = lines.select(key, "page").join(pages.select(key, "page", "h"), [key, "page"]).where("h > 0").groupBy(key).agg(F.floor(F.percentile("h", 0.5)).alias("_h"))
    total = pages.groupBy(key).agg(F.count_distinct("page").alias("_n"))
    merged = kept.groupBy(key, "island").agg(
        (F.sum(F.round(F.col("rel") * 10**DIGITS).cast("bigint")) / F.count("*") / 10**DIGITS).alias("_rel"), F.round(F.max("rel") - F.min("rel"), 4).alias("rel_spread"), F.count("*").alias("n_pages_hit"), F.bool_or("in_gold").alias("in_gold_any"),
        F.count_if(F.coalesce("length", F.lit(0)) <= WEAK_LENGTH).alias("weak"), F.array_sort(F.collect_list("page")).alias("pages"),
    )
    extra = placed.where("not _keep").groupBy(key, "island").agg(F.array_sort(F.collect_list(F.struct("rel", "page", "kind", "length"))).alias("extra"))
    t = merged.join(kind, [key, "island"]).join(extra, [key, "island"], "left").join(total, key).join(height, key, "left")
    none = F.array().cast(extra.schema["extra"].dataType)
    return t.select(
        key, "island", F.round(F.col("_rel") + 1e-9, 4).alias("rel"), "rel_spread", F.round(F.col("_rel") * F.col("_h") + 1e-9, 1).alias("px"), F.round(F.col("n_pages_hit") / F.col("_n"), 3).alias("support"),
        "n_pages_hit", "kind", "in_gold_any", "weak", "pages", F.coalesce("extra", none).alias("extra"),
    )


def founders(pages: DataFrame, key: str, tolerance: float = TOLERANCE, least: float = LEAST_SIMILARITY) -> DataFrame:
    """at and founder of pages(key, at, rels: sorted positions), families by first fit.

    In the order of `at`, a page joins the earliest founded family that has a page like it, or founds one. So its
    founder is the least of the founders of earlier pages like it, and that is the least page that a descending
    path of likeness reaches. Founders only fall: the first pages of a key are held against all its others, then
    only pairs whose earlier page has a lower founder than the later one are made (by a rare line that both must share),
    and in later rounds only those whose earlier page has just fallen, until none falls.
    """
    known = written(pages.select(key, "at", F.transform("rels", lambda r: F.round(r, DIGITS)).alias("rels")).withColumn("founder", F.col("at")).withColumn("n", F.size("rels")), "family-pages")
    full = known.where("n > 0")
    like = lambda a, b: line_similarity(a, b, tolerance) >= least
    used = None
    for _ in range(SEEDS):
        free = full.where("founder = at") if used is None else full.where("founder = at").join(used, [key, "at"], "left_anti")
        seeds = written(free.groupBy(key).agg(F.min("at").alias("at"), F.min_by("rels", "at").alias("seed")), "family-seeds")
        if not seeds.limit(1).count():
            break
        s = seeds.select(key, F.col("at").alias("_at"), "seed")
        met = full.join(s, key, "left")
        full = written(met.withColumn("founder", F.when((F.col("at") > F.col("_at")) & (F.col("_at") < F.col("founder")) & like(F.col("rels"), F.col("seed")), F.col("_at")).otherwise(F.col("founder"))).drop("_at", "seed"), "family-pages")
        used = seeds.select(key, "at") if used is None else used.unionByName(seeds.select(key, "at"))

    # Of n lines a page like it shares ceil(least * n); so of the n - that + 1 rarest at least one.
    marked = full.select(key, "at", "n", F.posexplode("rels").alias("j", "rel")).withColumn("cell", _cell(F.col("rel"), tolerance))
    common = marked.groupBy(key, "cell").agg(F.count("*").alias("seen"))
    order = Window.partitionBy(key, "at").orderBy("seen", "cell", "j")
    rare = marked.join(common, [key, "cell"]).withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1)
    asks = written(rare.select(key, "at", F.explode(F.sequence(F.col("cell") - 1, F.col("cell") + 1)).alias("cell")).distinct(), "family-asks")
    holds = written(marked.select(key, F.col("at").alias("m"), "cell").distinct(), "family-holds")
    fallen = full.select(key, F.col("at").alias("m"))
    while True:
        now = full.select(key, "at", "founder", "rels", "n")
        earlier = now.select(key, F.col("at").alias("m"), F.col("founder").alias("m_founder"), F.col("rels").alias("m_rels"), F.col("n").alias("m_n")).join(fallen, [key, "m"])
        shared = asks.join(holds.join(earlier.select(key, "m", "m_founder", "m_n"), [key, "m"]), [key, "cell"]).where("m < at")
        pairs = shared.join(now.select(key, "at", "founder", "n"), [key, "at"]).where((F.col("m_founder") < F.col("founder")) & (F.least("n", "m_n") >= least * F.greatest("n", "m_n") - 1e-9))
        pairs = pairs.select(key, "at", "m").distinct().join(now.select(key, "at", "rels"), [key, "at"]).join(earlier.select(key, "m", "m_rels", "m_founder"), [key, "m"])
        lower = written(pairs.where(like(F.col("rels"), F.col("m_rels"))).groupBy(key, "at").agg(F.min("m_founder").alias("lower")), "family-falls")
        if not lower.limit(1).count():
            break
        full = written(full.join(lower, [key, "at"], "left").withColumn("founder", F.least("founder", "lower")).drop("lower"), "family-pages")
        fallen = lower.select(key, F.col("at").alias("m"))
    return full.select(key, "at", "founder").unionByName(known.where("n = 0").select(key, "at", "founder"))


def page_families(pages: DataFrame, lines: DataFrame, key: str, tolerance: float = TOLERANCE, least: float = LEAST_SIMILARITY) -> DataFrame:
    """Families of pages(key, page, at) by their lines(key, page, rel): key, family, founder, is_primary, n_pages, median_n_lines, coverage, pages (in order).

    Families are numbered from 0 by pages, then median lines, both descending, then founder. A family of one page is
    evidence of that page only: single_page_evidence, else inducible. Pages without lines are families of their own.
    """
    rels = lines.groupBy(key, "page").agg(F.array_sort(F.collect_list("rel")).alias("rels"))
    whole = pages.join(rels, [key, "page"], "left").withColumn("rels", F.coalesce("rels", F.array().cast("array<double>")))
    found = founders(whole.select(key, "at", "rels"), key, tolerance, least).join(whole.select(key, "at", "page", F.size("rels").alias("n")), [key, "at"])
    made = found.groupBy(key, "founder").agg(F.count("*").alias("n_pages"), F.floor(F.percentile("n", 0.5)).cast("int").alias("median_n_lines"), F.array_sort(F.collect_list(F.struct("at", "page"))).alias("_p"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n_pages"), F.desc("median_n_lines"), "founder")) - 1
    t = made.withColumn("family", place)
    return t.select(key, "family", "founder", (F.col("family") == 0).alias("is_primary"), "n_pages", "median_n_lines", F.when(F.col("n_pages") >= INDUCIBLE_PAGES, "inducible").otherwise("single_page_evidence").alias("coverage"), F.col("_p.page").alias("pages"))
