"""Checks of annotation results against their pages: one finding for each page or record that a check counts faults in.

A result is one row for a page, with its records, values and boxes nested, as a page bounds them; the page's lines,
true size and plan regions are joined to it. Checks are data: a code, a level, and the expression that counts
faults. Those of a page are compiled into one pass over its row, those of a record into one over the exploded
records; lines that records share and ranges that overlap are found in the page's row, in sorted arrays.

results(stem, kind, schema_version, profile_id, tier, text_stream, chain, trace, layout, page, records, unassigned):
chain is an array of tiers (null: CHAIN), trace an array of (tier, ok), layout (covered, policy), page (w, h),
records an array of (lines, box, attrs), attrs of (attr, text, lines, boxes), boxes of four numbers, unassigned of
(text, reason). A null profile, tier, stream or array of records is a missing field. lines(stem, at, text),
sizes(stem, w, h), regions(stem, id, lo, hi, role) in shares of the height.

Defined cases: a result with schema faults has these only; a page without lines is checked within itself, with a warning;
blank values and notes are left out; boxes of other than four numbers are none; an empty table has no findings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireworks.functions import text as T

# What a result is called, the tiers in order, policies, and reasons that excuse text without a value.
KIND, VERSION, CHAIN = "annotation_result", "0.1.0", ("rule", "l1", "l2", "single_line")
POLICIES = ("family_params", "page_fallback")
EXCUSED = ("header", "footer", "unannotated_region", "page_constant", "decorative", "exclusion_zone")
#: Least share of text in values, characters of a large gap, lines that a single record covers, page heights that are equal, and pixels that a box may stand out.
COVERAGE, LARGE_GAP, WHOLE_PAGE, SAME_HEIGHT, OUTSIDE = 0.5, 20, 0.9, 0.02, 0.5

_SPANS = "array<struct<lo:int,hi:int>>"
_BOX = "array<double>"


@dataclass
class Check:
    """Counts the faults of a page or a record; n is null or 0 where there is none."""

    code: str
    level: str
    n: Column


def _flags(checks: list[Check], record: Column) -> Column:
    found = [F.struct(F.lit(c.level).alias("level"), F.lit(c.code).alias("code"), record.cast("int").alias("record"), F.coalesce(c.n.cast("long"), F.lit(0).cast("long")).alias("n")) for c in checks]
    return F.filter(F.array(*found), lambda f: f["n"] > 0)


def _count(c: Column) -> Column:
    return c.cast("int")


def _bare(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), T.SPACES, "")


def _blank(text: Column) -> Column:
    return _bare(text) == ""


def _covered(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0), lambda n, s: n + s["hi"] - s["lo"])


def _corners(box: Column) -> Column:
    x = lambda f, a, b: f(F.get(box, F.lit(a)), F.get(box, F.lit(b)))
    return F.struct(x(F.least, 0, 2).alias("x0"), x(F.least, 1, 3).alias("y0"), x(F.greatest, 0, 2).alias("x1"), x(F.greatest, 1, 3).alias("y1"))


def prepared(results: DataFrame, lines: DataFrame, sizes: DataFrame, regions: DataFrame) -> DataFrame:
    """results with their page's lines, size and regions, and the texts, values and spans that checks share."""
    texts = lines.where(~_blank(F.col("text"))).groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("_l"))
    texts = texts.select("stem", F.size("_l").alias("n_lines"), F.array_join(F.transform("_l", lambda x: _bare(x["text"])), "").alias("real"))
    areas = regions.groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("lo", "id", "hi", "role"))).alias("regions"))
    t = results.join(texts, "stem", "left").join(sizes.select("stem", F.struct("w", "h").alias("true_size")), "stem", "left").join(areas, "stem", "left")
    declared = F.when((F.col("page.w") > 0) & (F.col("page.h") > 0), F.struct(F.col("page.w").cast("double").alias("w"), F.col("page.h").cast("double").alias("h")))
    t = t.withColumns({
        "chain": F.coalesce("chain", F.array(*map(F.lit, CHAIN))), "size": F.coalesce(F.col("true_size"), declared),
        "stream": T.normal_locate(F.col("text_stream")), "real_norm": F.when(F.col("real").isNotNull(), T.normal_locate(F.col("real"))),
        "values": F.flatten(F.transform("records", lambda r: F.filter(F.transform(F.coalesce(r["attrs"], F.array().cast(results.schema["records"].dataType.elementType["attrs"].dataType)), lambda a: a["text"]), lambda v: ~_blank(v)))),
        "notes": F.filter(F.coalesce("unassigned", F.array().cast(results.schema["unassigned"].dataType)), lambda u: ~_blank(u["text"])),
    })
    t = t.withColumns({"found": T.ordered_spans(F.col("stream"), F.transform("values", lambda v: T.normal_locate(v))), "noted": T.ordered_spans(F.col("stream"), F.transform("notes", lambda u: T.normal_locate(u["text"])))})
    excused = F.filter(F.transform(F.filter("notes", lambda u: u["reason"].isin(*EXCUSED)), lambda u: F.struct((F.position(T.normal_locate(u["text"]), F.col("stream")) - 1).cast("int").alias("lo"), F.length(T.normal_locate(u["text"])).alias("n"))), lambda s: s["lo"] >= 0)
    t = t.withColumns({
        "spans": T.union_spans(F.col("found.spans")), "all_spans": T.union_spans(F.concat("found.spans", "noted.spans")),
        "known_spans": T.union_spans(F.concat("found.spans", F.transform(excused, lambda s: F.struct(s["lo"].alias("lo"), (s["lo"] + s["n"]).alias("hi"))).cast(_SPANS))),
    })
    return t.withColumn("gaps", F.filter(F.transform(T.gap_texts(F.col("stream"), F.col("known_spans")), lambda g: F.length(g)), lambda n: n >= LARGE_GAP))


def schema_faults(t: Column | None = None) -> Column:
    missing = [F.col(c).isNull() for c in ("profile_id", "stem", "tier", "records", "text_stream")]
    wrong = [~F.col("kind").eqNullSafe(F.lit(KIND)), F.substring_index(F.coalesce("schema_version", F.lit("")), ".", 1) != VERSION.split(".")[0], *missing]
    return sum((_count(w) for w in wrong[1:]), _count(wrong[0]))


def page_checks() -> list[Check]:
    """Checks of a page's row as a whole."""
    trace = F.coalesce("trace", F.array().cast("array<struct<tier:string,ok:boolean>>"))
    places = F.filter(F.transform(trace, lambda x: F.array_position("chain", x["tier"])), lambda p: p > 0)
    done = F.transform(F.filter(trace, lambda x: F.coalesce(x["ok"], F.lit(False))), lambda x: x["tier"])
    covered, policy, fallback = F.col("layout.covered"), F.coalesce("layout.policy", F.lit("")), F.col("layout.policy") == "page_fallback"
    first = F.coalesce(F.get("records", F.lit(0))["lines"], F.array().cast("array<int>"))
    reach = F.when(F.size(first) > 0, F.array_max(first) - F.array_min(first) + 1).otherwise(0)
    need = F.floor(F.lit(WHOLE_PAGE) * F.coalesce("n_lines", F.lit(0)))
    single = (F.col("tier") == "single_line") & ((F.size("records") != 1) | ((need > 0) & (reach < need)))
    folded = F.filter("values", lambda v: ~F.contains(F.col("real"), _bare(v)) & F.contains(F.col("real_norm"), T.normal_locate(v)))
    silent, length = F.length("stream") - _covered(F.col("all_spans")), F.length("stream")
    has_layout, known = F.col("layout").isNotNull(), F.col("real").isNotNull()
    return [
        Check("tier_unknown", "error", _count(~F.array_contains("chain", F.col("tier"))) + F.size(F.filter(trace, lambda x: ~F.coalesce(F.array_contains(F.col("chain"), x["tier"]), F.lit(False))))),
        Check("tier_trace_order", "warning", _count(places != F.array_sort(places))),
        Check("tier_skip", "warning", _count((F.size(places) > 0) & (F.array_max(places) - F.array_min(places) + 1 != F.size(places)))),
        Check("tier_mismatch", "error", _count((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)) != F.col("tier")))),
        Check("line_source_unresolved", "warning", _count(~known)),
        Check("stream_mismatch", "error", _count(known & (F.col("stream") != F.col("real_norm")))),
        Check("fabricated", "error", F.col("found.missing")),
        Check("value_disorder", "warning", F.col("found.back")),
        Check("glyph_folded", "warning", F.when(known, F.size(folded))),
        Check("unassigned_fabricated", "error", F.col("noted.missing")),
        Check("silent_gap", "error", silent),
        Check("coverage_low", "warning", _count((length > 0) & (_covered(F.col("spans")) / length < COVERAGE))),
        Check("large_gap", "warning", F.size("gaps")),
        Check("single_line_bad", "error", _count(single)),
        Check("layout_policy_unknown", "warning", _count(has_layout & (policy != "") & ~policy.isin(*POLICIES))),
        Check("layout_uncovered", "warning", _count(has_layout & ((covered.eqNullSafe(F.lit(False)) & (policy != "page_fallback")) | (covered.isNull() & F.coalesce(fallback, F.lit(False)))))),
        Check("layout_policy_mismatch", "warning", _count(has_layout & fallback & (F.col("tier") != "single_line"))),
        Check("page_size_unknown", "warning", _count(F.col("size").isNull())),
        Check("page_size_mismatch", "warning", _count(F.col("true_size").isNotNull() & (F.col("page.h") > 0) & (F.abs(F.col("page.h") - F.col("true_size.h")) > SAME_HEIGHT * F.col("true_size.h")))),
    ]


def record_checks() -> list[Check]:
    """Checks of a record within its page's row: lines, values without lines, boxes and regions."""
    outside = lambda i: (i < 0) | F.coalesce(i >= F.col("n_lines"), F.lit(False))
    bad_lines = F.size(F.filter("lines", outside)) + F.aggregate("attrs", F.lit(0), lambda n, a: n + F.coalesce(F.size(F.filter(a["lines"], outside)), F.lit(0)))
    bare = F.filter("attrs", lambda a: F.coalesce(F.size(a["lines"]), F.lit(0)) <= 0)
    known, no_lines = F.col("n_lines").isNotNull(), F.size("lines") == 0
    w, h = F.col("size.w"), F.col("size.h")
    out = F.filter("boxes", lambda b: (b["x0"] < -OUTSIDE) | (b["y0"] < -OUTSIDE) | (b["x1"] > w + OUTSIDE) | (b["y1"] > h + OUTSIDE))
    in_plan = F.col("size").isNotNull() & (F.coalesce(F.size("regions"), F.lit(0)) > 0) & (F.size("boxes") > 0)
    free = F.size(F.filter("areas", lambda r: F.coalesce(r["role"], F.lit("")).startswith("unannotated")))
    touched = F.size(F.array_distinct(F.filter(F.transform("areas", lambda r: r["id"]), lambda i: i.isNotNull())))
    return [
        Check("line_out_of_range", "error", bad_lines),
        Check("record_no_lines", "warning", _count(known & no_lines)),
        Check("attr_no_lines", "warning", F.when(known & no_lines, F.size(bare))),
        Check("box_inverted", "error", F.size(F.filter("boxes", lambda b: (b["x1"] <= b["x0"]) | (b["y1"] <= b["y0"])))),
        Check("box_out_of_page", "error", F.when(F.col("size").isNotNull(), F.size(out))),
        Check("record_spans_bands", "warning", _count(in_plan & (touched > 1))),
        Check("record_in_unannotated", "error", _count(in_plan & (free > 0) & (free == F.size("boxes")))),
        Check("record_touches_unannotated", "warning", F.when(in_plan & (free < F.size("boxes")), free)),
    ]


def records_of(pages: DataFrame, *page: str) -> DataFrame:
    """stem, record, lines, attrs (with a text), boxes, areas (the region of each box's centre), and the page's columns that record checks need, or that are asked for; a page without records has a row without any."""
    r = pages.select("stem", "n_lines", "size", "regions", *page, F.posexplode_outer("records").alias("record", "r"))
    attrs_kind = pages.schema["records"].dataType.elementType["attrs"].dataType
    attrs = F.filter(F.coalesce("r.attrs", F.array().cast(attrs_kind)), lambda a: ~_blank(a["text"]))
    all_boxes = F.concat(F.flatten(F.transform(F.coalesce("r.attrs", F.array().cast(attrs_kind)), lambda a: F.coalesce(a["boxes"], F.array().cast(f"array<{_BOX}>")))), F.array("r.box"))
    r = r.select("stem", "record", "n_lines", "size", "regions", *page, F.coalesce("r.lines", F.array().cast("array<int>")).alias("lines"), attrs.alias("attrs"), F.transform(F.filter(all_boxes, lambda b: (F.size(b) == 4) & ~F.exists(b, lambda x: x.isNull())), _corners).alias("boxes"))
    at = lambda b: F.get(F.filter("regions", lambda g: (g["lo"] <= (b["y0"] + b["y1"]) / 2 / F.col("size.h")) & ((b["y0"] + b["y1"]) / 2 / F.col("size.h") < g["hi"])), F.lit(0))
    return r.withColumn("areas", F.when(F.col("size").isNotNull() & F.col("regions").isNotNull(), F.transform("boxes", at)))


def _with_former(items: str) -> Column:
    """Each element of a column's array with the one before it, the first with itself."""
    return F.zip_with(items, F.slice(F.concat(F.slice(items, 1, 1), items), F.lit(1), F.size(items)), lambda x, former: F.struct(x.alias("x"), former.alias("former")))


def _error(code: str, record: Column, n: Column) -> Column:
    return F.struct(F.lit("error").alias("level"), F.lit(code).alias("code"), record.cast("int").alias("record"), n.cast("long").alias("n"))


def used_lines() -> Column:
    """Lines that records of a page have, sorted, each once for a record, as line * 2^31 + record."""
    known = lambda line: (line >= 0) & F.coalesce(line < F.col("n_lines"), F.lit(True))
    used = F.transform("records", lambda r, i: F.transform(F.filter(F.coalesce(r["lines"], F.array().cast("array<int>")), known), lambda line: F.shiftleft(line.cast("long"), 31) + i))
    return F.sort_array(F.array_distinct(F.flatten(used)))


def reused_lines() -> Column:
    """Those of `used` that an earlier record has too: a line belongs to its first record."""
    line = lambda u: F.shiftright(u, 31)
    return F.transform(F.filter(_with_former("used"), lambda p: (p["x"] != p["former"]) & (line(p["x"]) == line(p["former"]))), lambda p: p["x"])


def shared_lines() -> Column:
    """Faults of records with `reused` lines; a record that names a line twice has two."""
    record = lambda u: u.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
    times = lambda u: F.size(F.filter(F.get("records", record(u))["lines"], lambda line: line == F.shiftright(u, 31)))
    n = lambda i: F.aggregate(F.filter("reused", lambda u: record(u) == i), F.lit(0), lambda n, u: n + times(u))
    return F.transform(F.array_distinct(F.transform("reused", record)), lambda i: _error("line_reused", i, n(i)))


def ranges() -> Column:
    """(lo, hi, record) of a page's records that have lines, sorted."""
    return F.sort_array(F.filter(F.transform("records", lambda r, i: F.when(F.size(r["lines"]) > 0, F.struct(F.array_min(r["lines"]).alias("lo"), F.array_max(r["lines"]).alias("hi"), i.alias("record")))), lambda s: s.isNotNull()))


def overlapping() -> Column:
    """Faults of records whose range of lines begins within the one before it in `ranges`."""
    inside = F.filter(_with_former("ranges"), lambda s: (s["x"]["record"] != s["former"]["record"]) & (s["x"]["lo"] <= s["former"]["hi"]))
    return F.transform(inside, lambda s: _error("record_overlap", s["x"]["record"], F.lit(1)))


def findings(results: DataFrame, lines: DataFrame, sizes: DataFrame, regions: DataFrame) -> DataFrame:
    """stem, level, code, record (null for faults of the page), n for every check that counts a fault. A page's row is made once, and all its checks are made on it, so nothing is dealt out a second time."""
    broken = schema_faults() > 0
    schema = F.array(F.struct(F.lit("error").alias("level"), F.lit("schema").alias("code"), F.lit(None).cast("int").alias("record"), schema_faults().cast("long").alias("n")))
    pages = prepared(results, lines, sizes, regions).withColumns({"used": used_lines(), "ranges": ranges()}).withColumn("reused", reused_lines())
    of_page = F.when(broken, schema).otherwise(F.concat(_flags(page_checks(), F.lit(None)), shared_lines(), overlapping()))
    pages = pages.withColumns({"of_page": of_page, "records": F.when(~broken, F.col("records"))})
    first, record = F.coalesce("record", F.lit(0)) == 0, F.col("record")
    found = F.concat(F.when(first, F.col("of_page")).otherwise(F.filter("of_page", lambda f: F.lit(False))), F.when(record.isNotNull(), _flags(record_checks(), record)).otherwise(F.filter("of_page", lambda f: F.lit(False))))
    return records_of(pages, "of_page").select("stem", F.inline(found))


def report(results: DataFrame, found: DataFrame) -> DataFrame:
    """stem, ok (no errors), errors, warnings: how many of each a result has."""
    n = lambda level: F.coalesce(F.sum(F.when(F.col("level") == level, F.col("n"))), F.lit(0).cast("long"))
    t = found.groupBy("stem").agg(n("error").alias("errors"), n("warning").alias("warnings"))
    t = results.select("stem").join(t, "stem", "left").na.fill(0, ["errors", "warnings"])
    return t.select("stem", (F.col("errors") == 0).alias("ok"), "errors", "warnings")


def metrics(results: DataFrame, lines: DataFrame, sizes: DataFrame, regions: DataFrame) -> DataFrame:
    """stem, n_records, n_attrs, n_lines, n_stream_chars, attr_coverage, coverage, n_unassigned, n_uncovered_chars, n_large_gaps of results without schema faults."""
    t = prepared(results.where(schema_faults() == 0), lines, sizes, regions)
    share = lambda spans: F.when(F.length("stream") > 0, F.round(_covered(F.col(spans)) / F.length("stream"), 4)).otherwise(0.0)
    return t.select(
        "stem", F.size("records").alias("n_records"), F.size("values").alias("n_attrs"), "n_lines", F.length("stream").alias("n_stream_chars"), share("spans").alias("attr_coverage"), share("all_spans").alias("coverage"),
        F.size("notes").alias("n_unassigned"), (F.length("stream") - _covered(F.col("all_spans"))).alias("n_uncovered_chars"), F.size("gaps").alias("n_large_gaps"),
    )
