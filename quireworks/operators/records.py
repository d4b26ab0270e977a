"""Rule split: a page's lines cut into records, and a record's text into attributes.

Judgements about single lines are boolean columns, so the cut itself is a window over a page's lines; taking
attributes is a fold over a template of a few attributes, written out as columns.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Numerals that make a line noise, words that only stand inside records, and tails of cut names.
NOISE_NUMERALS = "〇零一二三四五六七八九十百千万萬两兩廿卅"
LIMIT_TAILS = ["有限", "有限公"]
#: Characters of a value that follows its anchor, at most.
MOST_CHARS = 80


def is_noise(text: Column) -> Column:
    """Under two characters, without CJK, or numerals alone."""
    cjk = F.regexp_replace(text, r"[^\x{4e00}-\x{9fff}]", "")
    return (F.length(text) < 2) | (cjk == "") | cjk.rlike(f"^[{NOISE_NUMERALS}]+$")


def is_limit_tail(text: Column) -> Column:
    """The first half of a name that was cut within its tail."""
    ends = lambda w: F.endswith(text, F.lit(w))
    return (ends(LIMIT_TAILS[0]) | ends(LIMIT_TAILS[1])) & ~text.isin(*LIMIT_TAILS)


def looks_like_record_name(text: Column, strong: Column, constants: list[str], fragments: list[str], most: int = 12) -> Column:
    """2 to `most` characters, no noise, no page constant and no bare fragment; and either a cut name, or without a strong anchor."""
    return F.length(text).between(2, most) & ~is_noise(text) & ~text.isin(*constants) & ~text.isin(*fragments) & (is_limit_tail(text) | ~strong)


def segment_records(lines: DataFrame, page: str, order: str, name: Column, body: Column, suffix: Column, opens: Column, anchored: Column) -> DataFrame:
    """lines with record (from 1; 0 before the first), is_start, forced and trimmed.

    A record starts at a name line that a body line follows, at once or after one suffix line. A line that
    `opens` starts one too if a body line follows and the line before neither starts a record nor is such a
    suffix; of neighbouring lines that open, every other one starts. Short lines without anchors at the foot of
    a page's last record are trimmed: they keep their record number but are no part of it.
    """
    w = Window.partitionBy(page).orderBy(order)
    after = lambda c, n=1: F.coalesce(F.lead(c, n).over(w), F.lit(False))
    before = lambda c: F.coalesce(F.lag(c).over(w), F.lit(False))
    yes = lambda c: F.coalesce(c, F.lit(False))
    d = lines.withColumns({"_name": yes(name), "_body": yes(body), "_suffix": yes(suffix), "_opens": yes(opens), "_anchored": yes(anchored)})
    d = d.withColumn("_by_suffix", F.col("_name") & ~after("_body") & after("_suffix") & after("_body", 2))
    d = d.withColumn("_base", F.col("_name") & after("_body") | F.col("_by_suffix"))
    d = d.withColumn("_blocks", F.col("_base") | before("_by_suffix"))
    first = F.row_number().over(w) == 1
    d = d.withColumn("_may", F.col("_opens") & ~F.col("_blocks") & after("_body") & ~first)
    # lines that may open alternate, counted from the last line that may not
    d = d.withColumn("_at", F.row_number().over(w)).withColumn("_from", F.max(F.when(~F.col("_may"), F.struct("_at", "_blocks"))).over(w))
    d = d.withColumn("forced", F.col("_may") & ((F.col("_at") - F.col("_from._at") + F.col("_from._blocks").cast("int")) % 2 == 1))
    d = d.withColumn("is_start", F.col("_base") | F.col("forced")).withColumn("record", F.sum(F.col("is_start").cast("int")).over(w))
    whole = Window.partitionBy(page)
    up = Window.partitionBy(page).orderBy(F.desc(order))
    firm = F.col("_body") | F.col("_anchored") | F.col("is_start")
    d = d.withColumn("trimmed", (F.col("record") == F.max("record").over(whole)) & (F.col("record") > 0) & (F.coalesce(F.sum(firm.cast("int")).over(up), F.lit(0)) == 0))
    return d.drop("_name", "_body", "_suffix", "_opens", "_anchored", "_by_suffix", "_base", "_blocks", "_may", "_at", "_from")


def record_texts(segmented: DataFrame, page: str, order: str, text: str) -> DataFrame:
    """page, record, name ('' if forced), text, body, n_lines, forced of the records that segment_records found."""
    part = F.array_sort(F.collect_list(F.struct(order, F.trim(F.col(text)).alias("t"), "is_start", "forced")))
    rows = segmented.where("record > 0 and not trimmed").groupBy(page, "record").agg(part.alias("p"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x["t"]), "")
    first = F.get("p", F.lit(0))
    return rows.select(page, "record", F.when(first["forced"], "").otherwise(first["t"]).alias("name"), joined(F.col("p")).alias("text"),
                       joined(F.slice("p", F.lit(2), F.size("p"))).alias("body"), F.size("p").alias("n_lines"), first["forced"].alias("forced"))


@dataclass(frozen=True)
class Attribute:
    """An attribute of the template and the pattern of its anchor; whole: the match is the value, else the value goes on from it."""

    name: str
    pattern: str
    whole: bool = False


def found_at(text: Column, pattern: str, start: Column) -> Column:
    """0-based place of the first match at or after start; null without one."""
    at = F.regexp_instr(F.substr(text, start + 1), F.lit(pattern))
    return F.when(at > 0, start + at - 1)


def anchor_bounds(text: Column, patterns: list[str]) -> Column:
    """Sorted distinct 0-based starts of all matches."""
    def starts(pattern: str) -> Column:
        cut = F.split(F.regexp_replace(text, f"({pattern})", "\x00$1\x01"), "\x00", -1)
        sizes = F.transform(F.slice(cut, F.lit(1), F.size(cut) - 1), lambda p: F.length(F.replace(p, F.lit("\x01"), F.lit(""))))
        step = lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["found"], F.array(s["at"] + n)).alias("found"))
        return F.aggregate(sizes, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found")), step, lambda s: s["found"])

    return F.array_sort(F.array_distinct(F.flatten(F.array(*map(starts, patterns)))))


def bound_after(bounds: Column, place: Column, otherwise: Column) -> Column:
    """The first bound beyond a place."""
    return F.coalesce(F.get(F.filter(bounds, lambda b: b > place), F.lit(0)), otherwise)


def stop_position(text: Column, start: Column, stops: list[str]) -> Column:
    """0-based place of the first stop word at or after start; null without one."""
    at = F.array_min(F.array_compact(F.array(*(F.nullif(F.position(F.lit(w), F.substr(text, start + 1)), F.lit(0)) for w in stops))))
    return start + at - 1


def strip_head_residue(text: Column, mark: str, date: str, most: int = 16) -> Column:
    """Without the tail of the record before: up to `most` characters and a mark that a date follows at once."""
    return F.regexp_replace(text, f"^(?s:.{{0,{most}}}?)(?:{mark})(?={date})", "")


def _within(spans: Column, place: Column) -> Column:
    return F.exists(spans, lambda s: (s["lo"] <= place) & (place < s["hi"]))


def extract_attributes(text: Column, template: list[Attribute], stops: list[str] = (), most: int = MOST_CHARS) -> Column:
    """map of attribute to value, for those found."""
    return extract_spans(text, template, stops, most)["values"]


def extract_spans(text: Column, template: list[Attribute], stops: list[str] = (), most: int = MOST_CHARS, lead: Column | None = None) -> Column:
    """struct(values: map of attribute to value for those found, taken: their stretches (lo, hi), after that of the lead).

    The first `lead` characters are taken beforehand (a record's name). Attributes are taken in the order of the template, each after the last; one that is not found there is looked
    for in the whole text, outside stretches already taken. A value that goes on from its anchor ends at the
    next anchor, at a stop word or after `most` characters.
    """
    def step(s: Column, bounds: Column, a: Attribute) -> Column:
        """The state after an attribute; what is used more than once is named by `let`."""
        def taken(at: Column, end: Column) -> Column:
            value = F.trim(F.substr(text, at + 1, end - at))
            got = at.isNotNull() & (value != "")
            return F.struct(
                F.when(got, F.greatest(s["cursor"], end)).otherwise(s["cursor"]).cast("int").alias("cursor"),
                F.when(got, F.concat(s["taken"], F.array(F.struct(at.cast("int").alias("lo"), end.cast("int").alias("hi"))))).otherwise(s["taken"]).alias("taken"),
                F.when(got, F.concat(s["values"], F.array(F.struct(F.lit(a.name).alias("key"), value.alias("value"))))).otherwise(s["values"]).alias("values"),
            )

        place = let(found_at(text, a.pattern, F.lit(0)), lambda any_: F.coalesce(found_at(text, a.pattern, s["cursor"]), F.when(~_within(s["taken"], any_), any_)))
        return let(place, lambda at: let(_value_end(text, a, at, bounds, stops, most), lambda end: taken(at, end)))

    begin = (F.lit(0) if lead is None else lead).cast("int")
    held = F.filter(F.array(F.struct(F.lit(0).alias("lo"), begin.alias("hi"))), lambda s: s["hi"] > 0)
    start = F.struct(begin.alias("cursor"), held.alias("taken"), F.array().cast("array<struct<key:string,value:string>>").alias("values"))

    def fold(bounds: Column) -> Column:
        state = start
        for a in template:
            state = let(state, _step_of(step, bounds, a))
        return let(state, lambda s: F.struct(F.map_from_entries(s["values"]).alias("values"), s["taken"].alias("taken")))

    return let(anchor_bounds(text, [a.pattern for a in template]), fold)


def _step_of(step, bounds: Column, a: Attribute):
    return lambda s: step(s, bounds, a)


def let(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _value_end(text: Column, a: Attribute, at: Column, bounds: Column, stops: list[str], most: int) -> Column:
    """Where the value that begins at `at` ends."""
    end = at + F.length(F.regexp_extract(F.substr(text, at + 1), f"({a.pattern})", 1))
    if a.whole:
        return end

    def limited(e: Column) -> Column:
        limit = F.least(bound_after(bounds, e, F.length(text)), at + most)
        return F.least(limit, F.coalesce(stop_position(text, e, list(stops)), limit)) if stops else limit

    return let(end, limited)


def extract_one(text: Column, attribute: Attribute, template: list[Attribute], stops: list[str] = (), most: int = MOST_CHARS) -> Column:
    """The value of one attribute in a short text; null if its anchor is not there, so nothing vague is filled in."""
    bounds = anchor_bounds(text, [a.pattern for a in template])
    value = lambda at: F.nullif(F.trim(F.substr(text, at + 1, _value_end(text, attribute, at, bounds, stops, most) - at)), F.lit(""))
    return let(found_at(text, attribute.pattern, F.lit(0)), value)


def fill_share(values: Column, required: list[str]) -> Column:
    """Share of the required attributes that have a value."""
    return sum((F.coalesce(F.element_at(values, F.lit(k)) != "", F.lit(False)).cast("int") for k in required), F.lit(0)) / len(required)


def split_confidence(share: Column, high: float = 0.55, low: float = 0.3) -> Column:
    return F.when(share >= high, "high").when(share >= low, "medium").otherwise("low")


def gap_count(values: Column, attributes: list[str]) -> Column:
    """Attributes without a value."""
    return sum((F.coalesce(F.trim(F.element_at(values, F.lit(k))), F.lit("")) == "").cast("int") for k in attributes)


def _merge(grams: list[str], most: int) -> list[str]:
    """Strings joined in pairs at their longest overlap until nothing new comes; those inside others go."""
    known = {g for g in grams if len(g) <= most}
    new = sorted(known)
    while new:
        made = set()
        for a, b in ((x, y) for n in new for o in sorted(known) for x, y in ((n, o), (o, n)) if x != y):
            size = next((k for k in range(min(len(a), len(b)), 0, -1) if a.endswith(b[:k])), 0)
            if size and len(a) + len(b) - size <= most:
                made.add(a + b[size:])
        new = sorted(made - known)
        known |= made
    return sorted(t for t in known if not any(t != o and t in o for o in known))


def maximal_strings(grams: DataFrame, key: list[str], gram: str, most: int = 20) -> DataFrame:
    """key, maximal strings of each line's frequent n-grams(key, gram). The grams are those of one line, so what they are joined to is bounded by `most`."""

    @F.pandas_udf("array<string>")
    def merged(lists: pd.Series) -> pd.Series:
        return pd.Series([_merge(list(g), most) for g in lists])

    return grams.groupBy(*key).agg(F.collect_set(gram).alias("_g")).select(*key, F.explode(merged("_g")).alias("text"))
