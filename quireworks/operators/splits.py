"""Pages split into records with values, persons, confidence, and every character accounted for.

A page's characters (of its lines without blanks at their ends) are those of values, those of record texts that no
value took, page constants that were cut out of record texts, and orphans: lines before the first record, and lines
trimmed off the last. Nothing is dropped in silence: `pages` adds them up, and both sides are equal.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireworks.functions import text as T
from quireworks.operators.records import MOST_CHARS, Attribute, extract_spans, found_at, record_texts, split_confidence

# Numerals and date units that names don't consist of; what stands right after the names of founders; dates and marks that are cut out of a run of names; common titles.
NUMERALS = "零〇一二三四五六七八九十百千万亿萬億两兩元圓圆角分第册冊年月日"
FOUNDED = "(?:为创办人|创办人|创办|发起)"
MARKS = ["(?:注册|补注)", "[〇零一二三四五六七八九十初廿]{1,3}月(?:[初廿〇零一二三四五六七八九十]{0,3}日)?"]
#: Characters of an orphaned head that may be the tail of the page before, at most.
TAIL_CHARS = 40


@dataclass(frozen=True)
class PersonRule:
    """How persons stand before an anchor: each after a title, or in a bare run of names of one length.

    titles and dates are patterns of Python; slots name the attributes of each person, name and title.
    """

    titles: str
    slots: tuple[tuple[str, str], ...]
    tail: str = FOUNDED
    name_length: int = 3
    dates: tuple[str, ...] = field(default=tuple(MARKS))
    least_name: int = 2
    date_share: float = 0.4


_CJK = re.compile("[㐀-鿿]")


def persons_in(region: str, raw: str, rule: PersonRule) -> list[tuple[str, str]]:
    """(title, name) of the persons in a stretch that ends right before the anchor; raw has the same length, and values are cut from it.

    With titles, the characters after each are the name, as many as names have, to the next title at most; what is
    longer than a name after the last one ends in a person without a title. Without titles the stretch is a bare run of
    names: dates and marks are cut out first, and it is given up if numerals are too large a share of what is left, or if
    it is longer than all slots.
    """
    size = rule.name_length
    hits = [m.span() for m in re.finditer(rule.titles, region)] if rule.titles else []
    found = []
    if hits:
        for (start, end), following in zip(hits, [h[0] for h in hits[1:]] + [len(region)]):
            name = raw[end : min(following, end + size)]
            if len(name) >= rule.least_name:
                found.append((raw[start:end], name))
        rest = raw[hits[-1][1] + size :]
        if len(rest) > size and _CJK.search(rest[-size:]):
            found.append(("", rest[-size:]))
        return found
    cut = {i for p in rule.dates for m in re.finditer(p, region) for i in range(*m.span())}
    run = "".join(c for i, c in enumerate(raw) if i not in cut and _CJK.match(c))
    if run and sum(c in NUMERALS for c in run) >= rule.date_share * len(run) or len(run) > size * len(rule.slots):
        return []
    names = [run[i : i + size] for i in range(0, len(run) - size + 1, size)]
    return [("", n) for n in names if not all(c in NUMERALS for c in n)]


def person_values(text: Column, taken: Column, rule: PersonRule, fold: Callable[[Column], Column] = T.fold_stream) -> Column:
    """map of slot attributes to values, of the persons between the last stretch taken before the anchor and the anchor. Places are found in the folded text, values keep their own characters."""

    @F.pandas_udf("array<struct<title: string, name: string>>")
    def persons(region: pd.Series, raw: pd.Series) -> pd.Series:
        return pd.Series([[{"title": t, "name": n} for t, n in persons_in(a, b, rule)] if isinstance(a, str) and a.strip() else [] for a, b in zip(region, raw)])

    head = found_at(fold(text), rule.tail, F.lit(0))
    lo = F.coalesce(F.array_max(F.filter(F.transform(taken, lambda s: s["hi"]), lambda e: e <= head)), F.lit(0))
    part = lambda c: F.substr(c, lo + 1, head - lo)
    found = persons(part(fold(text)), part(text))
    slots = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(t).alias("t")) for n, t in rule.slots))
    filled = F.zip_with(F.slice(found, F.lit(1), F.lit(len(rule.slots))), slots, lambda p, s: F.array(F.struct(s["n"].alias("key"), p["name"].alias("value")), F.struct(s["t"].alias("key"), p["title"].alias("value"))))
    kept = F.filter(F.flatten(F.filter(filled, lambda x: F.get(x, F.lit(0))["value"].isNotNull())), lambda e: F.coalesce(e["value"], F.lit("")) != "")
    return F.coalesce(F.map_from_entries(kept), F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>")))


@dataclass(frozen=True)
class Template:
    """What a record consists of: the attribute of its name, others by anchors, persons; which must be there; constants of a page; words that end a value."""

    name: str
    attributes: tuple[Attribute, ...]
    required: tuple[str, ...] = ()
    persons: PersonRule | None = None
    constants: tuple[str, ...] = ()
    stops: tuple[str, ...] = ()
    most: int = MOST_CHARS

    def all(self) -> list[str]:
        return [self.name, *(a.name for a in self.attributes), *(s for pair in (self.persons.slots if self.persons else ()) for s in pair)]


def split_records(segmented: DataFrame, page: str, order: str, text: str, template: Template) -> DataFrame:
    """page, record, name, values, text, taken, cut, n_lines, forced, fallback of every record of segmented lines.

    A page without records is one record of all its lines, without a name (fallback). Page constants are cut out of a
    record's text before values are taken, so a value goes on behind them; required attributes that are not found are ''.
    """
    shown = segmented.where(F.trim(F.col(text)) != "")
    made = record_texts(shown, page, order, text).select(page, "record", "name", "text", "n_lines", "forced", F.lit(False).alias("fallback"))
    lines = F.array_sort(F.collect_list(F.struct(order, F.trim(F.col(text)).alias("t"))))
    bare = shown.groupBy(page).agg(F.max("record").alias("record"), lines.alias("l")).where("record = 0")
    whole = bare.select(page, F.lit(1).cast(made.schema["record"].dataType).alias("record"), F.lit("").alias("name"), F.array_join(F.transform("l", lambda x: x["t"]), "").alias("text"), F.size("l").alias("n_lines"), F.lit(False).alias("forced"), F.lit(True).alias("fallback"))
    r = made.unionByName(whole)
    if template.constants:
        r = r.withColumn("_s", T.strip_constants(F.col("text"), list(template.constants))).withColumns({"text": F.col("_s.text"), "cut": F.col("_s.removed")}).drop("_s")
    else:
        r = r.withColumn("cut", F.array().cast("array<string>"))
    lead = F.when(F.startswith("text", F.col("name")), F.length("name")).otherwise(0)
    r = r.withColumn("_x", extract_spans(F.col("text"), list(template.attributes), list(template.stops), template.most, lead))
    named = F.map_from_entries(F.filter(F.array(F.struct(F.lit(template.name).alias("key"), F.col("name").alias("value"))), lambda e: e["value"] != ""))
    r = r.withColumns({"values": F.map_concat(named, "_x.values"), "taken": T.union_spans(F.col("_x.taken"))})
    if template.persons:
        people = person_values(F.col("text"), F.col("_x.taken"), template.persons)
        r = r.withColumn("_p", people).withColumn("_p", F.map_filter("_p", lambda k, _: ~F.map_contains_key("values", k))).withColumn("values", F.map_concat("values", "_p")).drop("_p")
    if template.required:
        none = F.create_map(*(F.lit(x) for k in template.required for x in (k, "")))
        r = r.withColumn("values", F.map_concat("values", F.map_filter(none, lambda k, _: ~F.map_contains_key("values", k))))
    return r.drop("_x")


def split_pages(segmented: DataFrame, records: DataFrame, page: str, order: str, text: str, template: Template, continues: str = "(?!)") -> DataFrame:
    """A row for each page with a line that is not blank: page, n_records, n_lines, fill_rate, confidence, forced, fallback, chars, in_values, unclaimed, cut, orphans, orphan_head, orphan_tail, from_page_before.

    chars = in_values + unclaimed + cut + orphans. fill_rate is the share of attributes, over all records, that have a
    value; a page with a forced or a fallback record is of low confidence. An orphaned head of TAIL_CHARS characters or less that
    the pattern `continues` is found in may belong to the page before; it is only marked.
    """
    shown = segmented.where(F.trim(F.col(text)) != "").withColumn("_t", F.trim(F.col(text)))
    orphan = (F.col("record") == 0) | F.col("trimmed")
    part = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct(order, "_t")))), lambda x: x["_t"]), "")
    p = shown.groupBy(page).agg(F.count("*").alias("n_lines"), F.sum(F.length("_t")).alias("chars"), F.max("record").alias("_last"), part(F.col("record") == 0).alias("_head"), part(orphan & (F.col("record") > 0)).alias("_tail"))
    size = lambda c: F.aggregate(c, F.lit(0), lambda n, s: n + s["hi"] - s["lo"])
    filled = sum(((F.coalesce(F.trim(F.element_at("values", F.lit(k))), F.lit("")) != "").cast("int") for k in template.all()), F.lit(0))
    r = records.groupBy(page).agg(
        F.count("*").alias("n_records"), F.sum(filled).alias("_filled"), F.sum(size(F.col("taken"))).alias("in_values"), F.sum(F.length("text") - size(F.col("taken"))).alias("unclaimed"),
        F.sum(F.aggregate("cut", F.lit(0), lambda n, c: n + F.length(c))).alias("cut"), F.count_if(F.col("forced")).alias("forced"), F.bool_or("fallback").alias("fallback"),
    )
    t = p.join(r, page, "left").withColumn("fill_rate", F.round(F.col("_filled") / (F.col("n_records") * len(template.all())), 4))
    side = lambda c: F.when(F.col("_last") == 0, "").otherwise(F.col(c))
    t = t.withColumns({"orphan_head": side("_head"), "orphan_tail": side("_tail")}).withColumn("orphans", (F.length("orphan_head") + F.length("orphan_tail")).cast("bigint"))
    doubt = F.col("fallback") | (F.col("forced") > 0)
    tail = (F.col("orphan_head") != "") & (F.length("orphan_head") <= TAIL_CHARS) & T.fold_stream(F.col("orphan_head")).rlike(continues)
    return t.select(
        page, "n_records", "n_lines", "fill_rate", F.when(doubt, "low").otherwise(split_confidence(F.col("fill_rate"))).alias("confidence"), "forced", "fallback", "chars", "in_values", "unclaimed", "cut", "orphans", "orphan_head", "orphan_tail",
        tail.alias("from_page_before"),
    )
