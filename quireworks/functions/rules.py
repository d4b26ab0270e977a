"""Field rules as columns: each gives struct(status, value) with status PASS, FIXED or SUSPECT; records and ledgers by patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quireworks.functions.amounts import amount, longest_amount

# Granularity characters of addresses, eras of dates, joint capital, degrees, cycle characters.
GRANULAR = "省府县縣州厅廳"
DOOR_TAIL = "[街巷道路][0-9〇零一二三四五六七八九十百]+号?.*$"
DATE_ERAS = "光绪|光緒|宣统|宣統|咸丰|咸豐|同治|乾隆|嘉庆|嘉慶|道光|康熙|雍正"
JOINT = "官商合[办辦]|官股|商股"
DIRECTION = "[存該收欠支撥撥付領借還繳缴兑兌]"
CURRENCY = "規元|規銀|库平|庫平|庫銀|库银|紋銀|纹银|洋銀|洋银|銀元|银元|銀两|银两|洋|銀|银|元"


def verdict(status: str | Column, value: Column) -> Column:
    return F.struct((F.lit(status) if isinstance(status, str) else status).alias("status"), value.alias("value"))


def fixed_if_changed(before: Column, after: Column) -> Column:
    return verdict(F.when(before == after, "PASS").otherwise("FIXED"), after)


def simplify_address(text: Column, concessions: tuple[str, ...] = ("租界",)) -> Column:
    """Concessions stay whole; else up to the last granularity character; else without street and door."""
    kept = text.rlike("|".join(concessions)) | (F.coalesce(text, F.lit("")) == "")
    cut = F.regexp_extract(text, f"^(?s:.*)[{GRANULAR}]", 0)
    bare = F.trim(F.regexp_replace(text, DOOR_TAIL, ""))
    return F.when(kept, verdict("PASS", text)).when(cut != "", fixed_if_changed(text, cut)).when(bare != "", fixed_if_changed(text, bare)).otherwise(verdict("PASS", text))


def check_date(text: Column) -> Column:
    """Era years or 18xx to 20xx; empty values pass."""
    fits = (F.trim(text) == "") | text.rlike(f"({DATE_ERAS})([0-9〇零一二三四五六七八九十]+|元)年?") | text.rlike("(1[89][0-9]{2}|20[0-9]{2})")
    return verdict(F.when(fits | text.isNull(), "PASS").otherwise("SUSPECT"), text)


def check_enum(text: Column, canonical: list[str], synonyms: dict[str, str]) -> Column:
    table = F.create_map(*(F.lit(x) for kv in synonyms.items() for x in kv)) if synonyms else F.create_map().cast("map<string,string>")
    return F.when(text.isin(*canonical) | (text == ""), verdict("PASS", text)).when(F.element_at(table, text).isNotNull(), verdict("FIXED", F.element_at(table, text))).otherwise(verdict("SUSPECT", text))


def check_capital(text: Column) -> Column:
    """A value of joint capital needs an official and a merchant amount; any other needs one amount."""
    part = lambda word: amount(longest_amount(F.regexp_extract(text, f"{word}([^官商]*)", 1)), True)
    joint = F.when(part("官股").isNull() | part("商股").isNull(), "SUSPECT").otherwise("PASS")
    return F.when(F.coalesce(text, F.lit("")) == "", verdict("PASS", text)).otherwise(
        verdict(F.when(text.rlike(JOINT), joint).when(amount(longest_amount(text), True).isNull(), "SUSPECT").otherwise("PASS"), text)
    )


def normalise_chars(text: Column, table: tuple[str, str]) -> Column:
    """One character for one by a pair of strings."""
    return fixed_if_changed(text, F.translate(text, *table))


def check_title(text: Column, vocabulary: list[str]) -> Column:
    """PASS if a vocabulary word is in the text, SUSPECT if a stretch of 2 to 6 characters is one edit from a word, else PASS."""
    words = F.array(*map(F.lit, vocabulary))
    has = F.exists(words, lambda w: F.contains(text, w))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.lit(6)), lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, n))).otherwise(F.array().cast("array<string>"))))
    near = F.exists(spans, lambda s: F.exists(words, lambda w: F.levenshtein(s, w, 1) >= 0))
    return verdict(F.when(~has & near, "SUSPECT").otherwise("PASS"), text)


def chain(value: Column, rules) -> Column:
    """Rules in order; what one fixed goes on to the next, and the gravest status stays."""
    out = verdict("PASS", value)
    for rule in rules:
        got = rule(out["value"])
        worst = F.when((out["status"] == "SUSPECT") | (got["status"] == "SUSPECT"), "SUSPECT").when((out["status"] == "FIXED") | (got["status"] == "FIXED"), "FIXED").otherwise("PASS")
        out = F.struct(worst.alias("status"), got["value"].alias("value"))
    return out


def ledger_fields(lines: Column) -> Column:
    """struct(name, direction, currency, raw, value) of an entry's lines: lines without an amount make the name."""
    text = F.array_join(lines, "")
    has = lambda t: longest_amount(t) != ""
    raw = F.coalesce(F.get(F.filter(F.transform(lines, longest_amount), lambda r: r != ""), F.lit(0)), F.lit(""))
    return F.struct(
        F.trim(F.array_join(F.filter(lines, lambda t: ~has(t)), "")).alias("name"), F.regexp_extract(text, DIRECTION, 0).alias("direction"),
        F.regexp_extract(text, CURRENCY, 0).alias("currency"), raw.alias("raw"), amount(raw).alias("value"),
    )


# Eras of rosters, cycle characters and degrees.
ROSTER_ERAS = (
    "洪武|建文|永乐|洪熙|宣德|正統|正统|景泰|天順|天顺|成化|弘治|正德|嘉靖|隆慶|隆庆|萬曆|万历|泰昌|天啟|天启|崇禎|崇祯|順治|顺治|康熙|雍正|乾隆|嘉慶|嘉庆|道光|咸豐|咸丰|"
    "同治|光緒|光绪|宣統|宣统|民國|民国|同光|宣光"
)
STEMS, BRANCHES = "甲乙丙丁戊己庚辛壬癸", "子丑寅卯辰巳午未申酉戌亥"
DEGREES = "進士|进士|舉人|举人|貢生|贡生|歲貢|岁贡|拔貢|拔贡|優貢|优贡|恩貢|恩贡|副貢|副贡|孝廉|狀元|状元|榜眼|探花|翰林|內閣|内阁|中書|中书"


def roster_fields(text: Column) -> Column:
    """struct(name, year, degree, rest) of a roster entry; what is not found is ''. The name is what stands before the first sign or era, up to six characters; the rest keeps the other characters in order."""
    era = F.regexp_extract(text, f"(?:{ROSTER_ERAS})[{STEMS}]{{0,2}}[{BRANCHES}]{{0,2}}[初元零一二三四五六七八九十]{{0,4}}[年科]?", 0)
    cycle = F.regexp_extract(text, f"[{STEMS}][{BRANCHES}]", 0)
    year = F.when((cycle != "") & ~F.contains(era, cycle), F.concat(era, cycle)).otherwise(era)
    degree = F.regexp_extract(text, DEGREES, 0)
    head = F.trim(F.regexp_extract(text, f"^((?s:.*?))(?:{ROSTER_ERAS}|[，,、。；;：:（(【\\[]|$)", 1))
    name = F.when(F.length(head).between(1, 6), head).otherwise("")

    def without(t: Column, part: Column) -> Column:
        at = F.position(part, t)
        return F.when((part != "") & (at > 0), F.concat(F.substr(t, F.lit(1), at - 1), F.substr(t, at + F.length(part)))).otherwise(t)

    rest = F.regexp_replace(without(without(without(text, name), year), degree), "^[，,、。 ．.]+|[，,、。 ．.]+$", "")
    return F.struct(name.alias("name"), year.alias("year"), degree.alias("degree"), rest.alias("rest"))


def same_as_above(text: Column) -> Column:
    return text.rlike("上同|同上")


def anchor_counts(text: Column, anchors: dict[str, list[str]]) -> Column:
    """struct(hits, types): how often the anchor patterns of each attribute occur in the text without white space, and how many attributes have one."""
    bare = F.regexp_replace(text, r"\s", "")
    per = [sum((F.size(F.regexp_extract_all(bare, F.lit(f"({p})"), F.lit(1))) for p in ps), F.lit(0)) for ps in anchors.values()]
    return F.struct(sum(per, F.lit(0)).alias("hits"), sum(((n > 0).cast("int") for n in per), F.lit(0)).alias("types"))


def triage(text: Column, anchors: dict[str, list[str]], least_hits: int = 3, least_chars: int = 20) -> Column:
    """ok from three anchor hits, suspect below, unmeasurable for under 20 characters or without anchors."""
    n = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", ""))
    return F.when((n < least_chars) | F.lit(not anchors), "unmeasurable").when(anchor_counts(F.coalesce(text, F.lit("")), anchors)["hits"] >= least_hits, "ok").otherwise("suspect")
