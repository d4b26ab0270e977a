"""Text expressions: folding, normal forms, tokens, line shapes, corrections, spans.

All are built-in column expressions, so they stay in the JVM, but strip_constants. A null text gives null unless stated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Simplified characters and the traditional ones they are folded to.
FOLD_FROM = "务报册注号铁银圆万两汉济芜厂矿阳东广苏沪"
FOLD_TO = "務報冊註號鐵銀圓萬兩漢濟蕪廠礦陽東廣蘇滬"

# Punctuation that retrieval drops, and that line profiles drop.
RETRIEVAL_PUNCTUATION = "，。！？、；：·　\"'“”‘’《》（）()【】[]\\/!?;"
PROFILE_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~，。、；：？！「」『』（）《》〈〉…—·・“”‘’【】〔〕～－＋＝＜＞／＼｜"

# Era names, date units, money units and numeral characters of line shapes.
ERA_WORDS = ["光緒", "光绪", "宣統", "宣统", "康熙", "乾隆", "嘉慶", "嘉庆", "道光", "咸豐", "咸丰", "同治", "順治", "顺治", "雍正", "民國", "民国", "明治", "大正", "昭和"]
DATE_UNITS, MONEY_UNITS, NUMERALS = "年月日", "元圓圆两兩万萬千股", "0123456789零一二三四五六七八九十百千两兩"

#: White space as the source language's isspace has it, for patterns.
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

#: The same as a string of characters.
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def _class(chars: str) -> str:
    return "[" + "".join("\\" + c if not c.isalnum() and c.isascii() else c for c in chars) + "]"


def fold_stream(text: Column) -> Column:
    """One character for one, so positions in the folded text hold in the original."""
    return F.translate(text, FOLD_FROM, FOLD_TO)


def normal_retrieval(text: Column, fold: tuple[str, str] = (FOLD_TO, FOLD_FROM)) -> Column:
    """Without white space and listed punctuation, traditional folded to simplified by the given pair of strings; null gives ''. One pass: characters without a counterpart go."""
    return F.translate(F.coalesce(text, F.lit("")), fold[0] + SPACES + RETRIEVAL_PUNCTUATION, fold[1])


def normal_line(text: Column) -> Column:
    """Line profile form: folded to traditional, without white space and punctuation. One pass, as above."""
    return F.translate(F.coalesce(text, F.lit("")), FOLD_FROM + SPACES + PROFILE_PUNCTUATION, FOLD_TO)


def grams(text: Column, n: int) -> Column:
    """All stretches of n characters, in no order; none for shorter texts. Stretches are cut one after another from each of n starts, so time is linear in the text, which substrings by position would not be."""
    cut = [F.regexp_extract_all(F.substr(text, F.lit(k + 1)), F.lit(f"(?s)(.{{{n}}})"), F.lit(1)) for k in range(n)]
    return F.concat(*cut)


def retrieval_tokens(text: Column) -> Column:
    """Pairs of characters, single CJK characters, and runs of ASCII letters and digits, of the normal form."""
    t = normal_retrieval(text)
    return F.concat(grams(t, 2), F.regexp_extract_all(t, F.lit("([\\u4e00-\\u9fff])"), F.lit(1)), F.regexp_extract_all(t, F.lit(r"([a-zA-Z0-9]+(?:\.[a-zA-Z0-9]+)*)"), F.lit(1)))


def line_shape(text: Column) -> Column:
    """dateish, money, short (up to 6), body (12 and more) or other, in this order."""
    t = F.trim(text)
    n = F.length(t)
    return (
        F.when(t.rlike("|".join(ERA_WORDS)) & t.rlike(f"[{DATE_UNITS}]"), "dateish")
        .when(t.rlike(f"[{NUMERALS}]") & t.rlike(f"[{MONEY_UNITS}]"), "money")
        .when(n <= 6, "short").when(n >= 12, "body").otherwise("other")
    )


def kana_count(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, "[\\u3041-\\u3096\\u30a1-\\u30f6]", ""))


def occurrences(text: Column, part: Column) -> Column:
    """How often a non-empty part occurs, without overlaps."""
    return F.when(F.length(part) > 0, ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")).otherwise(0)


def within_one_edit(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) >= 0


def single_substitution(a: Column, b: Column) -> Column:
    """struct(wrong, right) if the texts have equal length and differ at one place, else null."""
    pairs = F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.struct(x.alias("wrong"), y.alias("right"))), lambda p: p["wrong"] != p["right"])
    return F.when((F.length(a) == F.length(b)) & (F.size(pairs) == 1), F.get(pairs, F.lit(0)))


def char_overlap(a: Column, b: Column) -> Column:
    """Size of the common bag of characters."""
    x = F.split(a, "")
    return F.aggregate(F.array_distinct(x), F.lit(0), lambda n, c: n + F.least(occurrences(a, c), occurrences(b, c)))


def safe_correction(ocr: Column, corrected: Column) -> Column:
    """The correction where it may stand for the line: two characters at least, not over 60 % shorter, and half of the line's characters kept; else ''."""
    n, m = F.length(ocr), F.length(corrected)
    fits = (n > 0) & (m >= 2) & ~((m < n) & (n - m > 0.6 * n)) & (char_overlap(ocr, corrected) / n >= 0.5)
    return F.when(F.coalesce(corrected, F.lit("")) == "", "").when(corrected == ocr, corrected).when(fits, corrected).otherwise("")


def fields_text(fields: Column) -> Column:
    """key：value；key：value of a map, without null and empty values."""
    kept = F.filter(F.map_entries(fields), lambda e: e["value"].isNotNull() & (e["value"] != ""))
    return F.array_join(F.transform(kept, lambda e: F.concat(e["key"], F.lit("："), e["value"])), "；")


def ordered_spans(stream: Column, pieces: Column) -> Column:
    """struct(spans, back, missing): pieces found left to right; one found only before the cursor counts as back and does not move it. Spans are 0-based (lo, hi), in the order of pieces."""
    start = F.struct(F.array().cast("array<struct<lo:int,hi:int>>").alias("spans"), F.lit(0).alias("at"), F.lit(0).alias("back"), F.lit(0).alias("missing"))

    def step(s: Column, p: Column) -> Column:
        ahead = F.position(p, stream, s["at"] + 1)
        anywhere = F.position(p, stream)
        span = lambda k: F.array(F.struct((k - 1).cast("int").alias("lo"), (k - 1 + F.length(p)).cast("int").alias("hi")))
        return (
            F.when(F.coalesce(F.length(p), F.lit(0)) == 0, s)
            .when(ahead > 0, F.struct(F.concat(s["spans"], span(ahead)).alias("spans"), (ahead - 1 + F.length(p)).cast("int").alias("at"), s["back"].alias("back"), s["missing"].alias("missing")))
            .when(anywhere > 0, F.struct(F.concat(s["spans"], span(anywhere)).alias("spans"), s["at"].alias("at"), (s["back"] + 1).alias("back"), s["missing"].alias("missing")))
            .otherwise(F.struct(s["spans"].alias("spans"), s["at"].alias("at"), s["back"].alias("back"), (s["missing"] + 1).alias("missing")))
        )

    return F.aggregate(pieces, start, step, lambda s: F.struct(s["spans"].alias("spans"), s["back"].alias("back"), s["missing"].alias("missing")))


def union_spans(spans: Column) -> Column:
    """Sorted spans with touching and overlapping ones joined."""
    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], s["hi"]).alias("hi"))))
        return F.when((F.size(done) > 0) & (s["lo"] <= F.get(done, F.size(done) - 1)["hi"]), joined).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<lo:int,hi:int>>"), add)


def gap_texts(stream: Column, spans: Column) -> Column:
    """The stretches of stream that joined, sorted spans leave uncovered."""
    edges = F.concat(F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi"))), spans, F.array(F.struct(F.length(stream).alias("lo"), F.length(stream).alias("hi"))))
    between = F.transform(F.sequence(F.lit(1), F.size(edges) - 1), lambda i: F.substr(stream, F.get(edges, i - 1)["hi"] + 1, F.get(edges, i)["lo"] - F.get(edges, i - 1)["hi"]))
    return F.filter(between, lambda t: t != "")


def publication_of(name: Column) -> Column:
    """A page name without its trailing _NNNN."""
    return F.regexp_replace(name, r"_\d{4}$", "")


def stem_of(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)\.png$", "")


def volume_of(name: Column) -> Column:
    return F.regexp_extract(name, r"卷(?:之)?[一二三四五六七八九十百\d]+", 0)


def safe_name(name: Column) -> Column:
    """CJK, ASCII letters and digits, _ and - stay; others become _."""
    return F.regexp_replace(name, r"[^\x{4e00}-\x{9fff}A-Za-z0-9_-]", "_")


# What a source note at the end of a quote looks like, after a word for "see" or bare.
SOURCE_NOTE = r"\s*\[[^\]]*(?:section|unit|gold)_[^\]]+\]\s*\.?\s*$"


def strip_card_note(quote: Column) -> Column:
    """A quote without the note of its source card: one that a word for "see" leads, then one bare."""
    return F.trim(F.regexp_replace(F.regexp_replace(quote, r"\s*参考" + SOURCE_NOTE, ""), SOURCE_NOTE, ""))


def looks_like_name(text: Column) -> Column:
    """Two to eight characters that do not end in punctuation."""
    t = F.trim(text)
    return F.length(t).between(2, 8) & ~t.rlike("[，,、。；;：:]$")


def normal_locate(text: Column, fold: tuple[str, str] = (FOLD_TO, FOLD_FROM)) -> Column:
    """The form in which values are looked for: folded, without white space."""
    return F.translate(F.coalesce(text, F.lit("")), fold[0] + SPACES, fold[1])


def plain_text(html: Column) -> Column:
    """Without tags and white space."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]+>", ""), r"\s+", "")


def text_loss(before: Column, after: Column) -> Column:
    """struct(raw, out, delta, same_order, same_multiset) of two texts: equal bags in another order are a new reading order, unequal bags a loss."""
    bag = lambda t: F.array_join(F.array_sort(F.split(t, "")), "")
    a, b = plain_text(before), plain_text(after)
    return F.struct(F.length(a).alias("raw"), F.length(b).alias("out"), (F.length(b) - F.length(a)).alias("delta"), (a == b).alias("same_order"), (bag(a) == bag(b)).alias("same_multiset"))


def positions(text: Column, part: Column) -> Column:
    """0-based starts of a part in the text, without overlaps, left to right."""
    pieces = F.split(text, F.concat(F.lit("\\Q"), part, F.lit("\\E")), -1)
    ends = F.aggregate(
        F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found")),
        lambda s, p: F.struct((s["at"] + F.length(p) + F.length(part)).alias("at"), F.concat(s["found"], F.array(s["at"] + F.length(p))).alias("found")), lambda s: s["found"],
    )
    return F.when(F.length(part) > 0, ends).otherwise(F.array().cast("array<int>"))


def strip_constants(text: Column, constants: list[str]) -> Column:
    """struct(text, removed): the text without every stretch that constants cover, where they overlap too; constants and text meet in their folded form, and what is cut keeps its own characters.

    A null text gives a struct of nulls. Texts are walked in Python, once for each constant: cutting by position, or adding to an array,
    once for each hit takes time by the square of a text.
    """
    table = str.maketrans(FOLD_FROM, FOLD_TO)
    words = [c.translate(table) for c in constants if c]

    def cut(text: str | None, folded: str | None) -> tuple:
        if text is None or folded is None:
            return None, None
        spans = []
        for w in words:
            at = folded.find(w)
            while at >= 0:
                spans.append((at, at + len(w)))
                at = folded.find(w, at + len(w))
        kept, removed, done = [], [], 0
        for lo, hi in joined_spans(spans):
            kept.append(text[done:lo])
            removed.append(text[lo:hi])
            done = hi
        return "".join([*kept, text[done:]]), removed

    return F.udf(cut, "struct<text: string, removed: array<string>>", useArrow=True)(text, fold_stream(text))


def joined_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, with touching and overlapping ones joined."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def line_numbers(spec: Column) -> Column:
    """1,3-5 as [1, 3, 4, 5]: distinct and ascending; null for parts that are no number or run backwards, and for nothing."""
    parts = F.filter(F.transform(F.split(F.replace(spec, F.lit("，"), F.lit(",")), ","), lambda p: F.trim(p)), lambda p: p != "")
    run = lambda p: F.transform(F.split(p, "-"), lambda x: F.trim(x).cast("int"))
    legal = F.forall(parts, lambda p: p.rlike(r"^\d+$") | (p.rlike(r"^\d+\s*-\s*\d+$") & F.coalesce(F.get(run(p), F.lit(0)) <= F.get(run(p), F.lit(1)), F.lit(False))))
    numbers = F.flatten(F.transform(parts, lambda p: F.sequence(F.get(run(p), F.lit(0)), F.element_at(run(p), -1))))
    return F.when((F.size(parts) > 0) & legal, F.array_sort(F.array_distinct(numbers)))


def list_changes(old: Column, new: Column) -> Column:
    """struct(added, removed, moved): elements in one list only, in its order, and places (from 1) of those that changed place, by the new one."""
    moved = F.filter(F.transform(new, lambda x, i: F.struct(x.alias("item"), F.array_position(old, x).alias("from"), (i + 1).cast("long").alias("to"))), lambda m: (m["from"] > 0) & (m["from"] != m["to"]))
    return F.struct(F.filter(new, lambda x: ~F.array_contains(old, x)).alias("added"), F.filter(old, lambda x: ~F.array_contains(new, x)).alias("removed"), moved.alias("moved"))


def usable_correction(wrong: Column, right: Column) -> Column:
    """Both sides given, and not the same."""
    w, r = F.trim(F.coalesce(wrong, F.lit(""))), F.trim(F.coalesce(right, F.lit("")))
    return (w != "") & (r != "") & (w != r)


def sanitize_stem(name: Column, most: int = 80) -> Column:
    """Without signs that file names must not hold, blanks run together, no blanks and dots at the ends, at most so many characters; imported if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r'[<>:"/\\|?*\x00-\x1f]', ""), r"\s+", " ")
    ends = lambda t: F.regexp_replace(t, r"[ .]+$", "")
    cut = ends(F.substring(ends(F.regexp_replace(bare, r"^[ .]+", "")), 1, most))
    return F.when(cut == "", "imported").otherwise(cut)


def deletions(text: Column) -> Column:
    """The text and every text that is one character shorter: two texts within one edit share one of these."""
    n = F.length(text)
    shorter = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substr(text, F.lit(1), i - 1), F.substr(text, i + 1)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(text), shorter))


def near_pairs(names: DataFrame, name: str) -> DataFrame:
    """a, b: pairs of distinct names within one edit, a before b. Names meet by shared deletions, so not every pair is made."""
    keyed = names.select(F.col(name).alias("a"), F.explode(deletions(F.col(name))).alias("_k"))
    met = keyed.join(keyed.select(F.col("a").alias("b"), "_k"), "_k").where("a < b").select("a", "b").distinct()
    return met.where(within_one_edit(F.col("a"), F.col("b")))
