"""Chinese amounts as numbers, in liang, by their grammar.

An amount is a sum of parts of a liang (a digit and its unit), and of groups that 萬 (ten thousands) or 兩 (ones)
closes. A group is a sum of places (a digit and its place; no digit is one) and a last digit. Patterns cut the
text into these pieces, and each piece is looked up.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits, place units and decimal units.
DIGITS = {"零": 0, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
PLACES = {"十": 10, "拾": 10, "百": 100, "千": 1000, "仟": 1000}
DECIMALS = {"錢": 0.1, "钱": 0.1, "分": 0.01, "厘": 0.001, "毛": 0.001, "毫": 0.0001}
AMOUNT_RUN = "([一二三四五六七八九十百千萬万零兩两拾仟][一二三四五六七八九十百千萬万零兩两拾仟錢钱分厘毫]*)"
#: Characters that make a run of numerals an amount.
SILVER = "[兩两錢钱]"


_DIGIT, _PLACE, _PART, _CLOSE = ("[" + "".join(x) + "]" for x in (DIGITS, PLACES, DECIMALS, "萬万兩两"))
_PIECES = "".join([*DIGITS, *PLACES, *DECIMALS, "萬万兩两"])


def _lookup(table: dict[str, float], c: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for k, v in table.items() for x in (k, float(v)))), c)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _terms(text: Column, unit: str, table: dict[str, float], no_digit: float) -> Column:
    """The sum over all digits with a unit behind them; of several digits the last counts."""
    found = F.regexp_extract_all(text, F.lit(f"({_DIGIT}?{unit})"), F.lit(1))
    return _sum(F.transform(found, lambda t: F.when(F.length(t) > 1, _lookup(DIGITS, F.left(t, F.lit(1)))).otherwise(no_digit) * _lookup(table, F.right(t, F.lit(1)))))


def _group(text: Column) -> Column:
    last = F.regexp_extract(text, f"({_DIGIT}){_CLOSE}?$", 1)
    return _terms(text, _PLACE, PLACES, 1.0) + F.coalesce(_lookup(DIGITS, last), F.lit(0.0))


def amount(text: Column, keep_rest: bool = False) -> Column:
    """The number, or null if nothing above 0 was read. Characters that no amount has are skipped. keep_rest adds the group that nothing closes (兩千 is then 2000, else null)."""
    two = F.regexp_replace(text, f"[兩两](?={_PLACE})", "二")  # before a place it is the digit two
    pieces = F.regexp_replace(two, f"[^{_PIECES}]", "")
    parts = _terms(pieces, _PART, DECIMALS, 0.0)
    groups = F.regexp_replace(pieces, f"{_DIGIT}*{_PART}", "")
    closed = F.regexp_extract_all(groups, F.lit(f"([^萬万兩两]*{_CLOSE})"), F.lit(1))
    whole = _sum(F.transform(closed, lambda g: _group(g) * F.when(F.right(g, F.lit(1)).isin("萬", "万"), 10_000.0).otherwise(1.0))) + parts
    if keep_rest:
        whole = whole + _group(F.regexp_extract(groups, "([^萬万兩两]*)$", 1))
    return F.when(whole > 0, whole)


def amount_runs(text: Column) -> Column:
    """All runs of numerals with a silver unit, in order."""
    return F.filter(F.regexp_extract_all(text, F.lit(AMOUNT_RUN), F.lit(1)), lambda r: r.rlike(SILVER))


def longest_amount(text: Column) -> Column:
    """The longest run, the first of equals; '' if there is none."""
    return F.aggregate(amount_runs(text), F.lit(""), lambda best, r: F.when(F.length(r) > F.length(best), r).otherwise(best))


def all_amounts(text: Column, keep_rest: bool = True) -> Column:
    return F.transform(amount_runs(text), lambda r: F.struct(r.alias("raw"), amount(r, keep_rest).alias("value")))
