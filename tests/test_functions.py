"""Micro fixtures with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from quireworks.functions import amounts, geometry, rules, text
from quireworks.operators import corpus, review


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'array<double>' if isinstance(v, list) and v and isinstance(v[0], float) else 'array<string>' if isinstance(v, list) else 'string'}" for n, v in values.items()))
    assert names
    return df.select(column.alias("r")).first().r


@pytest.mark.parametrize("raw, plain, kept", [("五十九萬七千三百十二兩九錢一分三厘", 597312.913, 597312.913), ("兩千", None, 2000.0), ("三兩", 3.0, 3.0), ("三百零五兩", 305.0, 305.0), ("十萬", 100000.0, 100000.0), ("五十錢三兩", 53.0, 53.0), ("存洋二 千兩x四錢", 2000.4, 2000.4), ("二萬兩千五", 20000.0, 22005.0), ("百", None, 100.0), ("", None, None), ("錢分", None, None)])
def test_amounts(spark, raw, plain, kept):
    for keep, want in ((False, plain), (True, kept)):
        got = one(spark, amounts.amount(F.col("t"), keep), t=raw)
        assert got is None if want is None else got == pytest.approx(want)


def test_longest_amount_is_first_of_equals(spark):
    assert one(spark, amounts.longest_amount(F.col("t")), t="存三兩支五兩") == "三兩"
    assert one(spark, amounts.longest_amount(F.col("t")), t="三千") == ""


@pytest.mark.parametrize("raw, status, value", [("江蘇省江寧府句容縣天王寺", "FIXED", "江蘇省江寧府句容縣"), ("上海法租界霞飛路", "PASS", "上海法租界霞飛路"), ("", "PASS", "")])
def test_address(spark, raw, status, value):
    assert tuple(one(spark, rules.simplify_address(F.col("t")), t=raw)) == (status, value)


def test_one_edit_and_substitution(spark):
    for b, want in (("abd", True), ("abcd", True), ("ab", True), ("axx", False)):
        assert one(spark, text.within_one_edit(F.lit("abc"), F.col("t")), t=b) is want
    assert tuple(one(spark, text.single_substitution(F.lit("甲乙丙"), F.col("t")), t="甲丁丙")) == ("乙", "丁")
    assert one(spark, text.single_substitution(F.lit("甲乙"), F.col("t")), t="甲乙丙") is None


def test_apportion_and_iou(spark):
    assert one(spark, geometry.apportion(F.lit(10), F.col("w")), w=[1.0, 1.0, 1.0]) == [4, 3, 3]
    a, b = geometry.rect(F.col("a")), geometry.rect(F.col("b"))
    assert one(spark, geometry.iou(a, b), a=[0.0, 0.0, 10.0, 10.0], b=[5.0, 0.0, 15.0, 10.0]) == pytest.approx(1 / 3)
    assert one(spark, geometry.iou(a, b), a=[0.0, 0.0, 0.0, 10.0], b=[5.0, 0.0, 15.0, 10.0]) == 0


def test_line_shapes(spark):
    for line, want in (("光緒三十年正月", "dateish"), ("洋銀十萬圓", "money"), ("公司", "short"), ("一二三四五六七八九十甲乙", "body"), ("甲乙丙丁戊己庚", "other")):
        assert one(spark, text.line_shape(F.col("t")), t=line) == want


def test_spans_and_gaps(spark):
    found = text.ordered_spans(F.col("s"), F.col("p"))
    got = one(spark, found, s="abcdef", p=["ab", "de"])
    assert [tuple(x) for x in got["spans"]] == [(0, 2), (3, 5)] and got["back"] == 0 and got["missing"] == 0
    assert one(spark, text.gap_texts(F.col("s"), text.union_spans(found["spans"])), s="abcdef", p=["ab", "de"]) == ["c", "f"]
    back = one(spark, found, s="abcdef", p=["de", "ab", "zz"])
    assert back["back"] == 1 and back["missing"] == 1


def test_fold_keeps_length_and_grams_guard(spark):
    assert one(spark, text.fold_stream(F.col("t")), t="公司注册 a") == "公司註冊 a"
    assert one(spark, text.grams(F.col("t"), 3), t="ab") == []
    assert sorted(one(spark, text.grams(F.col("t"), 2), t="abcd")) == ["ab", "bc", "cd"]


def test_safe_correction(spark):
    keep = lambda a, b: one(spark, text.safe_correction(F.col("a"), F.col("b")), a=a, b=b)
    assert keep("甲乙丙丁", "甲乙丙戊") == "甲乙丙戊"
    assert keep("甲乙丙丁", "") == "" and keep("甲乙丙丁", "甲") == "" and keep("甲乙丙丁", "子丑寅卯") == ""


def test_ledger_fields(spark):
    got = one(spark, rules.ledger_fields(F.col("ls")), ls=["福記堂", "存規元三兩五錢"])
    assert (got["name"], got["direction"], got["currency"], got["raw"]) == ("福記堂", "存", "規元", "三兩五錢") and got["value"] == pytest.approx(3.5)


def test_gram_frequency_counts_pages(spark):
    df = spark.createDataFrame([(1, "abcabc"), (2, "abc"), (3, None)], "p int, t string")
    got = {r.gram: r.pages_hit for r in corpus.gram_frequency(df, "p", "t", least_ratio=0.5).collect()}
    assert got["abc"] == 2


def test_roster_fields(spark):
    got = one(spark, rules.roster_fields(F.col("t")), t="張三，光緒乙未科進士，句容人")
    assert (got["name"], got["year"], got["degree"]) == ("張三", "光緒乙未科", "進士")
    assert tuple(one(spark, rules.roster_fields(F.col("t")), t="")) == ("", "", "", "")


def test_triage(spark):
    anchors = {"date": ["年"], "place": ["縣|府"]}
    long = "某年某縣某府" + "文" * 20
    assert [one(spark, rules.triage(F.col("t"), anchors), t=t) for t in (long, "文" * 30, "年")] == ["ok", "suspect", "unmeasurable"]


def test_constants_are_cut_from_long_texts_in_linear_time(spark):
    import time

    text_ = "".join(f"w{i}er token " for i in range(60_000)) + "務Aer\U0001f600"
    d = spark.createDataFrame([(text_,), (None,), ("",), ("aaa erer",)], "t string")
    began = time.monotonic()
    got = [r.s for r in d.select(text.strip_constants(F.col("t"), ["token", "er", "务A", "aa"]).alias("s")).collect()]
    assert got[0].text == "".join(f"w{i}  " for i in range(60_000)) + "\U0001f600" and got[0].removed[-1] == "務Aer" and len(got[0].removed) == 120_001
    assert [tuple(x) for x in got[1:]] == [(None, None), ("", []), ("a ", ["aa", "erer"])] and time.monotonic() - began < 60
