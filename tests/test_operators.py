"""Operators whose state no SQL states: boxes in order, readers, streams."""

import json

import pytest
from pyspark.sql import functions as F

from quireworks.operators import groups, layout, learning
from quireworks.plans import bands
from quireworks.sources import pages
from quireworks.streaming import ingest


def boxes(spark, rows):
    return spark.createDataFrame(rows, "stem string, line_id long, x1 double, y1 double, x2 double, y2 double, text string")


def test_columns_run_from_right_to_left(spark):
    b = boxes(spark, [("p", 0, 0.0, 0.0, 10.0, 50.0, "c"), ("p", 1, 100.0, 0.0, 110.0, 50.0, "a"), ("p", 2, 102.0, 60.0, 112.0, 90.0, "b"), ("p", 3, None, None, None, None, "d")])
    assert {r.line_id: r.col_index for r in layout.column_clusters(b).collect()} == {0: 1, 1: 0, 2: 0, 3: -1}
    assert [r.line_id for r in layout.reading_order(b).orderBy("pos").collect()] == [1, 2, 0, 3]


def test_table_grid(spark):
    b = boxes(spark, [("p", 0, 0.0, 0.0, 10.0, 10.0, "a"), ("p", 1, 100.0, 1.0, 110.0, 11.0, "b"), ("p", 2, 0.0, 20.0, 10.0, 30.0, "c")])
    assert {(r.row, r.col): r.text for r in layout.table_grid(b).collect()} == {(0, 0): "a", (0, 1): "b", (1, 0): "c"}


def test_pages_gold_and_bad_lines(spark, tmp_path):
    (tmp_path / "pages").mkdir()
    line = {"line_id": 0, "xlsx_id": 1, "col_index": 0, "row_index": 0, "text": "甲", "box": [[0, 0], [1, 1]]}
    (tmp_path / "pages" / "a.json").write_text(json.dumps({"L2_lines": [line]}))
    (tmp_path / "pages" / "b.json").write_text(json.dumps({"other": 1}))
    (tmp_path / "pages" / "c.json").write_text("{broken")
    got = pages.page_line_rows(pages.read_pages(spark, str(tmp_path / "pages"))).collect()
    assert [(r.stem, r.text) for r in got] == [("a", "甲")]
    (tmp_path / "gold").mkdir()
    (tmp_path / "gold" / "x.jsonl").write_text('{"text": "one", "profile": "p"}\nnot json\n{"text": "two"}\n')
    rows = pages.read_gold(spark, str(tmp_path / "gold")).orderBy("row_no").collect()
    assert [(r.row_no, r.text) for r in rows] == [(0, "one"), (2, "two")]
    assert [r.text for r in pages.read_gold(spark, str(tmp_path / "gold"), "p").collect()] == ["one"]


def test_group_concat_and_carry(spark):
    df = spark.createDataFrame([("g1", 1, "北京"), ("g1", 2, "琉璃廠"), ("x", 3, "x")], "gid string, row_no int, text string")
    got = {r.gid: r.joined for r in groups.concat_groups(df, ["gid"], "row_no", "text").collect()}
    assert got == {"g1": "北京琉璃廠", "x": "x"}


def test_attr_order_with_cycle(spark):
    from pyspark.sql import functions as F

    from quireworks.operators import overrides

    pairs = spark.createDataFrame([("a", "b", 3), ("b", "c", 2), ("c", "b", 1), ("d", "e", 2), ("e", "f", 2), ("f", "d", 2)], "before string, after string, wins long")
    seeds = spark.createDataFrame([(1, a, k) for k, a in enumerate(["c", "b", "a", "d", "e", "f"])], "k int, attr string, seed int")
    got = overrides.attribute_orders(pairs.withColumn("k", F.lit(1)), seeds, "k").first()
    assert got.order == ["a", "b", "c", "d", "e", "f"] and got.cyclic == ["d", "e", "f"]


def test_band_changes(spark):
    old = spark.createDataFrame([("k", 1, 0.10), ("k", 2, 0.50)], "key string, band_id int, band_rel double")
    new = spark.createDataFrame([("k", 1, 0.102), ("k", 2, 0.90)], "key string, band_id int, band_rel double")
    assert {r.change: r.n for r in bands.band_changes(old, new, "key", 0.01).collect()} == {"present": 1, "add": 1, "stale": 1}


def test_stream_drains_once(spark, tmp_path):
    src = tmp_path / "in"
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00", "a"), (2, "2024-01-01 00:01:00", "a"), (3, "2024-01-01 00:02:00", "b")], "id int, t string, text string").withColumn("t", F.to_timestamp("t"))
    df.coalesce(1).write.parquet(str(src))
    for _ in range(2):
        stream = ingest.once_by_content(ingest.watch_folder(spark, str(src), "id int, t timestamp, text string"), "t", "1 hour", "text")
        ingest.drain(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


@pytest.mark.parametrize("rows, want", [([], []), ([(1, 0.0), (1, 0.4), (1, 2.0)], [(2, 0.2), (1, 2.0)])])
def test_islands(spark, rows, want):
    df = spark.createDataFrame(rows, "k int, v double")
    got = groups.islands(df, ["k"], "v", 0.5).orderBy("island").collect()
    assert [(r.n, pytest.approx(r["mean"])) for r in got] == want


def test_gram_frequency_of_documents_equals_brute_force(spark, tmp_path):
    from quireworks.plans import catalog  # noqa: F401
    from quireworks.plans.registry import QUERIES

    rows = [(0, "abcabcabd"), (1, "xabcd \n光緒元年"), (2, None), (3, "ab"), (4, "光緒元年 abc" * 40), (5, "zabcz"), (5, "光緒元年"), (6, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for k, t in rows:
        for n in range(3, 7):
            for at in range(len(t or "") - n + 1):
                seen.setdefault(t[at : at + n], set()).add(k)
    want = {g: len(k) for g, k in seen.items() if len(k) >= 0.2 * 7}
    assert {r.gram: r.pages_hit for r in QUERIES["ngram_df_documents"](spark, str(tmp_path)).collect()} == want


def test_maximal_strings_are_joined_at_longest_overlaps(spark):
    from quireworks.operators.records import maximal_strings

    line = "光緒三十年正月"
    grams = [line[k : k + n] for n in (3, 4) for k in range(len(line) - n + 1)]
    got = maximal_strings(spark.createDataFrame([(1, g) for g in grams] + [(2, "abc"), (2, "xyz"), (2, "cde")], "id int, g string"), ["id"], "g")
    assert sorted((r.id, r.text) for r in got.collect()) == [(1, line), (2, "abcde"), (2, "xyz")]


def test_forced_records_alternate(spark):
    from pyspark.sql import functions as F

    from quireworks.operators.records import record_texts, segment_records

    kinds = ["n", "b", "o", "o", "o", "b", "n", "s", "b", "f", "f"]  # name, body, opens (long enough for a body), suffix, foot
    rows = spark.createDataFrame([("p", k, kind) for k, kind in enumerate(kinds)], "page string, at int, kind string")
    is_ = lambda *v: F.col("kind").isin(*v)
    got = segment_records(rows, "page", "at", is_("n"), is_("b", "o"), is_("s"), is_("o"), is_("x")).orderBy("at").collect()
    assert [r.is_start for r in got] == [True, False, True, False, True, False, True, False, False, False, False]
    assert [r.forced for r in got] == [False, False, True, False, True, False, False, False, False, False, False]
    assert [r.trimmed for r in got] == [False] * 9 + [True, True]
    texts = record_texts(segment_records(rows, "page", "at", is_("n"), is_("b", "o"), is_("s"), is_("o"), is_("x")), "page", "at", "kind").orderBy("record").collect()
    assert [(r.name, r.text) for r in texts] == [("n", "nb"), ("", "oo"), ("", "ob"), ("n", "nsb")]


def test_constants_that_overlap_are_cut_whole(spark):
    from pyspark.sql import functions as F

    from quireworks.functions.text import line_numbers, strip_constants

    d = spark.createDataFrame([("xABCyABz", "1，3-5, 4"), ("none", "5-3"), (None, "a")], "t string, spec string")
    got = d.select(strip_constants(F.col("t"), ["AB", "BC", "Q.*"]).alias("s"), line_numbers(F.col("spec")).alias("n")).collect()
    assert (got[0].s.text, got[0].s.removed, got[0].n) == ("xyz", ["ABC", "AB"], [1, 3, 4, 5])
    assert (got[1].s.text, got[1].s.removed, got[1].n) == ("none", [], None) and got[2].n is None


def test_attributes_by_anchors(spark):
    from pyspark.sql import functions as F

    from quireworks.operators.records import Attribute, extract_attributes, extract_one, strip_head_residue

    template = [Attribute("date", "光緒[一二三十]+年", True), Attribute("address", "總號在"), Attribute("capital", "股分")]
    d = spark.createDataFrame([("時益號光緒三十年創辦總號在北京股分洋銀十萬元每股百元",), ("股分銀總號在津光緒二年",), ("無",)], "t string")
    got = [r.v for r in d.select(extract_attributes(F.col("t"), template, ["每股"]).alias("v")).collect()]
    assert got[0] == {"date": "光緒三十年", "address": "總號在北京", "capital": "股分洋銀十萬元"}
    assert got[1] == {"date": "光緒二年", "address": "總號在津", "capital": "股分銀"} and got[2] == {}
    one = d.select(extract_one(F.col("t"), template[1], template).alias("v"), strip_head_residue(F.col("t"), "號", "光緒").alias("h")).collect()
    assert [r.v for r in one] == ["總號在北京", "總號在津", None] and one[0].h.startswith("光緒三十年")
