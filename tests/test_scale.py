"""Many rows of one position, box or page: results stay right, and no pair of each with each is made."""

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quireworks.functions import geometry as G
from quireworks.operators import checks, corpus, evaluation, quotes, retrieval
from quireworks.plans import bands


def quick(f, seconds=60):
    began = time.monotonic()
    out = f()
    assert time.monotonic() - began < seconds
    return out


def boxes(spark, n, step):
    """n boxes of one record and text, of two places."""
    at = F.col("id") % 2 * step
    return spark.range(n).select(F.lit("p").alias("page"), F.lit(1).alias("record"), F.lit("a").alias("attr"), F.lit("t").alias("text"), F.col("id").alias("gold_id"), G.box(at, F.lit(0), at + 10, F.lit(10)).alias("box"))


def test_readings_of_one_text_that_fills_a_page(spark):
    got = quick(lambda: evaluation.value_readings(boxes(spark, 60_000, 100), boxes(spark, 60_000, 50)).collect())
    assert [tuple(r) for r in got] == [("a", 60_000, 60_000, 30_000)]
    alone = evaluation.value_readings(boxes(spark, 3, 0), boxes(spark, 3, 0).where("false")).first()
    assert (alone.gold, alone.found, alone.hit) == (3, 0, 0)


def test_equal_boxes_of_one_record_are_counted_before_they_meet(spark):
    r = quick(lambda: evaluation.record_aligned(boxes(spark, 100_000, 100), boxes(spark, 100_000, 50)).first())
    assert (r.n, r.hit, r.ratio) == (10_000_000_000, 2_500_000_000, 0.25)
    r = evaluation.record_aligned(boxes(spark, 2, 0), boxes(spark, 2, 0).where("false")).first()
    assert (r.n, r.hit, r.ratio) == (0, 0, None)


def test_nearest_of_many_bands_at_one_position(spark):
    at = lambda c: F.col("id").alias(c)
    b = spark.range(60_000).select(F.lit("k").alias("key"), at("band_id"), (F.col("id") % 2 / 100).alias("band_rel"))
    lines = spark.range(60_000).select(F.lit("k").alias("key"), at("line_id"), F.lit(0.009).alias("rel"))
    got = quick(lambda: bands.nearest_band(b, lines, "key", 0.03).groupBy("band_id", "off").count().collect())
    assert [tuple(r) for r in got] == [(1, 0.001, 60_000)]


def test_a_value_at_the_end_of_a_band_is_in_it(spark):
    """11 of 20 is 45 % off: 3 * 0.8 * 0.15 as the SQL multiplies."""
    v = spark.createDataFrame([(0, 20 / 25.0, 100.0)], "variant int, aspect double, price double")
    p = spark.createDataFrame([(k, k / 25.0, 100.0) for k in (10, 11, 12, 24, 25)], "page int, aspect double, price double")
    assert sorted(r.page for r in evaluation.match_variants(p, v, ["aspect", "price"]).collect()) == [11, 12, 24]


@pytest.mark.parametrize("parts", [1, 5])
def test_equal_intervals_have_an_order(spark, parts):
    rows = spark.createDataFrame([(1, i, 0, 5) for i in range(40)], "u int, e int, lo int, hi int").repartition(parts, "e")
    assert sorted(r.e for r in checks.overlaps_next(rows, "u", "lo", "hi", [F.desc("e")]).collect()) == list(range(1, 40))


@pytest.mark.parametrize("shortest, longest, least", [(3, 6, 0.3), (1, 9, 0.3), (2, 2, 0.5), (4, 8, 0.2), (3, 6, 2.0)])
def test_grams_of_pages_of_several_rows(spark, shortest, longest, least):
    r = random.Random(shortest)
    rows = [(i % 12, "".join(r.choice(["ab", "ba", "光緒", "\U0001f600x"]) for _ in range(r.randrange(9)))) for i in range(40)] + [(12, None), (None, "abab")]
    seen = {}
    for k, t in rows:
        for n in range(shortest, longest + 1):
            for at in range(len(t or "") - n + 1):
                if k is not None:
                    seen.setdefault(t[at : at + n], set()).add(k)
    d = spark.createDataFrame(rows, "k int, t string").repartition(5)
    got = {x.gram: x.pages_hit for x in corpus.gram_frequency(d, "k", "t", least, shortest, longest).collect()}
    assert got == {g: len(k) for g, k in seen.items() if len(k) >= least * 13}


def test_grams_that_are_rare_make_no_rows(spark):
    d = spark.range(3000).select("id", F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: F.sha2((F.col("id") * 300 + i).cast("string"), 256))).alias("t"), F.lit("token").alias("u"))
    got = quick(lambda: corpus.gram_frequency(d.select("id", F.concat("t", "u").alias("t")), "id", "t", 0.999).collect(), 90)
    assert ("token", 3000) in {tuple(r) for r in got}


def test_stretches_of_characters_have_their_own_codes():
    chars = quotes.codes("aba\U0010ffff\U0010ffff\U0010ffffab")
    for size in (1, 2, 3):
        got = corpus._stretches(chars, size).tolist()
        assert [corpus._characters(size)(c) for c in got] == ["aba\U0010ffff\U0010ffff\U0010ffffab"[k : k + size] for k in range(9 - size)] and min(got) >= 0
    assert all(len(corpus._stretches(quotes.codes(t), 3)) == 0 for t in ("", "a", "ab"))


def test_texts_of_a_page_are_read_together(monkeypatch):
    class Held:
        value = []

    rows = [(1, "ab"), (1, ""), (1, "bcd"), (2, ""), (3, "abc"), (3, "\U0010ffffabc"), (3, "a"), (4, "a"), (4, "b")]
    want = {}
    for p, t in rows:
        for k in range(len(t) - 2):
            want.setdefault(t[k : k + 3], set()).add(p)
    for codes in (1 << 21, 1, 4):
        monkeypatch.setattr(corpus, "CODES", codes)
        for cut in range(1, len(rows)):
            batches = [pa.RecordBatch.from_pylist([{"page": p, "text": t} for p, t in x]) for x in (rows[:cut], rows[cut:])]
            got = {}
            for b in corpus._counted(range(3, 4), Held)(batches):
                for r in b.to_pylist():
                    got[corpus._characters(3)(r["code"])] = got.get(corpus._characters(3)(r["code"]), 0) + r["n"]
            assert got == {g: len(k) for g, k in want.items()}


def test_texts_are_held_by_groups():
    batch = pa.RecordBatch.from_arrays([pa.array(range(150))], ["x"])
    got = list(retrieval.groups([batch, batch.slice(0, 0)]))
    assert [b.num_rows for b in got] == [64, 64, 22] and [v for b in got for v in b.column("x").to_pylist()] == list(range(150))


def test_field_values_of_many_cards_are_not_dealt_by_value(spark):
    q = spark.createDataFrame([(1, "an en text"), (2, "other")], "query_id int, query string")
    fields = spark.range(1000).select(F.col("id").alias("card_id"), F.when(F.col("id") >= 0, "en").otherwise("zz").alias("value"))
    got = retrieval.field_boost(q, fields)
    assert [tuple(r) for r in got.groupBy("query_id", "boost").count().collect()] == [(1, 0.35, 1000)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = retrieval.field_boost(q, fields)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan.partition("SortMergeJoin")[0]
