"""Attribute orders, overrides, HTML grids and job progress, against plain versions and micro fixtures."""

import heapq
import random
from collections import Counter

from quireworks.operators import overrides
from quireworks.sources.html import html_grid
from quireworks.streaming import progress


def plain_order(records, seed):
    won, attrs = Counter(), sorted({a for r in records for a in r})
    for r in records:
        first = list(dict.fromkeys(r))
        for i, a in enumerate(first):
            for b in first[i + 1 :]:
                won[a, b] += 1
    ahead = {a: {b for b in attrs if b != a and won[b, a] > won[a, b]} for a in attrs}
    heap = [(seed[a], a) for a in attrs if not ahead[a]]
    heapq.heapify(heap)
    order = []
    while heap:
        _, a = heapq.heappop(heap)
        order.append(a)
        for b in attrs:
            if a in ahead[b]:
                ahead[b].remove(a)
                if not ahead[b]:
                    heapq.heappush(heap, (seed[b], b))
    rest = sorted((a for a in attrs if a not in order), key=lambda a: seed[a])
    return order + rest, rest


def test_orders_equal_a_plain_peeling(spark):
    r = random.Random(1)
    keys = {k: [[r.choice("abcdefgh"[: 3 + k % 6]) for _ in range(r.randrange(1, 9))] for _ in range(r.randrange(1, 7))] for k in range(25)}
    seeds = {k: {a: i for i, a in enumerate(r.sample("abcdefgh", 8))} for k in keys}
    rows = [(k, f"{k}-{n}", i, a) for k, rs in keys.items() for n, rec in enumerate(rs) for i, a in enumerate(rec)]
    d = spark.createDataFrame(rows, "k int, record string, at int, attr string")
    attrs = spark.createDataFrame([(k, a, seeds[k][a]) for k, rs in keys.items() for a in {x for rec in rs for x in rec}], "k int, attr string, seed int")
    got = {x.k: (x.order, x.cyclic) for x in overrides.attribute_orders(overrides.wins(d, "k", "record", "at", "attr"), attrs, "k").collect()}
    assert got == {k: plain_order(rs, seeds[k]) for k, rs in keys.items()} and any(c for _, c in got.values())


LEARNED, OVERRIDES = "k int, order array<string>, required array<string>", "k int, attr string, source string, position string, required boolean"


def test_overrides_have_an_outcome_for_each_field(spark):
    learned = spark.createDataFrame([(1, list("abcde"), ["a", "e"]), (2, list("xy"), [])], LEARNED)
    rows = [(1, "e", "human", "1", None), (1, "a", "human", "1", False), (1, "b", "model", "2", True), (1, "c", "human", "9", True), (1, "d", "human", "four", None), (1, "q", "human", "1", True), (1, "b", "human", None, False), (2, "y", "human", "2", None)]
    out = overrides.override_outcomes(learned, spark.createDataFrame(rows, OVERRIDES), "k")
    got = sorted((x.k, x.attr, x.field, x.outcome, x.reason or "") for x in out.collect())
    assert got == sorted([
        (1, "e", "position", "applied", ""), (1, "a", "position", "noop", ""), (1, "a", "required", "applied", ""), (1, "b", "all", "skipped", "no_human_source"), (1, "c", "position", "skipped", "out_of_range"), (1, "c", "required", "applied", ""),
        (1, "d", "position", "skipped", "not_a_number"), (1, "q", "position", "skipped", "not_in_order"), (1, "q", "required", "skipped", "not_in_order"), (1, "b", "required", "noop", ""), (2, "y", "position", "noop", ""),
    ])
    new = {x.k: (x.order, x.required) for x in overrides.overridden(learned, out, "k").collect()}
    assert new == {1: (list("eabcd"), ["e", "c"]), 2: (list("xy"), [])}


def plain_pins(order, pins):
    rest = [a for a in order if a not in {a for a, _ in pins}]
    for a, p in sorted(sorted(pins), key=lambda x: x[1]):
        rest.insert(max(0, min(p - 1, len(rest))), a)
    return rest


def test_positions_are_put_back_in_turn(spark):
    r = random.Random(7)
    cases = {k: (r.sample("abcdefg", n := r.randrange(2, 8)), n) for k in range(40)}
    pins = {k: [(a, r.randrange(1, n + 1)) for a in r.sample(order, r.randrange(1, n + 1))] for k, (order, n) in cases.items()}
    learned = spark.createDataFrame([(k, order, []) for k, (order, _) in cases.items()], LEARNED)
    out = overrides.override_outcomes(learned, spark.createDataFrame([(k, a, "human", str(p), None) for k, v in pins.items() for a, p in v], OVERRIDES), "k")
    got = {x.k: x.order for x in overrides.overridden(learned, out, "k").collect()}
    for k, (order, _) in cases.items():
        moved = [(a, p) for a, p in pins[k] if order.index(a) + 1 != p]
        assert got[k] == plain_pins(order, moved)


def test_constants(spark):
    c = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "k int, word string")
    o = spark.createDataFrame([(1, "add", "a", "human"), (1, "add", " n ", "human"), (1, "remove", "b", "human"), (1, "remove", "z", "human"), (2, "remove", "a", "model"), (1, "add", " ", "human")], "k int, op string, word string, source string")
    now, outcomes = overrides.constants_set(c, o, "k")
    assert sorted(map(tuple, now.collect())) == [(1, "a"), (1, "n"), (2, "a")]
    assert sorted(map(tuple, outcomes.collect())) == [(1, "add", "a", "noop"), (1, "add", "n", "applied"), (1, "remove", "b", "applied"), (1, "remove", "z", "noop"), (2, "remove", "a", "skipped")]


def test_html_grids_with_spans_and_nesting(spark):
    page = """<p>x<table><tr><th rowspan=2>A</th><td colspan='2'>b <b>c</b></td></tr><tr><td>d&amp;e<td>f</tr><tr><td colspan=x rowspan="0">g<table><tr><td>in<td rowspan=9999>ner</table>h</td></tr></table>
    <table><td>bare<tr><td>open"""
    d = spark.createDataFrame([(1, page), (2, None), (3, "<td>no table</td></table>")], "page_id int, html string")
    got = [tuple(x)[1:] for x in html_grid(d, "page_id", "html").orderBy("table_no", "row_no", "col_no").collect()]
    assert got == [
        (0, None, 0, 0, 2, 1, True, "A"), (0, None, 0, 1, 1, 2, False, "b c"), (0, None, 1, 1, 1, 1, False, "d&e"), (0, None, 1, 2, 1, 1, False, "f"), (0, None, 2, 0, 1, 1, False, "gh"),
        (1, 0, 0, 0, 1, 1, False, "in"), (1, 0, 0, 1, 1000, 1, False, "ner"), (2, None, 0, 0, 1, 1, False, "bare"), (2, None, 1, 0, 1, 1, False, "open"),
    ]


def test_a_running_job_fails_after_its_time_to_live(spark, tmp_path):
    from datetime import datetime, timedelta

    start, schema = datetime(2024, 1, 1), "job string, at timestamp, kind string, count int, total int, error string"
    at = lambda minutes: start + timedelta(minutes=minutes)
    batches = [
        [("a", at(0), "register", None, None, None), ("a", at(1), "update", 3, 9, None), ("b", at(0), "register", None, None, None), ("c", at(0), "update", 5, 5, None), ("d", at(2), "failed", None, None, "no disk")],
        [("b", at(5), "done", 7, None, None), ("b", at(6), "update", 1, 1, None)],
        [("tick", at(50), "register", None, None, None)], [("tick", at(51), "update", 1, 1, None)],
        [("tick", at(200), "update", 2, 2, None)], [("tick", at(201), "update", 3, 3, None)],
    ]
    seen = []
    source = tmp_path / "in"
    source.mkdir()
    stream = progress.progress(spark.readStream.schema(schema).parquet(str(source)), delay="1 minute")

    def keep(frame, _):
        seen.extend(tuple(x) for x in frame.collect())

    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    by = {}
    for x in seen:
        by.setdefault(x[0], []).append(x[1:])
    t0 = start.timestamp()
    assert by["a"][0][:3] == ("running", 3, 9) and by["a"][1] == ("failed", 3, 9, t0, t0 + 60 + progress.TIME_TO_LIVE, "expired")
    assert [x[0] for x in by["a"]] == ["running", "failed", "unknown"]
    assert [x[:3] for x in by["b"]][:2] == [("running", 0, 0), ("done", 7, 7)] and by["b"][-1][0] == "unknown"
    assert "c" not in by and by["d"][0][0] == "failed" and by["d"][0][5] == "no disk" and by["d"][-1][0] == "unknown"


def test_states_after_changes():
    s = progress.after(None, "register", 1.0, None, None, None)
    assert s[:3] == ("running", 0, 0) and progress.after(None, "update", 2.0, 1, 1, None) is None
    s = progress.after(s, "update", 2.0, 4, None, None)
    assert s[:3] == ("running", 4, 0) and s[4] == 2.0
    assert progress.after(s, "done", 3.0, 6, None, None)[:3] == ("done", 6, 6) and progress.after(s, "failed", 3.0, None, None, "x")[5:] == (3.0, "x")
    assert progress.after(("done", 1, 1, 0.0, 1.0, 1.0, None), "update", 2.0, 9, 9, None)[1] == 1
