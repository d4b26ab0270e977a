"""Results with one fault each, and random results against plain loops."""

import random
from collections import Counter

import pytest

from quireworks.operators import validation as V

RESULT = """stem string, kind string, schema_version string, profile_id string, tier string, text_stream string, chain array<string>, trace array<struct<tier:string,ok:boolean>>,
layout struct<covered:boolean,policy:string>, page struct<w:double,h:double>, records array<struct<lines:array<int>,box:array<double>,attrs:array<struct<attr:string,text:string,lines:array<int>,boxes:array<array<double>>>>>>,
unassigned array<struct<text:string,reason:string>>"""
LINES = ["商號甲", "abcdefghijklmnop", "地址乙 丙", "股分丁", "尾"]
STREAM = "".join(LINES)


def result(stem, **more):
    attr = lambda text, lines, y: ("a", text, lines, [[10.0, y, 20.0, y + 50.0]])
    base = {
        "kind": V.KIND, "schema_version": "0.1.0", "profile_id": "p", "tier": "rule", "text_stream": STREAM, "chain": None, "trace": [("rule", True)], "layout": None, "page": (1000.0, 1000.0),
        "records": [([0, 1], [5.0, 300.0, 50.0, 500.0], [attr("商號甲", [0], 310.0), attr("abcdefghijklmnop", [1], 330.0)]), ([2, 3], None, [attr("地址乙丙", None, 400.0), attr("股分丁", [3], 420.0)])],
        "unassigned": [("尾", "footer"), (" ", "other")],
    } | more
    return (stem, *(base[k] for k in ("kind", "schema_version", "profile_id", "tier", "text_stream", "chain", "trace", "layout", "page", "records", "unassigned")))


def changed(k, **fields):
    """The records of a sound result with fields of record k replaced."""
    records = [list(r) for r in result("")[10]]
    for name, value in fields.items():
        records[k][("lines", "box", "attrs").index(name)] = value
    return [tuple(r) for r in records]


FAULTS = {
    "schema": {"kind": "other", "schema_version": "1.0", "profile_id": None},
    "tier_unknown": {"tier": "magic", "trace": None},
    "tier_trace_order": {"tier": "rule", "trace": [("l1", False), ("rule", True)]},
    "tier_skip": {"tier": "l2", "trace": [("rule", False), ("l2", True)]},
    "tier_mismatch": {"tier": "l1", "trace": [("rule", True)]},
    "stream_mismatch": {"text_stream": STREAM[:-1], "unassigned": []},
    "line_out_of_range": {"records": changed(1, lines=[2, 3, 9])},
    "line_reused": {"records": changed(1, lines=[1, 2, 3])},
    "record_overlap": {"records": changed(0, lines=[0, 3]) + changed(0, lines=[1, 4], attrs=None)[:1]},
    "record_no_lines": {"records": changed(1, lines=[])},
    "attr_no_lines": {"records": changed(1, lines=[])},
    "fabricated": {"records": changed(0, attrs=[("a", "商號甲", [0], None), ("a", "abcdefghijklmnop", [1], None), ("a", "not there", [1], None)])},
    "value_disorder": {"records": changed(0, attrs=[("a", "abcdefghijklmnop", [1], None), ("a", "商號甲", [0], None)])},
    "glyph_folded": {"records": changed(0, attrs=[("a", "商号甲", [0], None), ("a", "abcdefghijklmnop", [1], None)])},
    "unassigned_fabricated": {"unassigned": [("尾", "footer"), ("never said", "other")]},
    "silent_gap": {"unassigned": []},
    "coverage_low": {"records": changed(0, attrs=[]), "unassigned": [("尾", "footer"), ("商號甲abcdefghijklmnop", "header")]},
    "large_gap": {"records": [([0, 1], None, []), ([2, 3], None, [("a", "股分丁", [3], None)])], "unassigned": [("尾", "other"), ("商號甲abcdefghijklmnop地址乙丙", "other")]},
    "single_line_bad": {"tier": "single_line", "trace": None},
    "layout_policy_unknown": {"layout": (True, "guess")},
    "layout_uncovered": {"layout": (False, "family_params")},
    "layout_policy_mismatch": {"layout": (False, "page_fallback")},
    "box_inverted": {"records": changed(0, box=[5.0, 400.0, 5.0, 500.0])},
    "box_out_of_page": {"records": changed(0, box=[5.0, 400.0, 50.0, 1200.0])},
    "record_spans_bands": {"records": changed(0, box=[5.0, 300.0, 50.0, 990.0])},
    "record_in_unannotated": {"records": changed(1, attrs=[("a", "地址乙丙股分丁", [2], [[10.0, 10.0, 20.0, 40.0]])])},
    "record_touches_unannotated": {"records": changed(1, box=[10.0, 10.0, 20.0, 40.0])},
    "line_source_unresolved": {}, "page_size_unknown": {"page": None}, "page_size_mismatch": {"page": (1000.0, 900.0)},
}


def tables(spark, rows, stems):
    lines = [(s, k, t) for s in stems if s != "line_source_unresolved" for k, t in enumerate([*LINES, " "])]
    sizes = [(s, 1000.0, 1000.0) for s in stems if s not in ("page_size_unknown",)]
    regions = [(s, i, lo, hi, role) for s in stems for i, (lo, hi, role) in enumerate([(0.0, 0.1, "unannotated_top"), (0.1, 0.6, "body"), (0.6, 1.0, "foot")])]
    return (
        spark.createDataFrame(rows, RESULT), spark.createDataFrame(lines, "stem string, at int, text string"), spark.createDataFrame(sizes, "stem string, w double, h double"),
        spark.createDataFrame(regions, "stem string, id int, lo double, hi double, role string"),
    )


def test_every_code_is_found_where_its_fault_is(spark):
    rows = [result("sound")] + [result(code, **fields) for code, fields in FAULTS.items()]
    made = tables(spark, rows, ["sound", *FAULTS])
    got = {}
    for f in V.findings(*made).collect():
        got.setdefault(f.stem, set()).add(f.code)
    assert "sound" not in got
    for code in FAULTS:
        assert code in got[code], (code, got.get(code))
    assert got["schema"] == {"schema"} and len(FAULTS) == 30
    ok = {r.stem: r.ok for r in V.report(made[0], V.findings(*made)).collect()}
    assert ok["sound"] and not ok["fabricated"] and ok["value_disorder"] and len(ok) == len(rows)
    m = {r.stem: r for r in V.metrics(*made).collect()}["sound"]
    assert (m.n_records, m.n_attrs, m.n_lines, m.n_unassigned, m.n_uncovered_chars, m.coverage) == (2, 4, 5, 1, 0, 1.0)
    assert V.findings(made[0].limit(0), *made[1:]).count() == 0


def plain_spans(stream, pieces):
    spans, at, back, missing = [], 0, 0, 0
    for p in filter(None, pieces):
        k = stream.find(p, at)
        if k >= 0:
            at = k + len(p)
        else:
            k = stream.find(p)
            back += k >= 0
            missing += k < 0
        if k >= 0:
            spans.append((k, k + len(p)))
    return spans, back, missing


@pytest.mark.parametrize("seed", range(2))
def test_random_results_against_plain_loops(spark, seed):
    r = random.Random(seed)
    rows, want = [], {}
    for n in range(60):
        stem = f"s{n}"
        pick = lambda: STREAM[(i := r.randrange(len(STREAM) - 3)) : i + r.randrange(1, 9)].replace(" ", "")  # noqa: E731, B023
        records = [([r.randrange(-1, 6) for _ in range(r.randrange(4))], None, [("a", pick() if r.random() < 0.9 else "zzz", None, None) for _ in range(r.randrange(4))]) for _ in range(r.randrange(1, 4))]
        notes = [(pick(), r.choice(["footer", "other"])) for _ in range(r.randrange(3))]
        rows.append(result(stem, records=records, unassigned=notes))
        stream = STREAM.replace(" ", "").replace("號", "号")
        fold = lambda s: s.replace("號", "号")
        c = Counter()
        spans, c["value_disorder"], c["fabricated"] = plain_spans(stream, [fold(a[1]) for x in records for a in x[2]])
        noted, _, c["unassigned_fabricated"] = plain_spans(stream, [fold(t) for t, _ in notes])
        covered = {i for a, b in spans for i in range(a, b)}
        c["silent_gap"] = len(stream) - len(covered | {i for a, b in noted for i in range(a, b)})
        c["coverage_low"] = int(len(covered) / len(stream) < 0.5)
        c["line_out_of_range"] = sum(not 0 <= i < 5 for x in records for i in x[0])
        first: dict = {}
        for k, x in enumerate(records):
            for i in x[0]:
                if 0 <= i < 5:
                    c["line_reused"] += first.setdefault(i, k) != k
        ranges = sorted((min(x[0]), max(x[0]), k) for k, x in enumerate(records) if x[0])
        c["record_overlap"] = sum(b[0] <= a[1] for a, b in zip(ranges, ranges[1:]))
        c["record_no_lines"] = sum(not x[0] for x in records)
        c["attr_no_lines"] = sum(len(x[2]) for x in records if not x[0])
        want[stem] = c
    got = {s: Counter() for s in want}
    for f in V.findings(*tables(spark, rows, list(want))).collect():
        got[f.stem][f.code] += f.n
    for s, c in want.items():
        assert {k: got[s][k] for k in c if got[s][k]} == {k: n for k, n in c.items() if n}, s


def test_each_table_is_read_once_for_all_checks(spark):
    rows = [result("twice", records=changed(1, lines=[1, 1, 2, 3, 7, -1])), result("none", records=[]), result("broken", kind="other", records=changed(1, lines=[1]))]
    found = V.findings(*tables(spark, rows, ["twice", "none", "broken"]))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 4
    got = {(f.stem, f.code, f.record): f.n for f in found.collect()}
    assert got["twice", "line_reused", 1] == 2 and got["twice", "record_overlap", 0] == 1 and got["none", "silent_gap", None] > 0
    assert [k for k in got if k[0] == "broken"] == [("broken", "schema", None)]
