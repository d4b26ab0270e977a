"""Orders of boxes against plain walks, page by page."""

import random

from quireworks.operators import layout

SCHEMA = "stem string, line_id long, x1 double, y1 double, x2 double, y2 double, text string"


def pages(seed, n=12):
    r = random.Random(seed)
    rows = []
    for p in range(n):
        for k in range(r.randrange(1, 25)):
            x, y = r.choice([0, 40, 80, 120]) + r.randrange(12), r.randrange(300)
            rows.append((f"p{p}", k, float(x), float(y), None if r.random() < 0.08 else x + r.choice([18.0, 22.0, 30.0, 90.0]), y + r.choice([8.0, 14.0]), f"t{k}"))
    return rows


def by_page(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def plain_guarded(rows):
    columns = []
    for r in sorted(rows, key=lambda r: (r[2] + r[4], r[3]) if r[4] is not None else (0, 0)):
        done = False
        for c in columns if r[4] is not None else []:
            first = c["rows"][0]
            if first[4] is None:
                continue
            w, base = r[4] - r[2], first[4] - first[2]
            if min(w, base) / max(w, base) < 0.5 or max(r[4], first[4]) - min(r[2], first[2]) > 1.6 * base:
                continue
            shared = min(r[4], c["hi"]) - max(r[2], c["lo"])
            if shared <= 0 or shared / min(w, c["hi"] - c["lo"]) < 0.5:
                continue
            c["lo"], c["hi"] = min(c["lo"], r[2]), max(c["hi"], r[4])
            c["rows"].append(r)
            done = True
            break
        if not done:
            columns.append({"lo": r[2], "hi": r[4], "rows": [r]})
    columns.sort(key=lambda c: -max((r[2] + r[4]) / 2 if r[4] is not None else -1e18 for r in c["rows"]))
    return [(r[1], n) for n, c in enumerate(columns) for r in sorted(c["rows"], key=lambda r: r[3] if r[4] is not None else 0)]


def test_guarded_columns_equal_a_plain_walk(spark):
    rows = pages(1)
    got = {}
    for x in layout.guarded_order(spark.createDataFrame(rows, SCHEMA)).orderBy("stem", "pos").collect():
        got.setdefault(x.stem, []).append((x.line_id, x.column))
    assert got == {p: plain_guarded(v) for p, v in by_page(rows).items()}
    assert layout.guarded_order(spark.createDataFrame([], SCHEMA)).count() == 0


def test_mean_columns_equal_a_plain_walk(spark):
    rows = pages(2)
    want = {}
    for p, v in by_page(rows).items():
        groups = []
        for r in v:
            if r[4] is None:
                want[p, r[1]] = -1
                continue
            c = (r[2] + r[4]) / 2
            near = min(groups, key=lambda g: abs(sum(g[0]) / len(g[0]) - c), default=None)
            if near is None or abs(sum(near[0]) / len(near[0]) - c) > 30:
                groups.append(([c], [r[1]]))
            else:
                near[0].append(c)
                near[1].append(r[1])
        for n, g in enumerate(sorted(groups, key=lambda g: -sum(g[0]) / len(g[0]))):
            want |= {(p, k): n for k in g[1]}
    got = {(x.stem, x.line_id): x.col_index for x in layout.column_clusters(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want


def test_reading_orders_equal_a_plain_walk(spark):
    rows = pages(3)
    for upright in (True, False):
        want = {}
        for p, v in by_page(rows).items():
            whole = [r for r in v if r[4] is not None]
            cx, cy = (lambda r: (r[2] + r[4]) / 2), (lambda r: (r[3] + r[5]) / 2)
            limit = 30 if upright else 0.6 * sum(r[5] - r[3] for r in whole) / max(1, len(whole))
            bands = []
            for r in sorted(whole, key=(lambda r: -cx(r)) if upright else cy):
                at = -cx(r) if upright else cy(r)
                if bands and abs(at - bands[-1][0]) <= limit:
                    bands[-1][1].append(r)
                else:
                    bands.append((at, [r]))
            inner = cy if upright else cx
            want[p] = [r[1] for _, b in bands for r in sorted(b, key=lambda r: (inner(r), r[1]))] + [r[1] for r in v if r[4] is None]
        got = {}
        for x in layout.reading_order(spark.createDataFrame(rows, SCHEMA), upright=upright).orderBy("stem", "pos").collect():
            got.setdefault(x.stem, []).append(x.line_id)
        assert got == want


def test_pages_without_a_whole_box(spark):
    d = spark.createDataFrame([("a", 0, 1.0, 1.0, None, 2.0, "t"), ("b", 1, 1.0, 1.0, 9.0, 5.0, "u"), ("b", 2, 3.0, 1.0, 9.0, 5.0, "v")], SCHEMA)
    assert [tuple(x) for x in layout.table_grid(d).collect()] == [("b", 0, 0, "uv")]
    assert layout.guarded_order(d).count() == layout.reading_order(d).count() == layout.column_clusters(d).count() == 3
