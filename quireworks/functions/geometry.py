"""Box expressions. A box is struct(x1, y1, x2, y2) of doubles; anything illegal is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.cast("double").alias("x1"), y1.cast("double").alias("y1"), x2.cast("double").alias("x2"), y2.cast("double").alias("y2"))


def rect(flat: Column) -> Column:
    """[x1, y1, x2, y2] as a box, if it has an area."""
    return F.when((F.size(flat) == 4) & (flat[2] > flat[0]) & (flat[3] > flat[1]), box(flat[0], flat[1], flat[2], flat[3]))


def quad_rect(quad: Column) -> Column:
    """Corner points as the box around them."""
    xs, ys = F.transform(quad, lambda p: p[0]), F.transform(quad, lambda p: p[1])
    return F.when(F.size(quad) >= 2, box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))


def clamp(b: Column, width: Column, height: Column) -> Column:
    """Edges in order and inside the page; empty boxes become null."""
    lo = lambda p, q, most: F.greatest(F.lit(0.0), F.least(F.least(p, q), most))
    hi = lambda p, q, most: F.greatest(F.lit(0.0), F.least(F.greatest(p, q), most))
    out = box(lo(b["x1"], b["x2"], width), lo(b["y1"], b["y2"], height), hi(b["x1"], b["x2"], width), hi(b["y1"], b["y2"], height))
    return F.when((out["x2"] > out["x1"]) & (out["y2"] > out["y1"]), out)


def area(b: Column) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def iou(a: Column, b: Column) -> Column:
    """Overlap over union; 0 for disjoint or missing boxes."""
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    return F.coalesce(F.when(w * h > 0, w * h / (area(a) + area(b) - w * h)), F.lit(0.0))


def best_iou(a: Column, b: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(a, lambda p: F.array_max(F.transform(b, lambda q: iou(p, q))))), F.lit(0.0))


def row_uid(b: Column, index: Column) -> Column:
    """A fingerprint of the geometry, edges rounded half to even; the index where there is no box."""
    return F.when(b.isNotNull(), F.concat_ws("_", F.lit("box"), *(F.bround(b[k]).cast("long") for k in ("x1", "y1", "x2", "y2")))).otherwise(F.concat(F.lit("idx_"), index.cast("string")))


def same_column(a: Column, b: Column, overlap: float = 0.5, centre: float = 0.5, width: float = 1.6) -> Column:
    """Three guards without units: x overlap, distance of centres, ratio of widths."""
    wa, wb = a["x2"] - a["x1"], b["x2"] - b["x1"]
    shared = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    off = F.abs(a["x1"] + a["x2"] - b["x1"] - b["x2"]) / 2
    return (shared >= overlap * F.least(wa, wb)) & (off <= centre * F.greatest(wa, wb)) & (F.greatest(wa, wb) <= width * F.least(wa, wb))


def apportion(total: Column, weights: Column) -> Column:
    """Whole shares that add up to total: floors, then one more for the largest remainders, ties to the smaller index."""
    whole = F.aggregate(weights, F.lit(0.0), lambda s, w: s + w)
    exact = F.transform(weights, lambda w: total * w / whole)
    rest = (total - F.aggregate(exact, F.lit(0).cast("long"), lambda s, e: s + F.floor(e))).cast("int")
    order = F.transform(F.array_sort(F.transform(exact, lambda e, i: F.struct((-(e - F.floor(e))).alias("r"), i.alias("i")))), lambda x: x["i"])
    lucky = F.when(rest > 0, F.slice(order, F.lit(1), F.greatest(rest, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(exact, lambda e, i: (F.floor(e) + F.array_contains(lucky, i).cast("int")).cast("long"))


def sub_box(b: Column, offset: Column, length: Column, n: Column) -> Column:
    """The part of a box that a stretch of its n characters takes, along the longer side."""
    upright = (b["y2"] - b["y1"]) >= (b["x2"] - b["x1"])
    cell = F.when(upright, b["y2"] - b["y1"]).otherwise(b["x2"] - b["x1"]) / n
    lo, hi = offset * cell, (offset + length) * cell
    return F.when(upright, box(b["x1"], b["y1"] + lo, b["x2"], b["y1"] + hi)).otherwise(box(b["x1"] + lo, b["y1"], b["x1"] + hi, b["y2"]))


def union(boxes: Column) -> Column:
    """The box around an array of boxes; null for none."""
    edge = lambda f, k: f(F.transform(boxes, lambda b: b[k]))
    return F.when(F.size(boxes) > 0, box(edge(F.array_min, "x1"), edge(F.array_min, "y1"), edge(F.array_max, "x2"), edge(F.array_max, "y2")))


def metrics(b: Column, text: Column) -> Column:
    """struct(cx, cy, w, h, chars) of a line."""
    return F.struct(((b["x1"] + b["x2"]) / 2).alias("cx"), ((b["y1"] + b["y2"]) / 2).alias("cy"), (b["x2"] - b["x1"]).alias("w"), (b["y2"] - b["y1"]).alias("h"), F.length(text).alias("chars"))


def range_text(values: Column) -> Column:
    """lowest-highest with one decimal; '' without values."""
    return F.when(F.size(values) > 0, F.format_string("%.1f-%.1f", F.array_min(values), F.array_max(values))).otherwise("")


def ids_text(ids: Column) -> Column:
    """Two ids as a-b, any other number as a,b,c; '' for null."""
    as_text = F.transform(ids, lambda i: i.cast("string"))
    return F.coalesce(F.when(F.size(ids) == 2, F.array_join(as_text, "-")).otherwise(F.array_join(as_text, ",")), F.lit(""))


def split_text(text: Column, weights: Column) -> Column:
    """The text cut into as many parts as there are weights, of apportioned lengths; the parts joined are the text."""
    counts = apportion(F.length(text), weights)
    parts = F.transform(counts, lambda n, i: F.substr(text, (F.aggregate(F.slice(counts, F.lit(1), i), F.lit(0).cast("long"), lambda s, c: s + c) + 1).cast("int"), n.cast("int")))
    return F.when(F.size(weights) <= 1, F.array(text)).otherwise(parts)


def split_by_heights(text: Column, boxes: Column) -> Column:
    """split_text with the heights of the boxes, 1 at least, as weights."""
    return split_text(text, F.transform(boxes, lambda b: F.greatest(F.lit(1.0), b["y2"] - b["y1"])))


def char_fit_error(b: Column, chars: Column, cell: Column) -> Column:
    """How far the height of an upright box is from chars cells, relative; null for boxes that lie, or without a cell."""
    h = b["y2"] - b["y1"]
    return F.when((h > b["x2"] - b["x1"]) & (chars > 0) & (cell > 0), F.abs(h - cell * chars) / (cell * chars))


def char_boxes(b: Column, text: Column) -> Column:
    """A box for each character, evenly over the width."""
    step = (b["x2"] - b["x1"]) / F.length(text)
    places = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: box(b["x1"] + i * step, b["y1"], b["x1"] + (i + 1) * step, b["y2"]))


def column_boxes(b: Column, text: Column, advance: Column) -> Column:
    """A box for each character of a column, from its top on with a fixed advance, not beyond its foot."""
    places = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: box(b["x1"], b["y1"] + i * advance, b["x2"], F.least(b["y2"], b["y1"] + (i + 1) * advance)))


def fit_cell(heights: Column, chars: Column, lo: float = 12.0, hi: float = 160.0, rounds: int = 80) -> Column:
    """The cell height at which the heights, in whole cells of one at least, hold the characters: halving of lo to hi; 38 where there is nothing to fit."""
    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        many = F.aggregate(heights, F.lit(0).cast("long"), lambda n, h: n + F.greatest(F.lit(1).cast("long"), F.bround(h / mid).cast("long"))) > chars
        return F.struct(F.when(many, mid).otherwise(s["lo"]).alias("lo"), F.when(many, s["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2)
    return F.when((chars > 0) & (F.size(heights) > 0), found).otherwise(38.0)


def inside(x: Column, y: Column, zones: Column) -> Column:
    """Whether a point lies in one of the zones, edges included."""
    return F.exists(zones, lambda z: x.between(z["x1"], z["x2"]) & y.between(z["y1"], z["y2"]))


def outside_zones(b: Column, text: Column, zones: Column) -> Column:
    """The characters of a line whose centres are in none of the zones. Characters stand evenly along the longer side; a line without a box keeps none."""
    w, h, n = b["x2"] - b["x1"], b["y2"] - b["y1"], F.length(text)
    mid = lambda i: (i + 0.5) * F.greatest(w, h) / n
    x = lambda i: F.when(h >= w, (b["x1"] + b["x2"]) / 2).otherwise(b["x1"] + mid(i))
    y = lambda i: F.when(h >= w, b["y1"] + mid(i)).otherwise((b["y1"] + b["y2"]) / 2)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    kept = F.filter(places, lambda i: ~inside(x(i), y(i), zones))
    return F.when(b.isNull(), "").otherwise(F.array_join(F.transform(kept, lambda i: F.substr(text, i + 1, F.lit(1))), ""))


def orientation(aspect: Column) -> Column:
    return F.when(aspect < 1.0, "portrait").when(aspect >= 1.0, "landscape")
