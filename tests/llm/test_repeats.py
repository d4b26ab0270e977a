"""Repeated byte strings against a plain walk, the sort against Python's, on odd texts and odd tables."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quireworks.llm import repeats
from tests.llm.test_llm import DOCS, frame, texts


def plain(rows, width):
    raw = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(r[i : i + width] for _, r in raw for i in range(len(r) - width + 1))
    out = []
    for d, r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - width + 1):
            if seen[r[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        spans = sum(x == 1 and (k == 0 or gone[k - 1] == 0) for k, x in enumerate(gone))
        out.append((d, len(r), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(r, gone) if not g)).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def passages(seed, n, width):
    """Texts that share passages at, above and below the width, copies, edited copies and periodic stretches."""
    r = random.Random(seed)
    say = lambda k: "".join(r.choice("abcdefgh é中") for _ in range(k))
    shared = [say(k) for k in (width - 1, width, width + 1, 3 * width, width // 2)]
    rows = [say(r.randrange(3 * width)) + r.choice(shared) + say(r.randrange(2 * width)) + r.choice(shared) for _ in range(n)]
    long = say(8 * width)
    at = 4 * width
    rows += [long, long, long[:at] + "X" + long[at:], long[:at] + "Y" + long[at + 1 :], rows[0], "ab" * width, "ab" * (width // 2 + 3), "z" * (width + 2), say(5) + "z" * (width + 1), shared[1] + shared[1]]
    return [*rows, None, "", " "]


@pytest.mark.parametrize("width, gram, group_runs", [(40, 20, 4000), (40, 20, 3), (48, 8, 10), (16, 16, 2)])
def test_digests_equal_a_plain_walk(spark, width, gram, group_runs):
    rows = passages(width + group_runs, 60, width)
    assert result(repeats.digests(frame(spark, rows), width, gram, group_runs)) == plain(list(enumerate(rows)), width)


def test_production_width_on_odd_texts(spark):
    rows = texts(40) + passages(9, 30, 400)
    rows += [("edge " + str(k)) * 90 + rows[5] * 3 for k in range(4)]
    assert result(repeats.digests(frame(spark, rows))) == plain(list(enumerate(rows)), 400)


def test_stretches_of_long_texts_change_nothing(spark, monkeypatch):
    rows = passages(4, 20, 40)
    for stretch in (1, 7, 64):
        monkeypatch.setattr(repeats, "STRETCH", stretch)
        for t in rows[:6]:
            raw = (t or "").encode()
            runs = [(a, b) for lo, hi, _ in repeats.runs_of(raw, 40, 20) for a, b in zip(lo.tolist(), hi.tolist())]
            assert [i for a, b in runs for i in range(a, b)] == list(range(max(len(raw) - 39, 0)))


def test_a_hot_passage_with_many_edges(spark):
    r = random.Random(11)
    say = lambda k: "".join(r.choice("abcdefghijkl ") for _ in range(k))
    hot = say(90)
    rows = [say(50) + hot + say(50) for _ in range(150)] + [say(50) + hot[1:] for _ in range(3)] + ["copy " * 30] * 80
    assert result(repeats.digests(frame(spark, rows), 40, 20, 16)) == plain(list(enumerate(rows)), 40)


def test_passages_of_over_fifty_words_go_from_400_bytes_on(spark):
    r = random.Random(50)
    say = lambda words: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(words))
    long, short = say(58), say(56)  # 405 and 391 bytes, and a space at either end
    rows = [f"{say(80)}{m} {passage} {m}{say(40)}" for passage in (long, short) for m in "AB"] + [say(300) for _ in range(20)]
    got = result(repeats.digests(frame(spark, rows)))
    assert [(n_bytes, n_removed) for _, n_bytes, n_removed, _, _ in got] == [(len(t), len(long) + 2 if k < 2 else 0) for k, t in enumerate(rows)]
    assert got == plain(list(enumerate(rows)), 400)


@pytest.mark.parametrize("depth, shallow", [(40, 32), (40, 8), (24, 0), (9, 32), (5, 32)])
def test_deep_shallow_sorts_like_a_plain_sort(depth, shallow):
    r = random.Random(depth)
    for alphabet in (b"ab", bytes(range(256)), b"a"):
        text = bytes(r.choice(alphabet) for _ in range(700)) + b"abab" * 60
        starts = np.array([r.randrange(len(text) - depth + 1) for _ in range(400)])
        order, shared = repeats.deep_shallow(text, starts, depth, shallow)
        got = [text[s : s + depth] for s in starts[order]]
        assert sorted(order.tolist()) == list(range(400)) and got == sorted(got)
        common = lambda x, y: next((k for k in range(depth) if x[k] != y[k]), depth)  # noqa: E731, B023
        assert shared.tolist() == [0] + [common(x, y) for x, y in zip(got, got[1:])]
    assert [x.tolist() for x in repeats.deep_shallow(b"abc", np.zeros(0, np.int64), 2)] == [[], []]


def test_an_empty_table_and_clashing_columns(spark):
    assert repeats.digests(spark.createDataFrame([], DOCS)).count() == 0
    t = "0123456789" * 60
    d = spark.createDataFrame([(1, t, 2, 3, 4), (1, t, 2, 3, 4), (2, "x" + t, 2, 3, 4)], "doc_id long, text string, raw int, anchor int, `a.b` int")
    assert result(repeats.digests(d)) == plain([(1, t), (1, t), (2, "x" + t)], 400)
