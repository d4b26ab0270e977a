"""The array forms of the language model's passes against plain loops."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from quireworks.llm import lm

ODD = [b"", b"   ", b" \tA  bc\x0b\x0c\r\nA ", b"x\x1cy\x85z \xff\xfe Q\xc3\x89 \xc2\xa0", b"a\x00b c", b"one " * 700 + b"Two"]


class Taken:
    """Stands for a table: keeps the function that a pass hands to mapInArrow."""

    def mapInArrow(self, run, schema):
        self.run = run
        return self

    def groupBy(self, *_):
        return self

    def agg(self, *_):
        return self


class Shared:
    def __init__(self, value):
        self.value = value


def batches(texts, size=2):
    return iter([pa.RecordBatch.from_arrays([pa.array(texts[k : k + size], pa.binary())], ["text"]) for k in range(0, len(texts), size)])


def test_words_of_texts_equal_plain_splits():
    for texts in (ODD, ODD[:2], [], ODD[5:]):
        words, at, lengths = lm.words_of(pa.array(texts, pa.binary()))
        want = [t.lower().split() for t in texts]
        assert [words[k].as_py() for k in at.tolist()] == [w for t in want for w in t]
        assert lengths.tolist() == list(map(len, want)) and len(set(words.to_pylist())) == len(words)
    part = pa.array(ODD, pa.binary()).slice(2, 3)
    assert lm.words_of(part)[2].tolist() == [3, 4, 2]


def test_ending_units_equal_those_of_single_words():
    r = random.Random(3)
    words = [bytes(r.randrange(256) for _ in range(r.randrange(9))) for _ in range(2000)]
    column = pa.array(words, pa.binary())
    assert lm.ending_units(column).tolist() == [lm.ending_unit(w) for w in words]
    assert lm.ending_units(column.slice(11, 50)).tolist() == [lm.ending_unit(w) for w in words[11:61]]
    assert lm.ending_units(column.slice(0, 0)).tolist() == []


def test_a_pass_looks_up_each_different_word_once(spark):
    asked = []

    class Asked(lm.Lexicon):
        def units(self, words):
            asked.append(len(words))
            return super().units(words)

    texts = [b"red blue " * 400 + b"green"] * 6
    model = lm.ClassModel.__new__(lm.ClassModel)
    model.of = np.zeros(1 + lm.WORD_UNITS + lm.ENDING_UNITS, np.int64)
    for start in (lambda t, lex: lm.count_bigrams(t, lex), lambda t, lex: lm.count_contexts(t, lex, Shared(model))):
        asked.clear()
        taken = Taken()
        start(taken, Shared(Asked([b"red"], [9])))
        list(taken.run(batches(texts)))
        assert sum(asked) == 3  # 4,806 tokens


def test_counts_of_a_task_equal_plain_loops(spark, monkeypatch):
    r = random.Random(5)
    texts = ODD + [b" ".join(b"w%d" % r.randrange(60) for _ in range(r.randrange(30))) for _ in range(80)]
    want = Counter(w for t in texts for w in t.lower().split())
    order = [b"w%d" % k for k in range(20)]
    lexicon, unit = Shared(lm.Lexicon(order, [1] * 20)), lambda w: 1 + order.index(w) if w in order else lm.ending_unit(w)
    model = lm.ClassModel.__new__(lm.ClassModel)
    model.of = np.random.default_rng(7).integers(0, lm.CLASSES, 1 + lm.WORD_UNITS + lm.ENDING_UNITS)
    pairs, contexts = Counter(), Counter()
    for t in texts:
        w = t.lower().split()
        units = [0, *map(unit, w), 0]
        pairs.update(zip(units, units[1:]) if w else [(0, 0)])
        for k, x in enumerate(w, 1):
            if x not in order:
                contexts.update([(x, int(model.of[units[k - 1]])), (x, lm.CLASSES + int(model.of[units[k + 1]]))])
    for flush, size in ((300_000, 4 << 20), (3, 1)):
        monkeypatch.setattr(lm, "FLUSH_WORDS", flush)
        lots = lm.in_lots
        with monkeypatch.context() as m:
            m.setattr(lm, "in_lots", lambda rows, lots=lots, size=size: lots(rows, None, size))
            got, taken = Counter(), Taken()
            lm.count_words(taken)
            for b in taken.run(batches(texts)):
                got.update(dict(zip(b.column("word").to_pylist(), b.column("c").to_pylist())))
            assert got == want
            taken = Taken()
            lm.count_bigrams(taken, lexicon)
            assert Counter({(p, n): c for b in taken.run(batches(texts)) for p, n, c in zip(*(x.to_pylist() for x in b.columns))}) == pairs
            got, taken = Counter(), Taken()
            lm.count_contexts(taken, lexicon, Shared(model))
            for b in taken.run(batches(texts)):
                for w, packed in zip(*(x.to_pylist() for x in b.columns)):
                    got.update({(w, int(code)): int(n) for code, n in np.frombuffer(packed, lm._CONTEXT)})
            assert got == contexts


def test_runs_of_a_key_are_not_cut_by_batches(monkeypatch):
    r = random.Random(9)
    keys = sorted(b"k%d" % r.randrange(40) for _ in range(300))
    rows = [pa.RecordBatch.from_arrays([pa.array(keys[k : k + 7], pa.binary()), pa.array(range(k, min(k + 7, 300)))], ["word", "n"]) for k in range(0, 300, 7)]
    for most in (1, 20, 1000):
        monkeypatch.setattr(lm, "WORDS_AT_ONCE", most)
        found, seen = [], []
        for lot, begin in lm.whole_runs(iter(rows), "word"):
            ends = [*begin.tolist()[1:], len(lot)]
            for b, e in zip(begin.tolist(), ends):
                word = set(lot.column("word").slice(b, e - b).to_pylist())
                assert len(word) == 1
                found += word
            seen += lot.column("n").to_pylist()
        assert found == sorted(set(keys)) and seen == list(range(300))
    assert list(lm.whole_runs(iter([]), "word")) == []
