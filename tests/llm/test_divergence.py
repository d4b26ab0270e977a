"""Source divergence against a plain walk, on odd texts and odd tables."""

import random
import re
from collections import Counter, defaultdict

import pytest

from quireworks.llm import divergence
from tests.llm.test_llm import DOCS


def plain(rows, shown=200):
    word = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held, count, groups = Counter(), Counter(), defaultdict(set)
    for text, lang, source in rows:
        words = word.findall((text or "").translate(lower))
        groups[lang or ""].add(source or "")
        count.update((lang or "", source or "", w) for w in words)
        held.update((lang or "", w) for w in set(words))
    out = []
    for lang, sources in groups.items():
        terms = [w for (x, w), n in held.items() if x == lang and n >= 3]
        n = {s: sum(count[lang, s, w] for w in terms) for s in sources}
        p = lambda c, total: 1 + 10**9 * (c + 1) // (total + len(terms))  # noqa: B023, E731
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(-sum(f(p(count[lang, s, w], n[s]), p(count[lang, t, w], n[t])) for w in terms), t) for t in sources if t != s]
            q = {w: p(sum(count[lang, t, w] for t in sources), sum(n.values())) for w in terms}
            own = [(-f(p(count[lang, s, w], n[s]), q[w]), w) for w in terms if count[lang, s, w] and p(count[lang, s, w], n[s]) > q[w]]
            for part, found in (("pair", pairs), ("term", sorted(own, key=lambda x: (x[0], x[1].encode()))[:shown])):
                out += [(lang, s, part, item, -v, k) for k, (v, item) in enumerate(sorted(found, key=lambda x: (x[0], x[1].encode())), 1)]
    return out


def table(spark, rows):
    return spark.createDataFrame([(k, t, lang, s, 0, "u", "w", "k", "h") for k, (t, lang, s) in enumerate(rows)], DOCS)


@pytest.mark.parametrize("broadcast", [divergence.GROUPS_BROADCAST, 0])
def test_audit_equals_a_plain_walk(spark, broadcast):
    r = random.Random(8)
    words = "a The THE élan Élan straße 中文 x1y tion of-the \x00z ÀÉ ß the,and".split() + [f"w{k}" for k in range(30)]
    rows = [(" ".join(r.choice(words) for _ in range(r.randrange(40))), r.choice(["en", "fr", None]), r.choice(["s1", "s2", "S3", None])) for _ in range(120)]
    rows += [("only here", "xx", "s1"), (None, "xx", "s9"), ("", "yy", "s"), ("123 !!", "en", "silent"), *[("tie tie tie", "zz", s) for s in ("a", "b", "c", "a")], ("long " * 20000, "en", "s1"), *rows[:4]]
    got = sorted(tuple(x) for x in divergence.audit(table(spark, rows), broadcast).collect())
    assert got == sorted(plain(rows))


def test_only_the_first_terms_are_shown(spark):
    rows = [(" ".join(f"t{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(260)), "en", "a")] * 3 + [("other words", "en", "b")] * 3
    got = sorted(tuple(x) for x in divergence.audit(table(spark, rows)).collect())
    assert got == sorted(plain(rows)) and sum(x[2] == "term" and x[1] == "a" for x in got) == 200


def test_an_empty_table_and_odd_columns(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0
    d = spark.createDataFrame([("a b", "en", "x", 1, 2), ("a b", "en", "y", 1, 2), ("a", "en", "y", 1, 2)], "text string, lang string, source string, `a.b` int, term int")
    assert sorted(tuple(x) for x in divergence.audit(d).collect()) == sorted(plain([("a b", "en", "x"), ("a b", "en", "y"), ("a", "en", "y")]))


def test_probabilities_of_large_counts_are_exact(spark):
    from pyspark.sql import functions as F

    r = random.Random(3)
    cases = [(c, c + r.randrange(1, 10**15)) for c in (0, 1, 10**6, 10**10, 10**14, 8 * 10**15) for _ in range(5)]
    got = spark.createDataFrame(cases, "c long, t long").select("c", "t", divergence.probability(F.col("c"), F.col("t")).alias("p")).collect()
    assert all(x.p == 1 + 10**9 * (x.c + 1) // x.t for x in got)
