"""Quotes and ranked retrieval against plain versions that look at every pair."""

import difflib
import math
import random
from collections import Counter

from quireworks.operators import quotes, retrieval


def plain_score(quote, text, least=0.85, stretch=1.2):
    if not quote or not text:
        return False, 0.0
    if quote in text:
        return True, 1.0
    same = lambda w: difflib.SequenceMatcher(None, quote, w).ratio()
    n, w, best = len(quote), max(len(quote), int(len(quote) * stretch)), 0.0
    if n > len(text):
        return same(text) >= least, same(text)
    for at in range(0, len(text) - w + 1, max(1, n // 4)):
        best = max(best, same(text[at : at + w]))
        if best >= least:
            return True, best
    if len(text) > w:
        best = max(best, same(text[-w:]))
    return best >= least, best


def edited(r, quote, kind, every):
    out = []
    for k, c in enumerate(quote):
        if k % every == every - 1:
            out += {"change": ["#"], "drop": [], "add": [c, "#"]}[kind]
        else:
            out.append(c)
    return "".join(out)


def material(seed, alphabet, size):
    r = random.Random(seed)
    say = lambda n: "".join(r.choice(alphabet) for _ in range(n))
    asked = [say(n) for n in (1, 3, 4, 5, 6, 7, 9, 14, 30, 120, 240)] + [""]
    texts = [say(size) for _ in range(4)] + ["", "ab"]
    for q in asked:
        for kind in ("change", "drop", "add"):
            for every in (4, 6, 8, 11, 15, 40):
                texts.append(say(r.randrange(60)) + edited(r, q, kind, every) + say(r.randrange(60)))
        texts += [q, q[1:], q + "x", say(20) + q]
    return asked, texts


def test_scores_equal_a_plain_walk():
    for seed, alphabet in ((1, "abcdefghijklmnopqrstuvwxyz"), (2, "abc"), (3, "中文字漢典籍卷之一二三")):
        asked, texts = material(seed, alphabet, 400)
        for q in asked:
            for t in texts:
                want = plain_score(q, t)
                got = quotes.score(q, t)
                assert got[0] == want[0] and math.isclose(got[1], want[1]), (q, t)
                assert quotes.score(q, t, stretch=1.0)[0] == plain_score(q, t, stretch=1.0)[0]


def test_a_change_every_eleven_characters_is_found(spark):
    r = random.Random(5)
    q = "".join(r.choice("abcdefghijklmnop") for _ in range(120))
    near = edited(r, q, "change", 11)
    for text, stretch in ((near, 1.0), (near + "zz", 1.0), ("#" * 30 + near + "#" * 41, 1.0), (near + "y" * 24, 1.2), (edited(r, q, "change", 17) + "y" * 24, 1.2)):
        assert quotes.score(q, text, stretch=stretch) == plain_score(q, text, stretch=stretch)
    hit = quotes.find_quotes(spark.createDataFrame([(1, q)], "quote_id int, quote string"), spark.createDataFrame([(1, near)], "card_id int, text string"), stretch=1.0).first()
    assert round(hit.score, 3) == 0.917 and quotes.score(q, near, stretch=1.0)[0]


def test_verdicts_equal_brute_force(spark):
    asked, texts = material(7, "abcdefghijkl", 300)
    asked += [asked[8], "  , ，"]
    q = spark.createDataFrame(list(enumerate(asked)), "quote_id int, quote string")
    c = spark.createDataFrame(list(enumerate([*texts, None])), "card_id int, text string")
    want = {(k, j): s for k, a in enumerate(asked) for j, t in enumerate(texts) for hit, s in [plain_score(a if k < len(asked) - 1 else "", t)] if hit}
    got = {(x.quote_id, x.card_id): x.score for x in quotes.find_quotes(q, c).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
    assert {(x.quote_id, x.card_id) for x in quotes.exact_quotes(q, c).collect()} == {k for k, s in want.items() if s == 1}
    rows = {r.quote_id: r for r in quotes.quote_verdicts(q, c).collect()}
    assert len(rows) == len(asked)
    for k in range(len(asked)):
        mine = [s for (i, _), s in want.items() if i == k]
        assert (rows[k].cards, rows[k].whole, rows[k].verdict) == (len(mine), mine.count(1), "verified" if mine else "fabricated")
        assert rows[k].best == (round(max(mine), 4) if mine else None)
    assert quotes.quote_verdicts(q.limit(0), c).count() == 0 and quotes.quote_verdicts(q, c.limit(0)).where("verdict = 'fabricated'").count() == len(asked)


def test_windows_of_many_quotes_and_texts_are_compared_at_once(monkeypatch):
    r, calls, common = random.Random(11), [], quotes.Bits.common
    monkeypatch.setattr(quotes.Bits, "common", lambda *a: calls.append(len(a[2])) or common(*a))
    words = ["".join(r.choice("aeioulmnrst") for _ in range(5)) for _ in range(60)]
    asked = ["".join(r.choice(words) for _ in range(n)) for n in (1, 4, 13, 26, 27, 40) for _ in range(4)]
    texts = ["".join(r.choice(words) for _ in range(r.randrange(90))) + (edited(r, asked[k % 24], ("change", "drop", "add")[k % 3], 19) if k % 2 else "") for k in range(60)] + ["", "zz"]
    want = {(k, j): s for k, q in enumerate(asked) for j, t in enumerate(texts) for hit, s in [plain_score(q, t)] if hit and q not in t}
    held = [{k for k, q in enumerate(asked) if q in t} for t in texts]
    for piece, most, steps in ((100_000, 4096, 8), (70, 7, 3)):
        calls.clear()
        monkeypatch.setattr(quotes, "PIECE", piece)
        monkeypatch.setattr(quotes, "WINDOWS", most)
        monkeypatch.setattr(quotes, "STEPS", steps)
        block = quotes.Block(asked, 0.85, 1.2)
        got = {(k, j): s for k, j, s in quotes.near_hits(block, texts, held)}
        assert got == want
        assert len(want) > 15
        assert max(calls) <= most and len(calls) <= len(block.groups) + sum(calls) / most


def test_matching_blocks_equal_those_of_difflib():
    r = random.Random(3)
    for alphabet in ("ab", "abcdefghijklmnopqrstuvwxyz", "aaaabcdeéfgh 中文字典"):
        for _ in range(150):
            a = "".join(r.choice(alphabet) for _ in range(r.randrange(260)))
            b = edited(r, a, r.choice(("change", "drop", "add")), r.randrange(2, 30)) if r.random() < 0.5 else "".join(r.choice(alphabet) for _ in range(r.choice((5, 150, 199, 200, 320))))
            want = difflib.SequenceMatcher(None, a, b)
            assert quotes.matching_blocks(a, b) == sum(m.size for m in want.get_matching_blocks()), (a, b)
            assert quotes.ratio(a, b) == want.ratio() and quotes.ratio(a, b, 0.6) == (want.ratio() if want.quick_ratio() >= 0.6 else 0.0)


def test_answers(spark):
    rows = [(1, ["alpha beta gamma delta [unit_3]", "alpha beta 参考 [gold_1]. ", "nothing like it", None], "say: Alpha; alpha beta gamma delta!"), (2, [], "x"), (3, None, None)]
    got = {r.answer_id: r for r in quotes.verify_answers(spark.createDataFrame(rows, "answer_id int, quotes array<string>, text string")).collect()}
    assert [d.matched for d in got[1].details] == [True, True, False, False] and got[1].details[0].score == 1.0 and got[1].details[1].clean_quote == "alpha beta"
    assert (got[1].claimed, got[1].verified, got[1].fabricated, got[1].fabrication_rate, got[1].verified_text) == (4, 2, 2, 0.5, "alpha beta gamma delta\nalpha beta")
    assert all((got[k].claimed, got[k].fabricated, got[k].fabrication_rate, got[k].verified_text) == (0, 0, 0.0, "") for k in (2, 3))


def plain_ranking(asked, cards, k):
    n, counts = len(cards), [retrieval.term_counts(t) for t in cards]
    df, dl = Counter(t for c in counts for t in c), [sum(c.values()) for c in counts]
    avg = sum(dl) / max(1, n)
    idf = {t: 1 + math.log((n + 1) / (d + 1)) for t, d in df.items()}
    norm = [math.sqrt(sum((tf / dl[j] * idf[t]) ** 2 for t, tf in c.items())) for j, c in enumerate(counts)]
    out = {"bm25": {}, "cosine": {}}
    for i, q in enumerate(asked):
        terms = retrieval.term_counts(q)
        total = sum(terms.values())
        qw = {t: f / total * idf[t] for t, f in terms.items() if t in df}
        qn = math.sqrt(sum(w * w for w in qw.values()))
        b = [sum(f * max(0, (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * dl[j] / max(1, avg))) for t, f in terms.items() if t in c) for j, c in enumerate(counts)]
        s = [sum(w * c[t] / dl[j] * idf[t] for t, w in qw.items() if t in c) / (norm[j] * qn) if norm[j] and qn else 0 for j, c in enumerate(counts)]
        for kind, scores in (("bm25", b), ("cosine", s)):
            out[kind][i] = [(j, round(scores[j], 6)) for j in sorted(range(n), key=lambda j: (-round(scores[j], 9), j)) if scores[j] > 0][:k]
    return out


def test_rankings_equal_scores_of_every_pair(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "GROUP_CARDS", 4)
    monkeypatch.setattr(retrieval, "QUERIES_BLOCK", 3)
    monkeypatch.setattr(retrieval, "TERMS_HELD", 20)
    r = random.Random(2)
    word = lambda: r.choice("alpha beta gamma delta epsilon zeta eta theta iota 商號 股分 kappa1.5".split())
    cards = ["".join(word() for _ in range(r.randrange(1, 30))) for _ in range(60)] + ["", "alpha", "alpha"]
    asked = ["".join(word() for _ in range(r.randrange(1, 6))) for _ in range(8)] + ["", "zz", "商號"]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    c = spark.createDataFrame([(f"c{k}", t, k) for k, t in enumerate(cards)], "card_id string, text string, ord int").repartition(3)
    want = plain_ranking(asked, cards, 7)
    found = retrieval.best(q, retrieval.Index(c), 7).collect()
    for kind in want:
        for k in range(len(asked)):
            got = [(x.ord, round(x.raw, 6)) for x in sorted((x for x in found if x.kind == kind and x.query_id == k), key=lambda x: x.rank)]
            assert got == want[kind][k], (kind, k)
    assert retrieval.hybrid(q.limit(0), c).count() == 0 and retrieval.bm25(q, c.limit(0)).count() == 0


def test_answers_are_dealt_over_all_cores(spark):
    rows = spark.createDataFrame([(1, ["a"], "a")], "answer_id int, quotes array<string>, text string")
    assert "REPARTITION_BY_NUM" in quotes.verify_answers(rows)._jdf.queryExecution().executedPlan().toString()
