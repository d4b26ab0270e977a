"""The llm operators against plain versions, exact round trips and held-out labels, and on odd inputs."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quireworks.llm import decontam, langid, lm, packing, setjoin, sharding, tokens, toxicity, vafile, warc

WORDS = "the of and in tion ing er on re at en haus zu und der die est que les el de la mañana straße élan".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, unit string, word string, key string, shard string"


def texts(n=60, seed=5):
    r = random.Random(seed)
    base = [" ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(r.randrange(1, 60))) for _ in range(n)]
    return [*base, base[0], base[0], base[1] + " x", None, "", "   ", "one", "!!! 123 <|endoftext|> \n\t", "long " * 3000]


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "en" if k % 2 else "fr", "s", 0, "u", "w", "k", "h") for k, t in enumerate(rows)], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, texts()).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def test_token_counts_equal_the_library(docs, nothing):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in tokens.token_counts(docs).collect()}
    for k, text in enumerate(texts()):
        assert got[k].n_tokens == len(t.encode(text or "", add_special_tokens=False).ids)
        assert got[k].n_bytes == len((text or "").encode()) and got[k].over_limit == (got[k].n_tokens > 1024)
    assert tokens.token_counts(nothing).count() == 0


def test_counter_on_random_strings():
    t, c, r = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), tokens.PairMergeCounter(public_tokenizers.path("byte_bpe_50k.json")), random.Random(1)
    parts = [" ", "  ", "\n", "a", "the", "'s", "é", "中", "12", "<|endoftext|>", "\x85", "😀", "."]
    for _ in range(3000):
        s = "".join(r.choice(parts) for _ in range(r.randrange(12)))
        assert c.count(s) == len(t.encode(s, add_special_tokens=False).ids), s


def test_word_ids_on_random_strings():
    path, r = public_tokenizers.path("word_bpe_49k.json"), random.Random(2)
    t, w = Tokenizer.from_file(path), packing.WordIds(path)
    parts = [*"aAbBé É'.,;:!?<|>3½中ªΣσςİß\u0301 \n\t\x0b\x1c\x85", "the", "Of,", "'s", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "😀"]
    cases = ["".join(r.choice(parts) for _ in range(r.randrange(20))) for _ in range(5000)]
    for text, got in zip(cases, w.encode_texts([c.encode() for c in cases])):
        assert np.frombuffer(got, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_packing_is_whole_and_tight(docs, nothing):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.pack(docs).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for k, text in enumerate(texts()):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(by_doc[k], key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes()) and p.doc_tokens == len(ids)
            at += p.length
        assert at == len(ids)
    for parts in by_seq.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    assert len(by_seq) <= math.ceil(sum(r.length for r in rows) / 2048) + 2
    assert packing.pack(nothing).count() == 0


def test_column_generation_reaches_the_bound():
    r = np.random.default_rng(0)
    sizes = np.ceil((r.lognormal(6.5, 1, 4000).astype(int) % 2048 + 1) / 8).astype(int)
    histogram = Counter(sizes.tolist())
    slots = packing.plan(dict(histogram), 256)
    used = Counter()
    for size, table in slots.items():
        for rank in range(histogram[size]):
            first, seq, each = table[np.searchsorted(table[:, 0], rank, side="right") - 1]
            used[seq + (rank - first) // each] += size
    assert max(used.values()) <= 256 and len(used) <= sizes.sum() / 256 * 1.01 + 3


def test_shards_are_near_equal_and_slots_gapless(docs, nothing):
    rows = sharding.shard(docs, 4).collect()
    assert len(rows) == docs.count()
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(r.size == len((t or "").encode()) + 1 and r.text_crc32 == zlib.crc32((t or "").encode()) for r, t in ((r, texts()[r.doc_id]) for r in rows))
    assert sharding.shard(nothing).count() == 0


def test_equal_texts_stay_in_one_shard_unless_they_fill_it(spark):
    r = random.Random(3)
    rows = [(k, " ".join(r.choice(WORDS) for _ in range(40))) for k in range(2000)]
    rows += [(5000 + k, "a hot text " * 40) for k in range(900)] + [(9000 + 10 * g + k, f"group {g} " * 60) for g in range(30) for k in range(8)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    of, sizes = {}, Counter()
    for x in got:
        of.setdefault(dict(rows)[x.doc_id], set()).add(x.shard)
        sizes[x.shard] += x.size
    hot = of.pop("a hot text " * 40)
    assert len(hot) > 1 and all(len(s) == 1 for s in of.values())  # the hot text fills more than a shard
    assert max(sizes.values()) - min(sizes.values()) < 0.02 * sum(sizes.values()) / 4
    plain = sharding.place(np.array([[3.0, 1, 1], [3, 1, 1], [2, 1, 1], [2, 1, 1], [2, 1, 1]]), 2)
    assert np.bincount(plain, [3, 3, 2, 2, 2], 2).tolist() in ([6, 6], [5, 7], [7, 5])


def test_room_raises_shards_to_one_level():
    loads = np.array([[5.0, 1], [0, 1], [2, 1], [9, 1]])
    assert sharding.room(loads, np.array([5.0, 8])).tolist() == [[0, 2], [3.5, 2], [1.5, 2], [0, 2]]
    assert sharding.room(loads, np.array([20.0, 0])).sum(axis=0).tolist() == [20, 0] and sharding.room(np.zeros((3, 3)), np.zeros(3)).sum() == 0


def plain_place(vectors, shards, capacity):
    """Each unit in turn, largest first, by plain loops."""
    total = [max(1.0, sum(v[d] for v in vectors)) for d in range(3)]
    whole = [sum(c[d] for c in capacity) for d in range(3)]
    left = [[c[d] / max(whole[d], 1e-9) * shards for d in range(3)] for c in capacity]
    out = {}
    for k in sorted(range(len(vectors)), key=lambda k: (-vectors[k][0], k)):
        unit = [vectors[k][d] / total[d] * shards for d in range(3)]
        fits = [s for s in range(shards) if left[s][0] >= unit[0]]
        best = max(fits, key=lambda s: (round(sum(w * u * x for w, u, x in zip(sharding.WEIGHTS, unit, left[s])), 9), -s)) if fits else max(range(shards), key=lambda s: (left[s][0], -s))
        out[k] = best
        left[best] = [x - u for x, u in zip(left[best], unit)]
    return [out[k] for k in range(len(vectors))]


def test_every_group_is_placed_by_its_own_vector(spark, monkeypatch):
    monkeypatch.setattr(sharding, "LOT_GROUPS", 40)
    monkeypatch.setattr(sharding, "RANKED_ROWS", 20)
    r = random.Random(12)
    rows = [(k, "w " * r.randrange(1, 60) + str(k % 150)) for k in range(400)] + [(500 + k, None) for k in range(300)] + [(900 + k, "big " * 300) for k in range(40)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    loads, counts = np.zeros(4), Counter()
    for x in got:
        loads[x.shard] += x.size
        counts[x.shard] += 1
    for s in range(4):
        assert sorted(x.slot for x in got if x.shard == s) == list(range(counts[s]))
    assert len(got) == len(rows) and loads.max() - loads.min() < 0.02 * loads.sum() / 4
    v = np.array([[r.randrange(1, 900), r.randrange(1, 99), r.randrange(1, 5)] for _ in range(60)], float)
    c = np.array([[r.random(), r.random(), r.random()] for _ in range(5)])
    assert sharding.place(v, 5, capacity=c).tolist() == plain_place(v.tolist(), 5, c.tolist())
    lots = spark.createDataFrame([(0, k, *map(int, x)) for k, x in enumerate(v)], "lot int, text_hash long, bytes long, tokens long, n long")
    homes = {x.text_hash: x.home for x in sharding.pack_lots(lots, c).collect()}
    assert [homes[k] for k in range(60)] == plain_place(v.tolist(), 5, c.tolist())


def test_packing_vectors_balance_a_dominant_group():
    v = np.array([[1.0, 1, 1]] * 400 + [[50.0, 10, 1]] * 16)
    got = np.bincount(sharding.place(v, 16), v[:, 0], 16)
    assert got.max() - got.min() <= 2


def test_archives_round_trip(spark, tmp_path):
    long = "x" * 120
    rows = [(5, "u", long), (3, None, long), (9, "u", long), (1, "a\nb", "short"), (2, "b", "short"), (4, "c", None), (6, "d", ""), (7, "é", "é" * 40_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    path = warc.archive(pages, f"file://{tmp_path}/w")
    got = {r.page_id: r for r in warc.read_archives(spark, path).collect()}
    assert len(got) == len(rows) and {k for k, r in got.items() if r.record_type == "revisit"} == {5, 9}
    assert got[5].refers_to == 3 and got[3].refers_to is None and got[5].payload_bytes == 120
    assert all(bytes(got[i].payload) == (h or "").encode() for i, _, h in rows if i not in (5, 9))
    empty = warc.archive(pages.limit(0), f"file://{tmp_path}/e")
    assert warc.read_archives(spark, empty).count() == 0


def test_archives_keep_large_ids_and_skip_what_a_lost_attempt_left(spark, tmp_path):
    long, other = "y" * 500, "z" * 500
    rows = [(9007199254740993, "u", long), (9007199254740995, "u", long), (None, "u", long), (None, "v", other), (7, "a", other), (7, "b", other), (8, "c", other)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    path = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/w")
    left = next(f for f in tmp_path.glob("w/part-*.warc.zst"))
    (left.parent / "part-000000-0000-lost.warc.zst").write_bytes(left.read_bytes())
    got = sorted(((r.page_id or 0, r.url, r.record_type, r.refers_to) for r in warc.read_archives(spark, path).collect()), key=str)
    big = 9007199254740993
    assert got == sorted([(big, "u", "response", None), (big + 2, "u", "revisit", big), (0, "u", "revisit", big), (0, "v", "revisit", 7), (7, "a", "response", None), (7, "b", "response", None), (8, "c", "revisit", 7)], key=str)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) >= min(int(before), 1000)


def test_reading_an_archive_is_linear():
    import time

    def seconds(n):
        w = warc.ArchiveWriter(b"WARC/1.1 text")
        for k in range(n):
            w.add(warc.record_bytes(k, "u", random.Random(k).randbytes(900) + b"a" * 900, "0", None))
        began = time.perf_counter()
        assert sum(1 for _ in warc.read_archive(w.out.getvalue())) == n
        return time.perf_counter() - began

    seconds(100)
    assert seconds(8000) < 40 * max(seconds(500), 0.005)


def brute_components(rows):
    sets = {}
    for k, t in enumerate(rows):
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    up = {k: k for k in sets}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {k: top(k) for k in sets}, {k: len(s) for k, s in sets.items()}


def test_set_join_equals_brute_force(spark, nothing):
    r = random.Random(9)
    rows = texts(30)
    for base in range(3):  # families of near copies, linked and nearly linked
        words = [r.choice(WORDS) + r.choice(WORDS) + str(r.randrange(99)) for _ in range(80 + 60 * base)]
        for _ in range(25):
            w = list(words)
            for _ in range(r.randrange(0, 6)):
                w[r.randrange(len(w))] = "changed%d" % r.randrange(10**6)
            rows.append(" ".join(w[: r.randrange(len(w) - 12, len(w))]))
    want, sizes = brute_components(rows)
    got = {x.doc_id: x for x in setjoin.near_duplicates(frame(spark, rows)).collect()}
    assert {k: g.component_id for k, g in got.items()} == want and {k: g.n_shingles for k, g in got.items()} == sizes
    assert setjoin.near_duplicates(nothing).count() == 0


def test_shared_signatures_keep_sets_whose_copies_come_first(spark):
    r = random.Random(3)
    base = [f"w{k}x{r.randrange(10**6)}" for k in range(100)]
    family = [" ".join([*base[:90], *(f"e{k}y{j}" for j in range(10))]) for k in range(24)]
    rows = [family[0], family[0], *family[1:]]  # more than LOCAL_MOST sets with shared tokens, copies of the first at the front
    none = np.zeros(0, dtype=[("token", np.uint64), ("rank", np.int64)])
    docs = spark.createDataFrame([(t,) for t in rows], "text string").select(F.col("text").cast("binary").alias("text")).coalesce(1)
    found = lambda n: {(x.token, x.key) for x in setjoin.shared_signatures(docs, none, 10_000_000_000, n).collect()}
    signed = {}
    for t in family:
        s = setjoin.shingle_set(t.encode())
        for token in (setjoin.signature(s, none) * setjoin._M1).view(np.int64).tolist():
            signed.setdefault(token, set()).add(setjoin.set_key(s))
    want = {(token, key) for token, keys in signed.items() if len(keys) > 1 for key in keys}
    assert want and found(0) == want and found(300_000) == want


def test_needed_is_the_least_that_links_share_or_fewer(spark):
    size = lambda m: m // 5 + -(-m // 16)
    r = random.Random(7)
    ranges = [(n, int(1.1**c - 1e-6), math.ceil(1.1 ** (c + 1) + 1e-6)) for n in [*range(1, 400), 1000, 2999, 99_999] for c in range(int(math.log(max(1, n * 0.7), 1.1)) - 1, int(math.log(n * 1.4, 1.1)) + 2)]
    ranges += [(n, lo, lo + r.randrange(60)) for n in range(1, 400) for lo in (r.randrange(max(1, n // 2), 2 * n + 1) for _ in range(4))]
    rows = spark.createDataFrame([(397, 461, 465), (245, 304, 304), *ranges], "n long, lo long, hi long")
    for x in rows.withColumn("needed", setjoin.needed(F.col("n"), F.col("lo"), F.col("hi"))).collect():
        bounds = [max(1, -(-4 * (x.n + m) // 9) - max(x.n - size(x.n), m - size(m))) for m in range(max(1, x.lo), x.hi + 1) if 4 * max(x.n, m) <= 5 * min(x.n, m)]
        if bounds:
            assert min(bounds) - 3 <= x.needed <= min(bounds), x
    for _ in range(300):
        n, none = r.randrange(1, 400), np.zeros(0, dtype=[("token", np.uint64), ("rank", np.int64)])
        a = {r.getrandbits(63) for _ in range(n)}
        b = {t for t in a if r.random() < 0.93} | {r.getrandbits(63) for _ in range(n // 20)}
        x, y = (np.array(sorted(t), np.uint64) for t in (a, b))
        if len(b) and setjoin.linked(x, y):
            shared = len(np.intersect1d(setjoin.signature(x, none), setjoin.signature(y, none)))
            assert shared >= max(1, -(-4 * (len(x) + len(y)) // 9) - max(len(x) - size(len(x)), len(y) - size(len(y))))


def test_a_link_at_the_bound_is_kept_among_large_holders_of_its_passage(spark):
    own = lambda d, n: [f"d{d}w{k}" for k in range(n)]
    passage = own("t", 248)
    rows = [" ".join([*passage, *own(0, 1)]), " ".join([*passage, *own(1, 60)]), *(" ".join([*passage, *own(d, 3000)]) for d in range(2, 62))]
    assert setjoin.linked(*(setjoin.shingle_set(t.encode()) for t in rows[:2]))
    got = {x.doc_id: x.component_id for x in setjoin.near_duplicates(frame(spark, rows)).collect()}
    assert got == {0: 0, 1: 0, **{d: d for d in range(2, 62)}}


def test_set_join_on_a_hot_group_and_rows_without_ids(spark, monkeypatch):
    from quireworks.llm import common

    monkeypatch.setattr(common, "HOT_SHARE", 1 / 20)  # copies of one text, and empty texts, are hot here
    r = random.Random(11)
    words = [r.choice(WORDS) + str(r.randrange(9999)) for _ in range(90)]
    chain = [" ".join(words[k : k + 80]) for k in range(0, 11)]  # each linked with the next ones
    rows = [(k, chain[0]) for k in range(40)] + [(100 + k, t) for k, t in enumerate(chain)] + [(200, ""), (201, None), (None, chain[0]), (None, "alone here"), (5, "an id again, with other words")]
    got = [(x.doc_id, x.n_shingles, x.component_id) for x in setjoin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(got) == len(rows) and {c for i, n, c in got if i is not None and n == 76} == {0}
    assert (200, 0, 200) in got and (201, 0, 201) in got and (None, 76, 0) in got and (None, 1, None) in got and (5, 2, 5) in got


def test_components_of_a_long_path(spark):
    r = random.Random(12)
    order = r.sample(range(80), 80)
    links = spark.createDataFrame([(order[k], order[k + 1]) for k in range(79)] + [(1000, 1001)], "a long, b long")
    got = {x.key: x.comp for x in setjoin.components(links).collect()}
    assert got == {**{k: 0 for k in range(80)}, 1000: 1000, 1001: 1000}


def test_decontamination_finds_edited_passages(spark, nothing):
    r = random.Random(4)
    items = [(k, " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(20 + k))) for k in range(12)]
    clean = " ".join(r.choice(WORDS) + str(r.randrange(5000)) for _ in range(300))
    rows, want = [clean, None, ""], set()
    for k, t in items:
        w = t.upper().split()
        w[7] = "edited"
        rows.append(f"{clean} {', '.join(w)}. {clean}")
        want.add((len(rows) - 1, k))
    bench = spark.createDataFrame([*items, (99, None), (98, "")], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontam.contamination(frame(spark, rows), bench).collect()}
    assert got == want
    assert {(x.doc_id, x.item_id) for x in decontam.contamination(frame(spark, rows), bench, block_bytes=400).collect()} == want
    assert decontam.contamination(nothing, bench).count() == 0


@pytest.mark.parametrize("size", [100, 160])
def test_decontamination_recall_of_long_items_at_the_edit_bound(size):
    r = random.Random(size)
    items = [[f"w{r.randrange(5000)}" for _ in range(size)] for _ in range(100)]
    rows = []
    for item in items:
        w = list(item)
        for k in range(decontam.edit_bound(size)):
            at, kind = r.randrange(len(w)), r.randrange(3)
            w[at : at + (kind != 1)] = [] if kind == 2 else [f"new{k}"]
        rows.append(" ".join([*(f"a{r.randrange(10**6)}" for _ in range(40)), *w, *(f"b{r.randrange(10**6)}" for _ in range(40))]))
    found = {(m[0], m[1]) for m in decontam.ItemIndex([(k, " ".join(w)) for k, w in enumerate(items)]).match(rows)}
    assert sum((k, k) in found for k in range(len(items))) >= 98


def test_viterbi_equals_plain_dynamic_programming():
    r = np.random.default_rng(0)
    for _ in range(60):
        lengths = r.integers(0, 40, 5)
        scores = r.normal(0, 3, (int(lengths.sum()), 3))
        got, at = langid.viterbi(scores, lengths, 2.0, 7), 0
        for n in lengths.tolist():
            s = scores[at : at + n]
            cost = lambda path, s=s: sum(s[i, k] for i, k in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:]))
            best = s[0].copy() if n else np.zeros(3)
            for i in range(1, n):
                best = np.maximum(best, best.max() - 2.0) + s[i]
            if n:
                assert cost(got[at : at + n].tolist()) == pytest.approx(best.max())
            at += n


def test_language_labels_and_spans(spark, nothing):
    fr, de = ("les élans de la maison est que vous " * 4), ("der hund und die katze zu straße haus " * 4)
    rows = [fr if k % 2 == 0 else de for k in range(40)] + [None, "", "123 !!", fr + de]
    d = spark.createDataFrame([(k, t, None if k >= 40 else ("fr", "de")[k % 2]) for k, t in enumerate(rows)], "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in langid.identify(d).collect()}
    assert all(got[k].lang_pred == ("fr", "de")[k % 2] for k in range(40)) and [got[k].lang_pred for k in (40, 41, 42)] == ["und"] * 3
    profiles = langid.fit(d)
    spans = sorted((s.first_word, s.lang) for s in langid.label_spans(d.where("doc_id = 43"), profiles).collect())
    assert [s[1] for s in spans] == ["fr", "de"]
    assert langid.identify(nothing).count() == 0 and {r.lang_pred for r in langid.predict(d, langid.fit(d.limit(0))).collect()} == {"und"}


def test_emoji_are_no_letters(spark):
    rows = ["les élans de la maison est que vous", "der hund und die katze zu straße haus"] * 20
    d = spark.createDataFrame([(k, t, ("fr", "de")[k % 2]) for k, t in enumerate(rows)], "doc_id long, text string, lang string")
    odd = spark.createDataFrame([(0, "😀 🎉"), (1, "12 😀😀"), (2, "🀄!")], "doc_id long, text string")
    got = langid.predict(odd, langid.fit(d)).collect()
    assert [g.lang_pred for g in got] == ["und"] * 3
    assert langid.WordGrams(["a😀", "𝐚𠀀", "😀"]).letters.tolist() == [1, 2, 0]


def test_language_model_base_score(docs, nothing):
    rows = [(t or "").encode().lower().split() for t in texts()]
    train, ends = Counter(), 0
    for k, w in enumerate(rows):
        if zlib.crc32(str(k).encode()) % 5 != 1:
            train.update(w)
            ends += 1
    total, kinds = sum(train.values()) + ends, len(train) + 1
    log = lambda c: math.log10((c + 0.5) / (total + 0.5 * (kinds + 1)))
    for r in lm.score(docs).collect():
        w = rows[r.doc_id]
        assert r.n_tokens == len(w) + 1 and r.n_known == sum(train[x] > 0 for x in w) + 1 and r.train_tokens == total
        assert r.base_score == pytest.approx(sum(log(train[x]) for x in w) + log(ends)) and r.score < 0
    assert lm.score(nothing).count() == 0


def test_language_model_places_rare_words_by_their_contexts(spark):
    r = random.Random(8)
    a, b = [f"{k}left" for k in range(600)], [f"{k}right" for k in range(600)]
    few_a, few_b = [f"p{k}same" for k in range(150)], [f"q{k}same" for k in range(150)]  # one ending for both sides
    rows = []
    for k in range(300):
        text = [w for _ in range(100) for w in (r.choice(a), r.choice(b))]
        for w, v in ((few_a[k % 150], 0), (few_b[k % 150], 1)):
            text[2 * r.randrange(50) + v] = w
        rows.append((k if zlib.crc32(str(k).encode()) % 5 != 1 else 1000 + next(x for x in range(k * 50, k * 50 + 50) if zlib.crc32(str(1000 + x).encode()) % 5 != 1), " ".join(text)))
    held = [x for x in range(100_000, 100_100) if zlib.crc32(str(x).encode()) % 5 == 1][:2]
    right, wrong = [w for k in range(100) for w in (few_a[k], few_b[k])], [*few_a[:100], *few_b[:100]]
    rows += [(held[0], " ".join(right)), (held[1], " ".join(wrong))]
    got = {x.doc_id: x for x in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).where(F.col("doc_id").isin(held)).collect()}
    assert got[held[0]].base_score == pytest.approx(got[held[1]].base_score)
    assert got[held[0]].score > got[held[1]].score + 50


def test_class_model_is_a_distribution_and_exchange_separates():
    big = np.zeros((1 + lm.WORD_UNITS + lm.ENDING_UNITS,) * 2)
    big[1:4, 4:7] = 10
    big[4:7, 1:4] = 10
    of = lm.exchange(big, 2)
    assert len(set(of[1:4])) == 1 and len(set(of[4:7])) == 1 and of[1] != of[4]
    m = lm.ClassModel(big, big.sum(axis=0), (big.sum(axis=0) > 0).astype(float), 8)
    assert np.allclose((10.0**m.transition).sum(axis=1), 1)


def test_toxicity_on_held_out_rows(spark, nothing):
    r = random.Random(2)
    bad = ["grumlow", "grumpot", "grumsel"]
    rows, labels = [], []
    for k in range(400):
        w = [r.choice(WORDS) + r.choice(WORDS) for _ in range(30)]
        if k % 6 == 0:
            w[3], w[9] = r.choice(bad), r.choice(bad)
        rows.append(" ".join(w))
        labels.append((k, 1, int(k % 6 == 0)))
    d, la = frame(spark, [*rows, None, ""]), spark.createDataFrame([*labels, (7, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(d, la)
    got = {x.doc_id: x for x in toxicity.score(d, model).collect()}
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all(got[k].held_out == (k in set(held)) for k in range(400))
    assert np.mean([got[k].predicted == int(k % 6 == 0) for k in held]) > 0.95
    assert got[400].predicted == 0 and 0 <= got[401].score <= 1
    assert ((model.label_model.rate > 0) & (model.label_model.rate < 1)).all() and model.label_model.parent[0] == -1
    assert toxicity.score(d, toxicity.fit(d, la.limit(0))).agg(F.max("score")).first()[0] < 0.01
    assert toxicity.score(nothing, model).count() == 0


def test_vector_search_equals_brute_force(spark):
    r = np.random.default_rng(1)
    v = r.normal(0, 0.2, (300, 8)).astype(np.float32)
    v[10] = v[11] = v[0]
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(300, None), (301, [1.0, None] * 4), (302, [float("nan")] * 8), (303, [0.5, 0.5])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    ints = np.floor(256 * v.astype(np.float64)).astype(int)
    got = {}
    for x in vafile.top_k(d, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    for q in range(0, 300, 50):
        scores = ints @ ints[q]
        want = sorted(((-int(s), k) for k, s in enumerate(scores) if k != q))[:5]
        assert sorted(got[q]) == [(i + 1, k, -s) for i, (s, k) in enumerate(want)]
    assert 300 not in got
    assert vafile.top_k(d.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_vector_search_over_blocks_with_ties_and_large_numbers(spark):
    r = np.random.default_rng(4)
    v = r.integers(-3, 4, (400, 4)).astype(float) / 256  # many ties at the kth score, over many blocks
    rows = [(7 * k - 900, x.tolist()) for k, x in enumerate(v)] + [(None, [1.0] * 4), (0, [0.5] * 4), (0, [0.5] * 4)]
    large = [(1, [1e8, -1e8, 3.0, 0.0]), (2, [1e8, 1e8, 0.0, 1.0]), (3, [3e38, 3e38, 3e38, 3e38])]
    for given, chosen in ((rows, F.col("vec_id") % 50 == 0), (rows[:50] + large, F.col("vec_id").isin(1, 2, 3))):
        d = spark.createDataFrame(given, "vec_id long, embedding array<double>")
        ints = [(i, [max(-(2**56), min(2**56, math.floor(256 * x))) for x in e]) for i, e in given if i is not None]
        want = []
        for q, a in ints:
            if q % 50 == 0 if chosen is not None and given is rows else q in (1, 2, 3):
                scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ints if i != q)[:5]
                want += [(q, n + 1, i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, i) in enumerate(scores)]
        got = [tuple(x) for x in vafile.top_k(d, chosen, block_rows=16).select("query_id", "rank", "vec_id", "score").collect()]
        assert sorted(got) == sorted(want)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(6)
    say = lambda: " ".join(r.choice(WORDS) + r.choice(WORDS) + r.choice(WORDS) for _ in range(60))
    rows = [say() for _ in range(40)]
    item = say()
    rows += [rows[0], rows[1] + " x", f"{say()} {item} {say()}", "12 34", None]
    assert corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows).limit(0), "").count() == 0
    frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == set(range(40))


def test_near_duplicate_stage_tells_rows_apart_by_id_and_text(spark):
    import corpus_pipeline

    r = random.Random(13)
    say = lambda n=60: " ".join(r.choice(WORDS) + str(r.randrange(9999)) for _ in range(n))
    a, b, c = say(), say(), say()
    rows = [(1, a, 1), (2, a, 2), (2, b, 3), (3, c, 4), (3, c, 4), (4, b + " x", 5), (5, "", 6), (6, None, 7), (None, a, 8), (7, say(), 9), (3, c + " x", 10)]
    d = spark.createDataFrame(rows, "doc_id long, text string, may int")
    got = sorted((x.doc_id if x.doc_id is not None else -1, x.text or "", x.may) for x in corpus_pipeline.drop_near_duplicates(spark, d, "").collect())
    third = [x for x in got if x[0] == 3]
    assert len(third) == 1 and third[0][1] in (c, c + " x")
    assert [x for x in got if x[0] != 3] == sorted([(-1, a, 8), (1, a, 1), (2, b, 3), (5, "", 6), (6, "", 7), (7, rows[9][1], 9)])


def plain_edits(item, text):
    """Least word edits of the item to any stretch of the text."""
    cost = [0] * (len(text) + 1)
    for k, w in enumerate(item, 1):
        new = [k]
        for j, v in enumerate(text, 1):
            new.append(min(cost[j - 1] + (w != v), cost[j] + 1, new[j - 1] + 1))
        cost = new
    return min(cost)


def test_decontamination_against_plain_edit_distance(spark):
    r = random.Random(21)
    say = lambda n: [r.choice(WORDS) + str(r.randrange(300)) for _ in range(n)]
    items = [say(n) for n in (3, 8, 20, 20, 45, 90, 600)] + [[]]
    rows = []
    for k in range(60):
        w = list(r.choice(items[:6]))
        for _ in range(r.randrange(0, len(w) // 3 + 1)):
            at, kind = r.randrange(max(1, len(w))), r.randrange(3)
            w[at : at + (kind != 1)] = [] if kind == 2 else say(1)
        rows.append([*say(r.randrange(30)), *w, *say(r.randrange(30))])
    rows += [items[6], [], say(5)]
    bench = spark.createDataFrame([(f"i{k}", " ".join(w), k) for k, w in enumerate(items)] + [("twin", " ".join(items[2]), 9)], "item_id string, text string, doc_id int")
    docs = spark.createDataFrame([(k // 2, " ".join(w), k) for k, w in enumerate(rows)], "doc_id int, text string, item_id int")
    got = {(x.doc_id, x.item_id) for x in decontam.contamination(docs, bench).collect()}
    named = [(f"i{k}", w) for k, w in enumerate(items)] + [("twin", items[2])]
    want = {(k // 2, i) for k, w in enumerate(rows) for i, item in named if item and plain_edits(item, w) <= decontam.edit_bound(len(item))}
    assert got <= want and len(got) >= 0.97 * len(want) and all((d, "twin") in got for d, i in got if i == "i2")


def test_language_of_one_long_text_equals_the_chunked_path():
    r = np.random.default_rng(5)
    scores, lengths = r.normal(0, 3, (900, 4)), np.array([500, 0, 400])
    value = lambda path: sum(scores[i, k] for i, k in enumerate(path)) - 12.0 * sum(a != b for at, n in ((0, 500), (500, 400)) for a, b in zip(path[at : at + n], path[at + 1 : at + n]))
    whole, lots, long = (langid.viterbi(scores, lengths, most=m).tolist() for m in (1 << 26, 9000, 10))
    assert value(whole) == pytest.approx(value(lots)) == pytest.approx(value(long))


def test_language_model_scores_do_not_depend_on_partitions(spark):
    r = random.Random(31)
    rows = [(k, " ".join(r.choice(WORDS) for _ in range(r.randrange(1, 12)))) for k in range(80)]
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    per_token = [x.score / x.n_tokens for x in got]
    assert all(s < 0 for s in per_token) and min(per_token) > -6
    # words of one class chain: equal texts have equal scores, and a text's score falls with each more token
    again = {x.doc_id: x.score for x in lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert all(again[x.doc_id] == pytest.approx(x.score) for x in got)


def test_conflicting_labels_count_as_toxic_whatever_the_order(spark):
    r = random.Random(41)
    rows = [(k, " ".join(["grumlow" if k % 4 == 0 else "fine", *(r.choice(WORDS) for _ in range(12))])) for k in range(200)]
    rows += [(1000 + k, rows[k][1]) for k in range(0, 40, 4)]
    labels = [(k, 1, int(k % 4 == 0)) for k in range(200)] + [(1000 + k, 1, 0) for k in range(0, 40, 4)] + [(0, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fits = [toxicity.fit(docs, spark.createDataFrame(order, "doc_id long, quality int, toxic int").repartition(n)) for order, n in ((labels, 1), (labels[::-1], 3))]
    assert fits[0].voters.entry.keys() == fits[1].voters.entry.keys() and fits[0].score(rows[0][1]) == pytest.approx(fits[1].score(rows[0][1]), abs=1e-6)


def test_vector_search_sends_no_table_through_the_driver(spark, monkeypatch):
    """Small whole numbers, and queries that stand there once for each lane, take many times the room of their files."""
    plans = []

    def durable(df, label, f=vafile.durable):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return f(df, label)

    monkeypatch.setattr(vafile, "durable", durable)
    monkeypatch.setattr(vafile, "BLOCK_QUERIES", 4)
    monkeypatch.setattr(vafile, "PART_BLOCKS", 2, raising=False)
    monkeypatch.setattr(vafile, "HELD_BLOCKS", 2, raising=False)
    v = np.random.default_rng(3).integers(-128, 128, (240, 6))
    d = spark.createDataFrame([(k, (x / 256).tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    got = sorted(tuple(x) for x in vafile.top_k(d, F.col("vec_id") % 7 == 0, block_rows=16).select("query_id", "rank", "vec_id", "score").collect())
    want = [(q, n + 1, k, -s) for q in range(0, 240, 7) for n, (s, k) in enumerate(sorted((-int(v[q] @ x), k) for k, x in enumerate(v) if k != q)[:5])]
    assert got == want
    assert any("MapInArrow" in p and "SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_vector_search_reads_in_the_order_of_bounds_and_stops(spark, monkeypatch):
    monkeypatch.setattr(vafile, "CELL_BITS", 2)
    monkeypatch.setattr(vafile, "FIRST_READ", 1)
    r = np.random.default_rng(9)
    base = r.normal(size=(500, 12))
    rows = [(k, v.tolist()) for k, v in enumerate(base)] + [(600 + k, base[7].tolist()) for k in range(200)]  # a vector with many copies
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    kept, members = vafile.distinct_vectors(vafile.integer_vectors(d), 5)
    assert kept.count() == 500 and members.count() == 499 + 6
    whole = vafile.durable(vafile.integer_vectors(d).withColumn("row", F.monotonically_increasing_id()), "t")
    queries = whole.where("vec_id % 50 = 7").withColumn("reach", F.lit(float("-inf")))
    near, reaching = vafile.candidates(vafile.durable(vafile.build_index(kept, 64), "t"), queries, 2, 5)
    best, read = vafile.read_in_order(near, reaching, kept, members, 5, "long")
    ints = {k: np.floor(256 * np.array(v)).astype(int) for k, v in rows}
    for q in {x.query_id for x in best.collect()}:
        want = sorted(((-int(ints[q] @ v), k) for k, v in ints.items() if k != q))[:5]
        assert [(-x.exact, x.vec_id) for x in best.where(F.col("query_id") == int(q)).orderBy("rank").collect()] == want
    assert 0 < read < near.count() < queries.count() * 500


def drawn_votes(r, n, copies):
    """Votes of three independent voters, and of copies of the first with some noise; classes with a third toxic."""
    y = r.random(n) < 0.3
    fires = lambda hit, false: np.where(y, r.random(n) < hit, r.random(n) < false)
    votes = np.zeros((n, toxicity.VOTERS), bool)
    votes[:, 0], votes[:, 1], votes[:, 2] = fires(0.8, 0.3), fires(0.7, 0.05), fires(0.6, 0.04)
    for k in copies:
        votes[:, k] = np.where(r.random(n) < 0.03, r.random(n) < 0.5, votes[:, 0])
    return y, votes


def test_label_model_tells_copied_voters_from_independent_ones():
    r = np.random.default_rng(1)
    y, votes = drawn_votes(r, 30_000, (4, 5, 6))
    bits = (votes << np.arange(toxicity.VOTERS)).sum(axis=1)
    labels = np.where(r.random(len(y)) < 0.1, np.where(r.random(len(y)) < 0.97, y, ~y), -1).astype(int)
    keys, n = np.unique(np.stack([bits, labels]), axis=1, return_counts=True)
    model = toxicity.LabelModel(keys[0], keys[1], n, 0.3)
    group = {0, 4, 5, 6}
    linked = {frozenset((k, int(p))) for k, p in enumerate(model.parent) if p >= 0}
    assert sum(pair <= group for pair in linked) == 3 and not any(len(pair & group) == 1 and pair & {1, 2} and model.parent is None for pair in linked)
    got = model.posterior(bits)
    truth = {}
    for b, c in zip(bits.tolist(), y.tolist()):
        truth.setdefault(b, []).append(c)
    often = [b for b, c in truth.items() if len(c) > 400]
    by = dict(zip(bits.tolist(), got.tolist()))
    assert max(abs(by[b] - np.mean(truth[b])) for b in often) < 0.12  # copies are not counted four times
    assert abs(model.right[1] - 0.97) < 0.04 and abs(model.right[0] - 0.97) < 0.04


def plain_posterior(model, bits, label):
    out = []
    for c, prior in ((0, 1 - model.prior), (1, model.prior)):
        p = prior
        for k in range(toxicity.VOTERS):
            above = model.parent[k] >= 0 and bits >> int(model.parent[k]) & 1
            rate = model.rate[c, int(above), k]
            p *= rate if bits >> k & 1 else 1 - rate
        if label >= 0:
            p *= model.right[c] if label == c else 1 - model.right[c]
        out.append(p)
    return out[1] / sum(out)


def test_label_posterior_and_scores_equal_plain_walks(spark):
    r = np.random.default_rng(2)
    _, votes = drawn_votes(r, 3000, (4,))
    bits = (votes << np.arange(toxicity.VOTERS)).sum(axis=1)
    model = toxicity.LabelModel(bits, np.where(r.random(3000) < 0.2, votes[:, 1], -1).astype(int), np.ones(3000), 0.2)
    for b in np.unique(bits)[:40].tolist():
        for label in (-1, 0, 1):
            assert math.isclose(float(model.posterior(np.array([b]), np.array([label]))[0]), plain_posterior(model, b, label), rel_tol=1e-9)
    rng = random.Random(3)
    bad = lambda: " ".join(rng.choice(WORDS) for _ in range(20)) + f" vile{rng.choice('xyz')} vile{rng.choice('xyz')} SCUM "
    rows = [(k, bad() if k % 3 == 0 else " ".join(rng.choice(WORDS) for _ in range(25))) for k in range(240)] + [(900, ""), (901, None), (902, "vilex " * 9000)]
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, `a.b` int")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(200)], "doc_id long, toxic int")
    classifier = toxicity.fit(docs, labels)
    for x in toxicity.score(docs, classifier).collect():
        found, n, density = classifier.voters.hits(dict(rows)[x.doc_id] or "")
        z = classifier.bias + sum(classifier.weights[k] * v for k, v in zip(*toxicity.features(found, n, density, len(classifier.voters.entry))))
        assert math.isclose(x.score, 1 / (1 + math.exp(-z)), rel_tol=1e-9) and x.predicted == int(x.score >= 0.3)
        assert x.doc_id >= 900 or x.predicted == int(x.doc_id % 3 == 0)


def test_a_sweep_moves_word_types_like_plain_loops(spark, monkeypatch):
    r = random.Random(21)
    kinds = [[b"red", b"blue", b"green"], [b"sun", b"moon", b"star"], [b"runs", b"walks", b"stops"]]
    texts_ = [[r.choice(kinds[k % 3]) for k in range(r.randrange(1, 14))] for _ in range(300)]
    counts = Counter(w for t in texts_ for w in t)
    order = sorted(counts, key=lambda w: (-counts[w], w))
    old = {w: r.randrange(1, 5) for w in order}
    size, end = 1 + lm.WORD_UNITS + lm.ENDING_UNITS, 0
    stub = lm.ClassModel.__new__(lm.ClassModel)
    stub.of = np.zeros(size, np.int64)
    sc = spark.sparkContext
    train = spark.createDataFrame([(bytearray(b" ".join(t)),) for t in texts_], "text binary")
    words = spark.createDataFrame([(bytearray(w), counts[w], old[w]) for w in order], "word binary, c long, cls int")
    lexicon, head = sc.broadcast(lm.Lexicon(order, [counts[w] for w in order])), sc.broadcast(np.array([old[w] for w in order], np.uint8))
    got = {bytes(x.word): (x.c, x.cls) for x in lm.exchange_words(train, words, lexicon, sc.broadcast(stub), head, np.zeros((lm.ENDING_UNITS, 2 * lm.CLASSES)), end, len(texts_)).collect()}
    table, seen = np.zeros((lm.CLASSES, lm.CLASSES)), {w: np.zeros(2 * lm.CLASSES) for w in order}
    for t in texts_:
        cls = [end, *(old[w] for w in t), end]
        for a, b in zip(cls, cls[1:]):
            table[a, b] += 1
        for k, w in enumerate(t, 1):
            seen[w][cls[k - 1]] += 1
            seen[w][lm.CLASSES + cls[k + 1]] += 1
    tokens, types = np.zeros(lm.CLASSES), np.zeros(lm.CLASSES)
    tokens[end], types[end] = len(texts_), 1
    for w in order:
        tokens[old[w]] += counts[w]
        types[old[w]] += 1
    model = lm.ClassModel.__new__(lm.ClassModel)
    model.fit(table, tokens, types)
    moved = 0
    for w in order:
        likely = [sum(seen[w][c] * model.transition[c, k] + seen[w][lm.CLASSES + c] * model.transition[k, c] for c in range(lm.CLASSES)) - counts[w] * model.denominator[k] for k in range(lm.CLASSES)]
        best = int(np.argmax(likely))
        want = best if likely[best] > likely[old[w]] + lm.MOVE_COST else old[w]
        moved += want != old[w]
        assert got[w] == (counts[w], want)
    assert moved


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(31)
    say = lambda n=50: " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))
    texts_ = [say() for _ in range(24)]
    texts_ += [texts_[0], None, "", "12 34", "long " * 4000 + say()]
    schema = "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, `c``d` int, may int, whole int, row int, found int, label int, score double, spread int"
    d = spark.createDataFrame([(k, t, "en" if k % 2 else "fr", "s", 0, *range(5), *range(2), 0.5, k) for k, t in enumerate(texts_)], schema)
    spark.createDataFrame([(k, 1, int(k == 3)) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, say())], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, d, str(tmp_path))
        assert got.schema.names == d.schema.names, name
        rows = {x.doc_id: x for x in got.collect()}
        assert rows and all(x["a.b"] == 0 and x["c`d"] == 1 and x["spread"] == k for k, x in rows.items()), name
    assert {x.doc_id for x in corpus_pipeline.STAGES[-1][1](spark, d, str(tmp_path)).collect()} == set(range(len(texts_)))
