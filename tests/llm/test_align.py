"""Alignment of two tokenizers against a plain walk over bytes, on odd texts and odd tables."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quireworks.llm import align
from tests.llm.test_llm import DOCS, frame, texts

ODD = ["a  b", " a", "a ", "é́x", "<s>x</s> <|endoftext|>", "<0x41>", "a\tb\n", "　a", "▁a", "a\x00b", "ﬁn", "中文字 text 中", "😀", " ", "\r\n\r\n", "x" * 700]


def plain(rows):
    """The contract's figures by plain loops over byte positions."""
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    alphabet = align.byte_alphabet()
    found = []
    for doc_id, text in rows:
        a, b = [], []
        if text:
            a = [(k, bytes(alphabet[c] for c in first.id_to_token(k))) for k in first.encode(" " + text, add_special_tokens=False).ids]
            b = [(k, bytes([int(second.id_to_piece(k)[3:5], 16)]) if second.is_byte(k) else second.id_to_piece(k).replace("▁", " ").encode()) for k in second.encode(text)]
            if b"".join(x for _, x in a) != (" " + text).encode() or b"".join(x for _, x in b) != (" " + text).encode():
                a, b = [], []
        owners_a, owners_b = [k for k, (_, x) in enumerate(a) for _ in x], [k for k, (_, x) in enumerate(b) for _ in x]
        ends = lambda own: {p + 1 for p in range(len(own)) if p + 1 == len(own) or own[p] != own[p + 1]}
        shared = sorted(ends(owners_a) & ends(owners_b))
        groups, at = [], 0
        for end in shared:
            part = lambda own, side: ",".join(str(side[k][0]) for k in dict.fromkeys(own[at:end]))  # noqa: B023, E731
            groups.append(f"{part(owners_a, a)}|{part(owners_b, b)}")
            at = end
        links = [(a[x][0], b[y][0]) for x, y in dict.fromkeys(zip(owners_a, owners_b))]
        found.append((doc_id, len(a), len(b), len(groups), links, ";".join(groups)))
    counts = Counter(x for row in found for x in row[4])
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [
        (d, na, nb, ng, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(s.encode()).hexdigest() if s else "")
        for d, na, nb, ng, links, s in found
    ]


NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("held", [align.PAIRS_HELD, 12, 0])
def test_digests_equal_a_plain_walk(spark, held):
    rows = texts() + ODD + ODD[:3]
    got = sorted(tuple(r[c] for c in NAMES) for r in align.digests(frame(spark, rows), held=held).collect())
    assert got == sorted(plain(list(enumerate(rows))))


def test_words_are_cut_where_no_token_crosses(monkeypatch):
    r, sides = random.Random(4), align.Sides("byte_bpe_50k.json", "piece_bpe_32k.model")
    parts = ["the", "Of", "12", " ", " ", "  ", "\n", "é", "中", "'s", " a", " b", " 7", ",", ". ", "\t", "\u3000", "\u0301", "\x1c", "▁", "y" * 70]
    known = align.Words(sides)
    monkeypatch.setattr(align, "ENCODED_CHARS", 30)
    monkeypatch.setattr(align, "WORDS_BYTES", 3000)
    for _ in range(40):
        texts = ["".join(r.choice(parts) for _ in range(r.randrange(1, 60))) for _ in range(12)]
        for text, entries in zip(texts, known.entries(texts)):
            whole = sides.encode(text)
            assert " ".join(align.words(text)) == text and (whole is None) == (None in entries)
            cut = sides.ids(text)
            if whole is None:
                assert not len(cut[0])
                continue
            a, b = whole
            assert a.tolist() == cut[0].tolist() and b.tolist() == cut[1].tolist(), text
            own_a, own_b, shared = sides.overlaps(a, b)
            assert (sum(e[0] for e in entries), sum(e[1] for e in entries)) == (len(a), len(b))
            assert b"".join(e[2] for e in entries) == known.links(a, b, own_a, own_b).tobytes()
            assert b";".join(e[3] for e in entries) == sides.written(a, b, own_a[shared], own_b[shared])


def test_groups_and_products(spark):
    rows = texts(12) + ODD
    sides = align.Sides("byte_bpe_50k.json", "piece_bpe_32k.model")
    got = {r.doc_id: r.groups for r in align.alignment(frame(spark, rows)).collect()}
    want = Counter()
    for k, text in enumerate(rows):
        raw, at = (" " + text).encode() if text else b"", 0
        assert [x for g in got[k] for x in g.a] == sides.ids(text)[0].tolist() and [x for g in got[k] for x in g.b] == sides.ids(text)[1].tolist()
        for g in got[k]:
            for ids, side in ((g.a, 0), (g.b, 1)):
                assert b"".join(sides.both[side].bytes[i] for i in ids) == raw[at : g.end]
            want.update((x, y) for x in g.a for y in g.b)
            at = g.end
    assert {(r.a, r.b): r.groups for r in align.products(frame(spark, rows)).collect()} == want


def test_an_empty_table_and_clashing_columns(spark):
    assert align.digests(spark.createDataFrame([], DOCS)).count() == 0
    d = spark.createDataFrame([(7, "one two", 1, 2, 3)], "doc_id long, text string, row int, pair int, `a.b` int")
    assert [tuple(r[c] for c in NAMES) for r in align.digests(d).collect()] == plain([(7, "one two")])
