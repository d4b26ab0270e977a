"""Alignment of two tokenizers over the same bytes, by elementary intervals.

Both token sequences of a text tile the same bytes. The union of their end offsets cuts the bytes into elementary
intervals; each has one owner on either side (a binary search among the ends), so each is one overlap of a token
of A with one of B, and every overlap is one interval. Ends that both sides share close a group; within a group the
product of its two lists of ids expands to the pairs that the group aligns.

`alignment` gives the groups themselves, `products` the corpus-wide table of id pairs that groups align, `digests`
figures of each text against the corpus-wide counts of linked pairs.

How the counts reach the texts. A first pass writes each text's links and gives (pair, links) already added up by
tasks; pairs are shuffled once, by id pair. The most frequent pairs (PAIRS_HELD at most) go to all tasks of a
second pass; links of other pairs, none of them frequent, meet their counts in a join. So no table grows in a
task, and the second pass makes no ids anew.

Defined cases: a text that is null or empty, or whose token bytes on either side are not its own (a tokenizer that
normalises), has no tokens, no groups and no links; special strings in a text are plain text; a repeated row
counts again; ties of the highest count all count as best; an empty table gives an empty result; other columns are ignored. Texts,
long ones too, are cut at single spaces between words, where neither tokenizer has a token across: both sides
have an end there, so a text's groups are those of its words, and a word that comes again is not encoded again.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quireworks.llm.common import durable, gives_back, small_batches
from quireworks.llm.tokens import byte_alphabet

#: Most frequent pairs handed to every task (17 bytes each); links whose pairs a task gathers before it adds them up.
PAIRS_HELD, FLUSH_LINKS = 1_000_000, 4_000_000
#: Characters of a word that is remembered, and bytes of all remembered words of a worker, about; characters encoded at once.
WORD_CHARS, WORDS_BYTES, ENCODED_CHARS = 64, 128 << 20, 200_000

_CUT = re.compile(r"(?<=\S) (?=\S)")
_STRAY = re.compile(r"\s\s|\s\Z|\A\s|[^\S ] | [^\S ]")


class ByteLevel:
    """Ids of a byte-level vocabulary (tokenizers library) for a space and the text, and the bytes of each id."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        alphabet = byte_alphabet()
        self.bytes = [b""] * (1 + max(self.library.get_vocab().values()))
        for entry, k in self.library.get_vocab().items():
            self.bytes[k] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()

    def ids(self, text: str) -> list[int]:
        return self.library.encode(" " + text, add_special_tokens=False).ids


class Pieces:
    """Ids of a sentencepiece model, which sets a space before the text itself, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.library.id_to_piece(k) for k in range(self.library.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.library.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(names)]

    def ids(self, text: str) -> list[int]:
        return self.library.encode(text)


def tokenizer(name: str) -> ByteLevel | Pieces:
    path = public_tokenizers.path(name)
    return ByteLevel(path) if name.endswith(".json") else Pieces(path)


def words(text: str) -> list[str]:
    """The text in parts, cut at single spaces that stand between other characters; each tokenizer puts that space before the next part."""
    return _CUT.split(text) if _STRAY.search(text) else text.split(" ")


def lots(parts: list[str], size: int | None = None) -> Iterator[str]:
    """Parts joined again by spaces, so many that a joined text has `size` characters, or one more part."""
    held, chars = [], 0
    for part in parts:
        held.append(part)
        chars += len(part) + 1
        if chars >= (size or ENCODED_CHARS):
            yield " ".join(held)
            held, chars = [], 0
    if held:
        yield " ".join(held)


class Sides:
    """Both tokenizers, with the length of each id's bytes and its decimal digits."""

    def __init__(self, first: str, second: str):
        self.both = tokenizer(first), tokenizer(second)
        self.lengths = [np.array([len(x) for x in side.bytes], np.int64) for side in self.both]
        self.width = max(len(str(len(side.bytes) - 1)) for side in self.both)
        self.digits = [np.array([str(k) for k in range(len(side.bytes))], f"S{self.width}").view(np.uint8).reshape(-1, self.width) for side in self.both]
        self.n_digits = [np.count_nonzero(d, axis=1) for d in self.digits]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of either side for a space and the text; None if either side's bytes are others."""
        want, found = (" " + text).encode(), []
        for side in self.both:
            ids = side.ids(text)
            if b"".join(map(side.bytes.__getitem__, ids)) != want:
                return None
            found.append(np.array(ids, np.int32))
        return found[0], found[1]

    def ids(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of either side; none on both if either side's bytes are not those of the text."""
        none = np.zeros(0, np.int32)
        parts = [self.encode(part) for part in lots(words(text))] if text else []
        if not parts or any(p is None for p in parts):
            return none, none
        return tuple(np.concatenate(side) for side in zip(*parts))

    def overlaps(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each elementary interval: its owner of either side (a position), and whether both end there."""
        ends_a, ends_b = np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b])
        ends = np.union1d(ends_a, ends_b)
        own_a, own_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        return own_a, own_b, (ends_a[own_a] == ends) & (ends_b[own_b] == ends) if len(ends) else np.zeros(0, bool)

    def written(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> bytes:
        """a1,a2|b1;a3|b2,b3: the groups in order, as ASCII; last_a and last_b are the positions where groups end."""
        place_a = np.arange(len(a)) + np.concatenate([[0], last_b + 1])[np.searchsorted(last_a, np.arange(len(a)))]
        place_b = np.arange(len(b)) + (last_a + 1)[np.searchsorted(last_b, np.arange(len(b)))]
        out = np.zeros((len(a) + len(b), self.width + 1), np.uint8)
        for k, ids, place, last, close in ((0, a, place_a, last_a, b"|"), (1, b, place_b, last_b, b";")):
            mark = np.full(len(ids), ord(","), np.uint8)
            mark[last] = close[0]
            out[place, : self.width] = self.digits[k][ids]
            out[place, self.width] = mark
        flat = out.ravel()
        return flat[flat != 0].tobytes()[:-1]


class Words:
    """What each word of a text adds: its tokens on either side, its links as numbers a * (ids of B) + b, its groups in writing; None for a word that a side does not give back."""

    def __init__(self, sides: Sides):
        self.sides, self.n_second = sides, len(sides.lengths[1])
        self.number = np.dtype("<u4") if len(sides.lengths[0]) * self.n_second < 1 << 32 else np.dtype("<i8")
        self.known: dict[str, tuple[int, int, bytes, bytes] | None] = {}
        self.before: dict[str, tuple[int, int, bytes, bytes] | None] = {}  # an older generation: words that come again are taken over
        self.held = 0

    def entries(self, texts: list[str | None]) -> Iterator[list[tuple[int, int, bytes, bytes] | None]]:
        """The entries of each text's words; new words of all texts are encoded together."""
        parts = [words(t) if t else [] for t in texts]
        if self.held > WORDS_BYTES / 2:
            self.before, self.known, self.held = self.known, {}, 0
        passing: dict[str, tuple[int, int, bytes, bytes] | None] = {}
        new, chars = [], 0
        for w in set().union(*parts).difference(self.known):
            if w in self.before:
                self.add(w, self.before[w])
            elif len(w) > WORD_CHARS:
                passing[w] = self.one(w)
            elif w[0].isspace() or w[-1].isspace():
                self.add(w, self.one(w))
            else:
                new.append(w)
                chars += len(w) + 1
                if chars > ENCODED_CHARS:
                    self.learn(new)
                    new, chars = [], 0
        if new:
            self.learn(new)
        for p in parts:
            yield [self.known[w] if w in self.known else passing[w] for w in p] if passing else list(map(self.known.__getitem__, p))

    def add(self, word: str, entry: tuple[int, int, bytes, bytes] | None) -> None:
        self.known[word] = entry
        self.held += 300 + len(word) + (len(entry[2]) + len(entry[3]) if entry else 0)

    def one(self, word: str) -> tuple[int, int, bytes, bytes] | None:
        both = self.sides.encode(word)
        if both is None:
            return None
        a, b = both
        own_a, own_b, shared = self.sides.overlaps(a, b)
        return len(a), len(b), self.links(a, b, own_a, own_b).tobytes(), self.sides.written(a, b, own_a[shared], own_b[shared])

    def links(self, a: np.ndarray, b: np.ndarray, own_a: np.ndarray, own_b: np.ndarray) -> np.ndarray:
        return (a[own_a].astype(np.int64) * self.n_second + b[own_b]).astype(self.number)

    def learn(self, new: list[str]) -> None:
        """Entries of many words from one encoding of them all; one by one if that does not give back its bytes."""
        both = self.sides.encode(" ".join(new))
        if both is None:
            for w in new:
                self.add(w, self.one(w))
            return
        a, b = both
        own_a, own_b, shared = self.sides.overlaps(a, b)
        last = np.cumsum([1 + len(w.encode()) for w in new])
        ends_a = np.cumsum(self.sides.lengths[0][a])
        ends = np.minimum(ends_a[own_a], np.cumsum(self.sides.lengths[1][b])[own_b])  # an interval ends with the first of its owners
        upto = lambda x: np.searchsorted(x, last, side="right").tolist()
        cut_a, cut_b, cut_links, cut_groups = upto(ends_a), upto(np.cumsum(self.sides.lengths[1][b])), upto(ends), upto(ends[shared])
        links, groups, size = self.links(a, b, own_a, own_b).tobytes(), self.sides.written(a, b, own_a[shared], own_b[shared]).split(b";"), self.number.itemsize
        na = nb = nl = ng = 0
        for w, xa, xb, xl, xg in zip(new, cut_a, cut_b, cut_links, cut_groups):
            self.add(w, (xa - na, xb - nb, links[nl * size : xl * size], b";".join(groups[ng:xg])))
            na, nb, nl, ng = xa, xb, xl, xg


@lru_cache(maxsize=1)
def worker_words(first: str, second: str) -> Words:
    """One for a worker: tasks that follow each other in it share the models and the words."""
    return Words(Sides(first, second))


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*parts, np.zeros(0, np.int64)]), kind))


def alignment(docs: DataFrame, first: str = "byte_bpe_50k.json", second: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id and groups, an array of (a, b, end): the ids of either side up to a shared end, and that end in bytes of a space and the text."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = None
        for batch in batches:
            sides = sides or Sides(first, second)
            all_a, all_b, cuts_a, cuts_b, ends, sizes = [], [], [0], [0], [], []
            for text in batch.column("text").to_pylist():
                a, b = sides.ids(text)
                own_a, own_b, shared = sides.overlaps(a, b)
                cuts_a += (own_a[shared] + 1 + sum(map(len, all_a))).tolist()
                cuts_b += (own_b[shared] + 1 + sum(map(len, all_b))).tolist()
                ends.append(np.cumsum(sides.lengths[0][a])[own_a[shared]])
                all_a.append(a)
                all_b.append(b)
                sizes.append(int(shared.sum()))
            list_of = lambda cuts, parts: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate([*parts, np.zeros(0, np.int32)])))
            groups = pa.StructArray.from_arrays([list_of(cuts_a, all_a), list_of(cuts_b, all_b), pa.array(np.concatenate([*ends, np.zeros(0, np.int64)]))], ["a", "b", "end"])
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, groups)], ["doc_id", "groups"])

    return docs.select("doc_id", "text").mapInArrow(gives_back(run), f"doc_id {kind}, groups array<struct<a: array<int>, b: array<int>, end: bigint>>")


def products(docs: DataFrame, first: str = "byte_bpe_50k.json", second: str = "piece_bpe_32k.model") -> DataFrame:
    """a, b, groups: in how many groups, each with its multiplicity, an id of A stands with an id of B (the product of a group's two lists). Both lists of a group lie between two shared ends, so they are as short as the words of a text; pairs are added up before the shuffle."""
    group = alignment(docs, first, second).select(F.explode("groups").alias("g"))
    return group.select(F.explode("g.a").alias("a"), "g.b").select("a", F.explode("b").alias("b")).groupBy("a", "b").agg(F.count("*").alias("groups"))


def encoded(docs: DataFrame, first: str, second: str) -> DataFrame:
    """Two kinds of rows, written once: of each text (pair null) its figures and its links as numbers; of each pair (doc_id null) the links that a task gathered."""
    small_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType
    names = ["doc_id", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "linked", "pair", "links"]
    kinds = [pa.int64()] * 5 + [pa.string(), pa.binary(), pa.int64(), pa.int64()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, kept, held, id_kind = None, [], 0, None

        def added() -> pa.RecordBatch:
            pair, links = np.unique(np.concatenate(kept), return_counts=True)
            none = [pa.nulls(len(pair), t) for t in (id_kind, *kinds[:7])]
            return pa.RecordBatch.from_arrays([*none, pa.array(pair.astype(np.int64)), pa.array(links.astype(np.int64))], names)

        for batch in batches:
            known, id_kind = known or worker_words(first, second), batch.schema.field("doc_id").type
            cols: list[list] = [[] for _ in range(6)]
            for entries in known.entries(batch.column("text").to_pylist()):
                if not entries or None in entries:
                    row = (0, 0, 0, 0, "", b"")
                else:
                    na, nb, links, groups = zip(*entries)
                    linked, written = b"".join(links), b";".join(groups)
                    row = (sum(na), sum(nb), written.count(b";") + 1, len(linked) // known.number.itemsize, hashlib.sha256(written).hexdigest(), linked)
                    kept.append(np.frombuffer(linked, known.number))
                    held += row[3]
                for col, value in zip(cols, row):
                    col.append(value)
                if held > FLUSH_LINKS:
                    yield added()
                    kept, held = [], 0
            n = batch.num_rows
            rest = [pa.array(c, t) for c, t in zip(cols, kinds[1:7])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), *rest, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names)
        if held:
            yield added()

    source = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    return source.mapInArrow(
        gives_back(run),
        f"doc_id {id_type.simpleString()}, row bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, linked binary, pair bigint, links bigint",
    )


def pair_counts(found: DataFrame, n_second: int) -> DataFrame:
    """pair, links, best: the corpus-wide links of each id pair, and whether no pair of its B id has more. There is one highest count for each id of B, so that side is as small as a vocabulary."""
    counts = durable(found.where("pair is not null").groupBy("pair").agg(F.sum("links").alias("links")), "pairs")
    b = (F.col("pair") % n_second).alias("b")
    most = counts.groupBy(b).agg(F.max("links").alias("most"))
    return counts.withColumn("b", F.col("pair") % n_second).join(F.broadcast(most), "b").select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


def frequent(counts: DataFrame, held: int) -> tuple[np.ndarray, int]:
    """The pairs with `least` links or more, as sorted records, and that least count: a power of two at which they are `held` at most."""
    levels = counts.groupBy(F.floor(F.log2("links")).alias("level")).count().orderBy(F.desc("level")).collect()
    least, total = 1 << 62, 0
    for r in levels:
        total += r["count"]
        if total > held:
            break
        least = 1 << r.level
    rows = counts.where(F.col("links") >= least).toArrow()
    out = np.zeros(rows.num_rows, [("pair", np.int64), ("links", np.int64), ("best", bool)])
    for name in out.dtype.names:
        out[name] = rows.column(name).to_numpy()
    return np.sort(out, order="pair"), least


def digests(docs: DataFrame, first: str = "byte_bpe_50k.json", second: str = "piece_bpe_32k.model", held: int = PAIRS_HELD) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best counts the links whose pair has its B id's highest count in the corpus, count_sum adds the counts of all
    links, groups_sha256 is the digest of `a1,a2|b1;a3|b2,b3`, empty without tokens.
    """
    spark = docs.sparkSession
    n_first, n_second = len(tokenizer(first).bytes), len(tokenizer(second).bytes)
    found = durable(encoded(docs, first, second), "alignments", compression="zstd")
    counts = durable(pair_counts(found, n_second), "pair-counts")
    known, least = frequent(counts, held)
    shared = spark.sparkContext.broadcast((known["pair"], known["links"], known["best"]))
    number = "<u4" if n_first * n_second < 1 << 32 else "<i8"
    texts = found.where("pair is null").drop("pair", "links")
    names = [f.name for f in texts.schema if f.name != "linked"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, links, best = shared.value
            n_best, count_sum, rare, times = [], [], [], []
            for raw in batch.column("linked"):
                pair = np.frombuffer(raw.as_buffer(), number).astype(np.int64)
                at = np.minimum(np.searchsorted(pairs, pair), max(len(pairs) - 1, 0))
                hit = pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool)
                n_best.append(int(np.count_nonzero(best[at[hit]])))
                count_sum.append(int(links[at[hit]].sum()))
                some, n = np.unique(pair[~hit], return_counts=True)
                rare.append(some)
                times.append(n.astype(np.int64))
            made = [pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), _lists(rare, pa.int64()), _lists(times, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *made], [*names, "n_best", "count_sum", "rare", "times"])

    kinds = T.StructType([f for f in texts.schema if f.name in names])
    for name, kind in (("n_best", T.LongType()), ("count_sum", T.LongType()), ("rare", T.ArrayType(T.LongType())), ("times", T.ArrayType(T.LongType()))):
        kinds = kinds.add(name, kind)
    scored = durable(texts.mapInArrow(gives_back(run), kinds), "alignments-scored")
    spread = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("pair"), F.col("x.times").alias("times"))
    rest = (
        spread.join(counts.where(F.col("links") < least), "pair")
        .groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("links")).alias("more"))
    )
    both = scored.drop("rare", "times").join(rest, "row", "left")
    whole = lambda c, more: (F.col(c) + F.coalesce(more, F.lit(0))).alias(c)
    return both.select("doc_id", "n_a", "n_b", "n_groups", "n_links", whole("n_best", "more_best"), whole("count_sum", "more"), "groups_sha256")
