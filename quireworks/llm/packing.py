"""Packing token sequences by cutting stock with column generation.

Documents are cut into full sequences and one remainder. Remainders are counted in a length histogram; a
linear program over patterns (which lengths share a sequence) is solved by column generation: the duals of
the restricted program price lengths, a knapsack dynamic program finds the best new pattern, until none
improves. Patterns are rounded down, what is left over is placed first-fit decreasing, and pieces take the
slots of the patterns by their rank within their length.

Defined cases: null and empty texts have the end id only; a document of any length is cut, never dropped;
repeated rows are pieces of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quireworks.llm.common import durable, gives_back, small_batches

#: Tokens of a sequence, tokens of a length class, and salts that split the ranking of a hot class.
CAPACITY, GRAIN, SALTS = 2048, 8, 64
#: Bytes of words and ids that a worker remembers, in two generations, and what an entry takes besides them.
CACHE_BYTES, ENTRY_BYTES = 64 << 20, 200
END_ID = 1


_POINTS = b".,;:!?"
#: Words between the separators of one text handed to the library, and texts of one call.
_JOINED, _CALL = 256, 64
# Fixed value: how the vocabulary marks the end of a word.
WORD_END = "</w>"


class WordIds:
    """Ids of whole texts, word by word. The vocabulary drops white space and no token crosses it, so the library is asked once for each distinct word.

    It is also blind to case and splits letters from signs, so a word with points after its last letter is
    the lower-case word, then the points; words that may hold a special string or an apostrophe are left whole.
    The library gets many words as one text. Lower-case words of A-Z need none of its text forms, so only its
    merges run on them, and a token with the word-end sign closes each; other words have a special token between them.
    """

    def __init__(self, path: str, cache_bytes: int | None = None):
        self.cache_bytes = cache_bytes or CACHE_BYTES
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.library = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.library.model)  # the model is shared
        self.merges.pre_tokenizer = WhitespaceSplit()
        self.between = next((t.content, n) for n, t in sorted(self.library.get_added_tokens_decoder().items()) if t.special)
        self.closes = np.zeros(self.library.get_vocab_size(), dtype=bool)
        self.closes[[n for token, n in self.library.get_vocab(with_added_tokens=False).items() if token.endswith(WORD_END)]] = True
        self.known: dict[bytes, bytes] = {}  # of words as they stand
        self.before: dict[bytes, bytes] = {}  # an older generation: words that come again are taken over
        self.cores: dict[bytes, bytes] = {}  # of lower-case words and of points
        self.held = 0

    def encode_words(self, words: list[bytes], plain: bool) -> list[bytes]:
        """Ids of words, none of which holds a special string. plain: all are lower-case words of A-Z."""
        mark, mark_id = (" ", None) if plain else self.between
        encode = (self.merges if plain else self.library).encode_batch_fast
        texts = [mark.join([w.decode() for w in words[k : k + _JOINED]]) for k in range(0, len(words), _JOINED)]
        found: list[bytes] = []
        for k in range(0, len(texts), _CALL):
            for e in encode(texts[k : k + _CALL], add_special_tokens=False):
                ids = np.array(e.ids, dtype="<u4")
                raw = ids.tobytes()
                if plain:
                    stops = ((np.flatnonzero(self.closes[ids]) + 1) * 4).tolist()
                    found += [raw[i:j] for i, j in zip([0, *stops], stops)]
                else:
                    stops = (np.flatnonzero(ids == mark_id) * 4).tolist()
                    found += [raw[i:j] for i, j in zip([0, *[s + 4 for s in stops]], [*stops, len(raw)])]
        return found

    @staticmethod
    def parts(word: bytes) -> tuple[bytes, bytes]:
        core = word.rstrip(_POINTS)
        if core.isalpha() or core and b"'" not in word and core.decode()[-1].lower()[-1].isalpha():
            return core, word[len(core) :]
        return word, b""

    def learn(self, words: set[bytes]) -> None:
        cores = self.cores
        marked = [w for w in words if b"<|" in w]
        if marked:
            words = words.difference(marked)
            self.known |= {w: array("I", e.ids).tobytes() for w, e in zip(marked, self.library.encode_batch_fast([w.decode() for w in marked], add_special_tokens=False))}
        split = [(w, *self.parts(w)) for w in words]
        new = list({p for _, core, points in split for p in (core, points) if p and p not in cores})
        plain = [p for p in new if p.isalpha() and p.islower()]
        other = [p for p in new if not (p.isalpha() and p.islower())]
        cores.update(zip(plain, self.encode_words(plain, True), strict=True))
        cores.update(zip(other, self.encode_words(other, False), strict=True))
        self.known |= {w: cores[core] + cores[points] if points else cores[core] for w, core, points in split}
        self.held += ENTRY_BYTES * (len(words) + len(new)) + 3 * sum(map(len, words)) + 3 * sum(map(len, new))

    def encode_texts(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of UTF-8 texts."""
        if self.held > self.cache_bytes / 2:
            self.before, self.known, self.held = self.known, {}, 0
            self.cores.clear()
        words = [(t if b"<|" in t else t.lower()).split() for t in texts]
        new = set().union(*words).difference(self.known)
        if again := new.intersection(self.before):
            self.known |= {w: self.before[w] for w in again}
            self.held += ENTRY_BYTES * len(again) + 6 * sum(map(len, again))
            new -= again
        if new:
            self.learn(new)
        get = self.known.__getitem__
        return [b"".join(map(get, w)) for w in words]


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens for each piece of each row of docs(doc_id, text)."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = None, int(end_id).to_bytes(4, "little")
        for batch in batches:
            words = words or WordIds(public_tokenizers.path(tokenizer), cache_bytes)
            row, start, length, crc, tokens = [], [], [], [], []
            for k, ids in enumerate(words.encode_texts(batch.column("text").to_pylist())):
                ids += end
                n = len(ids) // 4
                for at in range(0, n, capacity):
                    part = ids[4 * at : 4 * (at + capacity)]
                    row.append(k)
                    start.append(at)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    tokens.append(n)
            columns = [pa.array(x, pa.int64()) for x in (start, length, crc, tokens)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), *columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return source.mapInArrow(gives_back(run), f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


class Knapsack:
    """Prices patterns: an unbounded knapsack over the capacity, by dynamic programming."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.sizes, self.capacity = sizes, capacity
        # sizes ascend, so those that fit w are a prefix
        self.fitting = [int(np.searchsorted(sizes, w, side="right")) for w in range(capacity + 1)]
        self.below = [w - sizes[:n] for w, n in enumerate(self.fitting)]

    def best(self, prices: np.ndarray) -> tuple[float, np.ndarray]:
        """The highest price of a pattern that fits, and that pattern."""
        value, pick = np.zeros(self.capacity + 1), np.full(self.capacity + 1, -1)
        last = 0.0
        for w in range(1, self.capacity + 1):
            if n := self.fitting[w]:
                got = value[self.below[w]] + prices[:n]
                k = int(got.argmax())
                if got[k] > last + 1e-12:
                    last, pick[w] = got[k], k
            value[w] = last
        pattern, w = np.zeros(len(self.sizes), dtype=np.int64), self.capacity
        while w > 0:
            if pick[w] < 0:
                w -= 1
            else:
                pattern[pick[w]] += 1
                w -= self.sizes[pick[w]]
        return float(last), pattern


def solve_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 5e-4, rounds: int = 3000, smooth: float = 0.8) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a row each) and their fractional counts: revised simplex with columns priced by the knapsack.

    Patterns are priced at duals drawn towards those with the best bound so far, which needs fewer rounds.
    It ends when the bound (the demand at the duals, over the best price there) shows that the count of
    sequences is within half a sequence, or a share of `gap`, of the linear program's optimum.
    """
    knapsack = Knapsack(sizes, capacity)
    basis = np.diag(capacity // sizes).astype(np.int64)
    inverse = np.diag(1.0 / (capacity // sizes))
    level = inverse @ demand
    good, bound = inverse.sum(axis=0), 0.0
    for _ in range(rounds):
        duals = inverse.sum(axis=0)
        for trial in (smooth * good + (1 - smooth) * duals, duals):
            price, pattern = knapsack.best(trial)
            if (b := float(demand @ trial) / max(price, 1.0)) > bound:
                bound, good = b, trial
            if duals @ pattern > 1 + 1e-9:
                break
        cost = float(level.sum())
        if cost - bound < max(0.5, gap * cost) or duals @ pattern <= 1 + 1e-9:
            break
        u = inverse @ pattern
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(u > 1e-9, level / u, np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        level = level - step * u
        level[out] = step
        row = inverse[out] / u[out]
        inverse -= u[:, None] * row
        inverse[out] = row
        basis[:, out] = pattern
    return basis.T.copy(), np.maximum(level, 0)


def first_fit_decreasing(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Patterns for the few pieces that rounding leaves over."""
    bins, room = [], []
    for k in np.argsort(-sizes):
        for _ in range(int(counts[k])):
            at = next((b for b, r in enumerate(room) if r >= sizes[k]), None)
            if at is None:
                bins.append(np.zeros(len(sizes), dtype=np.int64))
                room.append(capacity)
                at = len(bins) - 1
            bins[at][k] += 1
            room[at] -= sizes[k]
    return bins


def plan(histogram: dict[int, int], capacity: int) -> dict[int, np.ndarray]:
    """For each length class the slots its ranked pieces take: rows (first rank, first sequence, pieces of the class in a sequence)."""
    sizes = np.array(sorted(histogram), dtype=np.int64)
    demand = np.array([histogram[s] for s in sizes.tolist()], dtype=np.int64)
    if not len(sizes):
        return {}
    patterns, level = solve_patterns(sizes, demand.astype(float), capacity)
    times = np.floor(level + 1e-9).astype(np.int64)
    rest = np.maximum(demand - times @ patterns, 0)
    chosen = [(p, t) for p, t in zip(patterns, times.tolist()) if t] + [(p, 1) for p in first_fit_decreasing(sizes, rest, capacity)]
    slots: dict[int, list[tuple[int, int, int]]] = {s: [] for s in sizes.tolist()}
    taken, sequence = np.zeros(len(sizes), dtype=np.int64), 0
    for p, t in chosen:
        for k in np.flatnonzero(p):
            slots[int(sizes[k])].append((int(taken[k]), sequence, int(p[k])))
            taken[k] += p[k] * t
        sequence += t
    return {s: np.array(x, dtype=np.int64) for s, x in slots.items()}


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY, grain: int = GRAIN, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: every piece of every row in its place.

    The text is read and tokenized once; a worker remembers words in cache_bytes, about. The driver sees a histogram of
    capacity / grain classes and its counts by salt; ranks come from windows over (class, salt), offsets from windows
    over a sequence. Pieces of the largest class, which are most of a corpus of long texts, fill a sequence each and need neither.
    """
    spark = docs.sparkSession
    whole = durable(cut_pieces(docs, tokenizer, capacity=capacity, cache_bytes=cache_bytes), "pieces").withColumn("class", F.ceil(F.col("length") / grain).cast("int"))
    largest = -(-capacity // grain)
    pieces = whole.where(F.col("class") < largest).withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(SALTS)).cast("int"))
    counts = pieces.groupBy("class", "salt").count().orderBy("class", "salt").collect()  # at most capacity / grain * SALTS rows
    histogram: dict[int, int] = {}
    bases = []
    for r in counts:
        bases.append((r["class"], r["salt"], histogram.get(r["class"], 0)))
        histogram[r["class"]] = histogram.get(r["class"], 0) + r["count"]
    slots = plan(histogram, largest)
    # beyond all planned sequences, of which there are no more than pieces
    alone = whole.where(F.col("class") == largest).withColumn("sequence_id", F.lit(sum(histogram.values())) + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    offsets = spark.createDataFrame(bases, "class int, salt int, base long")
    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("class", "salt").orderBy("doc_id", "start", "ids_crc32")) - 1).join(F.broadcast(offsets), ["class", "salt"]).withColumn("rank", F.col("rank") + F.col("base"))

    @F.pandas_udf("long")
    def sequence_of(kind: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.empty(len(rank), dtype=np.int64)
        k, r = kind.to_numpy(), rank.to_numpy()
        for c in np.unique(k):
            at = k == c
            s = slots[int(c)][np.searchsorted(slots[int(c)][:, 0], r[at], side="right") - 1]
            out[at] = s[:, 1] + (r[at] - s[:, 0]) // s[:, 2]
        return pd.Series(out)

    within = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranked.withColumn("sequence_id", sequence_of("class", "rank")).withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0)).cast("long"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return placed.select(*columns).unionByName(alone.select(*columns))
