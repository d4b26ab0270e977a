"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts and items are word sequences. A CGK embedding walks a sequence, at each step writing the current word
and moving on or not by a random bit of (step, word); few edits leave few differing positions, so edit
distance becomes Hamming distance. Signatures sample positions of several embeddings; windows of an item's
size whose signature equals the item's in any repetition are verified by exact edit distance. How many
positions a signature has, and how many signatures there are, follows from the item's size and RECALL: long
items at their edit bound differ in more positions, so they get shorter or more signatures.

Only windows that a link permits are embedded: an item within its edit bound of a window shares an unbroken
run of words with it (k edits leave a run of ceil((n - k) / (k + 1)) of n words), so windows start where such
a run, up to RUN words, says.

Defined cases: null and empty texts, and items without words, match nothing; case and ASCII punctuation do
not matter; items of equal words match alike, each with its own row; rows that repeat an id are matched each;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from xxhash import xxh3_64_intdigest

from quireworks.llm.common import gives_back, small_batches

#: Least similarity: word edits may be 1 - SIMILARITY of the item's words.
SIMILARITY = 0.8
#: Words of a run, embeddings, and signatures of each embedding and positions of a signature for short items.
RUN, EMBEDDINGS, SAMPLES, BITS = 3, 4, 10, 4
#: Least chance that a window at the edit bound agrees with its item in a signature; pairs drawn to learn it, and sizes (a quarter apart) it is learned for, at most.
RECALL, DRAWN, LONGEST = 0.99, 48, 2000
#: UTF-8 bytes of items that tasks hold at once; more items are matched in blocks.
BLOCK_BYTES = 8 << 20
#: Windows that are embedded at once, at most, and words of a table of them (windows x the longest): tables are cut by size, so long items do not widen those of short ones.
WINDOWS, TABLE_WORDS = 4096, 1 << 18

_SPACE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_SPACE).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def edit_bound(n: int, similarity: float = SIMILARITY) -> int:
    return int(n * (1 - similarity) + 1e-9)


def run_length(n: int) -> int:
    k = edit_bound(n)
    return max(1, min(RUN, -(-(n - k) // (k + 1))))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(h) - n + 1, np.uint64(n))
    for k in range(n):
        out = out * _ODD + h[k : len(h) - n + 1 + k]
    return _mix(out)


def embed(windows: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """CGK embeddings (3 steps a word) of windows, a row each, of their sizes; a word past the end is 0."""
    rows, widest = windows.shape
    padded = np.concatenate([windows, np.zeros((rows, 1), np.uint64)], axis=1)
    at, out, every = np.zeros(rows, np.int64), np.empty((rows, 3 * widest), np.uint64), np.arange(rows)
    with np.errstate(over="ignore"):
        for step in range(3 * widest):
            word = padded[every, at]
            out[:, step] = word
            bit = _mix(word + _ODD * np.uint64(step + 1 + 100_003 * seed)) & np.uint64(1)
            at = np.minimum(at + bit.astype(np.int64), sizes)
    return out


def sampled_positions(size: int, seed: int, samples: int, bits: int) -> np.ndarray:
    return np.random.default_rng([size, seed]).integers(0, 3 * size, size=samples * bits)


def signatures(windows: np.ndarray, sizes: np.ndarray, embeddings: int = EMBEDDINGS, samples: int = SAMPLES, bits: int = BITS) -> np.ndarray:
    """rows x (embeddings * samples) hashes of the size, the repetition and the words at sampled positions, which depend on size and repetition alone."""
    out, every = [], np.arange(len(windows))[:, None]
    kinds, which = np.unique(sizes, return_inverse=True)
    for seed in range(embeddings):
        pick = np.stack([sampled_positions(n, seed, samples, bits) for n in kinds.tolist()])[which]
        words = embed(windows, sizes, seed)[every, pick].reshape(len(windows), samples, bits)
        sig = sizes[:, None].astype(np.uint64) * np.uint64(1_000_003) + np.arange(seed * samples, (seed + 1) * samples, dtype=np.uint64)[None, :]
        for k in range(bits):
            sig = sig * _ODD + words[:, :, k]
        out.append(_mix(sig))
    return np.concatenate(out, axis=1)


@lru_cache(maxsize=None)
def differing(size: int) -> np.ndarray:
    """Shares of positions (pairs x embeddings) in which embeddings of random items of a size and of windows at the edit bound differ."""
    r = np.random.default_rng(size)
    items = r.integers(1, 2**63, (DRAWN, size)).astype(np.uint64)
    edited = []
    for row in items.tolist():
        for kind in r.integers(0, 3, edit_bound(size)).tolist():
            at = int(r.integers(len(row)))
            row[at : at + (kind != 1)] = [] if kind == 2 else [int(r.integers(1, 2**63))]
        edited.append([*row, *r.integers(1, 2**63, size).tolist()][:size])
    sizes = np.full(DRAWN, size)
    return np.stack([(embed(items, sizes, seed) != embed(np.array(edited, np.uint64), sizes, seed)).mean(axis=1) for seed in range(EMBEDDINGS)], axis=1)


def repetitions(size: int) -> tuple[int, int]:
    """(signatures of each embedding, positions of a signature) for items of a size: the first choice that reaches RECALL."""
    step = min(LONGEST, int(1.25 ** np.ceil(np.log(max(size, 1)) / np.log(1.25) - 1e-9)) + 1)
    apart = differing(step)
    for samples, bits in [*((SAMPLES, b) for b in range(BITS, 1, -1)), (2 * SAMPLES, 2), *((SAMPLES << k, 1) for k in range(1, 7))]:
        missed = ((1 - (1 - apart) ** bits) ** samples).prod(axis=1).mean()
        if missed <= 1 - RECALL:
            break
    return samples, bits


def lots(sizes: np.ndarray, times: int = 1) -> Iterator[np.ndarray]:
    """Places of the sizes, ascending by size, in lots of at most WINDOWS with at most TABLE_WORDS / times words when filled up, or of one."""
    order, at = np.argsort(sizes, kind="stable"), 0
    while at < len(order):
        some = order[at : at + WINDOWS]
        fits = int(np.searchsorted(np.arange(1, len(some) + 1) * sizes[some] * times, TABLE_WORDS, side="right"))
        yield some[: max(1, fits)]
        at += max(1, fits)


def side_by_side(hashes: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """Windows as rows, filled up with 0."""
    out = np.zeros((len(hashes), int(sizes.max(initial=0))), np.uint64)
    for r, h in enumerate(hashes):
        out[r, : len(h)] = h
    return out


def infix_distance(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int]:
    """Least edit distance of the item to any stretch of the text, and the stretch (start, end); rows of the table are vectors over the text."""
    cost, begin = np.zeros(len(text) + 1, np.int64), np.arange(len(text) + 1)
    for k, word in enumerate(item.tolist(), 1):
        new, frm = np.empty_like(cost), np.empty_like(begin)
        new[0], frm[0] = k, 0
        swap, drop = cost[:-1] + (text != word), cost[1:] + 1
        new[1:] = np.minimum(swap, drop)
        frm[1:] = np.where(swap <= drop, begin[:-1], begin[1:])
        # insertions run along the row: a running minimum of cost less position
        lead = new - np.arange(len(new))
        low = np.minimum.accumulate(lead)
        first = np.maximum.accumulate(np.where(lead == low, np.arange(len(new)), 0))
        frm, cost = frm[first], low + np.arange(len(new))
        begin = frm
        if cost.min() > most:
            break
    end = int(cost.argmin())
    return int(cost[end]), int(begin[end]), end


class ItemIndex:
    """Items by run of words, and their signatures by window size."""

    def __init__(self, items: list[tuple[object, str]]):
        self.items = [(i, h) for i, t in items if len(h := word_hashes(words_of(t or "")))]
        runs: dict[int, list[tuple[int, int, int]]] = {}
        for k, (_, h) in enumerate(self.items):
            n = run_length(len(h))
            runs.setdefault(n, []).extend((int(r), k, at) for at, r in enumerate(run_hashes(h, n)))
        self.runs = {}
        for n, found in runs.items():
            found.sort()
            self.runs[n] = np.array([f[0] for f in found], np.uint64), np.array([f[1:] for f in found], np.int64).reshape(-1, 2)
        self.sizes = np.array([len(h) for _, h in self.items], np.int64)
        self.distinct = [set(h.tolist()) for _, h in self.items]
        if self.items:
            self.plan = {n: repetitions(n) for n in set(self.sizes.tolist())}
            self.signed = {}
            for (samples, bits), own in self.by_plan(self.sizes):
                parts = [own[lot] for lot in lots(self.sizes[own])]
                flat = np.concatenate([signatures(side_by_side([self.items[k][1] for k in part.tolist()], self.sizes[part]), self.sizes[part], EMBEDDINGS, samples, bits).ravel() for part in parts])
                order = np.argsort(flat, kind="stable")
                self.signed[samples, bits] = flat[order], np.repeat(np.concatenate(parts), EMBEDDINGS * samples)[order]

    def by_plan(self, sizes: np.ndarray) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
        """Each number of signatures and positions in use, with the places of the sizes that have it."""
        kinds, which = np.unique(sizes, return_inverse=True)
        plans = [self.plan[n] for n in kinds.tolist()]
        for plan in sorted(set(plans)):
            yield plan, np.flatnonzero(np.array([p == plan for p in plans])[which])

    def windows(self, h: np.ndarray) -> np.ndarray:
        """Distinct (size, start) of windows that some item's run points to."""
        found = []
        for n, (hashes, where) in self.runs.items():
            r = run_hashes(h, n)
            low = np.searchsorted(hashes, r)
            hit = np.flatnonzero((low < len(hashes)) & (hashes[np.minimum(low, len(hashes) - 1)] == r))
            high = np.searchsorted(hashes, r[hit], side="right")
            count = high - low[hit]
            if count.sum():
                entry = np.repeat(low[hit] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                size = self.sizes[where[entry, 0]]
                start = np.repeat(hit, count) - where[entry, 1]
                found.append(np.stack([size, np.clip(start, 0, np.maximum(len(h) - size, 0))], axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)

    def candidates(self, windows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs that agree in a signature."""
        found = []
        for (samples, bits), own in self.by_plan(sizes):
            flat, owner = self.signed[samples, bits]
            sig = signatures(windows[own, : sizes[own].max()], sizes[own], EMBEDDINGS, samples, bits).ravel()
            low = np.searchsorted(flat, sig)
            hit = np.flatnonzero((low < len(flat)) & (flat[np.minimum(low, len(flat) - 1)] == sig))
            count = np.searchsorted(flat, sig[hit], side="right") - low[hit]
            entry = np.repeat(low[hit] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            found.append(np.stack([np.repeat(own[hit // (EMBEDDINGS * samples)], count), owner[entry]], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pairs[:, 0], pairs[:, 1]

    def match(self, texts: list[str | None]) -> list[tuple[int, object, int, int, int]]:
        """(text, item id, first word, words, edits) of the best stretch for each item found in each text."""
        hashes = [word_hashes(words_of(t or "")) for t in texts]
        places = [(k, size, start) for k, h in enumerate(hashes) for size, start in self.windows(h).tolist()]
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for lot in lots(np.array([p[1] for p in places], np.int64)):
            some = [places[k] for k in lot.tolist()]
            sizes = np.array([p[1] for p in some], np.int64)
            block = side_by_side([hashes[k][start : start + size] for k, size, start in some], sizes)
            for r, item in zip(*(x.tolist() for x in self.candidates(block, sizes))):
                k, size, start = some[r]
                bound, low = edit_bound(size), max(0, start - edit_bound(size))
                stretch = hashes[k][low : start + size + bound]
                if len(self.distinct[item].difference(stretch.tolist())) > bound:
                    continue  # each word that the stretch lacks is an edit at least
                cost, s, e = infix_distance(self.items[item][1], stretch, bound)
                if cost <= bound and (cost, low + s, e - s) < best.get((k, item), (cost + 1, 0, 0)):
                    best[k, item] = cost, low + s, e - s
        return [(k, self.items[item][0], s, n, cost) for (k, item), (cost, s, n) in sorted(best.items())]


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[ItemIndex]:
    """Indexes of blocks of items of at most block_bytes or so: one for a usual benchmark, by a check of its size."""
    items = benchmark.select("item_id", "text").where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        yield ItemIndex([(r.item_id, r.text) for r in part])


def contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, first_word, n_words, edits for each item found in each row of docs(doc_id, text): a narrow pass over the documents for each block of items."""
    spark = docs.sparkSession
    small_batches(spark)
    kinds = {f.name: f.dataType.simpleString() for f in [docs.schema["doc_id"], benchmark.schema["item_id"]]}
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    source, out = docs.select("doc_id", "text"), None
    for block in item_blocks(benchmark, block_bytes):
        index = spark.sparkContext.broadcast(block)

        def run(batches: Iterable[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = index.value.match(batch.column("text").to_pylist())
                at = pa.array([f[0] for f in found], pa.int64())
                numbers = [pa.array([f[k] for f in found], pa.int64()) for k in (2, 3, 4)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), pa.array([f[1] for f in found], item_type), *numbers], ["doc_id", "item_id", "first_word", "n_words", "edits"])

        got = source.mapInArrow(gives_back(run), f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, first_word bigint, n_words bigint, edits bigint")
        out = got if out is None else out.unionByName(got)
    return out


def is_contaminated(spark: SparkSession, benchmark: DataFrame, text: Column, block_bytes: int = BLOCK_BYTES) -> Column:
    """Whether a text column holds any item, for filters that keep other columns."""
    small_batches(spark)
    out = F.lit(False)
    for block in item_blocks(benchmark, block_bytes):
        out = out | _holds_item(spark.sparkContext.broadcast(block))(text)
    return out


def _holds_item(index):
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            hit = {m[0] for m in index.value.match(list(texts))}
            yield pd.Series([k in hit for k in range(len(texts))], dtype=bool)

    return F.pandas_udf(gives_back(found), "boolean")
