"""Quotes against texts: whole hits, and near hits by the ratio of matching blocks to a sliding window.

The measure. A quote of n characters (normal form) is held by a text that contains it, with score 1. Else windows of
int(1.2 n) characters (STRETCH, a parameter), n // 4 apart, are compared by the ratio 2 M / (n + w), M characters in matching blocks; the
first window that reaches `least` decides, or else the last window of all. A text shorter than the quote is compared
whole; one that is shorter than a window but not than the quote gives 0.

The filter loses nothing. A ratio of `least` needs M >= least (n + w) / 2 characters in matching blocks, so a window needs as
many of the quote's characters, and at most n - M characters of the quote and w - M of the window are unmatched.
Matching blocks are a common subsequence. Its longest length is found for the windows of many quotes and texts at once, by
words of 64 bits, and only near the diagonal: a character of the quote has its match at most n - M places before its own in the window
and w - M after it. A window is given up as soon as the quote's beginning has more than n - M unmatched characters (its first
i, when i + w - n of the window are read: what is left of both is equally long). Only windows that pass both counts are compared.

Searches take a stated set of quotes, in blocks, against all texts: a text goes once through each block, and only hits
leave a task.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quireworks.functions import text as T
from quireworks.operators.tables import spread

#: Least ratio of a near hit; length of a window by that of the quote; quotes, and their characters, of a block; characters that are counted apart.
LEAST, STRETCH, BLOCK_QUOTES, BLOCK_CHARS, LETTERS = 0.85, 1.2, 200, 200_000, 64
#: Characters of texts taken together and counted at once, windows compared at once, and steps between looks at which of them can still pass.
TEXTS_CHARS, PIECE, WINDOWS, STEPS = 500_000, 100_000, 4096, 8


def window_size(n: int, stretch: float = STRETCH) -> int:
    return max(n, int(n * stretch))


def least_matched(n: int, window: int, least: float) -> int:
    """Characters in matching blocks that a window with the ratio has, at least."""
    return int(np.ceil(least * (n + window) / 2 - 1e-9))


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def window_starts(n: int, size: int, stretch: float = STRETCH) -> np.ndarray:
    """Starts of the windows of a quote of n characters in a text of `size`, the last window last."""
    w = window_size(n, stretch)
    inner = np.arange(0, size - w + 1, max(1, n // 4))
    return np.append(inner, size - w) if size > w else inner


class Block:
    """Quotes in normal form, and what the filter needs of them: counts of the block's frequent characters (all others together), and for each quote's characters the places where they stand, as bits."""

    def __init__(self, quotes: list[str], least: float, stretch: float):
        self.quotes, self.least, self.stretch = quotes, least, stretch
        self.codes = [codes(q) for q in quotes]
        self.letters, seen = np.unique(np.concatenate([*self.codes, np.zeros(0, np.int64)]), return_counts=True)
        self.counted = np.full(len(self.letters) + 1, min(LETTERS, len(self.letters)))
        self.counted[np.argsort(-seen, kind="stable")[:LETTERS]] = np.arange(min(LETTERS, len(self.letters)))
        self.size = np.array([len(q) for q in quotes], np.int64)
        self.window = np.array([window_size(len(q), stretch) for q in quotes], np.int64)
        self.matched = np.array([least_matched(n, w, least) for n, w in zip(self.size.tolist(), self.window.tolist())], np.int64)
        kind = np.uint16 if self.window.max(initial=0) < 1 << 16 else np.uint32  # counts up to a place may wrap: only their differences are used
        self.counts = np.array([np.bincount(self.counted[self.place(c)], minlength=self.counted[-1] + 1) for c in self.codes], kind).reshape(len(quotes), -1)
        words = -(-self.size // 64)
        self.groups = [Bits(self, np.flatnonzero(words == n), n) for n in np.unique(words).tolist()]

    def place(self, c: np.ndarray) -> np.ndarray:
        """The place of each character among the letters, that of all others last."""
        if not len(self.letters):
            return np.zeros(len(c), np.int64)
        at = np.minimum(np.searchsorted(self.letters, c), len(self.letters) - 1)
        return np.where(self.letters[at] == c, at, len(self.letters))

    def promising(self, line: "Line", k: int, ok: np.ndarray) -> np.ndarray:
        """Starts, in the line, of windows that share as many characters with quote k as they must; ok tells the texts to look at."""
        w, starts = int(self.window[k]), line.starts(len(self.quotes[k]), self.stretch, ok)
        if not len(starts):
            return starts
        kept, edges = [], np.searchsorted(starts, np.arange(len(line.counts) + 1) * PIECE)
        for upto, first, lo, hi in zip(line.counts, range(0, len(line.codes), PIECE), edges, edges[1:]):
            at = starts[lo:hi] - first
            inside = np.take(upto, at + w, axis=0)
            inside -= np.take(upto, at, axis=0)
            np.minimum(inside, self.counts[k], out=inside)
            kept.append(starts[lo:hi][np.einsum("ij->i", inside) >= self.matched[k]])  # the sum is no larger than the quote, so it fits the kind of the counts
        return np.concatenate(kept)


class Bits:
    """Quotes of one number of words of 64 bits, and for each of their characters where it stands; row 0 is of characters that a quote lacks."""

    def __init__(self, block: Block, which: np.ndarray, words: int):
        self.which, self.words = which, words
        self.size, self.window, self.matched = block.size[which], block.window[which], block.matched[which]
        self.row, found, rows = np.zeros((len(which), len(block.letters) + 1), np.int32), [np.zeros((1, words), np.uint64)], 1
        for i, k in enumerate(which.tolist()):
            own, place = np.unique(block.place(block.codes[k]), return_inverse=True)
            bits, at = np.zeros((len(own), words), np.uint64), np.arange(len(place))
            np.bitwise_or.at(bits, (place, at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
            self.row[i, own] = np.arange(rows, rows + len(own))
            found.append(bits)
            rows += len(own)
        self.masks = [np.ascontiguousarray(m) for m in np.concatenate(found).T]

    def begun(self, j: int) -> list[np.ndarray]:
        """For each word, the bits of each quote's beginning that must be matched when j characters of a window are read."""
        n = np.clip(j - (self.window - self.size), 0, self.size)
        most = [np.clip(n - 64 * k, 0, 64) for k in range(self.words)]
        return [np.where(m == 64, ~np.uint64(0), (np.uint64(1) << (m % 64).astype(np.uint64)) - np.uint64(1)) for m in most]

    def common(self, place: np.ndarray, starts: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Which windows, by the start of each in the places of characters and by its quote here, have a common subsequence with it as long as must be."""
        left, lost = np.arange(len(starts)), self.size - self.matched
        v = [np.full(len(starts), ~np.uint64(0)) for _ in range(self.words)]
        before, after, shortest, last = int((self.window - self.matched).max()), int(lost.max()), int(self.window.min()), int(self.window.max())
        for j in range(last):
            at = self.row[own, place[starts + j]]
            if j >= shortest:
                at[j >= self.window[own]] = 0
            carry = None
            for k in range(max(0, j - before) // 64, min((j + after) // 64, self.words - 1) + 1):
                u = self.masks[k][at]
                u &= v[k]
                total = v[k] + u
                over = total < u
                if carry is not None:
                    total += carry
                    over |= total < carry
                carry = over.astype(np.uint64)
                u ^= v[k]
                v[k] = np.bitwise_or(total, u, out=total)
            if j % STEPS == STEPS - 1 or j == last - 1:
                missed = sum(np.bitwise_count(x & b[own]).astype(np.int64) for x, b in zip(v, self.begun(j + 1)))
                good = missed <= lost[own]
                if not good.all():
                    left, starts, own, v = left[good], starts[good], own[good], [x[good] for x in v]
                if not len(left):
                    break
        return left


class Line:
    """Texts in normal form, one behind the other, with counts of letters up to each place of a piece. A piece goes on for the longest window, so any text is counted in bounded memory."""

    def __init__(self, texts: list[str], block: Block):
        self.texts, found = texts, [codes(t) for t in texts]
        self.sizes = np.array([len(c) for c in found], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.codes = np.concatenate([*found, np.zeros(0, np.int64)])
        longest = int(block.window.max(initial=0))
        self.place = np.concatenate([block.place(self.codes), np.full(longest, len(block.letters))])
        self.counts = []
        for at in range(0, len(self.codes), PIECE):
            letters = block.counted[self.place[at : min(at + PIECE + longest, len(self.codes))]]
            upto = np.zeros((len(letters) + 1, block.counts.shape[1]), block.counts.dtype)
            upto[np.arange(1, len(letters) + 1), letters] = 1
            self.counts.append(np.cumsum(upto, axis=0, out=upto))

    def starts(self, n: int, stretch: float, ok: np.ndarray) -> np.ndarray:
        """Starts of the windows of a quote of n characters in the texts to look at, ascending."""
        w, step = window_size(n, stretch), max(1, n // 4)
        fits = np.flatnonzero(ok & (self.sizes >= w))
        sizes, first = self.sizes[fits], self.first[fits]
        inner = (sizes - w) // step + 1
        total = inner + (sizes > w)
        at = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
        return np.repeat(first, total) + np.where(at < np.repeat(inner, total), at * step, np.repeat(sizes - w, total))


def matching_blocks(a: str, b: str) -> int:
    """Characters in the matching blocks of difflib's SequenceMatcher(None, a, b), which this equals. Only characters of a that can begin a block are walked, where it walks all of a stretch for each block."""
    at: dict[str, list[int]] = {}
    for j, c in enumerate(b):
        at.setdefault(c, []).append(j)
    if len(b) >= 200:  # as there: characters that are frequent in b begin no block
        at = {c: js for c, js in at.items() if len(js) <= len(b) // 100 + 1}
    seeds = [i for i, c in enumerate(a) if c in at]
    total, queue = 0, [(0, len(a), 0, len(b))]
    while queue:
        alo, ahi, blo, bhi = queue.pop()
        i0, j0, size, former, ends = alo, blo, 0, -2, {}
        for i in seeds[bisect.bisect_left(seeds, alo) : bisect.bisect_left(seeds, ahi)]:
            if i != former + 1:
                ends = {}
            former, new = i, {}
            for j in at[a[i]]:
                if j < blo:
                    continue
                if j >= bhi:
                    break
                k = new[j] = ends.get(j - 1, 0) + 1
                if k > size:
                    i0, j0, size = i - k + 1, j - k + 1, k
            ends = new
        while i0 > alo and j0 > blo and a[i0 - 1] == b[j0 - 1]:
            i0, j0, size = i0 - 1, j0 - 1, size + 1
        while i0 + size < ahi and j0 + size < bhi and a[i0 + size] == b[j0 + size]:
            size += 1
        if size:
            total += size
            if alo < i0 and blo < j0:
                queue.append((alo, i0, blo, j0))
            if i0 + size < ahi and j0 + size < bhi:
                queue.append((i0 + size, ahi, j0 + size, bhi))
    return total


def ratio(quote: str, window: str, least: float = 0.0) -> float:
    """The ratio of matching blocks; 0 where its bounds from above already stay under `least`."""
    both = len(quote) + len(window)
    if not both:
        return 1.0
    if 2.0 * min(len(quote), len(window)) / both < least or 2.0 * sum(min(quote.count(c), window.count(c)) for c in set(quote)) / both < least:
        return 0.0
    return 2.0 * matching_blocks(quote, window) / both


def near_hits(block: Block, texts: list[str], held: list[set[int]]) -> Iterator[tuple[int, int, float]]:
    """(quote, text, score) of near hits; held has the quotes that each text holds wholly, which are not looked for in it."""
    line = Line(texts, block)
    ok = np.ones((len(block.quotes), len(texts)), bool)
    for j, ks in enumerate(held):
        ok[list(ks), j] = False
    n = block.size[:, None]
    for k, j in np.argwhere(ok & (n > line.sizes) & (2 * line.sizes >= block.least * (n + line.sizes))).tolist():
        if (got := ratio(block.quotes[k], texts[j], block.least)) >= block.least:
            yield k, j, got
    for group in block.groups:
        found = [block.promising(line, k, ok[k]) for k in group.which.tolist()]
        starts, own = np.concatenate(found), np.repeat(np.arange(len(found)), [len(f) for f in found])
        done = None
        for at in range(0, len(starts), WINDOWS):
            for i in (at + group.common(line.place, starts[at : at + WINDOWS], own[at : at + WINDOWS])).tolist():
                k = int(group.which[own[i]])
                j = int(np.searchsorted(line.first, starts[i], "right")) - 1
                s, w = int(starts[i] - line.first[j]), int(block.window[k])
                if (k, j) != done and (got := ratio(block.quotes[k], texts[j][s : s + w], block.least)) >= block.least:
                    done = k, j
                    yield k, j, got


def score(quote: str, text: str, least: float = LEAST, stretch: float = STRETCH) -> tuple[bool, float]:
    """Whether the text holds the quote, and its score; without a hit the highest ratio of all windows."""
    if not quote or not text:
        return False, 0.0
    if quote in text:
        return True, 1.0
    for _, _, hit in near_hits(Block([quote], least, stretch), [text], [set()]):
        return True, hit
    if len(quote) > len(text):
        return False, ratio(quote, text)
    w, best = window_size(len(quote), stretch), 0.0
    for s in window_starts(len(quote), len(text), stretch).tolist():
        best = max(best, ratio(quote, text[s : s + w], best))
    return False, best


def _blocks(quotes: DataFrame) -> Iterator[list[tuple]]:
    """(quote_id, normal form) of the stated set, in blocks of a bounded size. Empty quotes are left out: no text holds them."""
    block, size = [], 0
    for r in quotes.select("quote_id", T.normal_retrieval(F.col("quote")).alias("q")).where("q <> ''").toLocalIterator():
        if block and (len(block) == BLOCK_QUOTES or size + len(r.q) > BLOCK_CHARS):
            yield block
            block, size = [], 0
        block.append((r.quote_id, r.q))
        size += len(r.q)
    if block:
        yield block


def _lots(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Texts taken together, each lot with the place of its first."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        if k > first and size + len(t) > TEXTS_CHARS:
            yield first, texts[first:k]
            first, size = k, 0
        size += len(t)
    if texts:
        yield first, texts[first:]


def _search(quotes: DataFrame, corpus: DataFrame, least: float | None, stretch: float = STRETCH) -> DataFrame:
    """quote_id, card_id, score of hits; least None asks for whole hits only."""
    spark, cards = corpus.sparkSession, spread(corpus).select("card_id", T.normal_retrieval(F.col("text")).alias("t")).where("t <> ''")
    schema = f"quote_id {quotes.schema['quote_id'].dataType.simpleString()}, card_id {corpus.schema['card_id'].dataType.simpleString()}, score double"

    id_kind = to_arrow_type(quotes.schema["quote_id"].dataType)

    def scan(block) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = ahocorasick.Automaton()
            for k, (_, q) in enumerate(block.value):
                whole.add_word(q, (*whole.get(q, ()), k))
            whole.make_automaton()
            near = Block([q for _, q in block.value], least, stretch) if least is not None else None
            for batch in batches:
                hits: list[tuple[int, int, float]] = []
                texts = batch.column("t").to_pylist()
                for first, some in _lots(texts):
                    held = [{k for _, ks in whole.iter(t) for k in ks} for t in some]
                    hits += [(k, first + j, 1.0) for j, ks in enumerate(held) for k in sorted(ks)]
                    if near is not None:
                        hits += [(k, first + j, got) for k, j, got in near_hits(near, some, held)]
                if hits:
                    q, row, s = zip(*hits)
                    ids = pa.array([block.value[k][0] for k in q], id_kind)
                    yield pa.RecordBatch.from_arrays([ids, batch.column("card_id").take(pa.array(row)), pa.array(s, pa.float64())], ["quote_id", "card_id", "score"])

        return cards.mapInArrow(run, schema)

    found = None
    for b in _blocks(quotes):
        part = scan(spark.sparkContext.broadcast(b))
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], schema)


def exact_quotes(quotes: DataFrame, corpus: DataFrame) -> DataFrame:
    """quote_id, card_id where the text holds the whole quote in normal form: quotes(quote_id, quote), corpus(card_id, text). Rows that repeat give repeated hits."""
    return _search(quotes, corpus, None).select("quote_id", "card_id")


def find_quotes(quotes: DataFrame, corpus: DataFrame, least: float = LEAST, stretch: float = STRETCH) -> DataFrame:
    """quote_id, card_id, score where the text holds the quote wholly (1) or nearly."""
    return _search(quotes, corpus, least, stretch)


def quote_verdicts(quotes: DataFrame, corpus: DataFrame, least: float = LEAST, stretch: float = STRETCH) -> DataFrame:
    """A row for every quote: quote_id, cards (that hold it), whole (of them wholly), best (score to 4 digits, null without any), verdict: verified or fabricated."""
    found = find_quotes(quotes, corpus, least, stretch).groupBy("quote_id").agg(F.count("*").alias("cards"), F.count_if(F.col("score") == 1).alias("whole"), F.round(F.max("score"), 4).alias("best"))
    every = quotes.select("quote_id").join(found, "quote_id", "left").na.fill(0, ["cards", "whole"])
    return every.select("quote_id", "cards", "whole", "best", F.when(F.col("cards") > 0, "verified").otherwise("fabricated").alias("verdict"))


def verify_answers(answers: DataFrame, least: float = LEAST, stretch: float = STRETCH) -> DataFrame:
    """answers(answer_id, quotes: array of strings, text) to answer_id, claimed, verified, fabricated, fabrication_rate, details (quote, clean_quote, matched, score), verified_text.

    A source note at a quote's end is cut off before it is compared. A null quote is an empty one, which no text
    holds; no quotes give zeros and an empty text.
    """
    kind = answers.schema["answer_id"].dataType.simpleString()
    clean = F.transform(F.coalesce("quotes", F.array().cast("array<string>")), lambda q: F.struct(F.coalesce(q, F.lit("")).alias("quote"), F.coalesce(T.strip_card_note(q), F.lit("")).alias("clean_quote")))
    ready = answers.select("answer_id", clean.alias("claims"), F.transform(clean, lambda c: T.normal_retrieval(c["clean_quote"])).alias("q"), T.normal_retrieval(F.col("text")).alias("t"))
    # answers are small rows and much work: adaptive execution would put them into few parts by their bytes
    spark = answers.sparkSession
    ready = ready.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    item = pa.struct([("matched", pa.bool_()), ("score", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("matched", "score"), score(q, t, least, stretch))) for q in qs] for qs, t in zip(batch.column("q").to_pylist(), batch.column("t").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("answer_id"), batch.column("claims"), pa.array(found, pa.list_(item))], ["answer_id", "claims", "found"])

    got = ready.mapInArrow(run, f"answer_id {kind}, claims array<struct<quote: string, clean_quote: string>>, found array<struct<matched: boolean, score: double>>")
    details = F.zip_with("claims", "found", lambda c, f: F.struct(c["quote"].alias("quote"), c["clean_quote"].alias("clean_quote"), f["matched"].alias("matched"), F.round(f["score"], 4).alias("score")))
    held = F.filter("details", lambda d: d["matched"])
    out = got.select("answer_id", details.alias("details")).withColumns({"claimed": F.size("details"), "verified": F.size(held), "verified_text": F.array_join(F.transform(held, lambda d: d["clean_quote"]), "\n")})
    lost = F.col("claimed") - F.col("verified")
    return out.select("answer_id", "claimed", "verified", lost.alias("fabricated"), (lost / F.greatest(F.col("claimed"), F.lit(1))).alias("fabrication_rate"), "details", "verified_text")
