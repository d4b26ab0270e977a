"""Token counts by heap-and-linked-list byte-pair merging.

A piece of text starts as one symbol per byte. A heap holds the ranks of adjacent pairs, a doubly
linked list the symbols that are left; the lowest-rank pair is merged until no ranked pair remains.
The count is the initial symbols minus the merges: no identifiers are made.

Defined cases: null and empty texts count 0 tokens; special strings inside a text count as one token
each, as the tokenizer's default has it; repeated rows give repeated results; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireworks.llm.common import gives_back, small_batches

#: Pieces whose counts a worker remembers before it starts anew.
CACHE_PIECES = 700_000

_STRAY_SPACE = re.compile(r"\s\s|\s\Z")


def byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: itself where printable, else the next free one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in printable}
    rest = [b for b in range(256) if b not in set(printable)]
    return table | {chr(256 + k): b for k, b in enumerate(rest)}


class PairMergeCounter:
    """Counts tokens for a byte-level BPE vocabulary in the JSON form of the tokenizers library."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN, cache_pieces: int = CACHE_PIECES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.rank = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.find = regex.compile(pattern).findall
        self.cache_pieces = cache_pieces
        self.pieces: dict[str, int] = {}
        self.words: dict[str, int] = {}

    def merge_count(self, data: bytes) -> int:
        """Tokens of one piece: its bytes minus the merges the heap allows."""
        n = len(data)
        if n < 2:
            return n
        rank = self.rank
        symbol: list[bytes | None] = [data[k : k + 1] for k in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, symbol[k], symbol[k + 1]) for k in range(n - 1) if (r := rank.get((symbol[k], symbol[k + 1]))) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = after[k]
            if symbol[k] != a or j >= n or symbol[j] != b:
                continue  # one of the two has been merged since
            both = symbol[k] = a + b
            symbol[j] = None
            left -= 1
            m = after[k] = after[j]
            if m < n:
                before[m] = k
                if (r := rank.get((both, symbol[m]))) is not None:
                    heapq.heappush(heap, (r, k, both, symbol[m]))
            p = before[k]
            if p >= 0 and (r := rank.get((symbol[p], both))) is not None:
                heapq.heappush(heap, (r, p, symbol[p], both))
        return left

    def piece(self, text: str) -> int:
        """Tokens of a regex piece, remembered."""
        n = self.pieces.get(text)
        if n is None:
            if len(self.pieces) >= self.cache_pieces:
                self.pieces.clear()
            n = self.merge_count(text.encode())
            if len(text) < 64:
                self.pieces[text] = n
        return n

    def stretch(self, text: str) -> int:
        return sum(map(self.piece, self.find(text)))

    def word(self, text: str) -> int:
        """Tokens of a space and the non-space-led stretch after it, remembered."""
        n = self.words.get(text)
        if n is None:
            if len(self.words) >= self.cache_pieces:
                self.words.clear()
            n = self.stretch(" " + text)
            if len(text) < 64:
                self.words[text] = n
        return n

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings. No piece crosses a space that stands between non-spaces, so such a text can be taken word by word."""
        if not text:
            return 0
        if _STRAY_SPACE.search(text):
            # Only the stretches around doubled white space need the pattern on more than a word.
            first, *rest = re.split(r"(?<=\S) (?=\S)", text)
        else:
            first, *rest = text.split(" ")
        known = self.words
        try:
            return self.stretch(first) + sum(map(known.__getitem__, rest))
        except KeyError:
            return self.stretch(first) + sum(map(self.word, rest))

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        return len(self.special.findall(text)) + sum(map(self.plain, self.special.split(text)))


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) for every row of docs(doc_id, text).

    One narrow pass: each task loads the vocabulary once and counts its own rows.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType
    text = F.coalesce(F.col("text"), F.lit(""))
    source = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or PairMergeCounter(public_tokenizers.path(tokenizer))
            n = pa.array([counter.count(t) for t in batch.column("text").to_pylist()], pa.int64())
            over = pa.array([x > limit for x in n.to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), n, over], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return source.mapInArrow(gives_back(run), f"doc_id {kind.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean")
