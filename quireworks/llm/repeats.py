"""Removal of long repeated byte strings: a suffix array of candidate positions, sorted deep-shallow in buckets.

A byte goes if it lies in a string of `width` bytes (400) that also starts anywhere else, in the same text or
another. So the question is, for every start of such a window, whether an equal window exists.

Candidates. Each window has an anchor: of its GRAM-byte strings the one with the least hash, the first of equal ones. Equal
windows have equal anchors at equal places. The windows of one anchor occurrence start in one run, so a text is
a few runs (one in some hundred bytes), each with its anchor's hash and the hash of all bytes that its windows cover.
An anchor that occurs once has no repeated window. A run whose bytes occur twice is repeated whole. What is left are
runs that share their anchor with others but not all of their bytes: the edges of copies and passages.

Sorting. Only those runs are cut out of their texts, one of each content, and dealt to buckets by their anchor. A bucket sorts its
windows: a multikey quicksort by eight bytes at a time orders them to SHALLOW bytes, and blind tries (branches hold
a depth and a byte; a string is compared once, at the leaf its branch bytes lead to) order the groups that are
still equal there. Neighbours with a common prefix of `width` bytes are equal windows.

Hot groups. Rows of one anchor or one content are added up in tasks before any shuffle, and joined with hot keys broadcast. An
anchor with more than GROUP_RUNS undecided runs is dealt to several buckets by a salt; those buckets also report each different
window once, by a 128-bit hash, and windows reported by two buckets are repeated. A window is reported once a bucket at most.

Defined cases: null is the empty text; texts under `width` bytes have no windows and lose nothing; the first of equal strings goes like the others; a text
whose copies are `width` bytes or longer loses everything; repeated rows are copies; cuts may fall inside a character, as
texts are bytes here; long texts are read in stretches of STRETCH starts, whose edges only add runs; ties of the least
hash go to the first place; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_intdigest

from quireworks.llm.common import attach, durable, gives_back, may_hold, small_batches

#: Bytes of a window, of an anchor, and to which windows are sorted by keys; runs of an anchor in one bucket, and of a bucket, about.
WIDTH, GRAM, SHALLOW, GROUP_RUNS, BUCKET_RUNS = 400, 200, 32, 4000, 2000
#: Starts of a long text that are read at once; places fit into PLACE bits.
STRETCH, PLACE = 1 << 19, np.uint64(20)

_BASE = 0x9E3779B97F4A7C15
_SPREAD = np.random.default_rng(400).integers(0, 1 << 64, 256, dtype=np.uint64)
_M = np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(raw: bytes, size: int) -> np.ndarray:
    """A 64-bit hash of every string of `size` bytes, by differences of one running sum."""
    n = len(raw)
    if n < size:
        return np.zeros(0, np.uint64)
    powers = lambda base: np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, base, np.uint64)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_SPREAD[np.frombuffer(raw, np.uint8)] * powers(_BASE))])
    x = (sums[size:] - sums[:-size]) * powers(pow(_BASE, -1, 1 << 64))[: n - size + 1]
    x = (x ^ (x >> np.uint64(32))) * _M
    return x ^ (x >> np.uint64(29))


def least_of_each(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours."""
    size, out = 1, x
    while size * 2 <= width:
        out, size = np.minimum(out[:-size], out[size:]), size * 2
    more = width - size
    return np.minimum(out[: len(x) - width + 1], out[more : more + len(x) - width + 1]) if more else out


def runs_of(raw: bytes, width: int = WIDTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of starts with one anchor, for each stretch of a text: their first starts, the starts after their last, and the anchors' hashes."""
    for begin in range(0, max(len(raw) - width + 1, 0), STRETCH):
        part = raw[begin : begin + STRETCH + width - 1]
        h = gram_hashes(part, gram)
        place = (least_of_each((h >> PLACE << PLACE) | np.arange(len(h), dtype=np.uint64), width - gram + 1) & np.uint64((1 << int(PLACE)) - 1)).astype(np.int64)
        lo = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        yield begin + lo, begin + np.concatenate([lo[1:], [len(place)]]), h[place[lo]]


def anchors(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """anchor, content, text_hash, n_bytes, lo, hi of every run in docs(raw, text_hash, n_bytes): windows start from lo to hi - 1, content is the hash of all their bytes."""
    small_batches(docs.sparkSession)
    names = ["anchor", "content", "text_hash", "n_bytes", "lo", "hi"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[list] = [[np.zeros(0, np.int64)] for _ in names]
            for raw, text_hash in zip(batch.column("raw"), batch.column("text_hash").to_pylist()):
                raw = raw.as_py()
                for lo, hi, anchor in runs_of(raw, width, gram):
                    content = np.fromiter((xxh3_64_intdigest(raw[a : b + width - 1]) for a, b in zip(lo.tolist(), hi.tolist())), np.uint64, len(lo))
                    for part, x in zip(parts, (anchor.view(np.int64), content.view(np.int64), np.full(len(lo), text_hash, np.int64), np.full(len(lo), len(raw), np.int64), lo, hi)):
                        part.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in parts], names)

    return docs.where(F.col("n_bytes") >= width).select("raw", "text_hash").mapInArrow(gives_back(run), ", ".join(f"{c} bigint" for c in names))


class BlindTrie:
    """Strings of `depth` bytes in a text, by their starts. An inner node is [depth, {byte: node}], a leaf [None, members]."""

    def __init__(self, text: bytes, depth: int):
        self.text, self.depth, self.root = text, depth, None

    def add(self, start: int, member: int) -> None:
        x = self.text[start : start + self.depth]
        if self.root is None:
            self.root = [None, [(start, member)]]
            return
        node = self.root
        while node[0] is not None:
            node = node[1].get(x[node[0]]) or next(iter(node[1].values()))
        at = node[1][0][0]
        y = self.text[at : at + self.depth]
        if x == y:
            node[1].append((start, member))
            return
        same = self.depth - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8
        above, node = None, self.root
        while node[0] is not None and node[0] < same:
            above, node = node, node[1][x[node[0]]]
        leaf = [None, [(start, member)]]
        if node[0] == same:
            node[1][x[same]] = leaf
            return
        fork = [same, {y[same]: node, x[same]: leaf}]
        if above is None:
            self.root = fork
        else:
            above[1][x[above[0]]] = fork

    def ordered(self) -> Iterator[tuple[int, int]]:
        """Members in the order of their strings, each with the length of its common prefix with the one before (0 for the first)."""
        stack, shared = [(self.root, 0)], 0
        while stack:
            node, shared = stack.pop()
            if node[0] is None:
                for k, (_, member) in enumerate(node[1]):
                    yield member, self.depth if k else shared
            else:
                kids = [node[1][b] for b in sorted(node[1])]
                stack += [(kid, node[0] if k else shared) for k, kid in reversed(list(enumerate(kids)))]


def deep_shallow(text: bytes, starts: np.ndarray, depth: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings of `depth` bytes at `starts`, and the length of each one's common prefix with the one before it in that order.

    Multikey quicksort to `shallow` bytes: ranges that are equal so far are sorted by their next eight bytes, and
    only ranges of two or more go on. Blind tries order those still equal at that depth.
    """
    n = len(starts)
    padded = text + bytes(8)
    word = np.ndarray((len(text) + 1,), ">u8", padded, strides=(1,))
    order, shared = np.arange(n), np.zeros(n, np.int64)
    first = np.zeros(n, np.int64)  # of the range that an element is in, its first place
    for level in range(0, min(shallow, depth) // 8 * 8, 8):
        size = np.bincount(first, minlength=n)
        live = np.flatnonzero(size[first] > 1)
        if not len(live):
            break
        key = word[starts[order[live]] + level].astype(np.uint64)
        by = np.lexsort((key, first[live]))
        order[live], key, group = order[live][by], key[by], first[live]
        new = np.flatnonzero((group[1:] == group[:-1]) & (key[1:] != key[:-1])) + 1
        differ = key[new] ^ key[new - 1]
        shared[live[new]] = level + sum((differ < (np.uint64(1) << np.uint64(64 - 8 * k))).astype(np.int64) for k in range(1, 8))
        edge = np.concatenate([[True], group[1:] != group[:-1]])
        edge[new] = True
        first[live] = live[np.maximum.accumulate(np.where(edge, np.arange(len(live)), 0))]
    size = np.bincount(first, minlength=n) if n else np.zeros(0, np.int64)
    for at in np.flatnonzero(size > 1).tolist():
        trie = BlindTrie(text, depth)
        for member in order[at : at + size[at]].tolist():
            trie.add(int(starts[member]), member)
        for k, (member, prefix) in enumerate(trie.ordered(), at):
            order[k] = member
            if k > at:
                shared[k] = prefix
    return order, shared


def sort_bucket(runs: list[tuple[bytes, bool]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """All windows of runs(bytes, undecided) in suffix order: run, start in the run's bytes, whether an equal one exists, whether it is the first of equal ones, and the text they lie in."""
    text = b"".join(r for r, _ in runs)
    lengths = np.array([len(r) for r, _ in runs], np.int64)
    counts = lengths - width + 1
    run = np.repeat(np.arange(len(runs)), counts)
    within = np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = (np.cumsum(lengths) - lengths)[run] + within
    order, shared = deep_shallow(text, starts, width)
    equal = np.concatenate([shared >= width, [False]])  # to the one before; place 0 has none
    return run[order], within[order], equal[:-1] | equal[1:], ~equal[:-1], text


def buckets_sorted(contexts: DataFrame, width: int) -> DataFrame:
    """contexts(bucket, salted, undecided, text_hash, n_bytes, lo, bytes) to rows (text_hash, n_bytes, lo, hi) of repeated starts, and in salted buckets (mark, more, alone) of each different window."""
    names = ["text_hash", "n_bytes", "lo", "hi", "mark", "more", "alone"]

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out: list[list] = [[] for _ in names]
        which, within, twice, leads, _ = sort_bucket([(r["bytes"], r["undecided"]) for r in rows], width)
        hit = np.flatnonzero(twice)
        hit = hit[np.lexsort((within[hit], which[hit]))]
        w, s = which[hit], within[hit]
        edge = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (s[1:] != s[:-1] + 1)])) if len(hit) else np.zeros(0, int)
        last = np.concatenate([edge[1:], [len(hit)]]) - 1 if len(hit) else edge
        for k, a, b in zip(w[edge].tolist(), s[edge].tolist(), s[last].tolist()):
            r = rows[k]
            if r["undecided"]:
                for col, x in zip(out, (r["text_hash"], r["n_bytes"], r["lo"] + a, r["lo"] + b + 1, None, None, None)):
                    col.append(x)
        for k, a, one in zip(which[leads].tolist(), within[leads].tolist(), (~twice[leads]).tolist()):
            r = rows[k]
            if r["salted"]:
                mark = xxh3_128_intdigest(r["bytes"][a : a + width])
                for col, x in zip(out, (r["text_hash"], r["n_bytes"], r["lo"] + a, r["lo"] + a + 1, (mark >> 64) - (1 << 63), (mark & ((1 << 64) - 1)) - (1 << 63), one and r["undecided"])):
                    col.append(x)
        return pa.table([pa.array(c, pa.int64() if name != "alone" else pa.bool_()) for name, c in zip(names, out)], names)

    return contexts.groupBy("bucket").applyInArrow(run, "text_hash bigint, n_bytes bigint, lo bigint, hi bigint, mark bigint, more bigint, alone boolean")


def repeated_starts(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, group_runs: int = GROUP_RUNS) -> DataFrame:
    """text_hash, n_bytes, lo, hi: runs of starts, lo to hi - 1, of windows that also start elsewhere; docs(raw, text_hash, n_bytes). Rows may repeat and overlap."""
    found = durable(anchors(docs, width, gram), "anchors")
    twice = durable(found.groupBy("anchor").count().where("count > 1").select("anchor"), "anchors-twice")
    some = found.where(may_hold(twice, "anchor", "anchor")).withColumn("spread", F.monotonically_increasing_id())
    at = F.min(F.struct("text_hash", "n_bytes", "lo", "hi")).alias("at")
    contents = durable(some.groupBy("anchor", "content").agg(F.count("*").alias("copies"), at), "run-contents")
    n_rows = contents.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]

    # Contents that occur twice are repeated whole.
    both = F.struct("anchor", "content")
    decided = contents.where("copies > 1").select(F.xxhash64("anchor", "content").alias("key"), both.alias("same"), "copies")
    whole = attach(some.withColumn("key", F.xxhash64("anchor", "content")), decided, "key", "same", n_rows, "spread").where(F.col("same") == both)

    # Contents that occur once, among others with their anchor, are sorted with them.
    groups = contents.groupBy("anchor").agg(F.count("*").alias("contents"), F.count_if(F.col("copies") == 1).alias("once")).where("contents > 1 and once > 0")
    groups = durable(groups.select("anchor", F.ceil(F.col("contents") / group_runs).alias("salts"), "contents"), "anchor-groups")
    n_contents = groups.agg(F.coalesce(F.sum("contents"), F.lit(0))).first()[0]
    single = contents.where(may_hold(groups, "anchor", "anchor")).select("anchor", "at.*", (F.col("copies") == 1).alias("undecided"))
    opened = attach(single, groups.select("anchor", "salts", F.col("contents").alias("copies")), "anchor", "salts", max(n_contents, 1), "text_hash").where("salts is not null")
    salt = F.pmod(F.xxhash64("text_hash", "lo"), F.col("salts"))
    bucket = F.when(F.col("salts") > 1, F.xxhash64("anchor", salt)).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(max(1, n_contents // BUCKET_RUNS)))).alias("bucket")
    wanted = durable(opened.select(bucket, (F.col("salts") > 1).alias("salted"), "undecided", "text_hash", "n_bytes", "lo", "hi"), "runs-wanted")
    contexts = cut_out(docs, wanted, width)
    sorted_ = durable(buckets_sorted(contexts, width), "runs-sorted")
    met = sorted_.where("mark is not null").groupBy("mark", "more").agg(F.collect_list(F.struct("text_hash", "n_bytes", "lo", "hi", "alone")).alias("places"), F.count("*").alias("buckets"))
    across = met.where("buckets > 1").select(F.explode("places").alias("p")).where("p.alone").select("p.text_hash", "p.n_bytes", "p.lo", "p.hi")
    names = ["text_hash", "n_bytes", "lo", "hi"]
    return whole.select(*names).unionByName(sorted_.where("mark is null").select(*names)).unionByName(across)


def cut_out(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """wanted with the bytes of each run. Texts are shuffled only where a run of theirs may be wanted; of equal texts one run is kept."""
    lists = durable(wanted.groupBy("text_hash", "n_bytes").agg(F.collect_list(F.struct("bucket", "salted", "undecided", "lo", "hi")).alias("runs")), "runs-by-text")
    texts = docs.where(may_hold(lists, "text_hash", "text_hash"))
    one = texts.groupBy("text_hash", "n_bytes").agg(F.max("raw").alias("raw"))
    cut = one.join(lists, ["text_hash", "n_bytes"]).select("text_hash", "n_bytes", "raw", F.explode("runs").alias("r"))
    piece = F.substring("raw", F.col("r.lo").cast("int") + 1, (F.col("r.hi") - F.col("r.lo") + width - 1).cast("int"))
    return cut.select("r.bucket", "r.salted", "r.undecided", "text_hash", "n_bytes", "r.lo", piece.alias("bytes"))


def merged(runs: Column, width: int) -> Column:
    """Sorted (lo, hi) runs of starts as maximal runs of bytes (from, to), one pass over the sorted array."""
    empty = F.array().cast("array<struct<from: bigint, to: bigint>>")

    def step(done: Column, r: Column) -> Column:
        start, end, last = r["lo"], r["hi"] + (width - 1), F.element_at(done, -1)
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["from"].alias("from"), F.greatest(last["to"], end).alias("to"))))
        apart = F.concat(done, F.array(F.struct(start.alias("from"), end.alias("to"))))
        return F.when((F.size(done) > 0) & (start <= F.try_element_at(done, F.lit(-1))["to"]), joined).otherwise(apart)

    return F.aggregate(F.array_sort(runs), empty, step)


def removed_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, group_runs: int = GROUP_RUNS) -> DataFrame:
    """doc_id, n_bytes, spans (array of (from, to): the maximal runs of bytes that go) and kept (the bytes that stay) for every row of docs(doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    known = docs.select("doc_id", text.cast("binary").alias("raw"), F.xxhash64(text).alias("text_hash"), F.octet_length(text).cast("bigint").alias("n_bytes"))
    starts = repeated_starts(known, width, gram, group_runs)
    spans = durable(starts.groupBy("text_hash", "n_bytes").agg(F.collect_set(F.struct("lo", "hi")).alias("runs")).select("text_hash", "n_bytes", merged(F.col("runs"), width).alias("spans")), "spans")
    marked = known.withColumn("may", may_hold(spans, "text_hash", "text_hash"))
    hit = marked.where("may").drop("may").withColumn("spread", F.monotonically_increasing_id())
    copies = hit.groupBy("text_hash").count()
    n_rows = copies.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    values = spans.join(copies, "text_hash").select("text_hash", F.struct("n_bytes", "spans").alias("found"), F.col("count").alias("copies"))
    met = attach(hit, values, "text_hash", "found", n_rows, "spread")
    none = F.array().cast("array<struct<from: bigint, to: bigint>>")
    met = met.where("found is null or found.n_bytes = n_bytes").select("doc_id", "n_bytes", "raw", F.coalesce("found.spans", none).alias("spans"))
    both = met.unionByName(marked.where("not may").select("doc_id", "n_bytes", "raw", none.alias("spans")))
    return both.select("doc_id", "n_bytes", "spans", F.when(F.size("spans") == 0, F.col("raw")).otherwise(kept_bytes(F.col("raw"), F.col("spans"), F.col("n_bytes"))).alias("kept"))


def kept_bytes(raw: Column, spans: Column, n_bytes: Column) -> Column:
    """The bytes outside the spans, in order."""
    begins = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(spans, lambda s: s["to"]))
    ends = F.concat(F.transform(spans, lambda s: s["from"]), F.array(n_bytes))
    gaps = F.filter(F.arrays_zip(begins.alias("b"), ends.alias("e")), lambda g: g["e"] > g["b"])
    return F.aggregate(gaps, F.lit(b""), lambda out, g: F.concat(out, F.substring(raw, (g["b"] + 1).cast("int"), (g["e"] - g["b"]).cast("int"))))


def digests(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, group_runs: int = GROUP_RUNS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs(doc_id, text)."""
    found = removed_spans(docs, width, gram, group_runs)
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
