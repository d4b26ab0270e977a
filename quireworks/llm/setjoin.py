"""Exact Jaccard joins of word n-gram sets by a token-group matrix.

A document's set is its distinct five-word shingles, as 64-bit hashes. Sets are partitioned into groups of
similar ones, a group stores the union of its members' signature tokens, and a set opens only groups whose
overlap with its own signature reaches the bound that a link implies. Opened pairs are compared exactly.

Why no link is lost. A link (100 * intersection >= 80 * union) leaves at most n // 5 tokens of either set
unshared. The first P = n // 5 + ceil(n / 16) tokens of each set in one global order are its signature. Of two
sets, take the one whose signature ends first in that order: its signature tokens that the other set has are
in the other's signature too. So if s signature tokens are shared, the intersection is at most s plus the
larger n - P, and a link needs so many shared ones. n - P moves in steps, so `needed` takes the least over a
range of sizes term by term, each from a bound without steps; a group of sets needs no more than its range of
sizes allows. Tokens keep all 64 bits, as the sets do. The order puts tokens found in many sets last, so a passage that many documents share stays out of
signatures.

Why no group is squared. Copies are one set. A set that shares too few signature tokens with all sets of any
size that could be linked to it is dropped. Near copies are first linked to a leader, the set among those with
one least token that has most shared tokens, which is the one most like all others; linked sets are then one
component, and a component's sets are never matched with each other. Of two components only the smaller
one's sets open groups of the larger one.

Defined cases: null, empty and white-space texts have an empty set and link with nothing; texts under five
words have one shingle, the whole sequence; rows that repeat an id keep one component each; a row without an
id stands for no set and takes the component of rows with its set, or none; ties of the leader go to the
smallest key; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from quireworks.llm.common import attach, durable, gives_back, may_hold, small_batches

#: Words of a shingle; members of a group; sets that make a token frequent; most frequent tokens handed to tasks.
WORDS, GROUP_SETS, FREQUENT, FREQUENT_MOST = 5, 32, 48, 1_000_000
#: Tokens, and signature tokens, that a task gathers before it hands them on; signature tokens of a bucket, about, and buckets at least and at most.
FLUSH_TOKENS, BUCKET_TOKENS, BUCKETS_LEAST, BUCKETS_MOST = 300_000, 1 << 20, 1024, 1 << 20
#: Sets of one token that a task sends for counting; more are shared beyond doubt.
LOCAL_MOST = 16
#: Sets that a task remembers, so as not to send their copies; copies of others are sent again.
REMEMBERED = 100_000

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M2
    return x ^ (x >> np.uint64(29))


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a UTF-8 text; a short text is one shingle."""
    w = text.lower().split()
    h = np.fromiter(map(xxh3_64_intdigest, w), np.uint64, len(w))
    if not len(h):
        return h
    span = min(words, len(h))
    out = np.full(len(h) - span + 1, np.uint64(span))
    for k in range(span):
        out = out * _M1 + h[k : len(h) - span + 1 + k]
    return np.unique(mix(out))


def set_key(tokens: np.ndarray) -> int:
    return xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def signature(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The first n // 5 + ceil(n / 16) tokens: rare ones by hash, then frequent ones from the less frequent on (frequent: tokens, ascending, with their rank)."""
    n = len(tokens)
    size = n // 5 + -(-n // 16)
    at = np.searchsorted(frequent["token"], tokens)
    hot = (at < len(frequent)) & (frequent["token"][np.minimum(at, len(frequent) - 1)] == tokens) if len(frequent) else np.zeros(n, bool)
    rare = tokens[~hot]
    if len(rare) >= size:
        return rare[:size]
    shared = tokens[hot][np.argsort(frequent["rank"][at[hot]], kind="stable")]
    return np.concatenate([rare, shared[: size - len(rare)]])


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if 100 * min(len(a), len(b)) < 80 * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 80 * (len(a) + len(b) - both)


def describe(docs: DataFrame) -> DataFrame:
    """A row for each row of docs(doc_id, text, text_hash) (with key, n, first, second: the two least tokens by two orders), and rows (token, seen) for tokens that a task saw in two sets or more."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        held = 0

        def frequent(id_type: pa.DataType) -> pa.RecordBatch:
            token, seen = np.unique(np.concatenate([*kept.values(), np.zeros(0, np.uint64)]), return_counts=True)
            token, seen = token[seen > 1].view(np.int64), seen[seen > 1]
            none = lambda t: pa.nulls(len(token), t)
            return pa.RecordBatch.from_arrays([none(id_type), *(none(pa.int64()) for _ in range(5)), pa.array(token), pa.array(seen.astype(np.int64))], names)

        for batch in batches:
            id_type = batch.column("doc_id").type
            keys, sizes, first, second = [], [], [], []
            for text in batch.column("text").to_pylist():
                t = shingle_set(text)
                keys.append(set_key(t) if len(t) else None)
                sizes.append(len(t))
                first.append(int(t[0].view(np.int64)) if len(t) else None)
                second.append(int(t[mix(t * _M1).argmin()].view(np.int64)) if len(t) else None)
                if len(t) and keys[-1] not in kept:
                    kept[keys[-1]] = t
                    held += len(t)
            n = len(keys)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *(pa.array(x, pa.int64()) for x in (keys, sizes, first, second)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names)
            if held > FLUSH_TOKENS:
                yield frequent(id_type)
                kept, held = {}, 0
        if kept:
            yield frequent(id_type)

    names = ["doc_id", "text_hash", "key", "n", "first", "second", "token", "seen"]
    return docs.mapInArrow(gives_back(run), f"doc_id {kind}, text_hash bigint, key bigint, n bigint, first bigint, second bigint, token bigint, seen bigint")


def frequent_tokens(described: DataFrame, most: int = FREQUENT_MOST) -> np.ndarray:
    """Tokens of FREQUENT sets or more, with their rank by frequency. The least count rises until they are `most` at most, so what tasks hold is bounded; a token that is left out costs time, never a link."""
    counts = described.where("token is not null").groupBy("token").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= FREQUENT)
    levels = counts.groupBy(F.floor(F.log2("seen")).alias("level")).count().orderBy(F.desc("level")).collect()
    least, total = None, 0
    for r in levels:
        total += r["count"]
        if total > most:
            break
        least = 2 ** r["level"]
    if least is None:
        return np.zeros(0, dtype=[("token", np.uint64), ("rank", np.int64)])
    found = counts.where(F.col("seen") >= least).toArrow()
    out = np.zeros(len(found), dtype=[("token", np.uint64), ("rank", np.int64)])
    out["token"] = found["token"].to_numpy().view(np.uint64)
    out["rank"] = found["seen"].to_numpy()
    return np.sort(out, order="token")


def shared_signatures(docs: DataFrame, frequent: np.ndarray, size: int = 0, remembered: int = REMEMBERED) -> DataFrame:
    """(token, key) for signature tokens that two sets or more have; size: signature tokens of all sets, about.

    Tasks deal blocks of (token, key) into buckets by the leading bits of the token, which is spread by an odd
    factor first; what a task itself saw in many sets is known to be shared and goes to any bucket. A bucket
    is counted when all of its blocks have come, so a task holds one bucket.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    bits = max(BUCKETS_LEAST, min(BUCKETS_MOST, -(-size // BUCKET_TOKENS))).bit_length() - 1

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        tokens, keys, held = [], [], 0
        turn = 0

        def blocks() -> pa.RecordBatch:
            nonlocal turn
            t, k = np.concatenate(tokens), np.concatenate(keys)
            order = np.lexsort((k, t))
            t, k = t[order], k[order]
            new = np.r_[True, (t[1:] != t[:-1]) | (k[1:] != k[:-1])]  # a copy says nothing: the two rows that are sent for counting must be two sets
            t, k = t[new], k[new]
            begin = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
            length = np.diff(np.r_[begin, len(t)])
            rank = np.arange(len(t)) - np.repeat(begin, length)
            known = (np.repeat(length, length) > LOCAL_MOST) & (rank >= 2)
            rows = []
            some_t, some_k = t[~known], k[~known]
            for b, s, e in zip(*_runs((some_t >> np.uint64(64 - bits)).astype(np.int64))):
                rows.append((b, False, some_t[s:e].tobytes(), some_k[s:e].tobytes()))
            known_t, known_k = t[known], k[known]
            for at in range(0, len(known_t), 4096):
                rows.append(((turn := turn + 7919) % (1 << bits), True, known_t[at : at + 4096].tobytes(), known_k[at : at + 4096].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.binary())], ["bucket", "known", "tokens", "keys"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                s = shingle_set(text)
                if not len(s) or (key := set_key(s)) in done:
                    continue
                if len(done) < remembered:
                    done.add(key)
                t = signature(s, shared.value) * _M1
                tokens.append(t)
                keys.append(np.full(len(t), key, dtype=np.int64))
                held += len(t)
                if held > FLUSH_TOKENS:
                    yield blocks()
                    tokens, keys, held = [], [], 0
        if held:
            yield blocks()

    def pairs(t: np.ndarray, k: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(k)], ["token", "key"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tokens, keys = None, [], []

        def several() -> pa.RecordBatch:
            t, k = np.concatenate(tokens), np.concatenate(keys)
            order = np.lexsort((k, t))
            t, k = t[order], k[order]
            new = np.r_[True, (t[1:] != t[:-1]) | (k[1:] != k[:-1])]
            t, k = t[new], k[new]
            same = t[1:] == t[:-1]
            met = np.r_[same, False] | np.r_[False, same]
            return pairs(t[met], k[met])

        for batch in batches:
            for bucket, known, t, k in zip(*(batch.column(c).to_pylist() for c in ("bucket", "known", "tokens", "keys"))):
                t, k = np.frombuffer(t, np.uint64), np.frombuffer(k, np.int64)
                if known:
                    yield pairs(t, k)
                    continue
                if bucket != now and tokens:
                    yield several()
                    tokens, keys = [], []
                now = bucket
                tokens.append(t)
                keys.append(k)
        if tokens:
            yield several()

    dealt = docs.select("text").mapInArrow(gives_back(deal), "bucket int, known boolean, tokens binary, keys binary")
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(gives_back(count), "token long, key long")


def _runs(values: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    begin = np.flatnonzero(np.r_[True, values[1:] != values[:-1]][: len(values)])
    return values[begin].tolist(), begin.tolist(), np.r_[begin[1:], len(values)].astype(int).tolist() if len(begin) else []


def signature_size(n: Column) -> Column:
    return F.floor(n / 5) + F.ceil(n / 16)


def needed(n: Column, least: Column, most: Column) -> Column:
    """Shared signature tokens that a link of a set of n tokens to one of least to most tokens needs, or fewer; null if sizes rule a link out.

    To a set of m tokens it is ceil(4 (n + m) / 9) - max(n - P(n), m - P(m)), and one at least. Over a range, the
    term with n - P(n) is least at the smallest m. m - P(m) is at most 0.7375 m + 0.8, as P(m) is at least
    m / 5 - 0.8 + m / 16; the term with that falls as m grows, so it is least at the largest m.
    """
    lo, hi = F.greatest(least, F.ceil(n * 4 / 5)), F.least(most, F.floor(n * 5 / 4))
    rising = F.ceil((n + lo) * 4 / 9) - (n - signature_size(n))
    falling = F.ceil((n + hi) * 4 / 9 - hi * 0.7375 - 0.8 - 1e-6)
    return F.when(lo <= hi, F.greatest(F.lit(1), F.least(rising, falling)))


def size_class(n: Column) -> Column:
    """Classes of sizes a tenth apart."""
    return F.floor(F.log(n) / F.log(F.lit(1.1)) + 1e-9).cast("int")


def prune(postings: DataFrame, sets: DataFrame, rounds: int = 2) -> DataFrame:
    """postings (token, key, n) of sets that share enough signature tokens with the sets of some class of sizes."""
    now = postings.join(sets.select("key", "n"), "key").dropDuplicates(["token", "key"])
    for _ in range(rounds):
        now = durable(now, "postings").withColumn("cls", size_class(F.col("n")))
        others = now.groupBy("token", F.col("cls").alias("other")).agg(F.min("key").alias("a"), F.max("key").alias("b"))
        near = F.col("other").between(F.col("cls") - 3, F.col("cls") + 3) & ~((F.col("a") == F.col("key")) & (F.col("b") == F.col("key")))
        met = now.join(others, "token").where(near).groupBy("key", "n", "other").agg(F.count("*").alias("shared"))
        least, most = F.floor(F.pow(F.lit(1.1), F.col("other") - 1e-6)), F.ceil(F.pow(F.lit(1.1), F.col("other") + 1 + 1e-6))
        keep = met.where(F.col("shared") >= needed(F.col("n"), least, most)).select("key").distinct()
        now = now.join(keep, "key", "left_semi").select("token", "key", "n")
    return durable(now, "postings")


def token_sets(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, tokens) of each of sets(key, rep), from the text of the document that stands for it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, found = [], []
            for k, (key, text) in enumerate(zip(batch.column("key").to_pylist(), batch.column("text").to_pylist())):
                t = shingle_set(text)
                if len(t) and set_key(t) == key:  # another row may have the same id
                    keep.append(k)
                    found.append(t.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(keep, pa.int64())), pa.array(found, pa.binary())], ["key", "tokens"])

    reps = sets.select("key", F.col("rep").alias("doc_id"))
    held = docs.where(may_hold(reps, "doc_id", "doc_id")).join(reps, "doc_id").select("key", "text")
    return held.mapInArrow(gives_back(run), "key bigint, tokens binary").dropDuplicates(["key"])


def check_pairs(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """The linked ones of pairs(a, b)."""
    left, right = tokens.select(F.col("key").alias("a"), F.col("tokens").alias("left")), tokens.select(F.col("key").alias("b"), F.col("tokens").alias("right"))

    @F.pandas_udf("boolean")
    def is_link(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([linked(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) for p, q in zip(x, y)], dtype=bool)

    return pairs.join(left, "a").join(right, "b").where(is_link("left", "right")).select("a", "b")


def stars(sets: DataFrame, by: str, tokens: DataFrame) -> DataFrame:
    """Links (a: leader, b) of sets to a leader that has the same least token: the one with the smallest share of tokens that no other set has, then the least key."""
    leaders = sets.groupBy(by).agg(F.min(F.struct("alone", "key"))["key"].alias("a"), F.count("*").alias("size")).where("size > 1").select(by, "a")
    pairs = sets.join(leaders, by).where("key <> a").select("a", F.col("key").alias("b"))
    return durable(check_pairs(pairs, tokens), "star-links")


def open_groups(postings: DataFrame, homes: DataFrame, tokens: DataFrame) -> DataFrame:
    """Links (a, b) between sets of different components. homes(key, n, comp) gives every set its component; a group is a part of a component of sets of like size, GROUP_SETS or so.

    The matrix has a row for each token and group. A set counts the tokens it has in common with a group of
    a larger component and opens it if the count allows a link.
    """
    sizes = homes.groupBy("comp").agg(F.count("*").alias("size"))
    part = F.struct(size_class(F.col("n")).alias("cls"), F.pmod(F.xxhash64("key"), F.ceil(F.col("size") / GROUP_SETS).cast("long")).alias("slice"))
    placed = durable(homes.join(sizes, "comp").select("key", "n", F.struct("size", "comp").alias("home"), part.alias("part")), "placed")
    held = durable(postings.select("token", "key").join(placed, "key"), "homed-postings")
    span = held.groupBy("token").agg(F.min("home").alias("least"), F.max("home").alias("most")).where("least < most")
    live = held.join(span, "token")
    matrix = live.where("home > least").select("token", F.col("home").alias("other"), F.col("part").alias("grp")).distinct()
    groups = placed.groupBy(F.col("home").alias("other"), F.col("part").alias("grp")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    probes = live.where("home < most").select("token", "key", "n", "home", "part")
    near = F.abs(F.col("grp.cls") - F.col("part.cls")) <= 3
    counts = probes.join(matrix, "token").where((F.col("home") < F.col("other")) & near).groupBy("key", "n", "other", "grp").agg(F.count("*").alias("shared"))
    opened = durable(counts.join(groups, ["other", "grp"]).where(F.col("shared") >= needed(F.col("n"), F.col("lo"), F.col("hi"))).select("key", "n", "other", "grp"), "opened")
    members = placed.select(F.col("home").alias("other"), F.col("part").alias("grp"), F.col("key").alias("b"), F.col("n").alias("m"))
    pairs = opened.join(members, ["other", "grp"]).where("100 * least(n, m) >= 80 * greatest(n, m)").select(F.col("key").alias("a"), "b")
    return check_pairs(pairs, tokens)


def components(links: DataFrame) -> DataFrame:
    """(key, comp) for every key of links(a, b): comp is the least key reachable. Large-star and small-star steps until nothing changes; each round ends in the shared folder."""
    edges = durable(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state, before = (lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()), None
    while (now := state(edges)) != before:
        before = now
        # large star: neighbours above u go to the least of u's neighbourhood
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("copies"))
        large = attach(both, least, "u", "m", 2 * now[0], "v").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: neighbours below u, and u, go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = durable(small, "edges")
    found = edges.select(F.col("u").alias("key"), F.col("v").alias("comp"))
    return found.unionByName(found.select(F.col("comp").alias("key"), "comp").distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, text_hash, set_group of every row of docs(doc_id, text).

    component_id is the smallest doc_id reachable by links; text_hash is xxhash64 of the text; rows are in one
    component if their set_group is equal (null for those with an empty set).
    """
    small_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit("")).cast("binary")
    source = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_hash"))
    described = durable(describe(source), "described")
    rows = described.where("n is not null").select("doc_id", "text_hash", "key", "n")
    with_set = described.where("key is not null and doc_id is not null")
    sets = durable(
        with_set.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("first").alias("first"), F.first("second").alias("second"), F.count("*").alias("copies")), "sets"
    )
    n_rows, size = sets.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.sum(signature_size(F.col("n"))), F.lit(0))).first()

    postings = prune(shared_signatures(source, frequent_tokens(described), size), sets)
    held = postings.groupBy("key").agg(F.count("*").alias("shared"))
    live = durable(sets.drop("copies").join(held, "key").withColumn("alone", F.round(1 - F.col("shared") / signature_size(F.col("n")), 3)).drop("shared"), "live-sets")
    tokens = durable(token_sets(source, live), "token-sets")

    one = stars(live, "first", tokens)
    homes = live.join(one.select(F.col("b").alias("key"), F.col("a").alias("comp")), "key", "left").select("key", "n", "second", "alone", F.coalesce("comp", "key").alias("comp"))
    two = stars(homes.where("key = comp"), "second", tokens)
    homes = homes.join(two.select(F.col("b").alias("comp"), F.col("a").alias("top")), "comp", "left").select("key", "n", F.coalesce("top", "comp").alias("comp"))
    links = one.unionByName(two).unionByName(open_groups(postings, homes, tokens))

    homed = durable(sets.join(components(links), "key", "left").select("key", "rep", "copies", F.coalesce("comp", "key").alias("comp")), "homed")
    names = homed.groupBy("comp").agg(F.min("rep").alias("component"), F.count("*").alias("copies"))
    placed = attach(homed, names.where("copies > 1"), "comp", "component", homed.count(), "key")
    named = placed.select("key", F.struct(F.coalesce("component", "rep").alias("component"), F.col("comp").alias("set_group")).alias("home"), "copies")
    return attach(rows, durable(named, "named-sets"), "key", "home", n_rows, "doc_id").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("home.component", "doc_id").alias("component_id"), "text_hash", "home.set_group"
    )
