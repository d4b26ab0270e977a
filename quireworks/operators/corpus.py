"""A corpus in numbers: constants by document frequency, line shapes and lengths, page flags."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quireworks.functions import text as T
from quireworks.operators import quotes
from quireworks.operators.tables import written

#: Characters of the grams that are counted first: three of 21 bits fit a code.
BASE = 3
#: Codes of pages that a task adds up at once, looked at every 64 pages.
CODES = 1 << 21
#: What stands between texts that are read together: the code of no character.
BREAK = 0x1FFFFF
SHAPES = ["dateish", "money", "short", "body", "other"]


def exact_constants(lines: DataFrame, page: str = "doc_id", shortest: int = 2, longest: int = 30) -> DataFrame:
    """text, pages_hit, ratio of normalised lines by distinct pages."""
    n = lines.select(page).distinct().agg(F.count("*").alias("n_pages"))
    # exploding keeps the form from being computed again by the filter
    found = lines.select(page, F.explode(F.array(T.normal_line(F.col("line")))).alias("text")).where(F.length("text").between(shortest, longest)).distinct()
    return found.groupBy("text").agg(F.count("*").alias("pages_hit")).join(F.broadcast(n)).select("text", "pages_hit", F.round(F.col("pages_hit") / F.col("n_pages"), 4).alias("ratio"))


def gram_frequency(texts: DataFrame, page: str, text: str, least_ratio: float = 0.9, shortest: int = 3, longest: int = 6) -> DataFrame:
    """gram, pages_hit of character n-grams in least_ratio of the pages or more.

    Every part of a frequent gram is frequent, so longer grams are counted only where the shorter ones they begin and end
    with are: first those of BASE characters, then those up to twice as long, which are pairs of these. The texts of a
    page are read together, each gram counts once in it, and tasks hand on counts by gram: no row is made for a gram of
    a page. The driver holds the frequent grams, at most as many as a mean page has grams, by least_ratio.
    """
    spark, n_pages = texts.sparkSession, texts.agg(F.count_distinct(page)).first()[0]
    dealt = texts.where(F.col(page).isNotNull() & F.col(text).isNotNull()).select(F.col(page).alias("page"), F.col(text).alias("text")).repartition("page").sortWithinPartitions("page")
    chain: list[tuple[int, np.ndarray]] = []
    size, names, out = min(shortest, BASE), [], []
    lengths = range(size, size + 1)
    while len(lengths):
        held = spark.sparkContext.broadcast(chain)
        counts = dealt.mapInArrow(_counted(lengths, held), "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("pages_hit"))
        found = written(counts.where(F.col("pages_hit") / F.lit(n_pages) >= least_ratio), "frequent-grams")
        known = np.sort(np.array([r.code for r in found.select("code").collect()], np.int64))
        spell = _speller(size, names) if chain else _characters(size)
        gram = F.udf(spell, "string")(F.col("code"))
        out.append(found.select(gram.alias("gram"), "pages_hit").where(F.length("gram") >= shortest))
        last = known if not chain else known[known // max(1, len(names)) ** 2 == lengths[-1] - size - 1]
        names, size = [spell(c) for c in last.tolist()], lengths[-1]
        chain = [*chain, (size, last)]
        lengths = range(size + 1, min(2 * size, longest) + 1) if len(last) or size == 1 else range(0)
    return reduce(DataFrame.unionByName, out)


def _characters(size: int):
    return lambda code: "".join(chr(code >> 21 * k & 0x1FFFFF) for k in range(size - 1, -1, -1))


def _speller(size: int, names: list[str]):
    """The gram of a code, which is of two frequent grams of `size` characters and how far they are apart."""
    def spell(code: int) -> str:
        apart, pair = divmod(code, len(names) ** 2)
        first, last = divmod(pair, len(names))
        return names[first] + names[last][-apart - 1 :]

    return spell


def _stretches(chars: np.ndarray, size: int) -> np.ndarray:
    """A code for each stretch of `size` characters (BASE at most), equal for equal stretches only."""
    last = max(0, len(chars) - size + 1)
    out = chars[:last]
    for k in range(1, size):
        out = (out << 21) | chars[k : k + last]
    return out


def _one(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of texts, one behind the other with a BREAK between two, and where these stand."""
    chars, breaks = quotes.codes("\n".join(texts)), np.cumsum([len(t) + 1 for t in texts[:-1]], dtype=np.int64) - 1
    chars[breaks] = BREAK
    return chars, breaks


def _pairs(at: np.ndarray, apart: int, n: int) -> np.ndarray:
    """Codes of stretches of which all shorter ones are frequent, from their places among n frequent ones; else -1."""
    size = max(0, len(at) - apart)
    whole = np.ones(size, bool)
    for k in range(apart + 1):
        whole &= at[k : k + size] >= 0
    return np.where(whole, (apart - 1) * n * n + at[:size] * n + at[apart : apart + size], -1)


def _places(chars: np.ndarray, chain: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Of each stretch of a text its place among the longest frequent grams, -1 for others."""
    at, before = _stretches(chars, chain[0][0]), None
    for size, known in chain:
        coded = at if before is None else _pairs(at, size - before[0], len(before[1]))
        place = np.minimum(np.searchsorted(known, coded), max(0, len(known) - 1))
        at, before = (np.where(known[place] == coded, place, -1) if len(known) else np.full(len(coded), -1)), (size, known)
    return at


def _counted(lengths: range, held):
    """For batches of page and text, in the order of pages: codes of grams with the number of pages that have them, in parts."""

    def of(texts: list[str]) -> np.ndarray:
        (chars, breaks), chain = _one(texts), held.value
        if not chain:
            found = _stretches(chars, lengths[0])
            within = np.ones(len(chars), bool)
            for k in range(lengths[0]):
                within[np.maximum(breaks - k, 0)] = False
            return np.unique(found[within[: len(found)]])
        at, (size, known) = _places(chars, chain), chain[-1]  # no stretch with a BREAK is frequent
        found = np.concatenate([_pairs(at, n - size, len(known)) for n in lengths])
        return np.unique(found[found >= 0])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, texts, parts, done, chars, size = None, [], [], [], 0, 0

        def added() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(done), return_counts=True)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(n, pa.int64())], ["code", "n"])

        def joined() -> np.ndarray:
            if texts:
                parts.append(of(texts))
                texts.clear()
            return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))

        for batch in batches:
            for p, t in zip(batch.column("page").to_pylist(), batch.column("text").to_pylist()):
                if p != page and (texts or parts):
                    done.append(joined())
                    parts.clear()
                    chars = size = 0
                    if len(done) % 64 == 0 and sum(map(len, done)) > CODES:
                        yield added()
                page = p
                texts.append(t)
                chars += len(t) + 1
                if chars > CODES:
                    parts.append(of(texts))
                    texts.clear()
                    chars, size = 0, size + len(parts[-1])
                    if size > CODES and len(parts) > 1:
                        parts[:] = [joined()]
                        size = 0
            if done:
                yield added()
        if texts or parts:
            done.append(joined())
            yield added()

    return run


def shape_share(lines: DataFrame) -> DataFrame:
    """shape, n, share for the shapes that occur."""
    kinds = lines.where("trim(line) <> ''").groupBy(T.line_shape(F.col("line")).alias("shape")).agg(F.count("*").alias("n"))
    return kinds.select("shape", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 4).alias("share"))  # five rows at most


def length_percentiles(lines: DataFrame) -> DataFrame:
    n = F.length("line")
    return lines.agg(F.percentile(n, 0.5).alias("len_median"), F.percentile(n, 0.9).alias("len_p90"), F.min(n).alias("len_min"), F.max(n).alias("len_max"))


def page_flags(pages: DataFrame, lines: DataFrame, page: str = "doc_id", thin: float = 0.4, outlier: float = 1.5, kana: float = 0.3) -> DataFrame:
    """lines, len_median and flags of each page against thresholds of the corpus: empty, thin, outlier_len, kana_heavy, kana_trace."""
    full = lines.where("trim(line) <> ''")
    per = full.groupBy(page).agg(F.count("*").alias("lines"), F.percentile(F.length("line"), 0.5).alias("len_median"), F.sum(F.length("line")).alias("chars"), F.sum(T.kana_count(F.col("line"))).alias("kana"))
    per = pages.select(page).distinct().join(per, page, "left").na.fill(0, ["lines"])
    limits = per.agg(F.percentile("lines", 0.5).alias("lines_median")).join(full.agg(F.percentile(F.length("line"), 0.9).alias("len_p90")))
    share = F.col("kana") / F.col("chars")
    flags = F.array_compact(F.array(
        F.when(F.col("lines") == 0, "empty"), F.when((F.col("lines") > 0) & (F.col("lines") < F.col("lines_median") * thin), "thin"),
        F.when(F.col("len_median") > F.col("len_p90") * outlier, "outlier_len"), F.when(share > kana, "kana_heavy").when(share > 0, "kana_trace"),
    ))
    return per.join(F.broadcast(limits)).select(page, "lines", F.round("len_median", 2).alias("len_median"), F.array_join(flags, ",").alias("flags"))
