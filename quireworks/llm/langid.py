"""Language labels for spans of mixed-language text.

Every word has a score for each learned language, the sum of log probabilities of its character n-grams.
The script of the word, by ranges of code points, narrows the candidates to languages written in it. A
Viterbi path over the words, with a penalty for each switch, labels spans; a text's language is the one with
most letters on its path, its score that language's share of the letters.

Defined cases: null texts and texts without letters have no span, the label `und` and score 0; with
nothing to learn from, every label is `und`; repeated rows are labelled each; equal shares go to the first
language by name; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireworks.llm.common import gives_back, id_fold, small_batches

#: Texts of each language that the n-gram profiles are fitted on, at most (expected size; picked by hash).
FIT_ROWS = 5000
#: Hashed n-grams of 1 to MAX_N characters; the penalty for a switch, in nats; words of a Viterbi chunk.
BUCKETS, MAX_N, SWITCH, CHUNK = 1 << 15, 3, 12.0, 64
#: Words whose scores a worker remembers; longer words (in characters) are scored each time; labels a Viterbi table may hold at once.
CACHE_WORDS, CACHE_LONGEST, TABLE_LABELS = 200_000, 64, 1 << 22
#: New words that are scored at once; bounds what n-gram tables of a batch take.
SCORED_WORDS = 20_000
FOLDS, HELD_OUT = 4, 2

# First and last code points of scripts.
SCRIPTS = [
    ("Latin", 0x41, 0x24F), ("Greek", 0x370, 0x3FF), ("Cyrillic", 0x400, 0x52F), ("Armenian", 0x530, 0x58F), ("Hebrew", 0x590, 0x5FF),
    ("Arabic", 0x600, 0x77F), ("Devanagari", 0x900, 0x97F), ("Bengali", 0x980, 0x9FF), ("Tamil", 0xB80, 0xBFF), ("Thai", 0xE00, 0xE7F),
    ("Georgian", 0x10A0, 0x10FF), ("Latin", 0x1E00, 0x1EFF), ("Greek", 0x1F00, 0x1FFF), ("Kana", 0x3040, 0x30FF), ("Han", 0x3400, 0x9FFF), ("Hangul", 0xAC00, 0xD7AF),
]
_NAMES = sorted({s[0] for s in SCRIPTS})
_STARTS = np.array([s[1] for s in SCRIPTS])
_ENDS = np.array([s[2] for s in SCRIPTS])
_KIND = np.array([_NAMES.index(s[0]) for s in SCRIPTS])
_OTHER = len(_NAMES)


def _letters_table() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


_LETTER = _letters_table()


class WordGrams:
    """Hashed character n-grams, letters and script of a list of words."""

    def __init__(self, words: list[str]):
        code = np.frombuffer((" " + "  ".join(words) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
        owner = np.repeat(np.arange(len(words)), lengths)
        is_letter = _LETTER[code]
        self.letters = np.bincount(owner[is_letter], minlength=len(words))
        at = np.searchsorted(_STARTS, code, side="right") - 1
        script = np.where((at >= 0) & (code <= _ENDS[at]), _KIND[at], _OTHER)
        votes = np.bincount(owner[is_letter] * (_OTHER + 1) + script[is_letter], minlength=len(words) * (_OTHER + 1)).reshape(len(words), -1)
        self.script = votes.argmax(axis=1)
        owners, buckets = [], []
        gram = np.zeros(len(code), dtype=np.uint64)
        for n in range(1, MAX_N + 1):
            stop = len(code) - n + 1
            gram = gram[:stop] * np.uint64(0x9E3779B97F4A7C15) + (code[n - 1 :] + n).astype(np.uint64)
            mixed = (gram ^ (gram >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            inside = owner[:stop] == owner[n - 1 :]
            if n == 1:
                inside = code != 32
            owners.append(owner[:stop][inside])
            buckets.append((mixed[inside] >> np.uint64(64 - 15)).astype(np.int64))
        self.owner, self.bucket = np.concatenate(owners), np.concatenate(buckets)


class Profiles:
    """log probabilities of n-gram buckets by language, and the scripts each language is written in."""

    def __init__(self, langs: list[str], grams: np.ndarray, scripts: np.ndarray, smooth: float = 0.5):
        self.langs = langs
        logp = np.log((grams + smooth) / (grams.sum(axis=1, keepdims=True) + smooth * BUCKETS))
        self.logp = (logp - logp.mean(axis=0)).T.astype(np.float64) if langs else logp.T
        share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        self.writes = share >= 0.01  # language x script

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores (words x languages) and letters of words. Words without letters, and in scripts no language has, say nothing."""
        g = WordGrams(words)
        out = np.empty((len(words), len(self.langs)))
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(g.owner, self.logp[g.bucket, k], len(words))
        allowed = self.writes[:, g.script].T
        out[~allowed & allowed.any(axis=1)[:, None]] -= 1e3
        out[(g.letters == 0) | ~allowed.any(axis=1)] = 0
        return out, g.letters


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float = SWITCH, chunk: int = CHUNK, most: int = TABLE_LABELS) -> np.ndarray:
    """The best label of every word of many texts, exactly, for a constant penalty a switch; texts go by lots whose tables hold `most` labels or so, one that needs more by a table of words x labels."""
    kinds = scores.shape[1]
    if kinds == 1 or not len(scores):
        return np.zeros(len(scores), dtype=np.int16)
    need = np.maximum(1, -(-lengths // chunk)) * chunk * kinds * kinds
    out, at = np.empty(len(scores), dtype=np.int16), 0
    begin, ends = 0, np.cumsum(lengths)
    while begin < len(lengths):
        stop = begin + max(1, int(np.searchsorted(np.cumsum(need[begin:]), most, side="right")))
        end = int(ends[stop - 1])
        if end > at:
            solve = viterbi_long if need[begin] > most else viterbi_chunks
            out[at:end] = solve(scores[at:end], lengths[begin:stop], penalty, chunk)
        begin, at = stop, end
    return out


def viterbi_long(scores: np.ndarray, lengths: np.ndarray, penalty: float, chunk: int) -> np.ndarray:
    """The path of one text, word after word: with a constant penalty all switches into a word leave from one label."""
    best, top, switch = scores[0].copy(), np.zeros(len(scores), np.int16), np.zeros(scores.shape, bool)
    for t in range(1, len(scores)):
        top[t] = k = best.argmax()
        leap = best[k] - penalty
        switch[t] = best < leap
        best = np.maximum(best, leap) + scores[t]
    path, now = np.empty(len(scores), np.int16), int(best.argmax())
    for t in range(len(scores) - 1, -1, -1):
        path[t] = now
        if switch[t, now]:
            now = int(top[t])
    return path


def viterbi_chunks(scores: np.ndarray, lengths: np.ndarray, penalty: float, chunk: int) -> np.ndarray:
    """Paths of many texts. Texts are cut into chunks that are solved side by side for every label before the
    chunk; the chunks of a text are then joined in order, and the paths read back. So steps are as many as
    words in a chunk.
    """
    kinds = scores.shape[1]
    docs = np.flatnonzero(lengths)
    if not len(docs):
        return np.zeros(0, dtype=np.int16)
    per = -(-lengths[docs] // chunk)
    first = np.concatenate([[0], np.cumsum(per)[:-1]])
    n = int(per.sum())
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]])[docs]
    which = np.repeat(np.arange(len(docs)), per)
    begin = start[which] + (np.arange(n) - first[which]) * chunk
    size = np.minimum(chunk, start[which] + lengths[docs][which] - begin)
    step = np.arange(chunk)
    inside = step[None, :] < size[:, None]
    padded = np.zeros((n, chunk, kinds))
    padded[inside] = scores
    best = padded[:, 0][:, None, :] - penalty * (1 - np.eye(kinds))
    came = np.empty((chunk, n, kinds, kinds), dtype=np.int16)  # step, chunk, label before the chunk, label now -> label one word earlier
    came[0] = np.arange(kinds)[None, :, None]
    keep = np.arange(kinds, dtype=np.int16)[None, None, :]
    for t in range(1, chunk):
        top = best.argmax(axis=2)
        leap = np.take_along_axis(best, top[..., None], 2) - penalty
        switch = leap > best
        came[t] = np.where(switch, top[..., None], keep)
        best = np.where(switch, leap, best) + padded[:, t][:, None, :]
    # join the chunks of each text
    total = np.zeros((len(docs), kinds))
    entry = np.empty((n, kinds), dtype=np.int16)  # label before the chunk, for each label at its end
    most = int(per.max())
    order = np.argsort(-per, kind="stable")
    for j in range(most):
        live = order[: int(np.searchsorted(-per[order], -j, side="left"))]
        at = first[live] + j
        through = total[live][:, :, None] + best[at]
        entry[at] = through.argmax(axis=1)
        total[live] = through.max(axis=1)
    last = np.empty(n, dtype=np.int64)
    label = total.argmax(axis=1)
    for j in range(most - 1, -1, -1):
        live = order[: int(np.searchsorted(-per[order], -j, side="left"))]
        at = first[live] + j
        last[at] = label[live]
        label[live] = entry[at, label[live]]
    enter = entry[np.arange(n), last].astype(np.int64)
    path = np.empty((n, chunk), dtype=np.int16)
    now, rows = last, np.arange(n)
    for t in range(chunk - 1, -1, -1):
        path[:, t] = now
        now = came[t, rows, enter, now].astype(np.int64)
    return path[inside]


class Labeller:
    """Labels batches of texts; word scores are remembered across batches."""

    def __init__(self, profiles: Profiles):
        self.profiles = profiles
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.profiles.langs)))
        self.letters = np.zeros(0, dtype=np.int64)

    def paths(self, texts: list[str | None]) -> tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray]:
        """words and, over all of them, owner text, letters and label."""
        if len(self.letters) > CACHE_WORDS:
            self.forget()
        words = [(t or "").lower().split() for t in texts]
        flat = list(chain.from_iterable(words))
        new = [w for w in dict.fromkeys(flat) if w not in self.at]
        if new:
            self.at |= {w: k for k, w in enumerate(new, len(self.letters))}
            parts = [self.profiles.word_scores(new[k : k + SCORED_WORDS]) for k in range(0, len(new), SCORED_WORDS)]
            self.scores, self.letters = (np.concatenate([kept, *some]) for kept, some in zip((self.scores, self.letters), zip(*parts)))
        at = np.fromiter(map(self.at.__getitem__, flat), np.int64, len(flat))
        for w in new:
            if len(w) > CACHE_LONGEST:
                del self.at[w]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        return words, np.repeat(np.arange(len(words)), lengths), self.letters[at], viterbi(self.scores[at], lengths)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Each text's language and that language's share of the letters."""
        langs, n = self.profiles.langs, len(texts)
        if not langs:
            return ["und"] * n, np.zeros(n)
        _, owner, letters, label = self.paths(texts)
        share = np.bincount(owner * len(langs) + label, letters, n * len(langs)).reshape(n, len(langs))
        total = share.sum(axis=1)
        names = [langs[k] if t else "und" for k, t in zip(share.argmax(axis=1).tolist(), total.tolist())]
        return names, share.max(axis=1) / np.maximum(total, 1)


def fit(train: DataFrame, fit_rows: int = FIT_ROWS) -> Profiles:
    """Profiles from train(text, lang). Each language gives about fit_rows texts at most, picked by a hash of the text among all its rows."""
    known = train.where("text is not null and lang is not null")
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    rate = F.create_map(*chain.from_iterable((F.lit(k), F.lit(min(1.0, fit_rows / n))) for k, n in sizes.items())) if sizes else F.lit(None)
    if not langs:
        return Profiles([], np.zeros((0, BUCKETS)), np.zeros((0, _OTHER + 1)))
    some = known.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < rate[F.col("lang")] * (1 << 20)).select("text", "lang")
    width = BUCKETS + _OTHER + 1

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(langs), width))
        for frame in frames:
            for k, lang in enumerate(langs):
                seen: Counter = Counter()
                for t in frame["text"][frame["lang"] == lang]:
                    seen.update(t.lower().split())
                if seen:
                    g, n = WordGrams(list(seen)), np.fromiter(seen.values(), np.float64, len(seen))
                    sums[k, :BUCKETS] += np.bincount(g.bucket, n[g.owner], BUCKETS)
                    sums[k, BUCKETS:] += np.bincount(g.script, n * g.letters, _OTHER + 1)
        k, b = np.nonzero(sums)
        yield pd.DataFrame({"lang": k, "slot": b, "n": sums[k, b]})

    got = some.mapInPandas(gives_back(run), "lang int, slot int, n double").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros((len(langs), width))
    sums[got["lang"].to_numpy(), got["slot"].to_numpy()] = got["n"].to_numpy()
    return Profiles(langs, sums[:, :BUCKETS], sums[:, BUCKETS:])


def label_spans(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, first_word, n_words, letters, lang of every span of every row of docs(doc_id, text)."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(shared.value)
        for frame in frames:
            words, owner, letters, label = labeller.paths(list(frame["text"]))
            if not len(owner) or not shared.value.langs:
                continue
            new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (label[1:] != label[:-1])])
            base = np.concatenate([[0], np.cumsum([len(w) for w in words])[:-1]])
            yield pd.DataFrame({
                "doc_id": frame["doc_id"].to_numpy()[owner[new]], "first_word": new - base[owner[new]], "n_words": np.diff(np.r_[new, len(owner)]),
                "letters": np.add.reduceat(letters, new), "lang": np.array(shared.value.langs)[label[new]],
            })

    return docs.select("doc_id", "text").mapInPandas(gives_back(run), f"doc_id {kind}, first_word long, n_words long, letters long, lang string")


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs(doc_id, text): the language with most letters on the Viterbi path, and its share."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    source = docs.select("doc_id", (id_fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for batch in batches:
            names, score = labeller.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return source.mapInArrow(gives_back(run), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Fits on the rows of docs(doc_id, text, lang) outside the held-out fold and predicts every row."""
    return predict(docs, fit(docs.where(id_fold("doc_id", FOLDS) != HELD_OUT).select("text", "lang")))


def label_of(spark: SparkSession, profiles: Profiles, text: Column) -> Column:
    """struct(lang_pred, score) of a text column, for filters that keep other columns."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(profiles)

    def labels(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(shared.value)
        for texts in parts:
            names, score = labeller.predict([None if t is None else t for t in texts])
            yield pd.DataFrame({"lang_pred": names, "score": score})

    return F.pandas_udf(gives_back(labels), "lang_pred string, score double")(text)
