"""Toxicity by weak supervision.

Lexicons of words and word beginnings are drawn from labelled texts and dealt into voters; patterns (shouting,
masked words, repeated signs, several lexicon words together) are voters too, and so are labels, where there are any.
A generative label model has, for either class, each voter's rate of firing given what one other voter does: a tree of
the strongest dependencies within the classes. Expectation maximisation over the patterns of votes of all texts that may be learned
from estimates these rates, which are accuracies and correlations in one, and the accuracy of labels. A linear
classifier is then trained on the posterior labels, and scores every text.

Defined cases: a null or empty text is scored as a text without features; a null id counts as empty text in
the fold; without labels every score is the prior (0); of conflicting labels of one id or one text the toxic
one counts; repeated rows are scored each; an empty table gives an empty result; labels, lang, source and ids are no inputs of a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireworks.llm.common import durable, gives_back, id_fold, small_batches

#: Labelled rows that lexicons and classifier are fitted on, at most (expected size; picked by a hash of the id).
FIT_ROWS = 20_000
#: Least share of labels that are right; least mutual information (nats) of voters that depend on each other, over all texts and as so many nats beyond chance; rounds of expectation maximisation.
LABELS_RIGHT, LEAST_INFORMATION, BEYOND_CHANCE, ROUNDS = 0.99, 1e-3, 10.0, 60
#: Lexicon entries kept, groups they are dealt into, and least toxic texts and lift of an entry.
ENTRIES, LEXICON_VOTERS, LEAST_TEXTS, LEAST_LIFT = 800, 6, 3, 6.0
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3

_WORD = re.compile(r"\w+")
#: Shouting by signs, by density of signs, by capitals; masked words.
_PATTERNS = [lambda t: "!!" in t, lambda t: 50 * t.count("!") > len(t) > 0, str.isupper, lambda t: any(m in t for m in ("**", "@#", "#$", "$%"))]
VOTERS = LEXICON_VOTERS + 2 + len(_PATTERNS)


def text_features(text: str) -> set[str]:
    """Words, and beginnings of 4 and 5 letters of longer words, as lexicon entries name them."""
    words = set(_WORD.findall(text.lower()))
    return words | {f"{w[:4]}-" for w in words if len(w) > 4} | {f"{w[:5]}-" for w in words if len(w) > 5}


class Voters:
    """Votes of a text: a lexicon group fires if it holds an entry, two more if two or three words do, and each pattern if found."""

    def __init__(self, entries: list[str]):
        self.entry = {e: k for k, e in enumerate(entries)}
        self.whole = {e for e in entries if e[-1] != "-"}
        self.start4 = {e[:-1] for e in entries if e[-1] == "-" and len(e) == 5}
        self.start5 = {e[:-1] for e in entries if e[-1] == "-" and len(e) == 6}

    def hits(self, text: str) -> tuple[list[int], int, float]:
        """Entries in the text, how many of its words hold one (repeats count), and that number for each 50 words."""
        every = _WORD.findall(text.lower())
        words = set(every)
        whole = words & self.whole
        at4, at5 = self.start4.intersection(w[:4] for w in words), self.start5.intersection(w[:5] for w in words)
        if not (whole or at4 or at5):
            return [], 0, 0.0
        near4, near5 = {w for w in words if len(w) > 4 and w[:4] in at4}, {w for w in words if len(w) > 5 and w[:5] in at5}
        found = [self.entry[e] for e in whole | {f"{w[:4]}-" for w in near4} | {f"{w[:5]}-" for w in near5}]
        holding = whole | near4 | near5
        n = sum(w in holding for w in every)
        return found, n, 50 * n / len(every)

    def votes(self, text: str, found: list[int], n: int) -> int:
        """The votes as bits."""
        bits = 0
        for k in found:
            bits |= 1 << k % LEXICON_VOTERS
        bits |= (n >= 2) << LEXICON_VOTERS | (n >= 3) << LEXICON_VOTERS + 1
        for k, p in enumerate(_PATTERNS):
            if p(text):
                bits |= 1 << LEXICON_VOTERS + 2 + k
        return bits


class LabelModel:
    """P(class) * product over voters of P(vote | class, vote of its parent) * P(label | class), by expectation maximisation over vote patterns.

    parent: the voter that each one depends on (-1: none); rate[class, vote of the parent, voter]: how often it fires;
    right[class]: how often a label says the class. Labels name the classes, so they are held to be right more often than LABELS_RIGHT.
    """

    def __init__(self, patterns: np.ndarray, labels: np.ndarray, counts: np.ndarray, prior: float, rounds: int | None = None):
        fired, n, gold = self.fired(patterns), counts.astype(float), labels >= 0
        self.prior = min(max(prior, 1e-4), 0.5)
        if gold.any():  # start where labelled texts say
            q, w = np.where(gold, labels, 0.0).astype(float), n * gold
        else:
            q, w = (fired[:, :LEXICON_VOTERS].sum(axis=1) >= 2).astype(float), n
        self.right = np.array([LABELS_RIGHT, LABELS_RIGHT])
        for k in range(ROUNDS if rounds is None else rounds):
            if k % 10 == 0:
                self.parent = self.tree(fired, w * q, w * (1 - q))
            self.rate = np.stack([self.rates(fired, w * (1 - q)), self.rates(fired, w * q)])
            if k and gold.any():
                says = [(w * gold * (1 - q) * (labels == 0)).sum(), (w * gold * q * (labels == 1)).sum()]
                of = [(w * gold * (1 - q)).sum(), (w * gold * q).sum()]
                self.right = np.clip((np.array(says) + 1) / (np.array(of) + 1.05), LABELS_RIGHT, 0.999)
            q, w = self.posterior(patterns, labels), n

    @staticmethod
    def fired(patterns: np.ndarray) -> np.ndarray:
        return (np.asarray(patterns)[:, None] >> np.arange(VOTERS) & 1).astype(float)

    @staticmethod
    def tree(fired: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
        """The tree of most mutual information of votes given the class, grown from the first voter; weak dependencies are left out."""
        total, information = toxic.sum() + clean.sum(), np.zeros((VOTERS, VOTERS))
        for m in (toxic, clean):
            both = (fired * m[:, None]).T @ fired + 0.25
            size = m.sum() + 1.0
            one = np.clip(np.diag(both), 0.5, size - 0.5)
            for a, b, joint in ((one[:, None], one[None, :], both), (one[:, None], size - one[None, :], one[:, None] - both), (size - one[:, None], one[None, :], one[None, :] - both), (size - one[:, None], size - one[None, :], size - one[:, None] - one[None, :] + both)):
                joint = np.maximum(joint, 0.25)
                information += joint / max(total, 1.0) * np.log(joint * size / (a * b))
        parent, near, link = np.full(VOTERS, -1), information[0].copy(), np.zeros(VOTERS, int)
        near[0] = -np.inf
        for _ in range(VOTERS - 1):
            k = int(np.argmax(near))
            parent[k] = link[k] if near[k] > max(LEAST_INFORMATION, BEYOND_CHANCE / max(total, 1.0)) else -1
            closer = (information[k] > near) & (near > -np.inf)
            near, link = np.where(closer, information[k], near), np.where(closer, k, link)
            near[k] = -np.inf
        return parent

    def rates(self, fired: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Of each voter, by what its parent does: how often it fires. Rates lean on the voter's own over both, as ten texts would."""
        alone = (m @ fired + 0.5) / (m.sum() + 1.0)
        above = np.where(self.parent >= 0, fired[:, self.parent], 0.0)
        out = []
        for side in (1 - above, above):
            out.append(((m[:, None] * side * fired).sum(axis=0) + 10 * alone) / ((m[:, None] * side).sum(axis=0) + 10))
        return np.stack(out)

    def posterior(self, patterns: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
        """P(toxic | votes and, where it is 0 or 1, the label)."""
        fired = self.fired(patterns)
        above = np.where(self.parent >= 0, fired[:, self.parent], 0.0)
        likely = []
        for c in (0, 1):
            p = np.where(above > 0, self.rate[c, 1], self.rate[c, 0])
            likely.append(np.where(fired > 0, np.log(p), np.log(1 - p)).sum(axis=1))
        logit = np.log(self.prior / (1 - self.prior)) + likely[1] - likely[0]
        if labels is not None:
            clean, toxic = self.right
            logit = logit + np.where(labels == 1, np.log(toxic / (1 - clean)), np.where(labels == 0, np.log((1 - toxic) / clean), 0.0))
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


#: Inputs of the classifier besides the entries.
COUNTS = 4


def features(found: list[int], n: int, density: float, entries: int) -> tuple[list[int], list[float]]:
    """Sparse inputs of the classifier: entries present, how many words hold one, and how densely."""
    return [*found, *range(entries, entries + COUNTS)], [1.0] * len(found) + [min(n, 6) / 3.0, float(n >= 2), float(n >= 3), min(density, 2.0)]


def train_linear(rows: list[tuple[list[int], list[float]]], target: np.ndarray, width: int, rounds: int = 400, ridge: float = 2e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, by gradient steps with momentum over a sparse matrix."""
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    at = np.fromiter((k for r in rows for k in r[0]), np.int64)
    value = np.fromiter((v for r in rows for v in r[1]), np.float64)
    w, b, mw, mb = np.zeros(width), 0.0, np.zeros(width), 0.0
    vw, vb = np.zeros(width), 0.0
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, w[at] * value, len(rows)) + b, -30, 30)))
        e = (p - target) / len(rows)
        gw, gb = np.bincount(at, e[owner] * value, width) + ridge * w, e.sum()
        mw, mb, vw, vb = 0.9 * mw + 0.1 * gw, 0.9 * mb + 0.1 * gb, 0.99 * vw + 0.01 * gw**2, 0.99 * vb + 0.01 * gb**2
        rate = 0.1 / (1 - 0.9**t)
        scale = 1 - 0.99**t
        w = w - rate * mw / (np.sqrt(vw / scale) + 1e-8)
        b = b - rate * mb / (np.sqrt(vb / scale) + 1e-8)
    return w, float(b)


class Classifier:
    def __init__(self, voters: Voters, weights: np.ndarray, bias: float, label_model: LabelModel | None):
        self.voters, self.weights, self.bias, self.label_model = voters, weights, bias, label_model

    def score(self, text: str) -> float:
        found, n, density = self.voters.hits(text)
        at, value = features(found, n, density, len(self.voters.entry))
        z = self.bias + sum(self.weights[k] * v for k, v in zip(at, value))
        return 1 / (1 + np.exp(-min(max(z, -30.0), 30.0)))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Classifier:
    """Fits on docs(doc_id, text) and labels(doc_id, toxic) outside the held-out fold.

    Lexicons and classifier come from a bounded sample of labelled rows, whose ids (fit_rows or so) are
    broadcast; votes are counted over every text that may be learned from, and meet the labels by id without
    the text. The driver gets counts by pattern (2 ** VOTERS * 3 at most).
    """
    spark = docs.sparkSession
    small_batches(spark)
    open_docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(id_fold("doc_id", FOLDS) != HELD_OUT)
    open_labels = labels.where("toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(id_fold("doc_id", FOLDS) != HELD_OUT)
    n, positive = open_labels.agg(F.count("*"), F.coalesce(F.avg("toxic"), F.lit(0.0))).first()
    if not n:
        return Classifier(Voters([]), np.zeros(COUNTS), -30.0, None)
    some = open_labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(min(1.0, fit_rows / n) * (1 << 20))))
    sample = durable(open_docs.join(F.broadcast(some), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic")), "toxic-sample")

    def count_entries(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = (Counter(), Counter())
        for frame in frames:
            for text, toxic in zip(frame["text"], frame["toxic"]):
                seen[int(toxic > 0)].update(text_features(text))
        # what no toxic text of this task has is a matter for other tasks' sums too, so all is handed on
        names = list(seen[0].keys() | seen[1].keys())
        yield pd.DataFrame({"entry": names, "toxic": [seen[1][e] for e in names], "clean": [seen[0][e] for e in names]})

    n_toxic, n_clean = sample.agg(F.sum((F.col("toxic") > 0).cast("long")), F.sum((F.col("toxic") <= 0).cast("long"))).first()
    n_toxic, n_clean = n_toxic or 0, n_clean or 0
    lift = (F.col("toxic") + 0.5) / (n_toxic + 1.0) / ((F.col("clean") + 0.5) / (n_clean + 1.0))
    picked = (
        sample.mapInPandas(gives_back(count_entries), "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where((F.col("toxic") >= LEAST_TEXTS) & (lift >= LEAST_LIFT)).select("entry", (F.col("toxic") * F.log(lift)).alias("weight"))
        .orderBy(F.desc("weight"), "entry").limit(ENTRIES).collect()
    )
    voters = Voters([r.entry for r in picked])
    shared = spark.sparkContext.broadcast(voters)

    def vote(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = [shared.value.votes(t, *shared.value.hits(t)[:2]) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(votes, pa.int64())], ["doc_id", "votes"])

    voted = open_docs.mapInArrow(gives_back(vote), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, votes bigint")
    marked = voted.join(open_labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id", "left")
    table = marked.groupBy("votes", F.coalesce("toxic", F.lit(-1)).cast("long").alias("toxic")).agg(F.count("*").alias("n")).toArrow()
    model = LabelModel(table["votes"].to_numpy(), table["toxic"].to_numpy(), table["n"].to_numpy(), float(positive))

    def inputs(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text, toxic in zip(frame["text"], frame["toxic"]):
                found, k, density = shared.value.hits(text)
                rows.append((found, k, density, shared.value.votes(text, found, k), int(toxic)))
            yield pd.DataFrame(rows, columns=["found", "words", "density", "votes", "toxic"])

    fitted = sample.mapInPandas(gives_back(inputs), "found array<int>, words int, density double, votes long, toxic int").toArrow()  # about fit_rows rows of a few numbers
    if not len(fitted):
        return Classifier(voters, np.zeros(len(picked) + COUNTS), -30.0, model)
    target = model.posterior(fitted["votes"].to_numpy(), (fitted["toxic"].to_numpy() > 0).astype(int))
    rows = [features(*x, len(picked)) for x in zip(*(fitted[c].to_pylist() for c in ("found", "words", "density")))]
    weights, bias = train_linear(rows, target, len(picked) + COUNTS)
    return Classifier(voters, weights, bias, model)


def score(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs(doc_id, text)."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    source = docs.select("doc_id", (id_fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([shared.value.score(t) for t in batch.column("text").to_pylist()], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return source.mapInArrow(gives_back(run), f"doc_id {kind}, held_out boolean, score double, predicted int")


def score_of(spark: SparkSession, classifier: Classifier, text: Column) -> Column:
    """The score of a text column, for filters that keep other columns."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(classifier)

    def scores(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    return F.pandas_udf(gives_back(scores), "double")(F.coalesce(text, F.lit("")))
