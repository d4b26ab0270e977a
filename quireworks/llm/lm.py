"""Brown class-based bigram scores of whole texts.

Word counts and unit bigrams are counted over every training text. The unit of a frequent word is the word,
that of any other word is the group of its ending; exchange clustering moves units between classes while
the likelihood of the class bigrams grows. That gives the classes their first members. Then every other word
type of the training texts gets a class of its own: a pass over the texts counts the classes before and after
it, and it goes to the class that makes these contexts most likely; so the words that are placed grow with
the vocabulary. Sweeps of exchange may follow, in which every word type may move, those of the first clustering too: contexts and
class bigrams are counted again with all words where they are, and each type goes where they are most likely.
Class bigrams are counted at last with all words in their places. Only words that no training
text holds go by their ending. A text's probability is the product over its tokens of
P(class | class before) and P(word | class), both smoothed.

Tokens: words of bytes other than white space (space, \\t to \\r) with A-Z lower-cased, then one end token. A batch's texts
are cut and coded by Arrow, each different word of a lot is looked up once, and arrays do the rest.

Defined cases: a null or empty text is the end token alone; a null id counts as empty text in the fold;
repeated rows are scored each; with no training text all counts are 0; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireworks.llm.common import durable, gives_back, id_fold, small_batches

#: Frequent words whose counts every task holds; the counts of other words come by a join.
HEAD_WORDS = 150_000
#: Units of the first clustering: words of their own, and groups of endings; classes (at most 128).
WORD_UNITS, ENDING_UNITS, CLASSES = 1000, 400, 64
#: Tokens whose contexts, like those of its ending's group, are added to a word's own when it is placed.
ENDING_WEIGHT = 1.0
#: Sweeps over all word types after the first placement (each reads the texts once more), and by how much (log10) a move must raise the likelihood: it costs what naming a class does, so rare words don't follow chance.
SWEEPS, MOVE_COST = 0, 8.0
#: Distinct words, and words with their contexts, a task gathers before it hands them on.
FLUSH_WORDS, FLUSH_CONTEXTS = 300_000, 2_000_000
#: Rows of words, and bytes of texts, that a task works on at once; batches of Arrow are smaller.
WORDS_AT_ONCE, TEXT_AT_ONCE = 8_192, 4 << 20
FOLDS, HELD_OUT = 5, 1


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of texts, for each token its word's place among them, and each text's number of tokens. Arrow's kernels touch A-Z and ASCII white space only."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.binary()).view(pa.string())))
    flat, lengths = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    filled = pc.greater(pc.binary_length(flat), 0)  # white space at a text's edge leaves empty words
    if not pc.all(filled, min_count=0).as_py():
        lengths = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[filled.to_numpy(zero_copy_only=False)], minlength=len(lengths))
        flat = flat.filter(filled)
    coded = flat.view(pa.binary()).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), lengths


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ends of a binary column's values, from 0 on, and their joined bytes."""
    column = column.cast(pa.binary())
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, ends, raw = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return ends - ends[0], np.frombuffer(raw or b"", np.uint8)[ends[0] : ends[-1]]


def binary_column(ends: np.ndarray, raw: bytes) -> pa.Array:
    """Values of raw between ends (from 0 on)."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)])


def same_words(parts: list[pa.Array]) -> tuple[pa.Array, np.ndarray]:
    """The different words of parts, and the place among them of each word of all parts."""
    coded = pa.concat_arrays(parts).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy()


def ending_unit(word: bytes) -> int:
    return 1 + WORD_UNITS + zlib.crc32(word[-3:]) % ENDING_UNITS


_CRC = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)  # steps of a crc32 by a byte


def ending_units(words: pa.Array) -> np.ndarray:
    """ending_unit of each word."""
    ends, raw = binary_parts(words)
    lengths, crc = np.diff(ends), np.full(len(words), 0xFFFFFFFF, np.uint32)
    for k in (3, 2, 1):
        at = np.flatnonzero(lengths >= k)
        crc[at] = _CRC[(crc[at] ^ raw[ends[1:][at] - k]) & 0xFF] ^ (crc[at] >> 8)
    return (1 + WORD_UNITS + (crc ^ np.uint32(0xFFFFFFFF)) % ENDING_UNITS).astype(np.int32)


def in_lots(batches: Iterable[pa.RecordBatch], rows: int | None = None, size: int = TEXT_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Batches put together to about `rows` rows or `size` bytes."""
    held, n, n_bytes = [], 0, 0
    for batch in batches:
        held.append(batch)
        n, n_bytes = n + len(batch), n_bytes + batch.nbytes
        if n_bytes >= size or (rows and n >= rows):
            yield pa.concat_batches(held)
            held, n, n_bytes = [], 0, 0
    if held:
        yield pa.concat_batches(held)


def count_words(train: DataFrame) -> DataFrame:
    """word, c over all rows of train(text), pre-added in each task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, counts, held = [], [], 0

        def merged() -> tuple[pa.Array, np.ndarray]:
            words, of = same_words(parts)
            return words, np.bincount(of, np.concatenate(counts), len(words)).astype(np.int64)

        for batch in in_lots(batches):
            words, at, _ = words_of(batch.column("text"))
            parts.append(words)
            counts.append(np.bincount(at, minlength=len(words)))
            held += len(words)
            if held > 2 * FLUSH_WORDS:
                words, c = merged()
                parts, counts, held = [words], [c], len(words)
                if held > FLUSH_WORDS:
                    yield pa.RecordBatch.from_arrays([words, pa.array(c)], ["word", "c"])
                    parts, counts, held = [], [], 0
        if held:
            words, c = merged()
            yield pa.RecordBatch.from_arrays([words, pa.array(c)], ["word", "c"])

    return train.mapInArrow(gives_back(run), "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


class Lexicon:
    """What each task needs of the frequent words: position, unit and log10(count + 0.5)."""

    def __init__(self, words: list[bytes], counts: list[int]):
        self.words = pa.array(words, pa.binary())
        self.unit = ending_units(self.words)
        self.unit[:WORD_UNITS] = 1 + np.arange(len(self.unit[:WORD_UNITS]))
        self.log_count = np.log10(np.array(counts, dtype=np.float64) + 0.5)

    def units(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Positions (-1: not frequent) and units of words."""
        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy()
        unit = ending_units(words)
        known = np.flatnonzero(at >= 0)
        unit[known] = self.unit[at[known]]
        return at, unit


def count_bigrams(train: DataFrame, lexicon) -> DataFrame:
    """prev, next, n of units over all rows of train(text); unit 0 is the end, before the first word too."""
    size = 1 + WORD_UNITS + ENDING_UNITS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, dtype=np.int64)
        for batch in in_lots(batches):
            words, at, lengths = words_of(batch.column("text"))
            unit = lexicon.value.units(words)[1][at]
            whole = np.concatenate([[0], np.insert(unit, np.cumsum(lengths), 0)]).astype(np.int64)  # an end after each text
            total += np.bincount(whole[:-1] * size + whole[1:], minlength=size * size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at // size, pa.int32()), pa.array(at % size, pa.int32()), pa.array(total[at], pa.int64())], ["prev", "next", "n"])

    return train.mapInArrow(gives_back(run), "prev int, next int, n bigint").groupBy("prev", "next").agg(F.sum("n").alias("n"))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = 12) -> np.ndarray:
    """The class of each unit. Units start in classes by frequency; each in turn goes to the class that raises the class-bigram likelihood most, until a sweep moves none."""
    size = len(bigrams)
    mass = bigrams.sum(axis=0) + bigrams.sum(axis=1)
    order = np.argsort(-mass, kind="stable")
    of = np.empty(size, dtype=np.int64)
    of[order] = np.arange(size) % classes
    member = np.zeros((size, classes))
    member[np.arange(size), of] = 1
    table = member.T @ bigrams @ member
    xlogx = lambda x: x * np.log(np.maximum(x, 1e-300))
    eye = np.eye(classes)
    for _ in range(sweeps):
        moved = 0
        for u in order:
            if not mass[u]:
                continue
            own = bigrams[u, u]
            to = bigrams[u] @ member
            frm = bigrams[:, u] @ member
            k = of[u]
            to[k] -= own
            frm[k] -= own
            table[k, :] -= to
            table[:, k] -= frm
            table[k, k] -= own
            # likelihood terms that change when u joins each class: its row, its column, and both margins
            row = xlogx(table + to) - xlogx(table)
            col = xlogx(table + frm[:, None]) - xlogx(table)
            corner = table.diagonal()
            both = xlogx(corner + to + frm + own) - xlogx(corner)
            gain = row.sum(axis=1) - row.diagonal() + col.sum(axis=0) - col.diagonal() + both
            out, into = table.sum(axis=1), table.sum(axis=0)
            a, b = to.sum() + own, frm.sum() + own
            # the margins of other classes change by where u's neighbours are, alike for every choice but the class itself
            out_new, into_new = out[None, :] + frm + eye * a, into[None, :] + to + eye * b
            gain -= xlogx(out_new).sum(axis=1) + xlogx(into_new).sum(axis=1)
            best = int(gain.argmax())
            if gain[best] <= gain[k] + 1e-9:
                best = k
            moved += best != k
            of[u] = best
            member[u, k], member[u, best] = 0, 1
            table[best, :] += to
            table[:, best] += frm
            table[best, best] += own
        if not moved:
            break
    return of


_CONTEXT = np.dtype([("code", np.uint8), ("n", np.uint32)])


def count_contexts(train: DataFrame, lexicon, model, head_class=None) -> DataFrame:
    """word, contexts (packed codes and counts): code c for class c before the word, CLASSES + c for class c after it. Pre-added in each task.

    Without head_class, of words that have no unit of their own, by the classes of units; with it, of all words, by
    the classes of frequent words, and of the ending for others.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.value.of
        parts, gathered, n_words, held = [], [], 0, 0

        def emit() -> pa.RecordBatch:
            words, place = same_words(parts)
            found = np.concatenate(gathered)
            keys, n = np.unique(place[found // (2 * CLASSES)].astype(np.int64) * (2 * CLASSES) + found % (2 * CLASSES), return_counts=True)
            owner = keys // (2 * CLASSES)
            packed = np.empty(len(keys), _CONTEXT)
            packed["code"], packed["n"] = keys % (2 * CLASSES), n
            begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            return pa.RecordBatch.from_arrays([words.take(pa.array(owner[begin])), binary_column(np.r_[begin, len(keys)] * _CONTEXT.itemsize, packed.tobytes())], ["word", "contexts"])

        for batch in in_lots(batches):
            words, at, lengths = words_of(batch.column("text"))
            at_head, unit = lexicon.value.units(words)
            home = of[unit] if head_class is None or not len(head_class.value) else np.where(at_head >= 0, head_class.value[at_head], of[unit])
            mine = (unit > WORD_UNITS) | (head_class is not None)
            ends = np.cumsum(lengths)
            whole = np.concatenate([[-1], np.insert(at, ends, -1)])  # -1: the end, before the first word too
            cls = np.where(whole >= 0, home[whole] if len(home) else of[0], of[0])
            own = np.flatnonzero((whole >= 0) & mine[whole]) if len(mine) else np.zeros(0, np.int64)
            if len(own):
                first = (whole[own] + n_words) * (2 * CLASSES)
                gathered += [first + cls[own - 1], first + CLASSES + cls[own + 1]]
                held += 2 * len(own)
                parts.append(words)
                n_words += len(words)
            if held > FLUSH_CONTEXTS or n_words > 4 * FLUSH_WORDS:
                yield emit()
                parts, gathered, n_words, held = [], [], 0, 0
        if held:
            yield emit()

    return train.mapInArrow(gives_back(run), "word binary, contexts binary")


def _seen(contexts: pa.Array, owner: np.ndarray, n: int) -> np.ndarray:
    """Packed contexts of each of n owners as a row of counts by code."""
    ends, raw = binary_parts(contexts)
    own = np.frombuffer(raw.tobytes(), _CONTEXT)
    row = np.repeat(owner, np.diff(ends) // _CONTEXT.itemsize)
    return np.bincount(row * (2 * CLASSES) + own["code"], own["n"], n * 2 * CLASSES).reshape(n, 2 * CLASSES)


def _of_lists(parts: pa.Array) -> np.ndarray:
    """Rows of counts of a column of lists."""
    return _seen(parts.flatten(), np.repeat(np.arange(len(parts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False)), len(parts))


def whole_runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Lots of sorted rows, and where in them each new key begins; no key's rows are in two lots."""

    def begins(rows: pa.RecordBatch) -> np.ndarray:
        column = rows.column(key)
        return np.flatnonzero(np.r_[True, pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)])

    last = None
    for batch in in_lots(batches, WORDS_AT_ONCE):
        rows = batch if last is None else pa.concat_batches([last, batch])
        if len(rows):
            begin = begins(rows)
            last = rows.slice(begin[-1])
            if len(begin) > 1:
                yield rows.slice(0, begin[-1]), begin[:-1]
    if last is not None:
        yield last, begins(last)


def exchange_words(train: DataFrame, words: DataFrame, lexicon, model, head_class, ending_contexts: np.ndarray, end: int, n_texts: int) -> DataFrame:
    """word, c, cls after a sweep in which every type of words(word, c, cls) may move: contexts by the classes of now, class bigrams from them, and each type where they make it most likely. A type stays unless a move is worth MOVE_COST."""
    sc = train.sparkSession.sparkContext
    contexts = count_contexts(train, lexicon, model, head_class).groupBy("word").agg(F.collect_list("contexts").alias("parts"))
    met = durable(contexts.join(words, "word"), "word-contexts")

    def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, CLASSES, CLASSES))
        for batch in in_lots(batches, WORDS_AT_ONCE):
            seen, cls = _of_lists(batch.column("parts")), batch.column("cls").to_numpy()
            np.add.at(total[0].T, cls, seen[:, :CLASSES])
            np.add.at(total[1], cls, seen[:, CLASSES:])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total.ravel()[at].astype(np.int64))], ["pair", "n"])

    found = np.zeros(2 * CLASSES * CLASSES)
    for r in met.mapInArrow(gives_back(pairs), "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        found[r.pair] = r.n
    into, out = found.reshape(2, CLASSES, CLASSES)
    into[:, end] += np.maximum(out[:, end] - into[:, end], 0)  # steps to the end token, which has no contexts of its own
    members = np.zeros((2, CLASSES))
    members[:, end] = n_texts, n_texts > 0
    for r in words.groupBy("cls").agg(F.sum("c").alias("tokens"), F.count("*").alias("types")).collect():
        members[:, r.cls] += r.tokens, r.types
    now = ClassModel.__new__(ClassModel)
    now.fit(into, *members)
    shared = sc.broadcast(now)

    def move(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        gain = np.concatenate([m.transition, m.transition.T])
        prior = ENDING_WEIGHT * (ending_contexts @ gain - ending_contexts.sum(axis=1, keepdims=True) / 2 * m.denominator)
        for batch in in_lots(batches, WORDS_AT_ONCE):
            seen, old = _of_lists(batch.column("parts")), batch.column("cls").to_numpy()
            ending = ending_units(batch.column("word")) - 1 - WORD_UNITS
            score = seen @ gain - seen[:, :CLASSES].sum(axis=1)[:, None] * m.denominator + prior[ending]
            best = score.argmax(axis=1)
            stays = score[np.arange(len(old)), best] <= score[np.arange(len(old)), old] + MOVE_COST
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(np.where(stays, old, best), pa.int32())], ["word", "c", "cls"])

    return durable(met.mapInArrow(gives_back(move), "word binary, c bigint, cls int"), "word-classes")


def place_words(contexts: DataFrame, model, ending_contexts: np.ndarray) -> DataFrame:
    """word, c, cls: the class of each word of contexts(word, contexts) that makes its contexts most likely."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        gain = np.concatenate([m.transition, m.transition.T])  # by code, for each class
        prior = ENDING_WEIGHT * (ending_contexts @ gain - ending_contexts.sum(axis=1, keepdims=True) / 2 * m.denominator)
        for rows, begin in whole_runs(batches, "word"):
            words = rows.column("word").take(pa.array(begin))
            seen = _seen(rows.column("contexts"), np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(rows)])), len(begin))
            c = seen[:, :CLASSES].sum(axis=1)
            cls = (seen @ gain - c[:, None] * m.denominator + prior[ending_units(words) - 1 - WORD_UNITS]).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([words, pa.array(c.astype(np.int64)), pa.array(cls, pa.int32())], ["word", "c", "cls"])

    # a row a word and task: sorted once, where a list a word would be sorted before and after the shuffle
    return contexts.repartition("word").sortWithinPartitions("word").mapInArrow(gives_back(run), "word binary, c bigint, cls int")


def count_classes(classes: DataFrame, end: int) -> np.ndarray:
    """Class bigrams of rows of classes(classes: a byte a token and one for the end after the text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * CLASSES, dtype=np.int64)
        for batch in batches:
            # each text begins after an end: that of the text before it, or the first one here
            whole = np.frombuffer(bytes([end]) + b"".join(batch.column("classes").to_pylist()), np.uint8).astype(np.int64)
            total += np.bincount(whole[:-1] * CLASSES + whole[1:], minlength=CLASSES * CLASSES)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["pair", "n"])

    table = np.zeros(CLASSES * CLASSES)
    for r in classes.mapInArrow(gives_back(run), "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        table[r.pair] = r.n
    return table.reshape(CLASSES, CLASSES)


class ClassModel:
    """log10 P(class | class before) and the log10 denominator of P(word | class)."""

    def __init__(self, bigrams: np.ndarray, unit_tokens: np.ndarray, unit_types: np.ndarray, classes: int = CLASSES, prior: float = 10.0):
        self.of = exchange(bigrams.astype(np.float64), classes)
        table = np.zeros((classes, classes))
        np.add.at(table, (self.of[:, None], self.of[None, :]), bigrams)
        self.fit(table, np.bincount(self.of, unit_tokens, classes), np.bincount(self.of, unit_types, classes), prior)

    def fit(self, table: np.ndarray, tokens: np.ndarray, types: np.ndarray, prior: float = 10.0) -> None:
        """Both from class bigrams and each class's tokens and word types."""
        classes = len(table)
        share = (tokens + 1) / (tokens.sum() + classes)
        self.transition = np.log10((table + prior * share) / (table.sum(axis=1, keepdims=True) + prior))
        self.denominator = np.log10(tokens + 0.5 * (types + 1))


def score(docs: DataFrame, sweeps: int = SWEEPS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs(doc_id, text).

    Passes over the text: word counts, unit bigrams, contexts of words, again in each sweep, classes; then two over the
    classes, a byte a token: class bigrams, scores. Counts and classes of words that are not frequent are
    joined to the texts that hold them by word; the driver holds the frequent words, the units' bigram matrix
    and the class model, whose sizes are parameters.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sc = spark.sparkContext
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), (id_fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"))
    train = source.where(~F.col("held_out")).select("text")

    counts = durable(count_words(train), "word-counts")
    words_total, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_texts = train.count()
    total, distinct = words_total + n_texts, types + (n_texts > 0)
    head = counts.orderBy(F.desc("c"), "word").limit(HEAD_WORDS).toArrow()
    lexicon = sc.broadcast(Lexicon(head["word"].to_pylist(), head["c"].to_pylist()))
    floor = head["c"][-1].as_py() if len(head) == HEAD_WORDS else 0

    size = 1 + WORD_UNITS + ENDING_UNITS
    bigrams = np.zeros((size, size))
    found = count_bigrams(train, lexicon).toArrow()  # at most size * size rows
    bigrams[found["prev"].to_numpy(), found["next"].to_numpy()] = found["n"].to_numpy()

    # tokens and word types of each unit: all words by their endings, less those that are units themselves
    own = list(zip(head["word"][:WORD_UNITS].to_pylist(), head["c"][:WORD_UNITS].to_pylist()))
    per_unit = np.zeros((2, size))
    per_unit[:, 0] = n_texts, n_texts > 0
    ending = (F.crc32(F.substring("word", -3, 3)) % ENDING_UNITS + 1 + WORD_UNITS).alias("unit")
    for r in counts.groupBy(ending).agg(F.sum("c").alias("tokens"), F.count("*").alias("types")).collect():
        per_unit[:, r.unit] = r.tokens, r.types
    for k, (w, c) in enumerate(own):
        per_unit[:, 1 + k] = c, 1
        per_unit[:, ending_unit(w)] -= c, 1
    first = ClassModel(bigrams, *per_unit)
    model = sc.broadcast(first)
    base_floor = math.log10(total + 0.5 * (distinct + 1))
    end_log = math.log10(n_texts + 0.5)

    # every word type of the training texts in a class: those of the first clustering stay
    member = np.eye(CLASSES)[first.of]
    around = np.concatenate([bigrams.T @ member, bigrams @ member], axis=1)[1 + WORD_UNITS :]
    around /= np.maximum(around[:, :CLASSES].sum(axis=1, keepdims=True), 1)
    own_units = spark.createDataFrame(
        [(bytearray(w), c, int(first.of[1 + k])) for k, (w, c) in enumerate(own)], "word binary, c bigint, cls int"
    )
    words = durable(place_words(count_contexts(train, lexicon, model), model, around).unionByName(own_units), "word-classes")
    end_class = int(first.of[0])

    def of_frequent(words: DataFrame):
        """The classes of the frequent words, in their order above."""
        placed = words.orderBy(F.desc("c"), "word").limit(HEAD_WORDS).select("cls").toArrow()
        return sc.broadcast(placed["cls"].to_numpy().astype(np.uint8))

    head_class = of_frequent(words)
    for _ in range(sweeps):
        words = exchange_words(train, words, lexicon, model, head_class, around, end_class, n_texts)
        head_class = of_frequent(words)

    def tag(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, of, classes_of = lexicon.value, model.value.of, head_class.value
        for batch in in_lots(batches):
            words, token, lengths = words_of(batch.column("text"))
            word_at, word_unit = lex.units(words)
            n_docs, at, by_ending = len(lengths), word_at[token], of[word_unit]
            doc = np.repeat(np.arange(n_docs), lengths)
            logs = np.where(word_at >= 0, lex.log_count[word_at] if len(lex.log_count) else 0.0, 0.0)[token]
            known = np.bincount(doc[at >= 0], minlength=n_docs) + (n_texts > 0)
            log_sum = np.bincount(doc, logs, n_docs) + end_log
            ends = np.cumsum(lengths)
            cls = np.where(word_at >= 0, classes_of[word_at] if len(classes_of) else 0, by_ending).astype(np.uint8)[token]
            raw = np.insert(cls, ends, end_class).tobytes()  # an end after each text
            rows = batch.column("row")
            none = lambda n, t: pa.nulls(n, t)
            yield pa.RecordBatch.from_arrays(
                [rows, batch.column("doc_id"), batch.column("held_out"), none(n_docs, pa.binary()), none(n_docs, pa.binary()), none(n_docs, pa.int32()), pa.array(lengths + 1), pa.array(known.astype(np.int64)), pa.array(log_sum), binary_column(np.r_[0, ends + np.arange(1, n_docs + 1)], raw)],
                names,
            )
            rare = np.flatnonzero(at < 0)
            if len(rare):
                # each rare word of a text, with its places there
                key = doc[rare] * len(words) + token[rare]
                order = np.argsort(key, kind="stable")
                key, place = key[order], (rare - (ends - lengths)[doc[rare]])[order].astype(np.uint32)
                begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                bounds, n = np.r_[begin, len(key)], len(begin)
                owner, word = np.divmod(key[begin], len(words))
                yield pa.RecordBatch.from_arrays(
                    [rows.take(pa.array(owner)), none(n, batch.column("doc_id").type), none(n, pa.bool_()), words.take(pa.array(word)), binary_column(bounds * place.itemsize, place.tobytes()), pa.array(by_ending[word], pa.int32()), pa.array(np.diff(bounds)), none(n, pa.int64()), none(n, pa.float64()), none(n, pa.binary())],
                    names,
                )

    names = ["row", "doc_id", "held_out", "word", "places", "by_ending", "n", "known", "log_sum", "classes"]
    tagged = durable(
        source.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "held_out", "text").mapInArrow(gives_back(tag), f"row bigint, doc_id {kind}, held_out boolean, word binary, places binary, by_ending int, n bigint, known bigint, log_sum double, classes binary"),
        "lm-partial",
    )
    rare_words = words.where(F.col("c") <= floor) if floor else words
    rare = (
        tagged.where("word is not null").select("row", "word", "places", "by_ending", "n").join(rare_words, "word", "left").groupBy("row")
        .agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare_log"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("rare_known"),
             F.collect_list(F.when(F.col("cls") != F.col("by_ending"), F.struct("places", "cls"))).alias("moved"))
    )

    def put(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, raw = binary_parts(batch.column("classes"))
            moved, cls = batch.column("moved"), raw.copy()
            found = moved.flatten()
            if len(found):
                word_ends, places = binary_parts(pc.struct_field(found, "places"))
                each = np.diff(word_ends) // 4
                begin = np.repeat(ends[:-1], pc.fill_null(pc.list_value_length(moved), 0).to_numpy(zero_copy_only=False))
                cls[np.repeat(begin, each) + np.frombuffer(places.tobytes(), np.uint32)] = np.repeat(pc.struct_field(found, "cls").to_numpy(zero_copy_only=False).astype(np.uint8), each)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), binary_column(ends, cls.tobytes())], [*kept, "classes"])

    kept = ["doc_id", "held_out", "n", "known", "logs"]
    whole = tagged.where("word is null").select("row", "doc_id", "held_out", "n", "known", "log_sum", "classes").join(rare, "row", "left").select(
        "doc_id", "held_out", "n", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("known"), (F.col("log_sum") + F.coalesce("rare_log", F.lit(0.0))).alias("logs"), "classes", "moved"
    )
    classed = durable(whole.mapInArrow(gives_back(put), f"doc_id {kind}, held_out boolean, n bigint, known bigint, logs double, classes binary"), "lm-classes")

    members = np.zeros((2, CLASSES))
    members[:, end_class] = n_texts, n_texts > 0
    for r in words.groupBy("cls").agg(F.sum("c").alias("tokens"), F.count("*").alias("types")).collect():
        members[:, r.cls] += r.tokens, r.types
    last = ClassModel.__new__(ClassModel)
    last.fit(count_classes(classed.where(~F.col("held_out")).select("classes"), end_class), *members)
    final = sc.broadcast(last)

    def rest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = final.value
        for batch in batches:
            texts = batch.column("classes").to_pylist()
            cls = np.frombuffer(b"".join(texts), np.uint8)
            before = np.concatenate([[end_class], cls[:-1]]).astype(np.int64)
            owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(np.bincount(owner, m.transition[before, cls] - m.denominator[cls], len(texts)))], [*kept, "rest"])

    return classed.mapInArrow(gives_back(rest), f"doc_id {kind}, held_out boolean, n bigint, known bigint, logs double, rest double").select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n") * base_floor).alias("base_score"), (F.col("logs") + F.col("rest")).alias("score"),
    )
