"""Ranked retrieval over texts: ratio-IDF BM25, TF-IDF cosine, their mix, field boosts, dense similarity, routes.

Scorers take queries(query_id, query), a stated set, and corpus(card_id, text, ord), and score all queries at once.
A card becomes one row with its terms and counts, written once; document counts are added up in the tasks before
they are shuffled. Queries go to the tasks in blocks of a bounded size. A task takes cards in groups, bounds every
query's score of a group by the highest weights in it, scores only what may still be among the query's best, and
hands on `most` cards a query: no row is made for a pair of query and card.
"""

from __future__ import annotations

import operator
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quireworks.functions import text as T
from quireworks.operators.tables import spread, written

K1, B, ALPHA = 1.5, 0.75, 0.5
BOOST, BOOST_CAP, BOOST_LENGTH, SEMANTIC, REFUSAL, RESCUE = 0.35, 3, 2, 0.35, 0.06, 0.55
#: Digits that scores are compared at, so that orders of addition do not decide ties.
TIE_DIGITS = 9
#: Queries, and bytes of their weights, of a block; cards of a group; terms whose document counts go to all tasks.
QUERIES_BLOCK, MATRIX_BYTES, GROUP_CARDS, TERMS_HELD = 256, 128 << 20, 64, 100_000

_CJK, _RUN = re.compile("[一-鿿]"), re.compile(r"[a-zA-Z0-9]+(?:\.[a-zA-Z0-9]+)*")


def term_counts(normal: str) -> Counter:
    """Terms of a text in normal form: pairs of neighbouring characters, single CJK characters, runs of ASCII letters and digits."""
    found = Counter(map(operator.add, normal, normal[1:]))
    if not normal.isascii():
        found.update(_CJK.findall(normal))
    found.update(_RUN.findall(normal))
    return found


def forward(texts: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    """key, more, dl (terms with repetition), terms, tfs: a row for each text."""
    kinds = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in (key, *more))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches):
            counts = [term_counts(t) for t in batch.column("_normal").to_pylist()]
            made = [pa.array([sum(c.values()) for c in counts], pa.int64()), pa.array([list(c) for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (key, *more)), *made], [key, *more, "dl", "terms", "tfs"])

    return texts.select(key, *more, T.normal_retrieval(F.col(text)).alias("_normal")).mapInArrow(run, f"{kinds}, dl bigint, terms array<string>, tfs array<int>")


def groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut to GROUP_CARDS rows: what Python holds of long texts does not grow with Arrow's batches."""
    for batch in batches:
        for start in range(0, batch.num_rows, GROUP_CARDS):
            yield batch.slice(start, GROUP_CARDS)


class Index:
    """A corpus as written rows of terms, with its document counts; scorers share it."""

    def __init__(self, corpus: DataFrame):
        self.cards = written(forward(spread(corpus), "card_id", "text", "ord"), "cards")
        self.counts = written(self.cards.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "document-counts")
        row = self.cards.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("t")).first()
        self.n_docs, self.avgdl = row.n, row.t / max(1, row.n)
        self._norms: DataFrame | None = None

    def idf(self, df: Column) -> Column:
        return 1 + F.log((F.lit(self.n_docs) + 1) / (df + 1))

    def with_norms(self) -> DataFrame:
        """Cards with the norm of their TF-IDF vector, which needs all their terms: those of many cards from a bounded table in every task, the others by a join in which no term is frequent."""
        if self._norms is None:
            levels, least, total = self.counts.groupBy(F.floor(F.log2("df")).alias("level")).count().orderBy(F.desc("level")).collect(), 1 << 62, 0
            for r in levels:
                total += r["count"]
                if total > TERMS_HELD:
                    break
                least = 1 << r.level
            known = self.counts.where(F.col("df") >= least).select("term", self.idf(F.col("df")).alias("idf")).toPandas()
            held = self.cards.sparkSession.sparkContext.broadcast(dict(zip(known["term"], known["idf"])))
            kind = self.cards.schema["card_id"].dataType.simpleString()

            def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in groups(batches):
                    idf, part, rare, times = held.value, [], [], []
                    for dl, terms, tfs in zip(*(batch.column(c).to_pylist() for c in ("dl", "terms", "tfs"))):
                        found = [(idf.get(t), tf) for t, tf in zip(terms, tfs)]
                        part.append(float(sum((w * tf / dl) ** 2 for w, tf in found if w is not None)))
                        rare.append([t for t, (w, _) in zip(terms, found) if w is None])
                        times.append([tf / dl for w, tf in found if w is None])
                    yield pa.RecordBatch.from_arrays([batch.column("card_id"), pa.array(part, pa.float64()), pa.array(rare, pa.list_(pa.string())), pa.array(times, pa.list_(pa.float64()))], ["card_id", "part", "rare", "times"])

            parts = written(self.cards.mapInArrow(run, f"card_id {kind}, part double, rare array<string>, times array<double>"), "norm-parts")
            spread = parts.select("card_id", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("card_id", F.col("x.rare").alias("term"), F.col("x.times").alias("w"))
            rest = spread.join(self.counts.where(F.col("df") < least), "term").groupBy("card_id").agg(F.sum(F.pow(F.col("w") * self.idf(F.col("df")), F.lit(2.0))).alias("rest"))
            norm = parts.join(rest, "card_id", "left").select("card_id", F.sqrt(F.col("part") + F.coalesce("rest", F.lit(0.0))).alias("norm"))
            self._norms = written(self.cards.join(norm, "card_id"), "cards-with-norms")
        return self._norms


class Best:
    """The `most` best cards of each query so far, by shown score and then order."""

    def __init__(self, n_queries: int, most: int):
        self.most, self.kept = most, [[] for _ in range(n_queries)]
        self.least = np.zeros(n_queries)

    def add(self, k: int, found: list[tuple[float, object, object, float]]) -> None:
        """found: (-shown, ord, card, raw)."""
        self.kept[k] = sorted(self.kept[k] + found, key=lambda x: x[:2])[: self.most]
        if len(self.kept[k]) == self.most:
            self.least[k] = -self.kept[k][-1][0]


def best(queries: DataFrame, index: Index, most: int, kinds: tuple[str, ...] = ("bm25", "cosine")) -> DataFrame:
    """query_id, kind, rank, card_id, ord, raw: of each kind of score the `most` best positive ones of a query; ties at TIE_DIGITS by ord."""
    spark = queries.sparkSession
    asked = written(forward(queries, "query_id", "query"), "queries")
    terms = asked.select("query_id", F.col("dl").alias("q_total"), F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("query_id", "q_total", F.col("x.terms").alias("term"), F.col("x.tfs").alias("qtf"))
    known = written(terms.join(index.counts, "term").withColumn("idf", index.idf(F.col("df"))), "query-terms")
    id_kind, card_kind, ord_kind = queries.schema["query_id"].dataType.simpleString(), *(index.cards.schema[c].dataType.simpleString() for c in ("card_id", "ord"))
    cards = index.with_norms() if "cosine" in kinds else index.cards
    schema = f"query_id {id_kind}, kind string, card_id {card_kind}, ord {ord_kind}, raw double, shown double"
    found = None
    for ids in _query_blocks(known.groupBy("query_id").count().orderBy("query_id").collect()):
        part = _block_best(cards, spark.sparkContext.broadcast(_weights(known.where(F.col("query_id").isin(ids)).toPandas(), ids, index)), most, kinds, schema, index.avgdl, to_arrow_type(queries.schema["query_id"].dataType))
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    order = Window.partitionBy("query_id", "kind").orderBy(F.desc("shown"), "ord")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("shown")


def _query_blocks(sizes: list) -> Iterator[list]:
    """Ids of queries, so many that their weights stay under MATRIX_BYTES and QUERIES_BLOCK; a query alone may be larger. sizes: a row for each query of the stated set."""
    ids, terms = [], 0
    for r in sizes:
        if ids and (len(ids) == QUERIES_BLOCK or (terms + r["count"]) * (len(ids) + 1) * 16 > MATRIX_BYTES):
            yield ids
            ids, terms = [], 0
        ids.append(r.query_id)
        terms += r["count"]
    if ids:
        yield ids


def _weights(rows: pd.DataFrame, ids: list, index: Index) -> tuple:
    """Query ids, the place of each term, its BM25 weight (0 for terms of more than half of the cards) and TF-IDF weight in each query, its IDF."""
    place = {t: k for k, t in enumerate(sorted(set(rows["term"])))}
    at, q = rows["term"].map(place).to_numpy(), rows["query_id"].map({x: k for k, x in enumerate(ids)}).to_numpy()
    ratio, tf_idf, idf = np.zeros((len(place), len(ids))), np.zeros((len(place), len(ids))), np.zeros(len(place))
    df = rows["df"].to_numpy(float)
    ratio[at, q] = rows["qtf"].to_numpy() * np.maximum(0.0, (index.n_docs - df + 0.5) / (df + 0.5))
    tf_idf[at, q] = rows["qtf"].to_numpy() / rows["q_total"].to_numpy() * rows["idf"].to_numpy()
    idf[at] = rows["idf"].to_numpy()
    norm = np.sqrt((tf_idf**2).sum(axis=0))
    return ids, place, ratio, tf_idf / np.where(norm > 0, norm, 1), idf


def _block_best(cards: DataFrame, block, most: int, kinds: tuple[str, ...], schema: str, avgdl: float, id_kind: pa.DataType) -> DataFrame:
    """Every task's best cards for one block of queries."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, place, ratio, tf_idf, idf = block.value
        weights = {"bm25": ratio, "cosine": tf_idf}
        tops = {kind: Best(len(ids), most) for kind in kinds}
        any_ratio = ratio.any(axis=1)
        for batch in groups(batches):
            columns = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            rows: dict[str, list] = {kind: [] for kind in kinds}
            for k in range(batch.num_rows):
                dl = columns["dl"][k]
                hits = [(p, tf) for t, tf in zip(columns["terms"][k], columns["tfs"][k]) if (p := place.get(t)) is not None]
                if not hits:
                    continue
                at, tf = np.array([p for p, _ in hits]), np.array([tf for _, tf in hits], float)
                if "bm25" in rows:
                    part = tf * (K1 + 1) / np.maximum(1e-9, tf + K1 * (1 - B + B * dl / max(1.0, avgdl)))
                    some = any_ratio[at]
                    if some.any():
                        rows["bm25"].append((k, at[some], part[some]))
                if "cosine" in rows:
                    rows["cosine"].append((k, at, tf / dl * idf[at] / columns["norm"][k]))
            for kind, group in rows.items():
                if not group:
                    continue
                top, w = tops[kind], weights[kind]
                met = np.unique(np.concatenate([at for _, at, _ in group]))
                x = np.zeros((len(group), len(met)))
                for g, (_, at, v) in enumerate(group):
                    x[g, np.searchsorted(met, at)] = v
                near = w[met]
                live = np.flatnonzero(x.max(axis=0) @ near >= np.maximum(top.least - 1e-8, 1e-300))
                if not len(live):
                    continue
                scores = x @ near[:, live]
                shown = np.round(scores, TIE_DIGITS)
                for j, q in enumerate(live.tolist()):
                    good = np.flatnonzero((scores[:, j] > 0) & (shown[:, j] >= top.least[q]))
                    if len(good):
                        top.add(q, [(-float(shown[g, j]), columns["ord"][group[g][0]], columns["card_id"][group[g][0]], float(scores[g, j])) for g in good.tolist()])
        out = [(ids[q], kind, card, ord_, raw, -shown) for kind, top in tops.items() for q, kept in enumerate(top.kept) for shown, ord_, card, raw in kept]
        if out:
            kinds_of = (id_kind, pa.string(), batch.schema.field("card_id").type, batch.schema.field("ord").type, pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds_of)], ["query_id", "kind", "card_id", "ord", "raw", "shown"])

    return cards.mapInArrow(run, schema)


def bm25(queries: DataFrame, corpus: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, card_id, score. IDF is max(0, (N - n + 0.5) / (n + 0.5)); a term that a query repeats counts each time."""
    return best(queries, Index(corpus), k, ("bm25",)).select("query_id", "rank", "card_id", F.round("raw", 4).alias("score"))


def tfidf(queries: DataFrame, corpus: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, card_id, score: cosine of tf / length * (1 + ln((N + 1) / (df + 1))) vectors."""
    return best(queries, Index(corpus), k, ("cosine",)).select("query_id", "rank", "card_id", F.round("raw", 4).alias("score"))


def hybrid(queries: DataFrame, corpus: DataFrame, k: int = 5, over: int = 3, alpha: float = ALPHA) -> DataFrame:
    """query_id, rank, card_id, score, bm25_score, tfidf_score.

    Candidates are the k * over best of either scorer, with scores rounded to 4 digits; BM25 is min-max
    scaled among a query's candidates (0 where all are equal, and for those BM25 lacks). Halves of the last
    digit, which mixed 4-digit scores often give, go up.
    """
    found = written(best(queries, Index(corpus), k * over), "candidates")
    side = lambda kind, score, at: found.where(F.col("kind") == kind).select("query_id", "card_id", "ord", F.round("raw", 4).alias(score), F.col("rank").alias(at))
    both = side("bm25", "bm25_score", "at_a").join(side("cosine", "tfidf_score", "at_b"), ["query_id", "card_id", "ord"], "full").na.fill(0.0, ["bm25_score", "tfidf_score"])
    q = Window.partitionBy("query_id")
    lo, hi = F.min("bm25_score").over(q), F.max("bm25_score").over(q)
    scaled = both.withColumn("bm25_norm", F.when(hi > lo, (F.col("bm25_score") - lo) / (hi - lo)).otherwise(0.0))
    mixed = scaled.withColumn("raw", alpha * F.col("bm25_norm") + (1 - alpha) * F.col("tfidf_score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("raw", TIE_DIGITS)), F.asc_nulls_last("at_a"), "at_b")
    top = mixed.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= k) & (F.col("raw") > 0))
    return top.select("query_id", "rank", "card_id", "ord", F.round(F.col("raw") + 1e-9, 4).alias("score"), "bm25_score", "tfidf_score")


def field_boost(queries: DataFrame, fields: DataFrame) -> DataFrame:
    """query_id, card_id, boost: 0.35 for each field value (2 characters or more) that the query holds, three at most. fields(card_id, value) is matched by value length, so no pair of query and value is made that does not hold."""
    q = queries.select("query_id", T.normal_retrieval(F.col("query")).alias("q"))
    v = fields.select("card_id", T.normal_retrieval(F.col("value")).alias("v")).where(F.length("v") >= BOOST_LENGTH)
    forms = v.select("v").distinct()
    lengths = forms.select(F.length("v").alias("n")).distinct()
    pieces = q.join(F.broadcast(lengths)).where("length(q) >= n").select("query_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("q") - F.col("n") + 1), lambda i: F.substr(F.col("q"), i, F.col("n"))))).alias("v"))
    held = pieces.join(forms, "v", "left_semi")  # the queries are a stated set: what they hold goes to all tasks, so a frequent value is no task's alone
    return v.join(F.broadcast(held), "v").groupBy("query_id", "card_id").agg((F.least(F.count("*"), F.lit(BOOST_CAP)) * BOOST).alias("boost"))


def hybrid_boosted(queries: DataFrame, corpus: DataFrame, fields: DataFrame, k: int = 5, over: int = 3, similarity: DataFrame | None = None) -> DataFrame:
    """Hybrid candidates (k * over of them) with field boosts and, if given, 0.35 * similarity(query_id, card_id, sim), ranked anew."""
    got = hybrid(queries, corpus, k * over, over).join(field_boost(queries, fields), ["query_id", "card_id"], "left").na.fill(0.0, ["boost"])
    got = got.withColumn("score", F.round(F.col("score") + F.col("boost"), 4)).withColumn("before", F.col("rank"))
    if similarity is not None:
        got = got.join(similarity, ["query_id", "card_id"], "left").withColumn("score", F.round(F.col("score") + SEMANTIC * F.coalesce("sim", F.lit(0.0)), 4))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "before")
    return got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "card_id", "score", "boost", "tfidf_score")


def route(queries: DataFrame, units: DataFrame, docs: DataFrame | None = None, similarity: DataFrame | None = None) -> DataFrame:
    """query_id, route: unit or doc if the first result has cosine 0.06 or more, semantic if a similarity reaches 0.55, else refused. units and docs are ranked results."""
    first = lambda d, name: d.where("rank = 1").select("query_id", (F.col("tfidf_score") >= REFUSAL).alias(name))
    out = queries.select("query_id").join(first(units, "unit"), "query_id", "left")
    out = out.join(first(docs, "doc"), "query_id", "left") if docs is not None else out.withColumn("doc", F.lit(False))
    near = similarity.groupBy("query_id").agg((F.max("sim") >= RESCUE).alias("near")) if similarity is not None else None
    out = out.join(near, "query_id", "left") if near is not None else out.withColumn("near", F.lit(False))
    return out.select("query_id", F.when(F.col("unit"), "unit").when(F.col("doc"), "doc").when(F.col("near"), "semantic").otherwise("refused").alias("route"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


#: Vectors, and queries, of a block; vector blocks that a lane searches.
BLOCK_ROWS, BLOCK_QUERIES, LANE_BLOCKS = 4096, 512, 8


def _packed(rows: DataFrame, key: str, vector: str, size: int, name: str) -> DataFrame:
    """Rows of `size` vectors of one length: width, {name}_ids, {name}_vectors as bytes. Rows with nulls take no part."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for width, part in frame.groupby(frame["v"].map(len)):
                for at in range(0, len(part), size):
                    some = part.iloc[at : at + size]
                    yield pd.DataFrame([[width, some["k"].to_numpy(np.int64).tobytes(), np.stack(some["v"].to_numpy()).astype(np.float64).tobytes()]], columns=["width", f"{name}_ids", f"{name}_vectors"])

    whole = rows.select(F.col(key).alias("k"), F.col(vector).alias("v")).where(F.col("k").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    return whole.mapInPandas(run, f"width int, {name}_ids binary, {name}_vectors binary")


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, sim (cosine): queries(query_id, q) are a stated set, all rows of vectors are candidates.

    Blocks of queries go to every lane, a block of vectors to one; of each pair of blocks a query keeps its k
    best, ties to the smaller id, and those are ranked.
    """
    blocks = _packed(vectors, "vec_id", "embedding", BLOCK_ROWS, "v")
    lanes = max(1, -(-vectors.count() // (BLOCK_ROWS * LANE_BLOCKS)))
    laned = blocks.withColumn("lane", F.pmod(F.xxhash64("v_ids"), F.lit(lanes)).cast("int"))
    asked = _packed(queries, "query_id", "q", BLOCK_QUERIES, "q").withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for x in frame.itertuples():
                ids, qids = np.frombuffer(x.v_ids, np.int64), np.frombuffer(x.q_ids, np.int64)
                v, q = np.frombuffer(x.v_vectors).reshape(len(ids), x.width), np.frombuffer(x.q_vectors).reshape(len(qids), x.width)
                sim = (q @ v.T) / np.sqrt((q * q).sum(axis=1)[:, None] * (v * v).sum(axis=1)[None, :])
                shown = np.where(ids[None, :] == qids[:, None], -np.inf, np.round(sim, TIE_DIGITS))
                best = np.lexsort((np.broadcast_to(ids, shown.shape), -shown), axis=1)[:, :k]
                row = np.repeat(np.arange(len(qids)), best.shape[1])
                found = pd.DataFrame({"query_id": qids[row], "vec_id": ids[best.ravel()], "sim": sim[row, best.ravel()]})
                yield found[(found["query_id"] != found["vec_id"]) & found["sim"].notna()]

    near = laned.join(asked, ["lane", "width"]).mapInPandas(run, "query_id long, vec_id long, sim double")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("sim", TIE_DIGITS)), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.round("sim", 6).alias("sim"))


def amount_intent(query: Column) -> Column:
    """max or min for questions that name an amount and an extreme, else null."""
    q = T.normal_retrieval(query)
    return F.when(q.rlike("金额|金額|錢|钱|款|一笔|一筆|账|賬"), F.when(q.rlike("最大|最多|最高"), "max").when(q.rlike("最小|最低|最少"), "min"))


def amount_top_k(cards: DataFrame, op: str, k: int = 5) -> DataFrame:
    """cards(card_id, amount) with the k largest or smallest amounts, ties by card."""
    key = F.desc("amount") if op == "max" else F.asc("amount")
    return cards.where("amount is not null").orderBy(key, "card_id").limit(k)


def expand_query(query: Column, synonyms: dict[str, list[str]]) -> Column:
    """The query and the synonyms of words it holds that it does not hold itself."""
    q = T.normal_retrieval(query)
    extra = F.flatten(F.array(*(F.when(F.contains(q, T.normal_retrieval(F.lit(w))), F.array(*map(F.lit, s))).otherwise(F.array().cast("array<string>")) for w, s in synonyms.items())))
    fresh = F.filter(F.array_distinct(extra), lambda s: ~F.contains(q, T.normal_retrieval(s)))
    return F.trim(F.concat_ws(" ", F.trim(query), F.array_join(fresh, " ")))
