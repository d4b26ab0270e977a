"""From raw documents to packed sequences: five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireworks.llm import decontam, langid, packing, setjoin, toxicity
from quireworks.llm.common import durable, id_fold, may_hold, table

#: Least share of a text's letters that its language must have; bytes of words that a worker remembers in the last stage, few as it has run the others before.
LEAST_SHARE, PACKING_CACHE = 0.5, 24 << 20


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the classifier scores below its threshold. Documents without features have the lowest scores and stay."""
    classifier = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score_of(spark, classifier, F.col("text")) < toxicity.THRESHOLD)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which one learned language has half of the letters or more; null texts and texts without letters (`und`) go.

    Repeated rows fare alike; a share of just a half stays; without rows to learn from nothing stays.
    """
    profiles = langid.fit(docs.where(id_fold("doc_id", langid.FOLDS) != langid.HELD_OUT).select("text", "lang"))
    label = langid.label_of(spark, profiles, F.col("text"))
    return docs.where((label["lang_pred"] != "und") & (label["score"] >= LEAST_SHARE))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each component of near duplicates one document: the one with the smallest id, or of several texts under that id the one with the least hash.

    Rows are told apart by id and text, so one that shares its id with a copy stays if its text is no copy. Of
    rows equal in id and text, the one with the least hash of all columns stays. Rows without an id stay.
    Only rows that may be among those that go, or that occur again, are shuffled with their texts. Other
    columns may have any name.
    """
    found = durable(setjoin.near_duplicates(docs).where("doc_id is not null").select("doc_id", "text_hash", "component_id", "set_group"), "components")
    leads = found.where("doc_id = component_id and set_group is not null").groupBy("doc_id", "set_group").agg(F.min("text_hash").alias("stays"), F.max("text_hash").alias("last")).where("stays <> last")
    twins = found.join(leads, ["doc_id", "set_group"]).where("text_hash <> stays")
    gone = durable(found.where("doc_id <> component_id").select("doc_id", "text_hash").unionByName(twins.select("doc_id", "text_hash")).distinct(), "copies")
    again = found.groupBy("doc_id", "text_hash").count().where("count > 1").select("doc_id", "text_hash")
    row = lambda doc_id, text_hash: F.xxhash64(doc_id, text_hash)
    own_hash = F.xxhash64(F.coalesce("text", F.lit("")).cast("binary"))
    may = may_hold(gone.unionByName(again).select(row("doc_id", "text_hash").alias("row")), "row", row("doc_id", own_hash))
    whole = docs.select(F.struct(*(f"`{c.replace('`', '``')}`" for c in docs.columns)).alias("whole"), "doc_id", own_hash.alias("text_hash"), (may & F.col("doc_id").isNotNull()).alias("may"))
    kept = whole.where("may").join(gone, ["doc_id", "text_hash"], "left_anti").groupBy("doc_id", "text_hash").agg(F.min_by("whole", F.xxhash64("whole")).alias("whole"))
    return whole.where("not may").select("whole.*").unionByName(kept.select("whole.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no benchmark item within the edit bound; null and empty texts hold none. Repeated rows fare alike."""
    return docs.where(~decontam.is_contaminated(spark, table(spark, sf_dir, "benchmark"), F.col("text")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens. A null text is the end id alone; repeated rows have pieces of their own."""
    return packing.pack(docs, cache_bytes=PACKING_CACHE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language", keep_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: No stage can be stated in SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
