"""Review work: gates, queues, evaluation by value and box."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireworks.functions.geometry import iou


def first_failure(checks: dict[str, Column]) -> Column:
    """The name of the first check that does not hold; unknown counts as failed; null if all hold."""
    return F.coalesce(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items()))


def queue(items: DataFrame, status: str = "status", confidence: str = "confidence", then: tuple[str, ...] = ("stem", "field")) -> DataFrame:
    """Pending first, then by confidence (none counts as 1), then by name."""
    return items.orderBy(F.when(F.col(status) == "pending", 0).otherwise(1), F.coalesce(confidence, F.lit(1.0)), *then)


def page_status(pages: DataFrame, has_text: str, has_gold: str, has_draft: str) -> DataFrame:
    kind = F.when(~F.col(has_text), "needs_ocr").when(F.col(has_gold), "done").when(F.col(has_draft), "needs_adjudication").otherwise("needs_annotation")
    return pages.withColumn("page_status", kind)


def match_gold(gold: DataFrame, predicted: DataFrame, least: float = 0.5) -> DataFrame:
    """gold rows (stem, gold_id, attr, text, box) with matched (equal text on the page) and located (such a row's box has IoU of least or more)."""
    p = predicted.select("stem", "text", F.col("box").alias("_pb"))
    hit = gold.join(p, ["stem", "text"], "left").groupBy("stem", "gold_id", "attr").agg(F.max(F.col("_pb").isNotNull().cast("int")).alias("matched"), F.max(iou(F.col("box"), F.col("_pb"))).alias("iou"))
    return hit.withColumn("located", (F.col("iou") >= least).cast("int"))


def fold_ratio(folds: DataFrame, hit: str, total: str) -> DataFrame:
    """Sum of hits over sum of totals, not the mean of ratios."""
    return folds.agg(F.round(F.sum(hit) / F.sum(total), 4).alias("ratio"), F.sum(hit).alias("hits"), F.sum(total).alias("rows"))
