"""Pages as numbered lines: the line table, its columns, page totals and page classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quireworks.functions import text as T

#: Lines of a column when a page gives no columns of its own.
COLUMN_LINES = 12


def page_lines(pages: DataFrame, page: str = "doc_id", text: str = "text") -> DataFrame:
    """page, line_no (from 0), col_index, row_index, line of every line of every text; null texts have none."""
    split = pages.where(F.col(text).isNotNull()).select(page, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return split.withColumn("col_index", F.floor(F.col("line_no") / COLUMN_LINES).cast("int")).withColumn("row_index", F.col("line_no") % COLUMN_LINES)


def number_lines(lines: DataFrame, page: str = "doc_id", start: int = 1) -> DataFrame:
    """line_id from 0 by (column, row) within a page, and xlsx_id = start + line_id."""
    order = Window.partitionBy(page).orderBy("col_index", "row_index")
    return lines.withColumn("line_id", F.row_number().over(order) - 1).withColumn("xlsx_id", F.col("line_id") + start)


def sections(lines: DataFrame, page: str = "doc_id", preview: int = 200) -> DataFrame:
    """A row for each column of a page: counts, characters, id range, first line and a preview of the joined lines."""
    ordered = F.array_sort(F.collect_list(F.struct("line_id", "line")))
    return (
        lines.groupBy(page, "col_index")
        .agg(F.count("*").alias("line_count"), F.sum(F.length("line")).alias("char_count"), F.min("line_id").alias("first_id"), F.max("line_id").alias("last_id"), F.min_by("line", "line_id").alias("first_text"), ordered.alias("ls"))
        .withColumn("preview", F.substring(F.array_join(F.transform("ls", lambda x: x["line"]), ""), 1, preview)).drop("ls")
    )


def page_totals(lines: DataFrame, page: str = "doc_id") -> DataFrame:
    return lines.groupBy(page).agg(F.count("*").alias("total_lines"), F.count_distinct("col_index").alias("total_columns"), F.sum(F.length("line")).alias("total_chars"))


def line_stats(lines: DataFrame, page: str = "doc_id", year: str = "年") -> DataFrame:
    return lines.groupBy(page).agg(
        F.count("*").alias("n"), F.avg(F.length("line")).alias("avg_len"), F.avg((F.length("line") <= 3).cast("int")).alias("short_ratio"), F.sum(F.contains("line", F.lit(year)).cast("int")).alias("year_rows")
    )


def content_class(stats: DataFrame) -> DataFrame:
    """roster, prose or ambiguous by line statistics (letters need their phrases, see letter_class)."""
    n, avg, short = F.col("n"), F.col("avg_len"), F.col("short_ratio")
    kind = F.when((n >= 30) & (avg <= 4), "roster").when((n >= 15) & (avg <= 6) & (short >= 0.5), "roster").when((n >= 8) & (avg >= 8), "prose").otherwise("ambiguous")
    return stats.withColumn("content_class", kind)


def letter_class(lines: DataFrame, phrases: list[str], page: str = "doc_id") -> DataFrame:
    """Pages that read as letters: two phrases or more, 40 lines at most, 4 characters a line or more."""
    hits = [F.max(F.contains("line", F.lit(p)).cast("int")) for p in phrases]
    found = lines.groupBy(page).agg(sum(hits, F.lit(0)).alias("hits"), F.count("*").alias("n"), F.avg(F.length("line")).alias("avg_len"))
    return found.withColumn("is_letter", (F.col("hits") >= 2) & (F.col("n") <= 40) & (F.col("avg_len") >= 4))


def layout_class(boxes: DataFrame, page: str) -> DataFrame:
    """vertical, horizontal or ambiguous by shares of tall and wide boxes (struct column `box`)."""
    size = boxes.where("box is not null").groupBy(page).agg(F.max("box.x2").alias("w"), F.max("box.y2").alias("h"))
    b = boxes.join(size, page).where("box is not null")
    share = b.groupBy(page).agg(F.avg(((F.col("box.y2") - F.col("box.y1")) >= 0.5 * F.col("h")).cast("int")).alias("tall"), F.avg(((F.col("box.x2") - F.col("box.x1")) >= 0.5 * F.col("w")).cast("int")).alias("wide"))
    kind = F.when((F.col("tall") >= 0.6) & (F.col("wide") < 0.3), "vertical").when((F.col("wide") >= 0.6) & (F.col("tall") < 0.3), "horizontal").otherwise("ambiguous")
    return boxes.select(page).distinct().join(share.select(page, kind.alias("layout")), page, "left").na.fill("ambiguous", ["layout"])


def line_offsets(lines: DataFrame, page: str = "doc_id") -> DataFrame:
    """First character of each line in the page's stream."""
    before = Window.partitionBy(page).orderBy("line_id").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("first_char", F.coalesce(F.sum(F.length("line")).over(before), F.lit(0)))


def corrected_lines(lines: DataFrame, corrections: DataFrame) -> DataFrame:
    """Lines with their safe correction, where corrections(xlsx_id, corrected) has one."""
    joined = lines.join(corrections.select("xlsx_id", "corrected"), "xlsx_id", "left")
    safe = T.safe_correction(F.col("line"), F.coalesce("corrected", F.lit("")))
    return joined.withColumn("corrected_line", F.when(safe != "", safe).otherwise(F.col("line")))


def page_text(lines: DataFrame, page: str = "doc_id", line: str = "line", join: str = "\n") -> DataFrame:
    """The lines of a page, in order, as one text."""
    ordered = F.array_sort(F.collect_list(F.struct("line_id", F.col(line).alias("t"))))
    return lines.groupBy(page).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), join).alias("page_text"))


def fingerprint(lines: DataFrame, page: str = "doc_id") -> DataFrame:
    """sha1 of the lines joined by the unit separator."""
    return page_text(lines, page, join="\x1f").select(page, F.sha1("page_text").alias("fingerprint"))


def chunks(lines: DataFrame, page: str = "doc_id", size: int = 12) -> DataFrame:
    return lines.withColumn("chunk", F.floor(F.col("line_id") / size).cast("int"))
