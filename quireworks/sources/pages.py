"""Readers of page documents, label rows, run reports and ledgers, and their writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_QUAD = "array<array<double>>"
#: Layers of a page document.
PAGE_SCHEMA = (
    "L0_document struct<image_name:string,ocr_backend:string,ocr_model:string,ocr_at:string,total_lines:int,total_columns:int,total_chars:int,quality:string,xlsx_id_range:array<int>,duplicate_of:string>, "
    "L1_sections array<struct<section_id:string,col_index:int,line_count:int,char_count:int,first_text:string,preview:string>>, "
    f"L2_lines array<struct<line_id:int,xlsx_id:int,col_index:int,row_index:int,text:string,confidence:double,box:{_QUAD},quality:string>>, _corrupt string"
)
GOLD_SCHEMA = "image_name string, box array<double>, text string, ts string, source string, attr string, profile string, note string, gid string, xp string"
LEDGER_SCHEMA = "xlsx_id int, image_name string, col int, row int, ocr_text string, confidence double, status string, corrected_text string"


def file_stem(path=None):
    """The file name without its last extension."""
    return F.regexp_extract(F.input_file_name() if path is None else path, r"([^/]+?)(\.[^./]*)?$", 1)


def read_pages(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """stem and layers of files that are pages: names that begin with _ and files with no page layer or bad JSON are left out."""
    raw = spark.read.schema(PAGE_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", glob).json(path)
    named = raw.withColumn("stem", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1))
    layer = F.col("L0_document").isNotNull() | F.col("L1_sections").isNotNull() | F.col("L2_lines").isNotNull()
    return named.where(layer & F.col("_corrupt").isNull() & ~F.startswith("stem", F.lit("_"))).select("stem", "L0_document", "L1_sections", "L2_lines")


def page_line_rows(pages: DataFrame) -> DataFrame:
    return pages.select("stem", F.explode("L2_lines").alias("l")).select("stem", "l.*")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """stem, row_no and fields of each good line. A bad line is skipped but keeps its number, so numbers stay identities."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.ai|\.notes)?\.jsonl$", 1).alias("stem"), F.posexplode(F.split("value", "\n")).alias("row_no", "line"))
    parsed = whole.where("trim(line) <> ''").withColumn("r", F.from_json("line", schema, {"mode": "PERMISSIVE"}))
    good = F.col("r").isNotNull() & F.try_parse_json("line").isNotNull()
    return parsed.where(good).select("stem", "row_no", "r.*")


def read_gold(spark: SparkSession, path: str, profile: str | None = None) -> DataFrame:
    """Label rows in file order; rows without a profile belong to none, and no profile asked for means all rows."""
    rows = read_jsonl(spark, path, GOLD_SCHEMA)
    return rows if not profile else rows.where(F.col("profile") == profile)


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Reports below run_* folders with their run, without summaries."""
    raw = spark.read.schema(schema).option("multiLine", True).json(f"{path}/run_*/*.json")
    place = F.col("_metadata.file_path")
    return raw.select("*", F.regexp_extract(place, r"/(run_[^/]+)/", 1).alias("run"), F.regexp_extract(place, r"([^/]+)\.json$", 1).alias("stem")).where("stem <> 'summary'")


def newest_run(runs: DataFrame) -> DataFrame:
    """stem and the last run that has it."""
    return runs.groupBy("stem").agg(F.max("run").alias("run"))


def read_ledger(spark: SparkSession, path: str, edits_only: bool = False) -> DataFrame:
    """xlsx_id, corrected of a CSV or Parquet ledger; with edits_only, those that differ from the line."""
    raw = spark.read.parquet(path) if path.rstrip("/").endswith("parquet") else spark.read.schema(LEDGER_SCHEMA).option("header", True).csv(path)
    kept = raw.where(F.coalesce("corrected_text", F.lit("")) != "")
    if edits_only:
        kept = kept.where(~F.col("corrected_text").eqNullSafe(F.col("ocr_text")))
    return kept.select("xlsx_id", F.col("corrected_text").alias("corrected"))


def scan_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("png", "jpg", "jpeg", "tif", "tiff", "pdf")) -> DataFrame:
    """path, extension, length, md5 of files below a folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return raw.withColumn("extension", kind).where(F.col("extension").isin(*extensions)).select("path", "extension", "length", F.md5("content").alias("md5"))


def html_cells(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, table_no, row_no, cell_no, text of plain tables; nested tables and spans are left to a parser of their own."""
    tables = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<table[^>]*>(.*?)</table>"), F.lit(1))).alias("table_no", "t"))
    rows = tables.select(key, "table_no", F.posexplode(F.regexp_extract_all("t", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row_no", "r"))
    cells = rows.select(key, "table_no", "row_no", F.posexplode(F.regexp_extract_all("r", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1))).alias("cell_no", "c"))
    return cells.withColumn("text", F.trim(F.regexp_replace("c", "<[^>]*>", ""))).drop("c")


def header_columns(sample: DataFrame, text: str) -> DataFrame:
    """Column names of the first line with two or more parts, by tab, comma, bar or ideographic comma."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda l: F.filter(F.transform(F.split(l, r"[\t,|，、]"), lambda p: F.trim(p)), lambda p: p != "")), lambda p: F.size(p) >= 2)
    return sample.select(F.coalesce(F.get(lines, F.lit(0)), F.array().cast("array<string>")).alias("columns"))


def write_pages(pages: DataFrame, path: str) -> None:
    pages.write.mode("overwrite").json(path)


def write_cards(cards: DataFrame, path: str, by: str = "project") -> None:
    """One folder for each project, in one job; duplicates are left out."""
    kept = cards.where(F.coalesce("quality", F.lit("")) != "possible_duplicate") if "quality" in cards.columns else cards
    kept.write.mode("overwrite").partitionBy(by).json(path)
