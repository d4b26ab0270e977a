"""Tables that leave the pipeline: flat line rows, sheets of units, cards of documents, lines and units, indexes and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireworks.functions import geometry as G
from quireworks.functions import text as T

# Fields of a roster unit that have columns of their own, and quality marks of lines with their counters.
ROSTER_FIELDS = {"姓名": "name", "科年": "keyear", "身份": "identity", "备注": "note"}
QUALITY_COUNTERS = {"low_quality": "low_quality_count", "garbage": "garbage_count", "layout_anomaly": "layout_anomaly_count", "possible_duplicate": "duplicate_count"}


def academic_rows(lines: DataFrame, corrections: DataFrame) -> DataFrame:
    """image_order, image_name, col_index, row_index, text, corrected, confidence, quality, box_x, box_y, xlsx_id of lines(image_name, col_index, row_index, text, xlsx_id, confidence, quality, xs, ys): corrections(xlsx_id, corrected) count where they are safe. The order of an image is the rank of its name: sorted names are numbered part by part."""
    names = lines.select("image_name").distinct().sort("image_name")
    order = names.rdd.zipWithIndex().map(lambda x: (x[0][0], x[1] + 1)).toDF("image_name string, image_order long")
    met = lines.join(order, "image_name").join(corrections.select("xlsx_id", F.col("corrected").alias("_c")), "xlsx_id", "left")
    corrected = F.when(F.col("xlsx_id").isNotNull(), T.safe_correction(F.col("text"), F.coalesce("_c", F.lit("")))).otherwise("")
    return met.select(
        "image_order", "image_name", "col_index", "row_index", "text", corrected.alias("corrected"), F.when(F.col("confidence").isNull(), "").otherwise(F.format_string("%.2f", "confidence")).alias("confidence"),
        "quality", G.range_text(F.col("xs")).alias("box_x"), G.range_text(F.col("ys")).alias("box_y"), "xlsx_id",
    )


def roster_sheet(units: DataFrame) -> DataFrame:
    """image, seq, name, keyear, identity, note, extra_fields (JSON of the other fields that are given), text, line_ids of the roster units."""
    field = lambda k: F.coalesce(F.element_at("fields", F.lit(k)), F.lit(""))
    extra = F.map_filter("fields", lambda k, v: ~k.isin(*ROSTER_FIELDS) & (F.coalesce(v, F.lit("")) != ""))
    return units.where("unit_type = 'roster_entry'").select(
        "image", "seq", *(field(k).alias(name) for k, name in ROSTER_FIELDS.items()), F.when(F.size(extra) > 0, F.to_json(extra)).otherwise("").alias("extra_fields"), "text", G.ids_text(F.col("line_ids")).alias("line_ids")
    )


def ledger_sheet(units: DataFrame) -> DataFrame:
    """image, seq, account, direction, currency, amount_raw, amount (4 decimals), text, line_ids of the ledger units."""
    field = lambda k: F.coalesce(F.element_at("fields", F.lit(k)), F.lit(""))
    return units.where("unit_type = 'ledger_entry'").select(
        "image", "seq", field("户名").alias("account"), field("方向").alias("direction"), field("币种").alias("currency"), field("金额原文").alias("amount_raw"),
        F.round(F.expr("try_cast(fields['金额归一'] as double)"), 4).alias("amount"), "text", G.ids_text(F.col("line_ids")).alias("line_ids"),
    )


def reading_sheet(units: DataFrame) -> DataFrame:
    return units.where("unit_type = 'paragraph'").select("image", "content_type", "seq", "text", G.ids_text(F.col("line_ids")).alias("line_ids"))


def provenance_sheet(units: DataFrame) -> DataFrame:
    """Where every unit stands: unit_id, image, content_type, unit_type, box_x, box_y, line_ids."""
    edge = lambda a, b: F.when(F.col("box").isNotNull(), G.range_text(F.array(F.col(f"box.{a}"), F.col(f"box.{b}")))).otherwise("")
    return units.select("unit_id", "image", "content_type", "unit_type", edge("x1", "x2").alias("box_x"), edge("y1", "y2").alias("box_y"), G.ids_text(F.col("line_ids")).alias("line_ids"))


def quality_counts(lines: DataFrame, page: str, quality: str) -> DataFrame:
    """A counter for each quality mark of a page's lines."""
    return lines.groupBy(page).agg(*(F.count_if(F.col(quality) == mark).alias(name) for mark, name in QUALITY_COUNTERS.items()))


def document_cards(pages: DataFrame, counts: DataFrame, page: str) -> DataFrame:
    """A card a page: card_id, card (struct of its totals and quality counts), confidence_source."""
    return pages.join(counts, page, "left").select(
        F.concat(F.lit("doc_"), F.col(page).cast("string")).alias("card_id"), F.struct(*(F.col(c) for c in [*pages.columns, *counts.columns] if c != page)).alias("card"),
        F.when(F.coalesce("backend", F.lit("")) == "", "unknown").otherwise(F.col("backend")).alias("confidence_source"),
    )


def section_cards(sections: DataFrame, page: str) -> DataFrame:
    """card_id and preview of a page's columns."""
    return sections.select(F.concat(F.lit("sec_"), F.col(page).cast("string"), F.lit("_"), F.col("col_index").cast("string")).alias("card_id"), "line_count", "char_count", "preview")


def line_cards(lines: DataFrame, page: str) -> DataFrame:
    """card_id, text, and a struct of where it stands."""
    return lines.select(F.concat(F.lit("line_"), F.col(page).cast("string"), F.lit("_"), F.col("line_id").cast("string")).alias("card_id"), F.col("line").alias("text"), F.struct("col_index", "row_index").alias("place"))


def unit_cards(units: DataFrame) -> DataFrame:
    """card_id, text, fields_text, needs_review: units that await review keep their card, with a mark."""
    return units.select(F.concat(F.lit("unit_"), "image", F.lit("_"), F.col("seq").cast("string")).alias("card_id"), "text", T.fields_text(F.col("fields")).alias("fields_text"), (F.col("status") == "needs_review").alias("needs_review"))


def unit_corpus(units: DataFrame, pages: DataFrame) -> DataFrame:
    """card_id, text: verified units; pages(image, text) without one come whole."""
    good = units.where("status = 'verified'")
    rest = pages.join(good.select("image").distinct(), "image", "left_anti").select(F.col("image").alias("card_id"), "text")
    return good.select(F.concat(F.lit("unit_"), "image", F.lit("_"), F.col("seq").cast("string")).alias("card_id"), "text").unionByName(rest)


def gold_corpus(rows: DataFrame, page: str, order: str, attr: str, text: str) -> DataFrame:
    """card_id, text: a card a page, its lines attr：text in file order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.concat(F.col(attr), F.lit("："), F.col(text)).alias("t"))))
    return rows.where(F.coalesce(F.col(text), F.lit("")) != "").groupBy(page).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n").alias("text")).select(F.concat(F.lit("gold_"), F.col(page).cast("string")).alias("card_id"), "text")


def page_texts(lines: DataFrame, page: str, order: list[str], text: str, sep: str = "\n") -> DataFrame:
    """page, full_text: lines joined in their order."""
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("t"))))
    return lines.groupBy(page).agg(F.array_join(F.transform(parts, lambda p: p["t"]), sep).alias("full_text"))


def in_scope(pages: DataFrame, scope: str, assigned: DataFrame, project: str | None = None, selected: DataFrame | None = None) -> DataFrame:
    """pages(image) of current_project, all_projects (any) or selected_images."""
    if scope == "selected_images":
        return pages.join(selected.select("image"), "image", "left_semi")
    wanted = assigned if scope == "all_projects" else assigned.where(F.col("project") == project)
    return pages.join(wanted.select("image"), "image", "left_semi")


def unit_index(units: DataFrame) -> DataFrame:
    """image, unit_count, verified_count, needs_review_count."""
    return units.groupBy("image").agg(F.count("*").alias("unit_count"), F.count_if(F.col("status") == "verified").alias("verified_count"), F.count_if(F.col("status") == "needs_review").alias("needs_review_count"))


def gold_summary(rows: DataFrame, page: str, attr: str) -> DataFrame:
    """gold_pages, gold_rows, gold_attrs (not empty)."""
    return rows.agg(F.count_distinct(page).alias("gold_pages"), F.count("*").alias("gold_rows"), F.count_distinct(F.nullif(F.col(attr), F.lit(""))).alias("gold_attrs"))


def project_coverage(pages: DataFrame, gold: DataFrame, page: str, project: str) -> DataFrame:
    """project ('' for none), pages, with_gold."""
    marked = pages.join(gold.select(page, F.lit(1).alias("_g")).distinct(), page, "left")
    return marked.groupBy(F.coalesce(F.col(project), F.lit("")).alias("project")).agg(F.count("*").alias("pages"), F.count_if(F.col("_g") == 1).alias("with_gold"))


def correction_stats(lines: DataFrame, page: str, text: str, corrected: str) -> DataFrame:
    """page, lines, corrected, ratio of lines whose correction is given and differs."""
    changed = (F.coalesce(F.col(corrected), F.lit("")) != "") & (F.col(corrected) != F.col(text))
    return lines.groupBy(page).agg(F.count("*").alias("lines"), F.count_if(changed).alias("corrected")).withColumn("ratio", F.round(F.col("corrected") / F.col("lines"), 4))


def cost(prompt: Column, completion: Column, price_in: float, price_out: float) -> Column:
    """Price of so many tokens, by the million; null if neither is known."""
    return F.when(prompt.isNotNull() | completion.isNotNull(), F.round((F.coalesce(prompt, F.lit(0)) * price_in + F.coalesce(completion, F.lit(0)) * price_out) / 1e6, 6))


def batch_totals(pages: DataFrame, key: list[str], counts: list[str]) -> DataFrame:
    """key, pages, and the sum of each count."""
    return pages.groupBy(*key).agg(F.count("*").alias("pages"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts))


def result_records(attrs: DataFrame, page: str, record: str, attr: str, text: str) -> DataFrame:
    """page, record, values (map; of repeated attributes the last by order stays) of attrs(page, record, order, attr, text)."""
    last = attrs.where((F.col(attr) != "") & (F.col(attr) != "跨页")).groupBy(page, record, attr).agg(F.max_by(text, "order").alias("_t"))
    return last.groupBy(page, record).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(attr), "_t")))).alias("values"))


def name_collisions(names: DataFrame, name: str) -> DataFrame:
    """safe, names: safe names that different names share."""
    return names.select(F.col(name).alias("_n"), T.safe_name(F.col(name)).alias("safe")).groupBy("safe").agg(F.count_distinct("_n").alias("names")).where("names > 1")


def daily_sequence(names: DataFrame, name: str, day: str) -> DataFrame:
    """next: one more than the highest number of names day_NNNN_; 1 without one."""
    n = F.expr("try_cast(_n as int)")
    return names.select(F.regexp_extract(F.col(name), f"^{day}_(\\d{{4}})_", 1).alias("_n")).agg((F.coalesce(F.max(n), F.lit(0)) + 1).alias("next"))


def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """base with rows of changes in place of those with their key, and new keys added: one shuffle, the later side wins."""
    both = base.withColumn("_side", F.lit(0)).unionByName(changes.withColumn("_side", F.lit(1)))
    rest = [c for c in base.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), "_side").alias("_r")).select(key, *(F.col(f"_r.{c}").alias(c) for c in rest))


def append_missing(base: Column, more: Column) -> Column:
    """base, then what more has beyond it, in order, without repeats."""
    return F.array_distinct(F.concat(base, F.filter(more, lambda x: ~F.array_contains(base, x))))
