"""Rules over pages and their states: page kinds, regions, bindings, flags, pools, plans, and what is learned from gold as one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireworks.functions import geometry as G
from quireworks.functions import text as T
from quireworks.operators import groups, learning

# Signs of amounts and directions on ledger lines, and names of attributes by the rule they ask for.
AMOUNT_SIGN, DIRECTION_SIGN = "[兩两]|[一二三四五六七八九十]{2,}[錢钱]分?", "[存該收欠支撥撥付領借還繳缴兑兌]"
RULE_HINTS = {"currency": "资本|資本|金额|金額", "address": "地址|住址|处所", "title": "职衔|職銜|功名"}


def own_page(rows: DataFrame, mark: str) -> DataFrame:
    """Without fragments that belong to the page before or after."""
    return rows.where(~F.coalesce(F.col(mark), F.lit("")).isin("prev", "next"))


def ledger_pages(lines: DataFrame, page: str, line: str, amount: str = AMOUNT_SIGN, direction: str = DIRECTION_SIGN) -> DataFrame:
    """page, is_ledger: two lines with an amount and two with a direction at least."""
    hits = lambda p: F.count_if(F.col(line).rlike(p))
    return lines.groupBy(page).agg(((hits(amount) >= 2) & (hits(direction) >= 2)).alias("is_ledger"))


def table_pages(lines: DataFrame, page: str, least_lines: int = 16, least_columns: int = 4, most_chars: float = 6, most_aspect: float = 3) -> DataFrame:
    """page, is_table of lines(page, col_index, chars, w, h): many short lines in several columns, and boxes that are not much higher than wide."""
    aspect = F.median(F.when(F.col("w") > 0, F.col("h") / F.col("w")))
    t = (F.count("*") >= least_lines) & (F.count_distinct("col_index") >= least_columns) & (F.median("chars") <= most_chars) & (F.coalesce(aspect, F.lit(0.0)) <= most_aspect)
    return lines.groupBy(page).agg(t.alias("is_table"))


def zones(exclusions: DataFrame, page: str, boxes: str) -> DataFrame:
    """page, zone: the legal rectangles among a page's zones."""
    return exclusions.select(page, F.explode(boxes).alias("_b")).select(page, G.rect(F.col("_b")).alias("zone")).where("zone is not null")


def row_states(frac: Column, run: Column, width: Column, least_run: float = 0.0, run_ratio: float = 0.5, rule_frac: float = 0.3, content: float = 0.02) -> Column:
    """rule for rows with a long enough dark run and enough ink, content for rows with ink, else sparse."""
    need = F.greatest(run_ratio * F.greatest(F.lit(1), width), F.lit(least_run))
    return F.when((run >= need) & (frac >= rule_frac), "rule").when(frac >= content, "content").otherwise("sparse")


def region_roles(values: DataFrame, regions: DataFrame, page: str) -> DataFrame:
    """values(page, value_id, y, height) with the role of the first region of its page that holds y / height; '' for none."""
    at = F.col("y") / F.col("height")
    met = values.where("height > 0").join(regions, page).where((at >= F.col("lo")) & (at < F.col("hi"))).groupBy(page, "value_id").agg(F.min_by("role", "lo").alias("role"))
    return values.join(met, [page, "value_id"], "left").withColumn("role", F.coalesce("role", F.lit("")))


def with_verdict(pages: DataFrame, verdicts: DataFrame, page: str) -> DataFrame:
    """pages with the newest verdict given; unknown without one."""
    newest = verdicts.groupBy(page).agg(F.max_by("verdict", "ts").alias("verdict"))
    return pages.join(newest, page, "left").withColumn("verdict", F.coalesce("verdict", F.lit("unknown")))


def rule_binding(attr: Column, enums: list[str] = ()) -> Column:
    """Names of the rules of an attribute: char first, then its enum, or what its name asks for."""
    found = F.lit(None).cast("string")
    for rule, pattern in reversed(RULE_HINTS.items()):
        found = F.when(attr.rlike(pattern), rule).otherwise(found)
    for name in reversed(enums):
        found = F.when(F.contains(attr, F.lit(name)), f"enum:{name}").otherwise(found)
    return F.array_compact(F.array(F.lit("char"), found))


def review_list(verdicts: DataFrame, field: str, status: str) -> DataFrame:
    """What is suspect, in the order of the fields."""
    return verdicts.where(F.col(status) == "SUSPECT").orderBy(field)


def flag_suspects(drafts: DataFrame, verdicts: DataFrame, key: list[str]) -> DataFrame:
    """drafts with confidence low where a rule found the value suspect; is_flagged says where."""
    bad = verdicts.where("status = 'SUSPECT'").select(*key).distinct().withColumn("_s", F.lit(True))
    met = drafts.join(bad, key, "left").withColumn("is_flagged", F.coalesce("_s", F.lit(False))).drop("_s")
    return met.withColumn("confidence", F.when(F.col("is_flagged"), "low").otherwise(F.col("confidence")))


def pool_fingerprints(pool: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """key, fingerprint: 12 digits of the SHA-1 of the pool's rows in order."""
    line = F.concat(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), F.lit("\n"))
    rows = F.array_sort(F.collect_list(F.struct(order, line.alias("l"))))
    return pool.groupBy(key).agg(F.substring(F.sha1(F.array_join(F.transform(rows, lambda r: r["l"]), "")), 1, 12).alias("fingerprint"))


def merge_pools(pool: DataFrame, adopted: DataFrame, bucket: str, order: str, cap: int, total: int) -> DataFrame:
    """Both pools, the newest `cap` of each bucket, drawn in turn up to total."""
    kept = groups.newest(pool.unionByName(adopted), [bucket], [F.desc(order)], cap).drop("rank")
    return groups.round_robin(kept, bucket, [F.desc(order)], total)


def add_constants(learned: DataFrame, candidates: DataFrame, least: float = 0.9) -> DataFrame:
    """text, source: learned constants, and candidates(text, ratio) of a high ratio whose folded form is not among them."""
    fold = lambda d: d.withColumn("_f", T.fold_stream(F.col("text")))
    fresh = fold(candidates.where((F.col("ratio") >= least) & (F.trim("text") != ""))).join(fold(learned).select("_f"), "_f", "left_anti")
    first = fresh.groupBy("_f").agg(F.min("text").alias("text"))
    return learned.select("text", F.lit("learned").alias("source")).unionByName(first.select("text", F.lit("corpus").alias("source")))


def deviation_floors(features: DataFrame, key: str, feature: str, value: str, factor: float = 1.5, least: float = 0.01) -> DataFrame:
    """key, feature, floor: 1.5 times the relative deviation, 0.01 at least."""
    rel = F.stddev_pop(value) / F.abs(F.avg(value))
    return features.groupBy(key, feature).agg(F.round(F.greatest(F.coalesce(rel * factor, F.lit(least)), F.lit(least)), 6).alias("floor"))


def revoke_bands(bands: DataFrame, key: str, rel: str, at: float | None, tolerance: float) -> DataFrame:
    """bands without those within the tolerance of a place; without a place, none is left."""
    return bands.where(F.lit(at is not None) & (F.abs(F.col(rel) - F.lit(at or 0.0)) > tolerance))


def page_lookup(pages: DataFrame, plan: DataFrame, page: str) -> DataFrame:
    """pages with the cluster of the plan that lists them, and covered."""
    return pages.join(plan.select(page, "cluster"), page, "left").withColumn("covered", F.col("cluster").isNotNull())


def stale_references(old: DataFrame, new: DataFrame, name: str, content: str) -> DataFrame:
    """name, state: same, changed, added or removed, by the SHA-256 of the content."""
    digest = lambda d, c: d.select(name, F.sha2(F.col(content).cast("binary"), 256).alias(c))
    both = digest(old, "_o").join(digest(new, "_n"), name, "full_outer")
    return both.select(name, F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_o") == F.col("_n"), "same").otherwise("changed").alias("state"))


def reattribute(rows: DataFrame, renames: DataFrame, key: list[str], attr: str) -> DataFrame:
    """rows whose attribute is renamed by renames(key, attr, new_attr); others stay."""
    return rows.join(renames, [*key, attr], "left").withColumn(attr, F.coalesce("new_attr", attr)).drop("new_attr")


def inventory(census: DataFrame, profiles: DataFrame, key: str) -> DataFrame:
    """key, name, pages, state: profiles without gold, and gold whose profile is gone."""
    both = profiles.join(census, key, "full_outer")
    state = F.when(F.col("name").isNull(), "unknown_profile").when(F.coalesce("pages", F.lit(0)) == 0, "no_gold").otherwise("has_gold")
    return both.select(key, "name", F.coalesce("pages", F.lit(0)).alias("pages"), state.alias("state"))


def assemble(blocks: DataFrame, page: str) -> DataFrame:
    """page, block_id, col_index, row_index: columns numbered from right to left by their centre's cluster, rows from the top in each. blocks(page, block_id, cx, cy, cluster)."""
    heads = blocks.groupBy(page, "cluster").agg(F.avg("cx").alias("_cx"))
    placed = heads.withColumn("col_index", F.row_number().over(Window.partitionBy(page).orderBy(F.desc("_cx"), "cluster")) - 1)
    rows = Window.partitionBy(page, "cluster").orderBy("cy", "block_id")
    return blocks.join(placed, [page, "cluster"]).select(page, "block_id", "col_index", (F.row_number().over(rows) - 1).alias("row_index"))


def picked_box(lines: DataFrame, picked: DataFrame, page: str) -> DataFrame:
    """page, box, n, legal: the box around the picked lines of a page; illegal if they come from more than one source."""
    met = lines.join(picked.select(page, "line_id"), [page, "line_id"], "left_semi")
    edge = lambda f, k: f(F.col("box")[k])
    box = G.box(edge(F.min, "x1"), edge(F.min, "y1"), edge(F.max, "x2"), edge(F.max, "y2"))
    return met.groupBy(page).agg(box.alias("box"), F.count("*").alias("n"), (F.count_distinct("source") == 1).alias("legal"))


def substring_box(b: Column, text: Column, part: Column) -> Column:
    """The box of a part's first place in a line, along its longer side; null if it is not there."""
    at = F.position(part, text)
    return F.when((F.length(part) > 0) & (at > 0), G.sub_box(b, at - 1, F.length(part), F.length(text)))


def attribute_list(names: Column, most: int = 40) -> Column:
    """Trimmed names without empty ones and repeats, in order, `most` at most."""
    return F.slice(F.array_distinct(F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: n != "")), 1, most)


def reusable(old: DataFrame, lines: DataFrame, page: str, text: str) -> DataFrame:
    """page, reuse: whether an earlier result(page, text) still holds the characters of the page's lines, as often."""
    bag = lambda c: F.array_join(F.array_sort(F.split(F.regexp_replace(c, r"\s", ""), "")), "")
    parts = lines.groupBy(page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_id", text))), lambda r: r[text]), "").alias("_now"))
    return old.join(parts, page, "left").select(page, F.coalesce(bag(F.col(text)) == bag(F.col("_now")), F.lit(False)).alias("reuse"))


def newest_path(files: DataFrame, key: str, path: str, *order: str) -> DataFrame:
    """key and the path that comes last by the order columns."""
    return files.groupBy(key).agg(F.max_by(path, F.struct(*order)).alias(path))


def state_summary(results: DataFrame, key: str, flags: list[str]) -> DataFrame:
    """key, n and how many rows have each flag."""
    return results.groupBy(key).agg(F.count("*").alias("n"), *(F.count_if(f).alias(f) for f in flags))


def learned_rules(rows: DataFrame, page: str, attr: str, text: str) -> DataFrame:
    """kind, key, value, n: what gold(page, attr, text) teaches, as one table: the skeleton (place of an attribute), page constants, value examples, enums and prefixes."""
    named = rows.select(F.col(page).alias("stem"), F.col(attr).alias("attr"), F.col(text).alias("v"))
    skeleton = learning.skeleton(named.select("stem", "attr")).select(F.lit("skeleton").alias("kind"), F.col("attr").alias("key"), F.col("pos").cast("string").alias("value"), F.col("pages").alias("n"))
    constants = learning.page_constants(named.select("stem", "v"), "stem", "v").select(F.lit("constant").alias("kind"), F.lit("").alias("key"), F.col("v").alias("value"), F.col("pages").alias("n"))
    examples = learning.value_examples(named, "attr", "v").select(F.lit("example").alias("kind"), F.col("attr").alias("key"), F.col("v").alias("value"), "n")
    enums = learning.observed_enums(named, "attr", "v").select(F.lit("enum").alias("kind"), F.col("attr").alias("key"), F.col("v").alias("value"), "n")
    starts = learning.prefixes(named, "attr", "v").select(F.lit("prefix").alias("kind"), F.col("attr").alias("key"), F.col("prefix").alias("value"), "n")
    return skeleton.unionByName(constants).unionByName(examples).unionByName(enums).unionByName(starts)
