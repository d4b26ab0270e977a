"""Orders of attributes learned from records, and what people set against them.

A profile (key) has a bounded number of attributes, so an order is an array in one row, and peeling or inserting is a
fold over it; profiles go on side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: what an override must name as its source to count.
HUMAN = "human"


def wins(rows: DataFrame, key: str, record: str, order: str, attr: str) -> DataFrame:
    """key, before, after, wins: in how many records of a key an attribute's first row stands before another's."""
    first = rows.groupBy(key, record, attr).agg(F.min(order).alias("at"))
    lists = first.groupBy(key, record).agg(F.array_sort(F.collect_list(F.struct("at", F.col(attr).alias("a")))).alias("xs"))
    later = lambda i: F.slice("xs", i + 2, F.size("xs"))
    pairs = F.flatten(F.transform("xs", lambda x, i: F.transform(later(i), lambda y: F.struct(x["a"].alias("before"), y["a"].alias("after")))))
    return lists.select(key, F.inline(pairs)).groupBy(key, "before", "after").agg(F.count("*").alias("wins"))


def attribute_orders(pairs: DataFrame, attributes: DataFrame, key: str) -> DataFrame:
    """key, order, cyclic: attributes(key, attr, seed) in topological order of pairs(key, before, after, wins) that win more often than they lose.

    Of attributes that nothing left stands before, the one with the least seed comes next, ties by name. What is left in
    a cycle follows by seed, and is `cyclic`.
    """
    pairs = pairs.select(key, "before", "after", "wins")
    lost = pairs.select(key, F.col("before").alias("after"), F.col("after").alias("before"), F.col("wins").alias("losses"))
    edges = pairs.join(lost, [key, "before", "after"], "left").where(F.col("wins") > F.coalesce("losses", F.lit(0)))
    ahead = edges.groupBy(key, F.col("after").alias("attr")).agg(F.collect_set("before").alias("ahead"))
    none = F.array().cast("array<string>")
    rows = attributes.join(ahead, [key, "attr"], "left").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seed", "attr", F.coalesce("ahead", none).alias("ahead")))).alias("left"))

    def step(s: Column, _: Column) -> Column:
        names = F.transform(s["left"], lambda a: a["attr"])
        free = F.get(F.filter(s["left"], lambda a: ~F.arrays_overlap(F.array_remove(a["ahead"], a["attr"]), names)), F.lit(0))["attr"]
        rest = F.filter(s["left"], lambda a: a["attr"] != free)
        return F.when(free.isNull(), s).otherwise(F.struct(rest.alias("left"), F.concat(s["order"], F.array(free)).alias("order")))

    done = F.aggregate(F.sequence(F.lit(1), F.size("left")), F.struct(F.col("left"), none.alias("order")), step)
    t = rows.select(key, done.alias("s"))
    return t.select(key, F.concat("s.order", F.transform("s.left", lambda a: a["attr"])).alias("order"), F.transform("s.left", lambda a: a["attr"]).alias("cyclic"))


def override_outcomes(learned: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """key, attr, field, outcome, value, was, reason: what becomes of each field that overrides(key, attr, source, position, required) set.

    learned(key, order, required: arrays of attributes). Position is a string from 1 on and only moves attributes; null
    fields are not set. Outcomes: applied; noop, if it is so already; skipped, with a reason (no_human_source, not_a_number,
    not_in_order, out_of_range). An attribute that is not required may be set so only if it is in the order.
    """
    t = overrides.join(learned.select(key, "order", F.col("required").alias("_required")), key)
    at, n = F.array_position("order", F.col("attr")).cast("int"), F.expr("try_cast(trim(position) as int)")
    refused = ~F.coalesce(F.col("source") == HUMAN, F.lit(False))
    reason = F.when(n.isNull(), "not_a_number").when(at == 0, "not_in_order").when(~n.between(1, F.size("order")), "out_of_range")
    place = F.struct(F.lit("position").alias("field"), F.when(reason.isNotNull(), "skipped").when(at == n, "noop").otherwise("applied").alias("outcome"), n.cast("string").alias("value"), F.nullif(at, F.lit(0)).cast("string").alias("was"), reason.alias("reason"))
    has = F.array_contains("_required", F.col("attr"))
    kind = F.when(F.col("required") == has, "noop").when(F.col("required") & (at == 0), "skipped").otherwise("applied")
    need = F.struct(F.lit("required").alias("field"), kind.alias("outcome"), F.col("required").cast("string").alias("value"), has.cast("string").alias("was"), F.when(kind == "skipped", "not_in_order").alias("reason"))
    whole = F.struct(F.lit("all").alias("field"), F.lit("skipped").alias("outcome"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("was"), F.lit("no_human_source").alias("reason"))
    fields = F.when(refused, F.array(whole)).otherwise(F.array_compact(F.array(F.when(F.col("position").isNotNull(), place), F.when(F.col("required").isNotNull(), need))))
    return t.select(key, "attr", F.inline(fields))


def overridden(learned: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    """key, order, required with the applied outcomes: attributes with a position are taken out and put back, lower positions first, and of equal ones the later name in front; the others keep their order. Required attributes follow the order if it changed."""
    done = outcomes.where("outcome = 'applied'").groupBy(key).agg(
        F.array_sort(F.collect_list(F.when(F.col("field") == "position", F.struct(F.col("value").cast("int").alias("p"), F.col("attr").alias("a"))))).alias("pins"),
        F.array_sort(F.collect_set(F.when((F.col("field") == "required") & (F.col("value") == "true"), F.col("attr")))).alias("more"),
        F.collect_set(F.when((F.col("field") == "required") & (F.col("value") == "false"), F.col("attr"))).alias("less"),
    )
    none = F.array().cast("array<string>")
    t = learned.join(done, key, "left").withColumns({c: F.coalesce(c, none) for c in ("more", "less")}).withColumn("pins", F.coalesce("pins", F.array().cast("array<struct<p:int,a:string>>")))
    rest = F.filter("order", lambda a: ~F.exists("pins", lambda x: x["a"] == a))
    put = lambda s, x: F.concat(F.slice(s, F.lit(1), F.least(x["p"] - 1, F.size(s))), F.array(x["a"]), F.slice(s, F.least(x["p"], F.size(s) + 1), F.size(s) + 1))
    t = t.withColumn("new_order", F.aggregate("pins", rest, put))
    need = F.array_except(F.concat("required", F.filter("more", lambda a: ~F.array_contains("required", a))), F.col("less"))
    t = t.withColumn("need", need)
    return t.select(key, F.col("new_order").alias("order"), F.when(F.size("pins") > 0, F.filter("new_order", lambda a: F.array_contains("need", a))).otherwise(F.col("need")).alias("required"))


def constants_set(constants: DataFrame, overrides: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Page constants(key, word) after overrides(key, op: add or remove, word, source), and key, op, word, outcome of each: applied, noop or skipped. Blank words are left out; an add comes before a removal."""
    asked = overrides.withColumn("word", F.trim("word")).where("word <> ''").distinct()
    has = constants.select(key, "word").distinct().withColumn("has", F.lit(True))
    added = asked.where((F.col("op") == "add") & (F.col("source") == HUMAN)).select(key, "word").distinct().withColumn("added", F.lit(True))
    t = asked.join(has, [key, "word"], "left").join(added, [key, "word"], "left").na.fill(False, ["has", "added"])
    there = F.when(F.col("op") == "add", F.col("has")).otherwise(F.col("has") | F.col("added"))
    human = F.coalesce(F.col("source") == HUMAN, F.lit(False))
    outcome = F.when(~human, "skipped").when((F.col("op") == "add") == there, "noop").otherwise("applied")
    outcomes = t.select(key, "op", "word", outcome.alias("outcome"))
    gone = outcomes.where("op = 'remove' and outcome = 'applied'").select(key, "word")
    return has.drop("has").unionByName(added.drop("added")).distinct().join(gone, [key, "word"], "left_anti"), outcomes
