"""How far the sources of a language diverge in their words: wide term vectors.

Words are counted by (language, source, term), each term of a language is pivoted into one array indexed by the
sources of that language, and higher-order functions turn that array into the contributions of pairs of
sources, which are added up before they are shuffled. Places where a source lacks the term all have one value, so
arrays hold the others, and what is left out is added by count. No Python runs on the way.

Measures. With N a group's words among the V kept terms of its language, a count c gives
p = 1 + floor(SCALE * (c + 1) / (N + V)); the divergence of p from q is the sum over terms of floor((p - q)^2 / q),
in whole numbers throughout. SCALE is 10^9, divided in three steps of a thousand, so that no product leaves 64 bits
while N + V stays under 9 * 10^15; the sum of (p - q)^2 / q over all terms is at most the square of the sum of p.

What may be large: terms, which are keys of every shuffle but the sums; words of a hot source or a hot term, which
are added up in the tasks before. What is small by its nature: sources of one language, as the result has a row for
each pair of them; a vector has as many places. Their table is broadcast up to GROUPS_BROADCAST rows, and beyond
that joined by language and a salt.

Defined cases: null text, language and source are ''; a text without words adds a group but no term; a language
without kept terms has pairs of value 0 and no terms; a language with one source has no pairs; repeated rows count
again; ties of a value go by the item's bytes; long texts are one array of words in one row; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireworks.llm.common import durable

#: Documents of a language that keep a term; rank of the last reported term; scale of p, in steps of STEP.
LEAST_DOCS, TERMS_SHOWN, STEP = 3, 200, 1000
#: Groups (languages with their sources) whose table goes to all tasks, and salts of a language beyond.
GROUPS_BROADCAST, SALTS = 100_000, 64

_BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text: runs of A-Z, a-z and characters beyond ASCII, only A-Z lower-cased. Texts at their ends may give empty words besides."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.split(F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER)), _BETWEEN)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows that hold it). Words of a row are sorted and paired with the one before, so the first of equal ones counts the row."""
    words = docs.select("lang", "source", F.sort_array(words_of(F.col("text"))).alias("words"))
    before = F.concat(F.array(F.lit("")), "words")
    rows = words.select("lang", "source", F.inline(F.arrays_zip(F.col("words").alias("term"), before.alias("before")))).where("term <> ''")
    return rows.groupBy("lang", "source", "term").agg(F.count("*").alias("n"), F.count_if(F.col("term") != F.col("before")).alias("docs"))


def probability(count: Column, total: Column) -> Column:
    """1 + floor(10^9 * (count + 1) / total), by long division in base STEP; count + 1 is at most total, as total is the words plus the terms."""
    out, rest = F.lit(0).cast("long"), count + 1
    for _ in range(3):
        part = rest * STEP
        out, rest = out * STEP + _div(part, total), part % total
    return out + 1


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def gap(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def vectors(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept terms (lang, term, counts: an array of (place, n)), and languages (lang, sources: sorted, totals: N + V of each, total: N + V of the language, terms: V)."""
    counts = durable(term_counts(docs), "term-counts")
    kept = durable(
        counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("counts")).where(F.col("docs") >= LEAST_DOCS).select("lang", "term", "counts"),
        "term-vectors",
    )
    groups = docs.select("lang", "source").distinct()
    words = kept.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("n"))
    terms = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    both = groups.join(words, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    languages = both.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("g"), F.sum("n").alias("n")).join(terms, "lang", "left")
    v = F.coalesce("terms", F.lit(0).cast("long"))
    languages = languages.select("lang", F.col("g.source").alias("sources"), F.transform("g.n", lambda n: n + v).alias("totals"), (F.col("n") + v).alias("total"), v.alias("terms"))
    return kept, durable(languages, "term-languages")


def with_language(kept: DataFrame, languages: DataFrame, n_groups: int, broadcast: int = GROUPS_BROADCAST) -> DataFrame:
    """kept with the columns of its language. One language may have a third of the terms: its row goes to all tasks while there are `broadcast` groups at most, and else to SALTS keys."""
    if n_groups <= broadcast:
        return kept.join(F.broadcast(languages), "lang")
    salted = languages.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"]).drop("salt")


def audit(docs: DataFrame, broadcast: int = GROUPS_BROADCAST) -> DataFrame:
    """lang, source, part, item, value, rank over docs(text, lang, source).

    Part `pair`: item is another source of the language, value the divergence from it. Part `term`: item is a term
    of the group that is more likely there than in the language, value its share of the divergence from the
    language, the first TERMS_SHOWN by value. Ranks go by value descending, item ascending.
    """
    known = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    kept, languages = vectors(known)
    n_groups = languages.agg(F.coalesce(F.sum(F.size("sources")), F.lit(0))).first()[0]
    by_place = F.transform("counts", lambda c: F.struct((F.array_position("sources", c["source"]) - 1).cast("int").alias("i"), c["n"].alias("n")))
    wide = with_language(kept, languages, n_groups, broadcast).withColumn("v", by_place)
    p = lambda count, i: probability(count, F.get("totals", i))
    with_p = F.transform("v", lambda c: F.struct(c["i"].alias("i"), p(c["n"], c["i"]).alias("p"), p(F.lit(0).cast("long"), c["i"]).alias("z")))
    q = probability(F.aggregate("v", F.lit(0).cast("long"), lambda a, c: a + c["n"]), F.col("total"))
    wide = durable(wide.select("lang", "term", with_p.alias("v"), q.alias("q")), "wide-vectors")
    pairs = pair_values(wide, languages)

    each = wide.select("lang", "term", "q", F.inline("v")).where(F.col("p") > F.col("q")).drop("z")
    named = with_language(each, languages.select("lang", "sources"), n_groups, broadcast)
    terms = named.select("lang", F.get("sources", "i").alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    return ranked(pairs).unionByName(ranked(terms, TERMS_SHOWN))


def pair_values(wide: DataFrame, languages: DataFrame) -> DataFrame:
    """lang, source, part, item, value for all pairs of sources, from vectors(lang, v: array of (i, p, z) at the places with occurrences; z is the p of count 0 there).

    A place without occurrences has the p of count 0, which is one number for a source. So a pair's sum is that of
    two vectors without any occurrence, plus what changes where the one source has the term (a histogram of its p
    is enough), plus the same for the other, plus what changes where both have it. Only the last is emitted by terms.
    """
    zero = languages.select("lang", "sources", "terms", F.transform("totals", lambda x: probability(F.lit(0).cast("long"), F.greatest(x, F.lit(1).cast("long")))).alias("zero"))
    f = lambda p, q: gap(F.col(p), F.col(q))
    cells = zero.select("lang", "sources", "terms", "zero", F.posexplode("zero").alias("i", "zi")).select("*", F.posexplode("zero").alias("j", "zj")).where("i <> j")
    cells = cells.select("lang", "i", "j", "zi", "zj", F.get("sources", "i").alias("source"), F.get("sources", "j").alias("item"), "terms")
    seen = durable(wide.select("lang", F.inline("v")).groupBy("lang", "i", "p").agg(F.count("*").alias("n")), "vector-histograms")
    near = cells.select("lang", "i", "j", "zi", "zj")
    one = near.join(seen, ["lang", "i"]).groupBy("lang", "i", "j").agg(F.sum(F.col("n") * (f("p", "zj") - f("zi", "zj"))).alias("value"))
    other = near.join(seen.withColumnRenamed("i", "j"), ["lang", "j"]).groupBy("lang", "i", "j").agg(F.sum(F.col("n") * (f("zi", "p") - f("zi", "zj"))).alias("value"))
    later = lambda k: F.slice("v", k + 2, F.size("v"))
    pair = lambda a, b: F.struct(a["i"].alias("i"), b["i"].alias("j"), a["p"].alias("p"), b["p"].alias("q"), a["z"].alias("zi"), b["z"].alias("zj"))
    met = F.flatten(F.transform("v", lambda a, k: F.transform(later(k), lambda b: pair(a, b))))
    change = lambda p, q, zp, zq: f(p, q) - f(p, zq) - f(zp, q) + f(zp, zq)
    both = wide.select("lang", F.inline(met)).groupBy("lang", "i", "j").agg(F.sum(change("p", "q", "zi", "zj")).alias("there"), F.sum(change("q", "p", "zj", "zi")).alias("back"))
    both = both.select("lang", F.inline(F.array(F.struct("i", "j", F.col("there").alias("value")), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), F.col("back").alias("value")))))
    sums = one.unionByName(other).unionByName(both).groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    whole = F.col("terms") * f("zi", "zj") + F.coalesce("value", F.lit(0).cast("long"))
    return cells.join(sums, ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", whole.alias("value"))


def ranked(rows: DataFrame, most: int | None = None) -> DataFrame:
    """rows with their rank in (lang, source, part). A limit is put on every task's rows before the shuffle, so a group's rows are not gathered whole."""
    from pyspark.sql import Window

    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return out.where(F.col("rank") <= most) if most else out
