"""Queries over plans and results: bands, families, validation, attribute order, overrides, page splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from quireworks.operators import layout, overrides, records, splits, validation
from quireworks.plans import catalog_records as records_sql
from quireworks.plans import families
from quireworks.plans.registry import query
from quireworks.sources import html

# bands and lines: parts are lines and bands, brands are plans


_PAIRS = """l as (select p_brand as key, p_partkey as line_id, (p_size * 20 + p_partkey % 7) / 1000.0::double as rel from part where p_partkey % 3 > 0),
b as (select p_brand as key, p_partkey as band_id, (p_size * 20 + p_partkey % 5) / 1000.0::double as band_rel from part where p_partkey % 3 = 0),
p as (select l.key, line_id, list(band_id order by abs(rel - band_rel), band_id desc) as cand from l join b on l.key = b.key and abs(rel - band_rel) <= 0.005 group by all),
n as (select *, row_number() over (partition by key order by line_id) as i from p),
r(key, i, used, line_id, band_id) as (select distinct key, 0::bigint, []::bigint[], null::bigint, null::bigint from n
 union all select key, i, case when pick is null then used else list_append(used, pick) end, line_id, pick
 from (select n.key, n.i, r.used, n.line_id::bigint as line_id, list_filter(n.cand, lambda x: not list_contains(r.used, x))[1]::bigint as pick from r join n on n.key = r.key and n.i = r.i + 1)),
m as (select r.key, r.line_id, r.band_id, abs(l.rel - b.band_rel) as off from r join l on l.line_id = r.line_id join b on b.band_id = r.band_id) """


def _lines_and_bands(t):
    p = t("part").select(F.col("p_brand").alias("key"), "p_partkey", "p_size")
    at = lambda k: (F.col("p_size") * 20 + F.col("p_partkey") % k) / F.lit(1000.0)
    return p.where("p_partkey % 3 > 0").select("key", F.col("p_partkey").alias("line_id"), at(7).alias("rel")), p.where("p_partkey % 3 = 0").select("key", F.col("p_partkey").alias("band_id"), at(5).alias("band_rel"))


@query("with recursive " + _PAIRS + "select key, line_id, band_id, round(off, 6) as off from m")
def band_matches(t):
    lines, bands = _lines_and_bands(t)
    return families.match_bands(lines, bands, "key").withColumn("off", F.round("off", 6))


@query("with recursive " + _PAIRS + """, x as (select key, count(*) as n_matched, max(off) as dev from m group by 1), nl as (select key, count(*) as n from l group by 1), nb as (select key, count(*) as n from b group by 1),
k as (select distinct p_brand as key from part), g as (select k.key, coalesce(nl.n, 0) as nl, coalesce(nb.n, 0) as nb, coalesce(n_matched, 0) as n_matched, dev from k left join nl using (key) left join nb using (key) left join x using (key))
select key, case when nb = 0 then 'no_contract_bands' when n_matched = 0 then 'unmatched' when n_matched = nl and n_matched = nb then 'conforms' else 'deviates' end as verdict, nb as n_contract, n_matched, nl - n_matched as n_plan_only, nb - n_matched as n_contract_only, round(dev, 4) as max_dev_rel, round(dev * 1000, 1) as max_dev_px from g""")
def band_agreement(t):
    lines, bands = _lines_and_bands(t)
    return families.band_agreement(lines, bands, t("part").select(F.col("p_brand").alias("key"), F.lit(1000.0).alias("ref_h")).distinct(), "key")


@query("""with recursive l as (select p_type as key, regexp_extract(p_brand, '[0-9]+')::int as pos, p_size as s, count(*) as c from part group by all), n as (select key, pos, sum(c) as n from l group by all),
e as (select a.key, a.pos as later, b.pos as earlier from l a join l b on a.key = b.key and a.s = b.s and a.pos > b.pos join n x on x.key = a.key and x.pos = a.pos join n y on y.key = b.key and y.pos = b.pos
 group by a.key, a.pos, b.pos, x.n, y.n having sum(least(a.c, b.c)) / greatest(x.n, y.n) >= 0.35),
r(key, pos, f) as (select key, pos, pos from n union select e.key, e.later, r.f from e join r on r.key = e.key and r.pos = e.earlier),
f as (select key, pos, min(f) as founder from r group by all),
g as (select f.key, founder, count(*) as n_pages, floor(quantile_cont(n.n, 0.5))::int as median_n_lines, string_agg('Brand#' || f.pos, ',' order by f.pos) as pages from f join n on n.key = f.key and n.pos = f.pos group by all)
select key, (row_number() over (partition by key order by n_pages desc, median_n_lines desc, founder) - 1)::int as family, founder, n_pages, median_n_lines, case when n_pages >= 2 then 'inducible' else 'single_page_evidence' end as coverage, pages from g""")
def page_families(t):
    p = t("part").select(F.col("p_type").alias("key"), F.col("p_brand").alias("page"), (F.col("p_size") / F.lit(50.0)).alias("rel"))
    pages = p.select("key", "page", F.regexp_extract("page", "[0-9]+", 0).cast("int").alias("at")).distinct()
    got = families.page_families(pages, p, "key", least=0.35)
    return got.select("key", "family", "founder", "n_pages", "median_n_lines", "coverage", F.array_join("pages", ",").alias("pages"))


@query("""with l as (select p_type as key, p_brand as page, p_partkey as line_no, (p_size * 20 + p_partkey % 7) / 1000.0::double as rel, left(p_name, 1) as kind, p_size % 5 as length, p_partkey % 3 = 0 as in_gold from part),
d as (select distinct key, rel from l), w as (select *, case when rel - lag(rel) over (partition by key order by rel) <= 0.004 then 0 else 1 end as new from d),
i as (select l.*, island from l join (select key, rel, sum(new) over (partition by key order by rel) as island from w) using (key, rel)),
m as (select key, island, quantile_cont(rel, 0.5) as mid from i group by all), p as (select i.*, mid, row_number() over (partition by key, island, page order by abs(rel - mid), rel, line_no) as r, min({'a': rel, 'b': page, 'c': line_no}) over (partition by key, island, page) as seen from i join m using (key, island)),
k as (select * from p where r = 1), c as (select key, island, kind, count(*) as n, min(seen) as seen from k group by all), b as (select key, island, arg_min(kind, {'n': -n, 'seen': seen}) as kind from c group by all),
t as (select p_type as key, count(distinct p_brand) as total from part group by 1), h as (select key, floor(quantile_cont(1000.0 + length(page) * 10, 0.5)) as h from l group by 1),
g as (select key, island, sum(round(rel * 1000000)::bigint) / count(*) / 1000000 as mean, max(rel) - min(rel) as spread, count(*) as n_pages_hit, bool_or(in_gold) as in_gold_any, sum((length <= 2)::int)::bigint as weak, string_agg(page, ',' order by page) as pages from k group by all),
x as (select key, island, count(*)::int as extra from p where r > 1 group by all)
select key, round(mean + 1e-9, 4) as rel, round(spread, 4) as rel_spread, round(mean * h + 1e-9, 1) as px, round(n_pages_hit / total, 3) as support, n_pages_hit, kind, in_gold_any, weak, pages, coalesce(extra, 0) as extra
from g join b using (key, island) join t using (key) join h using (key) left join x using (key, island)""")
def structure_lines(t):
    p = t("part")
    lines = p.select(F.col("p_type").alias("key"), F.col("p_brand").alias("page"), F.col("p_partkey").alias("line_no"), ((F.col("p_size") * 20 + F.col("p_partkey") % 7) / F.lit(1000.0)).alias("rel"), F.substring("p_name", 1, 1).alias("kind"), (F.col("p_size") % 5).alias("length"), (F.col("p_partkey") % 3 == 0).alias("in_gold"))
    pages = lines.select("key", "page", (F.lit(1000.0) + F.length("page") * 10).alias("h")).distinct()
    return families.structure_lines(lines, pages, "key", 0.004).withColumn("extra", F.size("extra")).withColumn("pages", F.array_join("pages", ",")).drop("island")


# results against their pages: orders are pages and line items their records; conversations are pages and their turns the lines


_ROWS = ["tier_unknown", "tier_trace_order", "tier_skip", "tier_mismatch", "line_out_of_range", "line_reused", "record_overlap", "record_no_lines", "box_inverted", "box_out_of_page", "record_spans_bands", "record_in_unannotated", "record_touches_unannotated", "layout_policy_unknown", "layout_uncovered", "layout_policy_mismatch", "page_size_unknown", "page_size_mismatch", "line_source_unresolved", "single_line_bad"]


@query("""with o as (select o_orderkey as k, o_orderkey::varchar as stem, ['rule', 'l1', 'l2', 'single_line', 'odd'][1 + o_orderkey % 5] as tier, [1 + o_orderkey % 4, 1 + (o_orderkey // 4) % 4] as places, [o_orderkey % 3 = 0, o_orderkey % 2 = 0] as oks,
 case o_orderkey % 3 when 0 then true when 1 then false end as covered, case o_orderkey % 4 when 0 then 'page_fallback' when 1 then 'family_params' when 2 then 'guess' end as policy, case when o_orderkey % 49 > 0 then 950.0 + o_orderkey % 5 * 25 end as h, o_orderkey % 7 > 0 as sized, case when o_orderkey % 13 > 0 then 6 end as n_lines from orders),
i as (select l_orderkey as k, (row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1)::int as record, l_quantity::int as q, l_partkey as p, l_suppkey as s, (l_partkey * 7) % 1000 as y0 from lineitem),
r as (select o.*, record, case when q % 9 = 0 then []::int[] else [q % 8, q % 8 + (p % 3)::int] end as ls, p % 985 as x0, p % 985 + 20 as x1, y0, y0 + s % 4 * 20 as y1, case when sized then 1000.0 else h end as ph from o join i using (k)),
n as (select o.k, count(i.record) as n, arg_min(i.q, i.record) as q, arg_min(i.p, i.record) as p from o left join i using (k) group by 1),
u as (select k, stem, record, unnest(ls) as line, n_lines from r), v as (select *, min(record) over (partition by k, line) as f from u where line < coalesce(n_lines, 1000000000)),
w as (select stem, record, lo, lag(hi) over (partition by stem order by lo, hi, record) as before from (select stem, record, list_min(ls) as lo, list_max(ls) as hi from r where len(ls) > 0)),
a as (select *, (y0 + y1) / 2.0 / ph as c, case when (y0 + y1) / 2.0 / ph < 0.2 then 0 when (y0 + y1) / 2.0 / ph < 0.7 then 1 when (y0 + y1) / 2.0 / ph < 1.0 then 2 end as area from r),
f as (select stem, 'error' as level, 'tier_unknown' as code, null::int as record, (tier = 'odd')::int as n from o union all select stem, 'warning', 'tier_trace_order', null, (places[1] > places[2])::int from o
 union all select stem, 'warning', 'tier_skip', null, (abs(places[1] - places[2]) <> 1)::int from o
 union all select stem, 'error', 'tier_mismatch', null, (case when oks[2] then ['rule', 'l1', 'l2', 'single_line'][places[2]] <> tier when oks[1] then ['rule', 'l1', 'l2', 'single_line'][places[1]] <> tier else false end)::int from o
 union all select stem, 'error', 'line_out_of_range', record, len(list_filter(ls, lambda x: x >= n_lines)) from r where n_lines is not null
 union all select stem, 'error', 'line_reused', record, count(*) from v where record <> f group by all union all select stem, 'error', 'record_overlap', record, 1 from w where lo <= before
 union all select stem, 'warning', 'record_no_lines', record, (len(ls) = 0)::int from r where n_lines is not null union all select stem, 'error', 'box_inverted', record, (y1 <= y0)::int from r
 union all select stem, 'error', 'box_out_of_page', record, (x1 > 1000.5 or y1 > ph + 0.5)::int from r where ph is not null
 union all select stem, 'error', 'record_in_unannotated', record, (area = 0)::int from a where ph is not null
 union all select stem, 'warning', 'layout_policy_unknown', null, (policy = 'guess')::int from o union all select stem, 'warning', 'layout_uncovered', null, ((covered = false and coalesce(policy, '') <> 'page_fallback') or (covered is null and policy = 'page_fallback'))::int from o
 union all select stem, 'warning', 'layout_policy_mismatch', null, (policy = 'page_fallback' and tier <> 'single_line')::int from o union all select stem, 'warning', 'page_size_unknown', null, (h is null and not sized)::int from o
 union all select stem, 'warning', 'page_size_mismatch', null, (sized and abs(h - 1000) > 20)::int from o union all select stem, 'warning', 'line_source_unresolved', null, (n_lines is null)::int from o
 union all select stem, 'error', 'single_line_bad', null, (tier = 'single_line' and (n <> 1 or (n_lines is not null and case when q % 9 = 0 then 0 else p % 3 + 1 end < 5)))::int from o join n using (k))
select stem, level, code, record, n::bigint as n from f where n > 0""")
def result_findings(t):
    """Findings of records, boxes, tiers and layouts; those of texts are in result_text_findings."""
    k = F.col("o_orderkey")
    tier = lambda i: F.get(F.array(*map(F.lit, validation.CHAIN)), i.cast("int"))
    kept = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_quantity").cast("int").alias("q"))
    attrs = F.array().cast("array<struct<attr:string,text:string,lines:array<int>,boxes:array<array<double>>>>")

    def record(i):
        """The record of a line item; made behind the shuffle, which its few columns pass more cheaply."""
        q, x, y = i["q"], (i["l_partkey"] % 985).cast("double"), ((i["l_partkey"] * 7) % 1000).cast("double")
        ls = F.when(q % 9 == 0, F.array().cast("array<int>")).otherwise(F.array(q % 8, (q % 8 + i["l_partkey"] % 3).cast("int")))
        return F.struct(ls.alias("lines"), F.array(x, y, x + 20, y + i["l_suppkey"] % 4 * 20).alias("box"), attrs.alias("attrs"))

    items = t("lineitem").groupBy(F.col("l_orderkey").cast("string").alias("stem")).agg(F.array_sort(F.collect_list(F.struct(*kept))).alias("items"))
    records = items.select("stem", F.transform("items", record).alias("records"))
    orders = t("orders").withColumn("stem", k.cast("string")).join(records, "stem", "left").withColumn("records", F.coalesce("records", F.array().cast(records.schema["records"].dataType)))
    results = orders.select(
        "stem", F.lit(validation.KIND).alias("kind"), F.lit("0.1.0").alias("schema_version"), F.lit("p").alias("profile_id"), F.get(F.array(*map(F.lit, (*validation.CHAIN, "odd"))), (k % 5).cast("int")).alias("tier"),
        F.lit("").alias("text_stream"), F.lit(None).cast("array<string>").alias("chain"), F.array(F.struct(tier(k % 4).alias("tier"), (k % 3 == 0).alias("ok")), F.struct(tier(F.floor(k / 4) % 4).alias("tier"), (k % 2 == 0).alias("ok"))).alias("trace"),
        F.struct(F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("covered"), F.when(k % 4 == 0, "page_fallback").when(k % 4 == 1, "family_params").when(k % 4 == 2, "guess").alias("policy")).alias("layout"),
        F.struct(F.lit(1000.0).alias("w"), F.when(k % 49 > 0, 950.0 + k % 5 * 25).alias("h")).alias("page"), "records", F.array().cast("array<struct<text:string,reason:string>>").alias("unassigned"),
    )
    stems = t("orders").select(k.cast("string").alias("stem"), k.alias("k"))
    lines = stems.where("k % 13 > 0").select("stem", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("at"), F.lit("x").alias("text"))
    sizes = stems.where("k % 7 > 0").select("stem", F.lit(1000.0).alias("w"), F.lit(1000.0).alias("h"))
    areas = F.array(*(F.struct(F.lit(i).alias("id"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(role).alias("role")) for i, lo, hi, role in ((0, 0.0, 0.2, "unannotated_top"), (1, 0.2, 0.7, "body"), (2, 0.7, 1.0, "foot"))))
    return validation.findings(results, lines, sizes, stems.select("stem", F.inline(areas))).where(F.col("code").isin(_ROWS))


@query()
def result_text_findings(t):
    """Whole conversations as pages: turns are lines and records, values are a turn's first and last characters, notes its middle; some streams are cut, some values made up, some notes left out."""
    c = t("conversations").select(F.col("conv_id").cast("string").alias("stem"), F.col("turn").cast("int").alias("turn"), F.coalesce("text", F.lit("")).alias("text"), F.col("conv_id").alias("k"))
    value = lambda text: F.struct(F.lit("a").alias("attr"), text.alias("text"), F.array("turn").alias("lines"), F.lit(None).cast("array<array<double>>").alias("boxes"))
    tail = F.when((F.col("k") + F.col("turn")) % 9 == 4, F.lit("made up, never said")).otherwise(F.substring("text", -20, 20))
    attrs = F.when(F.length("text") <= 60, F.array(value(F.col("text")))).otherwise(F.array(value(F.substring("text", 1, 30)), value(tail)))
    note = F.when((F.length("text") > 60) & ((F.col("k") + F.col("turn")) % 7 != 2), F.struct(F.expr("substring(text, 31, length(text) - 50)").alias("text"), F.when(F.col("turn") % 2 == 0, "other").otherwise("unannotated_region").alias("reason")))
    rows = c.withColumn("record", F.struct(F.array("turn").alias("lines"), F.lit(None).cast("array<double>").alias("box"), attrs.alias("attrs"))).withColumn("note", note)
    pages = rows.groupBy("stem", "k").agg(F.array_sort(F.collect_list(F.struct("turn", "text", "note"))).alias("rows"), F.transform(F.array_sort(F.collect_list(F.struct("turn", "record"))), lambda r: r["record"]).alias("records"))
    stream = F.array_join(F.transform("rows", lambda r: r["text"]), "")
    results = pages.select(
        "stem", F.lit(validation.KIND).alias("kind"), F.lit("0.1.0").alias("schema_version"), F.lit("p").alias("profile_id"), F.lit("rule").alias("tier"), F.when(F.col("k") % 11 == 3, F.expr("substring(array_join(transform(rows, r -> r.text), ''), 1, 200)")).otherwise(stream).alias("text_stream"),
        F.lit(None).cast("array<string>").alias("chain"), F.lit(None).cast("array<struct<tier:string,ok:boolean>>").alias("trace"), F.lit(None).cast("struct<covered:boolean,policy:string>").alias("layout"), F.struct(F.lit(100.0).alias("w"), F.lit(100.0).alias("h")).alias("page"),
        "records", F.filter(F.transform("rows", lambda r: r["note"]), lambda n: n.isNotNull()).alias("unassigned"),
    )
    none = c.select("stem", F.lit(0.0).alias("w"), F.lit(0.0).alias("h")).limit(0)
    return validation.findings(results, c.select("stem", F.col("turn").alias("at"), "text"), none, none.select("stem", F.lit(0).alias("id"), F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"), F.lit("").alias("role")))


# whole documents split into records


_SPLIT = records_sql.SEGMENTS + """, xs as (select doc_id, line_id, record::bigint as record, st, forced, trimmed, trim(line, ' ') as t from p where trim(line, ' ') <> ''),
rec as (select doc_id, record, case when bool_or(st and forced) then '' else max(case when st then t end) end as name, string_agg(t, '' order by line_id) as t, bool_or(st and forced) as forced, false as fallback from xs where record > 0 and not trimmed group by all
 union all select doc_id, 1, '', string_agg(t, '' order by line_id), false, true from xs group by doc_id having max(record) = 0),
num as (select *, substring(t, length(name) + 1) as body, regexp_matches(substring(t, length(name) + 1), '[0-9]+') as has_number from rec),
wrd as (select *, case when has_number then regexp_replace(body, '^.*?[0-9]+', '', 's') else body end as rest from num),
xv as (select *, (name <> '')::int + has_number::int + (regexp_matches(rest, '[xzq]') or (not regexp_matches(name, '[xzq]') and regexp_matches(t, '[xzq]')))::int as filled from wrd),
xr as (select doc_id, count(*) as n_records, sum(filled) as filled, sum(forced::int)::bigint as forced, bool_or(fallback) as fallback, sum(length(t)) as in_records from xv group by 1),
xg as (select doc_id, count(*) as n_lines, sum(length(t))::bigint as chars, case when max(record) = 0 then 0 else sum(case when record = 0 or trimmed then length(t) else 0 end) end::bigint as orphans from xs group by 1) """


@query(_SPLIT + """select doc_id, n_records, n_lines, round(filled / (n_records * 3), 4) as fill_rate, case when fallback or forced > 0 then 'low' when round(filled / (n_records * 3), 4) >= 0.55 then 'high' when round(filled / (n_records * 3), 4) >= 0.3 then 'medium' else 'low' end as confidence,
forced, fallback, chars, orphans, in_records::bigint as in_records, true as whole from xg join xr using (doc_id)""")
def page_splits(t):
    """Records of whole documents with a name, a number and a stretch from x, z or q on; `whole`: characters of values, of the rest of records and of orphans add up to the page's."""
    template = splits.Template("name", (records.Attribute("number", "[0-9]+", True), records.Attribute("word", "[xzq]")))
    segmented = records_sql._segments(t)
    got = splits.split_pages(segmented, splits.split_records(segmented, "doc_id", "line_id", "line", template), "doc_id", "line_id", "line", template)
    inside = F.col("in_values") + F.col("unclaimed")
    return got.select("doc_id", "n_records", "n_lines", "fill_rate", "confidence", "forced", "fallback", "chars", "orphans", inside.alias("in_records"), (F.col("chars") == inside + F.col("cut") + F.col("orphans")).alias("whole"))


_SIGNS = "周廷弼叶成忠張石君荣瑞馨宗敬德生黄思永王李趙錢孫吳鄭馮陳褚衛蔣沈韓楊朱秦尤許何呂施孔曹嚴華金魏陶姜"


@query(f"""with s as (select '{_SIGNS}' as a), d as (select p_partkey as k, p_size % 6 as n, p_type in ('ECONOMY', 'PROMO', 'SMALL') as titled, p_size % 4 = 1 as dated, p_partkey % 5 = 2 as odd, [substring(a, (p_partkey * 7 + i * 11) % 45 + 1, 1) || substring(a, (p_partkey * 3 + i * 5) % 45 + 1, 1) || substring(a, (p_partkey + i * 13) % 45 + 1, 1) for i in range(0, 6)] as who from part, s),
e as (select *, list_slice(who, 1, least(n, 4)) as kept from d)
select k, case when n = 0 or (not titled and n > 4) then null when titled or not odd then kept[1] else substring(kept[1], 1, 3) end as p1, case when n = 0 or (not titled and n > 4) then null else kept[2] end as p2, case when n = 0 or (not titled and n > 4) then null else kept[4] end as p4,
 case when titled and n > 0 then case when odd then '候选道' else '監生' end end as t1, case when titled and n > 1 then case when odd then '候选道' else '監生' end end as t2 from e""")
def person_fields(t):
    """Founders of generated records: one to five, with titles or in a bare run, with a registered date before a bare run or not."""
    at = lambda a, b, i: F.substring(F.lit(_SIGNS), ((F.col("p_partkey") * a + i * b) % 45 + 1).cast("int"), F.lit(1))
    names = F.array(*(F.concat(at(7, 11, i), at(3, 5, i), at(1, 13, i)) for i in range(6)))
    titled = F.col("p_type").isin("ECONOMY", "PROMO", "SMALL")
    title = F.when(F.col("p_partkey") % 5 == 2, "候选道").otherwise("監生")
    people = F.array_join(F.transform(F.slice(names, F.lit(1), F.col("p_size") % 6), lambda n: F.when(titled, F.concat(title, n)).otherwise(n)), "")
    date = F.when(~titled & (F.col("p_size") % 4 == 1), F.concat(F.lit("十二月廿三日"), F.lit("補註"))).otherwise("")
    text = F.concat(F.lit("總號在某地，"), date, people, F.lit("創辦，資本若干"))
    rule = splits.PersonRule("候选道|監生", (("p1", "t1"), ("p2", "t2"), ("p3", "t3"), ("p4", "t4")), tail="(?:創辦|创办)", dates=("補註", *splits.MARKS))
    taken = F.array(F.struct(F.lit(0).alias("lo"), F.lit(6).alias("hi")))
    v = t("part").select(F.col("p_partkey").alias("k"), splits.person_values(text, taken, rule, lambda c: c).alias("v"))
    return v.select("k", *(F.element_at("v", F.lit(n)).alias(n) for n in ("p1", "p2", "p4", "t1", "t2")))


# orders of attributes, and what is set against them


@query("""with recursive f as (select user_id % 10 as k, user_id, event_type as a, min(ts) as at from events group by all),
w as (select x.k, x.a as before, y.a as after, count(*) as wins from f x join f y on x.user_id = y.user_id and (x.at < y.at or (x.at = y.at and x.a < y.a)) group by all),
e as (select w.k, w.before, w.after from w left join w l on l.k = w.k and l.before = w.after and l.after = w.before where w.wins > coalesce(l.wins, 0)),
s as (select user_id % 10 as k, event_type as a, min(event_id) as seed from events group by all), h as (select s.k, s.a, s.seed, list(e.before) filter (e.before is not null) as ahead from s left join e on e.k = s.k and e.after = s.a group by all),
r(k, l, o, n) as (select k, list({'a': a, 'ahead': coalesce(ahead, [])} order by seed, a), []::varchar[], 0 from h group by k union all
 select k, list_filter(l, lambda y: y.a <> p), list_append(o, p), n + 1 from (select *, list_filter(l, lambda y: len(list_intersect(y.ahead, list_transform(l, lambda z: z.a))) = 0)[1].a as p from r) where p is not null)
select k, array_to_string(list_concat(o, list_transform(l, lambda y: y.a)), ',') as attrs, array_to_string(list_transform(l, lambda y: y.a), ',') as cyclic from (select *, row_number() over (partition by k order by n desc) as last from r) where last = 1""")
def attribute_order(t):
    e = t("events").withColumn("k", F.col("user_id") % 10)
    seeds = e.groupBy("k", F.col("event_type").alias("attr")).agg(F.min("event_id").alias("seed"))
    got = overrides.attribute_orders(overrides.wins(e, "k", "user_id", "ts", "event_type"), seeds, "k")
    return got.select("k", F.array_join("order", ",").alias("attrs"), F.array_join("cyclic", ",").alias("cyclic"))


_SET = """c as (select p_brand as k, p_type as a, count(*) as n, avg(p_size) as m from part group by all), l as (select k, list(a order by n desc, a) as o, coalesce(list(a order by n desc, a) filter (m > 25), []) as req from c group by k),
s as (select p_brand as k, case when p_partkey % 11 = 0 then 'NONE' else p_type end as a, p_partkey as id, p_partkey % 3 > 0 as human, case p_partkey % 5 when 0 then null when 1 then (p_size % 8)::varchar when 2 then 'x' else (p_size % 6 + 1)::varchar end as position, case p_partkey % 4 when 0 then null when 1 then true else false end as need from part),
j as (select s.*, o, req, coalesce(list_position(o, a), 0) as pl, try_cast(position as int) as p from s join l using (k)),
f as (select k, a, id, 'all' as field, 'skipped' as outcome, 'no_human_source' as reason, null::varchar as value from j where not human
 union all select k, a, id, 'position', case when p is null or pl = 0 or p < 1 or p > len(o) then 'skipped' when p = pl then 'noop' else 'applied' end, case when p is null then 'not_a_number' when pl = 0 then 'not_in_order' when p < 1 or p > len(o) then 'out_of_range' end, p::varchar from j where human and position is not null
 union all select k, a, id, 'required', case when need = list_contains(req, a) then 'noop' when need and pl = 0 then 'skipped' else 'applied' end, case when need <> list_contains(req, a) and need and pl = 0 then 'not_in_order' end, need::varchar from j where human and need is not null) """


def _learned_and_set(t):
    p = t("part")
    c = p.groupBy(F.col("p_brand").alias("k"), F.col("p_type").alias("a")).agg(F.count("*").alias("n"), F.avg("p_size").alias("m"))
    ranked = c.groupBy("k").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "a", "m"))).alias("x"))
    learned = ranked.select("k", F.transform("x", lambda s: s["a"]).alias("order"), F.transform(F.filter("x", lambda s: s["m"] > 25), lambda s: s["a"]).alias("required"))
    part = F.col("p_partkey")
    position = F.when(part % 5 == 1, (F.col("p_size") % 8).cast("string")).when(part % 5 == 2, "x").when(part % 5 > 2, (F.col("p_size") % 6 + 1).cast("string"))
    asked = p.select(F.col("p_brand").alias("k"), F.when(part % 11 == 0, "NONE").otherwise(F.col("p_type")).alias("attr"), part.alias("id"), F.when(part % 3 > 0, "human").otherwise("model").alias("source"), position.alias("position"), F.when(part % 4 == 1, True).when(part % 4 > 1, False).alias("required"))
    return learned, asked


@query("with " + _SET + "select k, a as attr, field, outcome, reason, value, count(*) as n from f group by all")
def override_outcomes(t):
    learned, asked = _learned_and_set(t)
    return overrides.override_outcomes(learned, asked, "k").groupBy("k", "attr", "field", "outcome", "reason", "value").agg(F.count("*").alias("n"))


@query("with recursive " + _SET + """, one as (select k, a, min(id) as id from s group by all), g as (select f.* from f join one using (k, a, id) where outcome = 'applied'),
pins as (select k, list({'p': value::int, 'a': a} order by value::int, a) as pins from g where field = 'position' group by k),
b as (select l.k, l.o, l.req, coalesce(pins, []) as pins, list_filter(l.o, lambda x: not list_contains(list_transform(coalesce(pins, []), lambda y: y.a), x)) as rest from l left join pins using (k)),
r(k, rest, pins, i) as (select k, rest, pins, 0 from b union all select k, list_concat(list_concat(rest[:least(pins[i + 1].p - 1, len(rest))], [pins[i + 1].a]), rest[least(pins[i + 1].p, len(rest) + 1):]), pins, i + 1 from r where i < len(pins)),
z as (select k, rest as o, len(pins) as n from r where i = len(pins)),
q as (select k, coalesce(list(a order by a) filter (value = 'true'), []) as more, coalesce(list(a) filter (value = 'false'), []) as less from g where field = 'required' group by k),
y as (select z.k, z.o, z.n, list_filter(list_concat(l.req, list_filter(coalesce(more, []), lambda x: not list_contains(l.req, x))), lambda x: not list_contains(coalesce(less, []), x)) as need from z join l using (k) left join q using (k))
select k, array_to_string(o, ',') as attrs, array_to_string(case when n > 0 then list_filter(o, lambda x: list_contains(need, x)) else need end, ',') as required from y""")
def overridden_orders(t):
    """One override for each attribute of a brand: that of its first part."""
    learned, asked = _learned_and_set(t)
    one = asked.groupBy("k", "attr").agg(F.min_by(F.struct("source", "position", "required"), "id").alias("o")).select("k", "attr", "o.*")
    got = overrides.overridden(learned, overrides.override_outcomes(learned, one, "k"), "k")
    return got.select("k", F.array_join("order", ",").alias("attrs"), F.array_join("required", ",").alias("required"))


@query("""with p as (select page_id, unnest(regexp_extract_all(html, '(?is)<ul[^>]*>(.*?)</ul>', 1)) as u, generate_subscripts(regexp_extract_all(html, '(?is)<ul[^>]*>(.*?)</ul>', 1), 1) - 1 as table_no from pages),
r as (select page_id, table_no, unnest(regexp_extract_all(u, '(?is)<li[^>]*>(.*?)</li>', 1)) as c, generate_subscripts(regexp_extract_all(u, '(?is)<li[^>]*>(.*?)</li>', 1), 1) - 1 as i, len(regexp_extract_all(u, '(?is)<li[^>]*>(.*?)</li>', 1)) as n from p)
select page_id, table_no::int as table_no, (i // 2)::int as row_no, case when i < 2 then i when i % 2 = 0 then 1 else 2 end::int as col_no, case when i = 0 then ((n + 1) // 2)::int else 1 end as rowspan, length(c)::int as chars from r""")
def html_grids(t):
    """The pages have lists and no tables, so each list is written as a table of three columns first: its first item spans all rows, the others fill the two columns beside it."""
    lists = F.regexp_extract_all("html", F.lit(r"(?is)<ul[^>]*>(.*?)</ul>"), F.lit(1))
    items = lambda u: F.regexp_extract_all(u, F.lit(r"(?is)<li[^>]*>(.*?)</li>"), F.lit(1))
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, "[^ ]", "x"), " ", "y")
    cell = lambda c, i, n: F.concat(F.when((i > 0) & (i % 2 == 0), "</tr><tr>").otherwise(""), F.when(i == 0, F.concat(F.lit("<td rowspan="), F.floor((n + 1) / 2).cast("string"), F.lit(">"))).otherwise("<td>"), bare(c), F.lit("</td>"))
    table = lambda u: F.concat(F.lit("<table><tr>"), F.array_join(F.transform(items(u), lambda c, i: cell(c, i, F.size(items(u)))), ""), F.lit("</table>"))
    pages = t("pages").select("page_id", F.array_join(F.transform(lists, table), "\n").alias("html"))
    return html.html_grid(pages, "page_id", "html").select("page_id", "table_no", "row_no", "col_no", "rowspan", F.length("text").alias("chars"))


# boxes in order: parts are boxes, brands with a type are pages. A state goes from box to box, so plain walks in the tests stand for SQL


def _boxes(t):
    k = F.col("p_partkey")
    x, y = (k * 37 % 9 * 40 + k % 13).cast("double"), (k * 53 % 700).cast("double")
    whole = F.when(k % 17 > 0, x + 20 + F.col("p_size") % 30)
    return t("part").select(F.concat_ws("/", "p_brand", "p_type").alias("stem"), k.alias("line_id"), x.alias("x1"), y.alias("y1"), whole.alias("x2"), (y + 12 + F.col("p_size") % 9).alias("y2"), F.col("p_name").alias("text"))


@query()
def guarded_columns(t):
    return layout.guarded_order(_boxes(t))


@query()
def mean_columns(t):
    return layout.column_clusters(_boxes(t))


@query()
def upright_reading_order(t):
    return layout.reading_order(_boxes(t))


@query()
def level_reading_order(t):
    return layout.reading_order(_boxes(t), upright=False)


@query()
def box_grid(t):
    return layout.table_grid(_boxes(t))
