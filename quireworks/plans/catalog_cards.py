"""Queries of tables that leave the pipeline, and of field rules and amounts, with their SQL. Rows of the operators' shape are made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireworks.functions import amounts as A
from quireworks.functions import geometry as G
from quireworks.functions import rules as R
from quireworks.operators import cards, lines, retrieval
from quireworks.plans import bands
from quireworks.plans.catalog import LINES, numbered
from quireworks.plans.registry import query
from quireworks.streaming import ingest

UNITS = """with u as (select conv_id::varchar as image, turn as seq, case role when 'user' then 'ledger_entry' when 'assistant' then 'roster_entry' else 'paragraph' end as unit_type, role, text, length(text) as n,
case when length(text) % 3 = 0 then 'needs_review' else 'verified' end as status from conversations) """


def _units(t) -> DataFrame:
    c = t("conversations")
    n = F.length("text")
    fields = F.create_map(F.lit("户名"), F.col("role"), F.lit("方向"), F.when(n % 2 == 0, "收"), F.lit("币种"), F.lit("洋"), F.lit("金额原文"), F.lit(""), F.lit("金额归一"), (n / 8).cast("string"), F.lit("姓名"), F.substring("text", 1, 4), F.lit("备注"), F.lit(""))
    kind = F.when(F.col("role") == "user", "ledger_entry").when(F.col("role") == "assistant", "roster_entry").otherwise("paragraph")
    return c.select(
        F.col("conv_id").cast("string").alias("image"), F.col("turn").alias("seq"), kind.alias("unit_type"), fields.alias("fields"), "text", F.array("turn", F.col("turn") + 2).alias("line_ids"), F.lit("chat").alias("content_type"),
        F.when(n % 3 == 0, "needs_review").otherwise("verified").alias("status"), F.concat("conv_id", F.lit("/"), "turn").alias("unit_id"), F.when(F.col("turn") > 0, G.box(F.col("turn"), F.col("turn"), F.col("turn") + 1, F.col("turn") + 2)).alias("box"),
    )


@query(UNITS + "select image, seq, role as account, case when n % 2 = 0 then '收' else '' end as direction, '洋' as currency, '' as amount_raw, round(n / 8, 4) as amount, text, seq || '-' || (seq + 2) as line_ids from u where unit_type = 'ledger_entry'")
def ledger_sheet(t):
    return cards.ledger_sheet(_units(t))


@query(UNITS + "select image, seq, substring(text, 1, 4) as name, '' as keyear, '' as identity, '' as note, (length(role) > 0)::int as has_extra, text, seq || '-' || (seq + 2) as line_ids from u where unit_type = 'roster_entry'")
def roster_sheet(t):
    s = cards.roster_sheet(_units(t))
    return s.withColumn("has_extra", (F.get_json_object("extra_fields", "$.户名") != "").cast("int")).drop("extra_fields")


@query(UNITS + "select image, 'chat' as content_type, seq, text, seq || '-' || (seq + 2) as line_ids from u where unit_type = 'paragraph'")
def reading_sheet(t):
    return cards.reading_sheet(_units(t))


@query(UNITS + """select image || '/' || seq as unit_id, image, 'chat' as content_type, unit_type, case when seq > 0 then format('{:.1f}-{:.1f}', seq::double, seq + 1.0::double) else '' end as box_x, case when seq > 0 then format('{:.1f}-{:.1f}', seq::double, seq + 2.0::double) else '' end as box_y,
seq || '-' || (seq + 2) as line_ids from u""")
def provenance_sheet(t):
    return cards.provenance_sheet(_units(t))


@query(UNITS + "select image, count(*) as unit_count, sum((status = 'verified')::int)::bigint as verified_count, sum((status = 'needs_review')::int)::bigint as needs_review_count from u group by 1")
def unit_index(t):
    return cards.unit_index(_units(t))


@query(UNITS + "select 'unit_' || image || '_' || seq as card_id, text, status = 'needs_review' as needs_review from u")
def unit_cards(t):
    return cards.unit_cards(_units(t)).drop("fields_text")


@query(UNITS + """, g as (select * from u where status = 'verified'), w as (select image, string_agg(text, chr(10) order by seq) as text from u group by 1)
select 'unit_' || image || '_' || seq as card_id, text from g union all select image, text from w where image not in (select image from g)""")
def unit_corpus(t):
    u = _units(t)
    return cards.unit_corpus(u, cards.page_texts(u, "image", ["seq"], "text").withColumnRenamed("full_text", "text"))


@query("select 'gold_' || conv_id as card_id, string_agg(role || '：' || text, chr(10) order by turn) as text from conversations where coalesce(text, '') <> '' group by conv_id")
def gold_corpus(t):
    return cards.gold_corpus(t("conversations"), "conv_id", "turn", "role", "text")


@query("""select doc_id, length(full_text)::bigint as chars, md5(full_text) as digest from (select doc_id, string_agg(line, chr(10) order by col_index, row_index) as full_text from (""" + LINES + "select * from l) group by doc_id)")
def page_full_text(t):
    f = cards.page_texts(numbered(t), "doc_id", ["col_index", "row_index"], "line")
    return f.select("doc_id", F.length("full_text").cast("long").alias("chars"), F.md5("full_text").alias("digest"))


@query("""with a as (select c_custkey::varchar as image, c_mktsegment as project from customer where c_custkey % 2 = 0), p as (select c_custkey::varchar as image from customer)
select 'current' as scope, count(*) as n from p where image in (select image from a where project = 'BUILDING') union all select 'all', count(*) from p where image in (select image from a) union all select 'selected', count(*) from p where image in ('3', '5', '7')""")
def scope_pages(t):
    c = t("customer").select(F.col("c_custkey").cast("string").alias("image"), F.col("c_mktsegment").alias("project"), "c_custkey")
    assigned, pages = c.where("c_custkey % 2 = 0"), c.select("image")
    count = lambda d, name: d.agg(F.lit(name).alias("scope"), F.count("*").alias("n"))
    now = cards.in_scope(pages, "current_project", assigned, "BUILDING")
    some = cards.in_scope(pages, "selected_images", assigned, selected=pages.where("image in ('3', '5', '7')"))
    return count(now, "current").unionByName(count(cards.in_scope(pages, "all_projects", assigned), "all")).unionByName(count(some, "selected"))


@query(LINES + """, q as (select doc_id, case line_id % 5 when 0 then 'low_quality' when 1 then 'garbage' when 2 then 'possible_duplicate' else '' end as quality from l)
select doc_id, sum((quality = 'low_quality')::int)::bigint as low_quality_count, sum((quality = 'garbage')::int)::bigint as garbage_count, 0::bigint as layout_anomaly_count, sum((quality = 'possible_duplicate')::int)::bigint as duplicate_count from q group by 1""")
def quality_counts(t):
    q = F.when(F.col("line_id") % 5 == 0, "low_quality").when(F.col("line_id") % 5 == 1, "garbage").when(F.col("line_id") % 5 == 2, "possible_duplicate").otherwise("")
    return cards.quality_counts(numbered(t).withColumn("quality", q), "doc_id", "quality")


@query(LINES + """, p as (select doc_id, count(*) as total_lines, sum(length(line))::bigint as total_chars from l group by 1) select 'doc_' || doc_id as card_id, total_lines, total_chars, case when coalesce(lang, '') = '' then 'unknown' else lang end as confidence_source from p join documents using (doc_id)""")
def document_cards(t):
    n = numbered(t)
    pages = lines.page_totals(n).join(t("documents").select("doc_id", F.col("lang").alias("backend")), "doc_id")
    c = cards.document_cards(pages, cards.quality_counts(n.withColumn("quality", F.lit("")), "doc_id", "quality"), "doc_id")
    return c.select("card_id", "card.total_lines", "card.total_chars", "confidence_source")


@query(LINES + "select 'sec_' || doc_id || '_' || col_index as card_id, count(*) as line_count, sum(length(line))::bigint as char_count from l group by doc_id, col_index")
def section_cards(t):
    return cards.section_cards(lines.sections(numbered(t)), "doc_id").drop("preview")


@query(LINES + "select 'line_' || doc_id || '_' || line_id as card_id, line as text, col_index, row_index from l")
def line_cards(t):
    return cards.line_cards(numbered(t), "doc_id").select("card_id", "text", "place.*")


@query("""with o as (select n_name, row_number() over (order by n_name) as image_order from (select distinct n_name from nation)) select image_order, n_name as image_name, c_custkey as xlsx_id, c_name as text, case when c_custkey % 3 = 0 then c_name || 'x' else '' end as corrected, case when c_custkey % 5 = 0 then '' else format('{:.2f}', c_custkey / 4.0::double) end as confidence, format('{:.1f}-{:.1f}', 1.0::double, c_nationkey + 1.5::double) as box_x
from customer join nation on c_nationkey = n_nationkey join o using (n_name)""")
def academic_rows(t):
    n = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = n.select(F.col("n_name").alias("image_name"), F.lit(0).alias("col_index"), F.col("c_custkey").alias("row_index"), F.col("c_name").alias("text"), F.col("c_custkey").alias("xlsx_id"),
                    F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey") / 4).alias("confidence"), F.lit("").alias("quality"), F.array(F.lit(1.0), F.col("c_nationkey") + 1.5).alias("xs"), F.array(F.lit(0.0)).alias("ys"))
    fixes = t("customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("xlsx_id"), F.concat("c_name", F.lit("x")).alias("corrected"))
    return cards.academic_rows(rows, fixes).select("image_order", "image_name", "xlsx_id", "text", "corrected", "confidence", "box_x")


@query("select count(distinct user_id) as gold_pages, count(*) as gold_rows, count(distinct nullif(event_type, 'error')) as gold_attrs from events")
def gold_summary(t):
    return cards.gold_summary(t("events").withColumn("event_type", F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type"))), "user_id", "event_type")


@query("""select case when c_nationkey % 4 = 0 then '' else c_mktsegment end as project, count(*) as pages, sum((c_custkey in (select o_custkey from orders))::int)::bigint as with_gold from customer group by 1""")
def project_coverage(t):
    pages = t("customer").select("c_custkey", F.when(F.col("c_nationkey") % 4 != 0, F.col("c_mktsegment")).alias("p"))
    return cards.project_coverage(pages, t("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "p")


@query("select l_orderkey, count(*) as lines, sum((l_linestatus <> l_returnflag and l_linestatus <> '')::int)::bigint as corrected, round(sum((l_linestatus <> l_returnflag and l_linestatus <> '')::int) / count(*), 4) as ratio from lineitem group by 1")
def correction_stats(t):
    return cards.correction_stats(t("lineitem"), "l_orderkey", "l_returnflag", "l_linestatus")


@query("select event_type, count(*) as pages, sum(user_id)::bigint as user_id, round(sum(round((user_id * 2.0 + event_id * 8.0) / 1e6, 6)), 4) as cost from events group by 1")
def batch_totals(t):
    e = t("events").withColumn("cost", cards.cost(F.col("user_id"), F.col("event_id"), 2.0, 8.0))
    return cards.batch_totals(e, ["event_type"], ["user_id", "cost"]).withColumn("cost", F.round("cost", 4))


@query("""with l as (select user_id, event_type, arg_max(value, event_id) as v from events group by all) select user_id, count(*)::int as n, round(max(case when event_type = 'view' then v end), 6) as view from l group by 1""")
def result_records(t):
    e = t("events").select("user_id", F.lit(0).alias("record"), F.col("event_type").alias("attr"), "value", F.col("event_id").alias("order"))
    r = cards.result_records(e, "user_id", "record", "attr", "value")
    return r.select("user_id", F.size("values").alias("n"), F.round(F.element_at("values", F.lit("view")), 6).alias("view"))


@query("""with n as (select distinct substring(p_type, 1, 9) || case when p_partkey % 2 = 0 then ' ' else '.' end || p_size as n from part) select regexp_replace(n, '[^A-Za-z0-9_-]', '_', 'g') as safe, count(distinct n) as names from n group by 1 having count(distinct n) > 1""")
def name_collisions(t):
    return cards.name_collisions(t("part").select(F.concat(F.substring("p_type", 1, 9), F.when(F.col("p_partkey") % 2 == 0, " ").otherwise("."), "p_size").alias("n")), "n")


@query("select coalesce(max(p_size * 7) filter (where p_partkey % 2 = 0), 0)::int + 1 as next from part")
def daily_sequence(t):
    n = F.concat(F.when(F.col("p_partkey") % 2 == 0, "20240102_").otherwise("20240103_"), F.lpad((F.col("p_size") * 7).cast("string"), 4, "0"), F.lit("_x.png"))
    return cards.daily_sequence(t("part").select(n.alias("n")), "n", "20240102")


@query("select c_custkey, case when c_custkey % 4 = 0 then 'new' else c_mktsegment end as project from customer where c_custkey % 3 <> 0 or c_custkey % 4 = 0")
def project_assignment(t):
    c = t("customer").select("c_custkey", F.col("c_mktsegment").alias("project"))
    return cards.upsert(c.where("c_custkey % 3 <> 0"), c.where("c_custkey % 4 = 0").withColumn("project", F.lit("new")), "c_custkey")


@query("select p_partkey as k, array_to_string(list_concat(string_split(p_type, ' '), list_filter(string_split(p_name, ' '), lambda x: not list_contains(string_split(p_type, ' '), x))), '|') as attrs from part where len(list_distinct(string_split(p_type, ' '))) = len(string_split(p_type, ' ')) and len(list_distinct(string_split(p_name, ' '))) = len(string_split(p_name, ' '))")
def header_attributes(t):
    p = t("part").select(F.col("p_partkey").alias("k"), F.split("p_type", " ").alias("a"), F.split("p_name", " ").alias("b"))
    return p.where((F.size(F.array_distinct("a")) == F.size("a")) & (F.size(F.array_distinct("b")) == F.size("b"))).select("k", F.array_join(cards.append_missing(F.col("a"), F.col("b")), "|").alias("attrs"))


# amounts and field rules: texts are written from numbers, and the SQL knows the numbers

DIGITS = "〇一二三四五六七八九"


def _digit(c):
    return F.translate(c.cast("string"), "0123456789", DIGITS)


@query("select k, round(value, 4) as value from (select p_partkey as k, ((1 + p_partkey % 9) * 10000 + (1 + p_size % 9) * 1000 + (1 + p_partkey % 7) * 100 + (1 + p_size % 5) * 10 + (1 + p_partkey % 3))::double + (1 + p_size % 8) / 10.0::double as value from part)")
def amount_values(t):
    d = lambda c, n: _digit(1 + F.col(c) % n)
    text = F.concat(d("p_partkey", 9), F.lit("萬"), d("p_size", 9), F.lit("千"), d("p_partkey", 7), F.lit("百"), d("p_size", 5), F.lit("十"), d("p_partkey", 3), F.lit("兩"), d("p_size", 8), F.lit("錢"))
    return t("part").select(F.col("p_partkey").alias("k"), F.round(A.amount(text), 4).alias("value"))


@query("select p_partkey as k, ((1 + p_size % 9) * 1000)::double as with_rest, null::double as without_rest from part")
def amount_divergence(t):
    text = F.concat(_digit(1 + F.col("p_size") % 9), F.lit("千"))
    return t("part").select(F.col("p_partkey").alias("k"), A.amount(text, True).alias("with_rest"), A.amount(text).alias("without_rest"))


@query("select p_partkey as k, case when p_size % 2 = 0 then 'FIXED' else 'PASS' end as status, case when p_size % 2 = 0 then '江蘇省' || p_brand || '縣' else p_brand || '租界某街' end as value from part")
def address_rule(t):
    text = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("江蘇省"), "p_brand", F.lit("縣天王寺"))).otherwise(F.concat("p_brand", F.lit("租界某街")))
    return t("part").select(F.col("p_partkey").alias("k"), R.simplify_address(text).alias("v")).select("k", "v.*")


@query("select p_partkey as k, case when p_size % 3 = 2 then 'SUSPECT' else 'PASS' end as date, case when p_size % 3 = 0 then 'PASS' when p_size % 3 = 1 then 'FIXED' else 'SUSPECT' end as enum, case when p_size % 3 = 1 then 'A' when p_size % 3 = 0 then 'A' else 'C' end as enum_value from part")
def date_and_enum_rules(t):
    r = F.col("p_size") % 3
    date = R.check_date(F.when(r == 0, "光緒三十年").when(r == 1, "1904").otherwise("某日"))
    kind = R.check_enum(F.when(r == 0, "A").when(r == 1, "a").otherwise("C"), ["A", "B"], {"a": "A", "b": "B"})
    return t("part").select(F.col("p_partkey").alias("k"), date["status"].alias("date"), kind["status"].alias("enum"), kind["value"].alias("enum_value"))


@query("select p_partkey as k, case when p_size % 2 = 0 then 'FIXED' else 'PASS' end as status, replace(replace(p_brand, 'Brand', '品'), 'x', 'y') || case when p_size % 2 = 0 then '官' else '官' end as value from part")
def rule_chain(t):
    text = F.concat(F.replace("p_brand", F.lit("Brand"), F.lit("品")), F.when(F.col("p_size") % 2 == 0, "宫").otherwise("官"))
    chained = R.chain(text, [lambda c: R.normalise_chars(c, ("宫", "官")), R.check_date])
    first = R.chain(text, [lambda c: R.normalise_chars(c, ("宫", "官"))])
    return t("part").select(F.col("p_partkey").alias("k"), first["status"].alias("status"), chained["value"].alias("value"))


@query("select p_partkey as k, case p_size % 3 when 0 then 'PASS' when 1 then 'SUSPECT' else 'PASS' end as status from part")
def title_rule(t):
    text = F.when(F.col("p_size") % 3 == 0, "候選知縣某").when(F.col("p_size") % 3 == 1, "候選知鹽某").otherwise("商人某")
    return t("part").select(F.col("p_partkey").alias("k"), R.check_title(text, ["候選知縣"])["status"].alias("status"))


@query("select p_partkey as k, '某號' || (p_size % 4) as name, '存' as direction, '洋' as currency, ((1 + p_size % 9) * 100)::double as value from part")
def ledger_fields(t):
    text = F.array(F.concat(F.lit("某號"), F.col("p_size") % 4), F.concat(F.lit("存洋"), _digit(1 + F.col("p_size") % 9), F.lit("百兩")))
    f = R.ledger_fields(text)
    return t("part").select(F.col("p_partkey").alias("k"), f["name"].alias("name"), f["direction"].alias("direction"), f["currency"].alias("currency"), f["value"].alias("value"))


# retrieval, review, bands, layout and streams that had no query


@query("""with v as (select p_partkey as k, case p_size % 4 when 0 then '金额最大的一笔' when 1 then '最少的款' when 2 then '最大的府' else '金额' end as q from part) select k, case when q in ('金额最大的一笔') then 'max' when q = '最少的款' then 'min' end as intent from v""")
def amount_intent(t):
    q = F.when(F.col("p_size") % 4 == 0, "金额最大的一笔").when(F.col("p_size") % 4 == 1, "最少的款").when(F.col("p_size") % 4 == 2, "最大的府").otherwise("金额")
    return t("part").select(F.col("p_partkey").alias("k"), retrieval.amount_intent(q).alias("intent"))


@query("select item_id, case when contains(text, 'qu') and not contains(regexp_replace(text, '\\s', '', 'g'), 'zz9') then trim(text) || ' zz9' else trim(text) end as expanded from benchmark")
def query_expansion(t):
    return t("benchmark").select("item_id", retrieval.expand_query(F.col("text"), {"qu": ["zz9"]}).alias("expanded"))


@query("""with b as (select p_brand as key, p_partkey as band_id, p_size / 50.0 as band_rel from part where p_partkey % 4 = 0), l as (select p_brand as key, p_partkey as line_id, p_size / 50.0 + 0.001 as rel from part where p_partkey % 4 = 1)
select key, line_id, band_id, off from (select l.key, l.line_id, b.band_id, round(abs(rel - band_rel), 6) as off, row_number() over (partition by l.key, l.line_id order by abs(rel - band_rel), b.band_id) as r from l join b on l.key = b.key and abs(rel - band_rel) <= 0.03) where r = 1""")
def nearest_bands(t):
    p = t("part").select(F.col("p_brand").alias("key"), "p_partkey", (F.col("p_size") / 50.0).alias("rel"))
    b = p.where("p_partkey % 4 = 0").select("key", F.col("p_partkey").alias("band_id"), F.col("rel").alias("band_rel"))
    return bands.nearest_band(b, p.where("p_partkey % 4 = 1").select("key", F.col("p_partkey").alias("line_id"), (F.col("rel") + 0.001).alias("rel")), "key", 0.03)


@query("""with p as (select p_brand as key, p_size as s from part group by all), o as (select key, s from p where s % 2 = 0), n as (select key, s from p where s % 3 = 0)
select key, change, count(*) as n from (select key, case when (key, s) in (select key, s from o) then 'present' else 'add' end as change from n union all select key, 'stale' from o where (key, s) not in (select key, s from n)) group by all""")
def band_changes(t):
    p = t("part").select(F.col("p_brand").alias("key"), F.col("p_size").alias("band_id"), (F.col("p_size") * 1.0).alias("band_rel")).distinct()
    return bands.band_changes(p.where("band_id % 2 = 0"), p.where("band_id % 3 = 0"), "key", 0.25)


@query("""with e as (select user_id, ts, event_id, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 6 hour then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts range unbounded preceding) as session from e)
select user_id, min(ts)::timestamp as session_start, count(*) as n from s group by user_id, session""")
def event_sessions(t):
    return ingest.session_counts(t("events"), "ts", "user_id", "6 hours").select("user_id", "session_start", "n")
