"""Queries of record splits, evaluation, drift and box measures over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireworks.functions import geometry as G
from quireworks.functions import text as T
from quireworks.operators import evaluation as E
from quireworks.operators import groups, records
from quireworks.plans.catalog import LINES, numbered
from quireworks.plans.registry import query

# boxes

BOXES = """with b as (select p_partkey as k, p_brand, p_type, p_name, p_size::double as x1, (p_partkey % 40)::double as y1, (p_size + 10)::double as x2, (p_partkey % 40 + 20)::double as y2 from part) """


def _boxes(t) -> DataFrame:
    b = G.box(F.col("p_size"), F.col("p_partkey") % 40, F.col("p_size") + 10, F.col("p_partkey") % 40 + 20)
    return t("part").select(F.col("p_partkey").alias("k"), "p_brand", "p_type", "p_name", b.alias("b"))


FIXED = lambda: G.box(F.lit(15), F.lit(10), F.lit(35), F.lit(40))


@query(BOXES + "select k, least(x1, 15) as x1, least(y1, 10) as y1, greatest(x2, 35) as x2, greatest(y2, 40) as y2 from b")
def box_union(t):
    return _boxes(t).select("k", G.union(F.array("b", FIXED())).alias("u")).select("k", "u.*")


@query(BOXES + "select k, (x1 + x2) / 2 as cx, (y1 + y2) / 2 as cy, x2 - x1 as w, y2 - y1 as h, length(p_name)::int as chars from b")
def line_metrics(t):
    return _boxes(t).select("k", G.metrics(F.col("b"), F.col("p_name")).alias("m")).select("k", "m.*")


@query(BOXES + "select k, x1 + 2 as x1, least(y1, 30) as y1, x2 as x2, least(y2, 30) as y2 from b where x1 + 2 < x2 and least(y1, 30) < least(y2, 30)")
def clamped_boxes(t):
    c = _boxes(t).select("k", G.clamp(G.box(F.col("b.x2"), F.col("b.y2"), F.col("b.x1") + 2, F.col("b.y1")), F.lit(1000.0), F.lit(30.0)).alias("c"))
    return c.where("c is not null").select("k", "c.*")


@query(BOXES + "select k, format('{:.1f}-{:.1f}', x1, x2) as xs, k::varchar || '-' || (k + 4)::varchar as two, k::varchar || ',' || (k + 1)::varchar || ',' || (k + 2)::varchar as three from b")
def range_texts(t):
    b = _boxes(t)
    return b.select("k", G.range_text(F.array("b.x1", "b.x2")).alias("xs"), G.ids_text(F.array(F.col("k"), F.col("k") + 4)).alias("two"), G.ids_text(F.array(F.col("k"), F.col("k") + 1, F.col("k") + 2)).alias("three"))


@query("""with p as (select p_partkey as k, p_name, length(p_name) as n, [p_size, 1 + p_partkey % 7, 5] as w from part), e as (select k, p_name, n, i, n * w[i] / list_sum(w)::double as x from p, range(1, 4) r(i)),
f as (select *, row_number() over (partition by k order by x - floor(x) desc, i) as r, n - sum(floor(x)) over (partition by k) as rest from e), c as (select k, p_name, i, (floor(x) + case when r <= rest then 1 else 0 end)::bigint as c from f),
s as (select *, coalesce(sum(c) over (partition by k order by i rows between unbounded preceding and 1 preceding), 0)::bigint as pos from c) select k, i::int as part, substring(p_name, pos + 1, c) as text from s""")
def split_by_weights(t):
    w = F.array(F.col("p_size").cast("double"), (1 + F.col("p_partkey") % 7).cast("double"), F.lit(5.0))
    parts = t("part").select(F.col("p_partkey").alias("k"), F.posexplode(G.split_text(F.col("p_name"), w)).alias("part", "text"))
    return parts.withColumn("part", F.col("part") + 1)


@query(BOXES + """, h as (select k, p_name, length(p_name) as n, y2 - y1 as a, 30.0::double as b from b), c as (select *, n * a / (a + b) as xa, n * b / (a + b) as xb from h),
d as (select *, floor(xa)::bigint + case when n - floor(xa) - floor(xb) > 0 and xa - floor(xa) >= xb - floor(xb) then 1 else 0 end as na from c) select k, substring(p_name, 1, na) as head, substring(p_name, na + 1) as tail from d""")
def split_by_heights(t):
    s = _boxes(t).select("k", G.split_by_heights(F.col("p_name"), F.array("b", FIXED())).alias("s"))
    return s.select("k", F.col("s")[0].alias("head"), F.col("s")[1].alias("tail"))


@query(BOXES + "select k, case when y2 - y1 > x2 - x1 and length(p_type) > 0 then round(abs(y2 - y1 - 1.5 * length(p_type)) / (1.5 * length(p_type)), 6) end as err from b")
def char_fit(t):
    return _boxes(t).select("k", F.round(G.char_fit_error(F.col("b"), F.length("p_type"), F.lit(1.5)), 6).alias("err"))


@query(BOXES + "select k, i::int as i, round(x1 + i * (x2 - x1) / length(p_type), 6) as lo, round(x1 + (i + 1) * (x2 - x1) / length(p_type), 6) as hi from b, lateral (select unnest(range(0, length(p_type))) as i)")
def char_mode_boxes(t):
    c = _boxes(t).select("k", F.posexplode(G.char_boxes(F.col("b"), F.col("p_type"))).alias("i", "c"))
    return c.select("k", "i", F.round("c.x1", 6).alias("lo"), F.round("c.x2", 6).alias("hi"))


@query(BOXES + "select k, i::int as i, y1 + 3.0 * i as lo, least(y2, y1 + 3.0 * (i + 1)) as hi from b, lateral (select unnest(range(0, length(p_brand))) as i)")
def column_text_boxes(t):
    c = _boxes(t).select("k", F.posexplode(G.column_boxes(F.col("b"), F.col("p_brand"), F.lit(3.0))).alias("i", "c"))
    return c.select("k", "i", F.col("c.y1").alias("lo"), F.col("c.y2").alias("hi"))


@query("""with recursive h as (select p_brand as b, list((p_size * 7)::double order by p_partkey) as hs, sum(p_size)::bigint as n from part group by 1),
s(b, hs, n, lo, hi, i) as (select b, hs, n, 12.0::double, 160.0::double, 0 from h union all
select b, hs, n, case when many then (lo + hi) / 2 else lo end, case when many then hi else (lo + hi) / 2 end, i + 1 from (select *, list_sum(list_transform(hs, lambda x: greatest(1, round_even(x / ((lo + hi) / 2), 0)::bigint))) > n as many from s where i < 80) q)
select b, round((lo + hi) / 2, 6) as cell from s where i = 80""")
def cell_fit(t):
    p = F.array_sort(F.collect_list(F.struct("p_partkey", (F.col("p_size") * 7).cast("double").alias("h"))))
    g = t("part").groupBy(F.col("p_brand").alias("b")).agg(F.transform(p, lambda x: x["h"]).alias("hs"), F.sum("p_size").alias("n"))
    return g.select("b", F.round(G.fit_cell(F.col("hs"), F.col("n")), 6).alias("cell"))


@query(BOXES + """, z as (select k, p_type, x1, y1, x2, y2, list_filter(range(0, length(p_type)), lambda i: not (case when y2 - y1 >= x2 - x1 then (x1 + x2) / 2 between 10 and 40 and y1 + (i + 0.5) * (y2 - y1) / length(p_type) between 5 and 25 else false end)) as kept from b)
select k, array_to_string(list_transform(kept, lambda i: substring(p_type, i + 1, 1)), '') as text from z""")
def exclusion_zones(t):
    zones = F.array(G.box(F.lit(10), F.lit(5), F.lit(40), F.lit(25)))
    return _boxes(t).select("k", G.outside_zones(F.col("b"), F.col("p_type"), zones).alias("text"))


@query(BOXES + "select p_brand as zone, count(*) as n from b where (x1 + x2) / 2 between 10 and 40 and (y1 + y2) / 2 between 5 and 25 group by 1")
def boxes_in_zones(t):
    zones = F.array(G.box(F.lit(10), F.lit(5), F.lit(40), F.lit(25)))
    m = G.metrics(F.col("b"), F.col("p_type"))
    return _boxes(t).where(G.inside(m["cx"], m["cy"], zones)).groupBy(F.col("p_brand").alias("zone")).agg(F.count("*").alias("n"))


@query(BOXES + """, u as (select k, p_brand, 'box_' || x1::bigint || '_' || y1::bigint || '_' || x2::bigint || '_' || y2::bigint as uid from b), r as (select *, row_number() over (partition by p_brand, uid order by k) as n from u)
select k, case when n = 1 then uid else uid || '__dup' || n end as unique_id from r""")
def unique_uids(t):
    u = _boxes(t).select("k", "p_brand", G.row_uid(F.col("b"), F.col("k")).alias("uid"))
    return groups.unique_ids(u, ["p_brand"], "uid", "k").select("k", "unique_id")


@query(BOXES + "select k, (least(x2, 35) - greatest(x1, 15) >= 0.5 * 10) and abs(x1 + x2 - 50) / 2 <= 0.5 * 20 and 20 <= 1.6 * (x2 - x1) as wide, (x2 >= 18 - 8 and x1 <= 30 + 8) as near from b")
def column_tests(t):
    b = _boxes(t)
    return b.select("k", G.same_column(F.col("b"), FIXED()).alias("wide"), ((F.col("b.x2") >= 18 - 8) & (F.col("b.x1") <= 30 + 8)).alias("near"))


@query("""with m as (select user_id, event_id, value as lo, value + 2 as hi, lag(value) over w as plo, lag(value + 2) over w as phi from events window w as (partition by user_id order by value, value + 2, event_id))
select event_id, sum(case when lo - phi > greatest(1.0, phi - plo) then 1 else 0 end) over (partition by user_id order by lo, hi, event_id rows unbounded preceding)::bigint as "group" from m""")
def contiguous_groups(t):
    e = t("events").select("user_id", "event_id", F.col("value").alias("lo"), (F.col("value") + 2).alias("hi"))
    return groups.contiguous_groups(e, ["user_id"], "lo", "hi", 1.0).select("event_id", "group")


@query("select p_partkey as k, case when p_size / 25.0 < 1 then 'portrait' else 'landscape' end as orientation from part")
def orientation_check(t):
    return t("part").select(F.col("p_partkey").alias("k"), G.orientation(F.col("p_size") / 25.0).alias("orientation"))


# text


@query("select doc_id, translate(regexp_replace(coalesce(text, ''), '\\s', '', 'g'), '務報', '务报') as t from documents")
def locate_form(t):
    return t("documents").select("doc_id", T.normal_locate(F.col("text")).alias("t"))


@query("select page_id, regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]+>', '', 'g'), '\\s+', '', 'g') as t from pages")
def html_plain_text(t):
    return t("pages").select("page_id", T.plain_text(F.col("html")).alias("t"))


@query("""with c as (select conv_id, turn, regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '\\s+', '', 'g') as a, regexp_replace(regexp_replace(case when turn % 3 = 0 then reverse(text) when turn % 3 = 1 then text else substring(text, 2) end, '<[^>]+>', '', 'g'), '\\s+', '', 'g') as b from conversations where text not like '%<%')
select conv_id, turn, length(a)::int as raw, length(b)::int as "out", (length(b) - length(a))::int as delta, a = b as same_order, list_sort(string_split(a, '')) = list_sort(string_split(b, '')) as same_multiset from c""")
def text_loss(t):
    c = t("conversations").where(~F.contains("text", F.lit("<")))
    after = F.when(F.col("turn") % 3 == 0, F.reverse("text")).when(F.col("turn") % 3 == 1, F.col("text")).otherwise(F.expr("substring(text, 2)"))
    return c.select("conv_id", "turn", T.text_loss(F.col("text"), after).alias("l")).select("conv_id", "turn", "l.*")


@query("select doc_id, regexp_replace(text, '(?:token|Licenser?|er)+', '', 'g') as text, len(regexp_extract_all(text, '(?:token|Licenser?|er)+'))::int as removed from documents")
def strip_page_constants(t):
    d = t("documents").select("doc_id", T.strip_constants(F.col("text"), ["token", "License", "er"]).alias("s"))
    return d.select("doc_id", "s.text", F.array_size("s.removed").alias("removed"))


@query("""select p_partkey as k, array_to_string(list_sort(list_distinct(list_concat(range(p_size, p_size + 4), [p_partkey % 60]))), ',') as numbers from part""")
def line_spec(t):
    spec = F.concat(F.col("p_size"), F.lit("-"), F.col("p_size") + 3, F.lit(" ，"), F.col("p_partkey") % 60)
    return t("part").select(F.col("p_partkey").alias("k"), F.array_join(T.line_numbers(spec), ",").alias("numbers"))


@query("""with w as (select p_partkey as k, string_split(p_type, ' ') as o, string_split(p_name, ' ') as n from part)
select k, array_to_string(list_filter(n, lambda x: not list_contains(o, x)), ' ') as added, array_to_string(list_filter(o, lambda x: not list_contains(n, x)), ' ') as removed from w""")
def list_changes(t):
    c = t("part").select(F.col("p_partkey").alias("k"), T.list_changes(F.split("p_type", " "), F.split("p_name", " ")).alias("c"))
    return c.select("k", F.array_join("c.added", " ").alias("added"), F.array_join("c.removed", " ").alias("removed"))


@query("""with w as (select conv_id, list(turn order by turn) as o, list(turn order by length(text), turn) as n from conversations group by 1), m as (select conv_id, list_position(o, x) as f, i as t, x as item from w, lateral (select unnest(n) as x, generate_subscripts(n, 1) as i))
select conv_id, item, f::bigint as "from", t::bigint as "to" from m where f <> t""")
def order_changes(t):
    turns = lambda *o: F.transform(F.array_sort(F.collect_list(F.struct(*o))), lambda x: x["turn"])
    w = t("conversations").select("conv_id", "turn", F.length("text").alias("n")).groupBy("conv_id").agg(turns("turn").alias("o"), turns("n", "turn").alias("p"))
    return w.select("conv_id", F.explode(T.list_changes(F.col("o"), F.col("p"))["moved"]).alias("m")).select("conv_id", "m.item", "m.from", "m.to")


@query("select l_returnflag, l_linestatus, count(*) as n from lineitem where l_returnflag <> l_linestatus and trim(l_returnflag) <> '' group by all")
def usable_corrections(t):
    return t("lineitem").where(T.usable_correction(F.col("l_returnflag"), F.col("l_linestatus"))).groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("""select page_id, substring(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '[<>:"/\\\\|?*]', '', 'g'), '\\s+', ' ', 'g'), '^[ .]+', ''), '[ .]+$', ''), 1, 30) as stem from pages where url is not null and url <> ''
and not regexp_matches(substring(regexp_replace(url, '[<>:"/\\\\|?*]', '', 'g'), 1, 30), '[ .]$')""")
def sanitized_stems(t):
    p = t("pages").where("url is not null and url <> ''").withColumn("c", F.substring(F.regexp_replace("url", r'[<>:"/\\|?*]', ""), 1, 30))
    return p.where(~F.col("c").rlike("[ .]$")).select("page_id", T.sanitize_stem(F.col("url"), 30).alias("stem"))


# records

HAN_FROM, HAN_TO = "0123456789Brand#", "一二三四五六七八九十公司有限商"
HAN = "with h as (select p_partkey as k, translate(p_brand, '0123456789Brand#', '一二三四五六七八九十公司有限商') || case p_partkey % 5 when 0 then '有限' when 1 then 'x' when 2 then '有限公' when 3 then '二十' else '' end as t from part) "


def _han(t) -> DataFrame:
    tail = F.when(F.col("p_partkey") % 5 == 0, "有限").when(F.col("p_partkey") % 5 == 1, "x").when(F.col("p_partkey") % 5 == 2, "有限公").when(F.col("p_partkey") % 5 == 3, "二十").otherwise("")
    return t("part").select(F.col("p_partkey").alias("k"), F.concat(F.translate("p_brand", HAN_FROM, HAN_TO), tail).alias("t"))


@query(HAN + """select k, regexp_matches(t, '有限$|有限公$') and t not in ('有限', '有限公') as tail, length(t) < 2 or not regexp_matches(t, '[一-鿿]') or regexp_matches(regexp_replace(t, '[^一-鿿]', '', 'g'), '^[〇零一二三四五六七八九十百千万萬两兩廿卅]+$') as noise,
length(t) between 2 and 8 and t not in ('公司') and (regexp_matches(t, '有限$|有限公$') or not contains(t, 'x')) as name from h""")
def record_names(t):
    c = F.col("t")
    return _han(t).select("k", records.is_limit_tail(c).alias("tail"), records.is_noise(c).alias("noise"), records.looks_like_record_name(c, F.contains(c, F.lit("x")), ["無"], ["公司"], 8).alias("name"))


SEGMENTS = LINES + """, f as (select doc_id, line_id, line, length(line) between 1 and 24 as nm, length(line) >= 30 as bd, length(line) <= 8 as sx, contains(line, 'a') as op, regexp_matches(line, '[0-9]') as an from l),
g as (select *, coalesce(lead(bd) over w, false) as b1, coalesce(lead(bd, 2) over w, false) as b2, coalesce(lead(sx) over w, false) as s1, row_number() over w as pos from f window w as (partition by doc_id order by line_id)),
h as (select *, nm and not b1 and s1 and b2 as bs, nm and b1 or (nm and not b1 and s1 and b2) as base from g), i as (select *, base or coalesce(lag(bs) over (partition by doc_id order by line_id), false) as bl from h),
j as (select *, op and not bl and b1 and pos > 1 as may from i), k as (select *, max(case when not may then pos end) over w as fr from j window w as (partition by doc_id order by line_id)),
m as (select k.*, (select x.bl from j x where x.doc_id = k.doc_id and x.pos = k.fr) as fb from k), n as (select *, may and (pos - fr + fb::int) % 2 = 1 as forced from m),
o as (select *, base or forced as st, sum((base or forced)::int) over (partition by doc_id order by line_id) as record from n),
p as (select *, record = max(record) over (partition by doc_id) and record > 0 and sum((bd or an or st)::int) over (partition by doc_id order by line_id desc) = 0 as trimmed from o) """


def _segments(t) -> DataFrame:
    n = F.length("line")
    return records.segment_records(numbered(t), "doc_id", "line_id", n.between(1, 24), n >= 30, n <= 8, F.contains("line", F.lit("a")), F.col("line").rlike("[0-9]"))


@query(SEGMENTS + "select doc_id, line_id, record::bigint as record, st as is_start, forced, trimmed from p")
def record_segments(t):
    return _segments(t).select("doc_id", "line_id", "record", "is_start", "forced", "trimmed")


@query(SEGMENTS + """select doc_id, record::bigint as record, case when bool_or(st and forced) then '' else max(case when st then trim(line, ' ') end) end as name, length(string_agg(trim(line, ' '), '' order by line_id))::int as chars,
count(*)::int as n_lines from p where record > 0 and not trimmed group by doc_id, record""")
def record_texts(t):
    r = records.record_texts(_segments(t), "doc_id", "line_id", "line")
    return r.select("doc_id", "record", "name", F.length("text").alias("chars"), "n_lines")


@query("""with c as (select conv_id, turn, text as t from conversations where text is not null), a as (select *, case when regexp_matches(t, '[0-9]+') then length(regexp_extract(t, '^(.*?)[0-9]+', 1, 's')) end as pos from c), b as (select *, case when pos is not null then pos + length(regexp_extract(substring(t, pos + 1), '[0-9]+')) end as hi from a),
d as (select *, coalesce(hi, 0) as cur from b), e as (select *, case when regexp_matches(substring(t, cur + 1), '[xzq]') then cur + length(regexp_extract(substring(t, cur + 1), '^(.*?)[xzq]', 1, 's')) when regexp_matches(t, '[xzq]') and not coalesce(length(regexp_extract(t, '^(.*?)[xzq]', 1, 's')) between pos and hi - 1, false) then length(regexp_extract(t, '^(.*?)[xzq]', 1, 's')) end as w from d),
f as (select *, regexp_extract(substring(t, w + 2), '^(([0-9]+|.)?[^xzq0-9]*)', 1, 's') as rest from e)
select conv_id, turn, case when pos is not null then substring(t, pos + 1, hi - pos) end as number, nullif(trim(substring(substring(t, w + 1, 1) || case when contains(rest, ',') then split_part(rest, ',', 1) else rest end, 1, 80), ' '), '') as word from f""")
def attribute_values(t):
    template = [records.Attribute("number", "[0-9]+", True), records.Attribute("word", "[xzq]")]
    c = t("conversations").where("text is not null")
    v = c.select("conv_id", "turn", records.extract_attributes(F.col("text"), template, [","]).alias("v"))
    return v.select("conv_id", "turn", F.element_at("v", F.lit("number")).alias("number"), F.element_at("v", F.lit("word")).alias("word"))


@query("""with c as (select conv_id, turn, text as t, length(regexp_extract(text, '^(.*?)[xzq]', 1, 's')) as w from conversations where regexp_matches(text, '[xzq]')) select conv_id, turn, nullif(trim(substring(t, w + 1, 1) || substring(regexp_extract(substring(t, w + 2), '^(([0-9]+|.)?[^xzq0-9]*)', 1, 's'), 1, 79), ' '), '') as word from c""")
def attribute_one(t):
    template = [records.Attribute("number", "[0-9]+", True), records.Attribute("word", "[xzq]")]
    c = t("conversations").where("text rlike '[xzq]'")
    return c.select("conv_id", "turn", records.extract_one(F.col("text"), template[1], template).alias("word"))


@query("select conv_id, turn, array_to_string(list_filter(range(0, length(text)), lambda i: substring(text, i + 1, 1) in ('x', 'z')), ',') as bounds, (strpos(text, 'qu') - 1)::int as stop from conversations where contains(text, 'qu')")
def anchor_positions(t):
    c = t("conversations").where(F.contains("text", F.lit("qu")))
    return c.select("conv_id", "turn", F.array_join(records.anchor_bounds(F.col("text"), ["x", "z"]), ",").alias("bounds"), records.stop_position(F.col("text"), F.lit(0), ["qu"]).alias("stop"))


@query("select p_partkey as k, regexp_replace(p_name || '#' || p_size, '^(?s:.{0,40}?)#([0-9])', '\\1') as t from part")
def head_residue(t):
    return t("part").select(F.col("p_partkey").alias("k"), records.strip_head_residue(F.concat("p_name", F.lit("#"), "p_size"), "#", "[0-9]", 40).alias("t"))


@query("""with e as (select event_id, event_type as a, case when value > 50 then '' else event_type end as b, case when value > 20 then null else 'x' end as c from events), f as (select event_id, (case when a <> '' then 1 else 0 end + case when b <> '' then 1 else 0 end + case when c <> '' then 1 else 0 end) / 3 as s from e)
select event_id, case when s >= 0.55 then 'high' when s >= 0.3 then 'medium' else 'low' end as confidence, (3 - round(s * 3))::int as gaps from f""")
def record_confidence(t):
    m = F.create_map(F.lit("a"), F.col("event_type"), F.lit("b"), F.when(F.col("value") > 50, "").otherwise(F.col("event_type")), F.lit("c"), F.when(F.col("value") <= 20, "x"))
    e = t("events").select("event_id", m.alias("m"))
    return e.select("event_id", records.split_confidence(records.fill_share(F.col("m"), ["a", "b", "c"])).alias("confidence"), records.gap_count(F.col("m"), ["a", "b", "c"]).alias("gaps"))


@query(None)
def maximal_strings(t):
    """Maximal strings of each benchmark item's words, of the 3-grams that a third of the items have."""
    words = t("benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("pos", "w"))
    grams = words.select("item_id", "pos", F.explode(F.array_distinct(T.grams(F.col("w"), 3))).alias("g"))
    often = grams.groupBy("g").agg(F.count_distinct("item_id").alias("n")).join(t("benchmark").agg(F.count("*").alias("all"))).where("3 * n >= all").select("g")
    return records.maximal_strings(grams.join(often, "g", "left_semi"), ["item_id", "pos"], "g", 12)


# evaluation


@query("with q as (select p_brand as page, count(*) as n, count(distinct p_type) as k from part where p_size <= 10 group by 1) select page, case when n <= 0 then 'empty' when n < 8 or k < 2 then 'thin' else 'ok' end as quality from q")
def gold_quality(t):
    q = t("part").where("p_size <= 10").groupBy(F.col("p_brand").alias("page")).agg(F.count("*").alias("n"), F.count_distinct("p_type").alias("k"))
    return q.select("page", E.gold_quality(F.col("n"), F.col("k")).alias("quality"))


@query("""with f as (select p_brand, count(*) as n from part group by 1), p as (select p_brand from f order by n desc, p_brand limit 1)
select p_partkey as k, case when split_part(p_type, ' ', 1) not in ('STANDARD', 'SMALL', 'ECONOMY', 'PROMO') then 'kind_not_structural' when p_partkey % 5 < 2 then 'too_few_pages' when p_size / 50.0 < 0.6 then 'low_support' when (p_partkey % 40) / 1000.0 > 0.02 then 'unstable_spread' when p_partkey % 3 >= p_partkey % 5 then 'weak_evidence' else 'accept' end as verdict
from part where p_brand in (select p_brand from p)""")
def backfill_candidates(t):
    p = t("part")
    families = p.groupBy(F.col("p_brand").alias("family")).agg(F.count("*").alias("n_pages"))
    bands = p.select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("family"), F.split("p_type", " ")[0].alias("kind"), (F.col("p_partkey") % 5).alias("pages_hit"), (F.col("p_size") / 50.0).alias("support"), ((F.col("p_partkey") % 40) / 1000.0).alias("spread"), (F.col("p_partkey") % 3).alias("weak"))
    return E.backfill_candidates(bands, families, ["STANDARD", "SMALL", "ECONOMY", "PROMO"]).select("k", "verdict")


PREDICTED = BOXES + """, g as (select p_brand as page, k % 10 as record, p_type as attr, p_type as text, * from b), p as (select p_brand as page, k % 10 as record, p_type as attr, p_type as text, x1 + k % 8 as x1, y1, x2 + k % 8 as x2, y2 from b where k % 2 = 0),
j as (select g.attr, g.k, greatest(0, least(g.x2, p.x2) - greatest(g.x1, p.x1)) * greatest(0, least(g.y2, p.y2) - greatest(g.y1, p.y1)) as i, (g.x2 - g.x1) * (g.y2 - g.y1) + (p.x2 - p.x1) * (p.y2 - p.y1) as s from g join p on g.page = p.page and g.attr = p.attr and MEET) """


def _gold_and_predicted(t) -> tuple[DataFrame, DataFrame]:
    b = _boxes(t)
    gold = b.select(F.col("p_brand").alias("page"), F.col("k").alias("gold_id"), (F.col("k") % 10).alias("record"), F.col("p_type").alias("attr"), F.col("p_type").alias("text"), F.col("b").alias("box"))
    moved = G.box(F.col("box.x1") + F.col("gold_id") % 8, F.col("box.y1"), F.col("box.x2") + F.col("gold_id") % 8, F.col("box.y2"))
    return gold, gold.where("gold_id % 2 = 0").withColumn("box", moved)


@query(PREDICTED.replace("MEET", "g.record = p.record") + "select count(*) as n, sum((i / (s - i) >= 0.5)::int)::bigint as hit, round(sum((i / (s - i) >= 0.5)::int) / count(*), 4) as ratio from j")
def record_aligned(t):
    return E.record_aligned(*_gold_and_predicted(t))


@query(PREDICTED.replace("MEET", "true") + ", m as (select k, max(i / (s - i)) as best from j group by 1) select g.attr, count(*) as gold, sum((m.k is not null)::int)::bigint as found, sum((coalesce(best, 0) >= 0.5)::int)::bigint as hit from g left join m on g.k = m.k group by g.attr")
def value_readings(t):
    return E.value_readings(*_gold_and_predicted(t))


@query("""with v as (select p_brand, 'p_size' as feature, p_size::double as v from part union all select p_brand, 'p_retailprice', p_retailprice from part)
select p_brand, feature, round(avg(v), 4) as mean, round(case when count(*) > 1 then stddev_pop(v) end, 4) as sd, min(v) as lo, max(v) as hi, count(*) as n from v group by all""")
def feature_summary(t):
    s = E.feature_summary(t("part"), ["p_size", "p_retailprice"], ["p_brand"])
    return s.withColumn("mean", F.round("mean", 4)).withColumn("sd", F.round("sd", 4))


@query("""with v as (select p_partkey as variant, p_size / 25.0 as aspect, p_retailprice as price from part where p_partkey <= 5), p as (select p_partkey as page, p_size / 25.0 as aspect, p_retailprice as price from part),
h as (select page, variant from p join v on abs(p.aspect - v.aspect) <= 3 * abs(v.aspect) * 0.15 and abs(p.price - v.price) <= 3 * abs(v.price) * 0.15 and (p.aspect < 1) = (v.aspect < 1)) select page, min(variant) as variant, 2::int as n_checks from h group by page""")
def variant_match(t):
    f = t("part").select("p_partkey", (F.col("p_size") / 25.0).alias("aspect"), F.col("p_retailprice").alias("price"))
    return E.match_variants(f.withColumnRenamed("p_partkey", "page"), f.where("p_partkey <= 5").withColumnRenamed("p_partkey", "variant"), ["aspect", "price"])


@query("""with a as (select p_brand, p_type as attr, avg(p_size) as m, count(*) as n from part group by all having count(*) >= 2) select p_brand, attr, round(m, 4) as mean_top, n from (select *, row_number() over (partition by p_brand order by m, n desc, attr) as r from a) where r = 1""")
def anchor_pick(t):
    return E.pick_anchor(t("part").select("p_brand", F.col("p_type").alias("attr"), F.col("p_size").alias("top")), ["p_brand"]).withColumn("mean_top", F.round("mean_top", 4))


@query("with f as (select user_id, arg_min(event_type, event_id) as attr from events group by 1) select attr, count(*) as pages from f group by 1 order by pages desc, attr limit 1")
def anchor_mode(t):
    return E.anchor_mode(t("events"), "user_id", "event_id", "event_type").withColumnRenamed("event_type", "attr")


@query("""with r as (select event_type, value, row_number() over (partition by event_type order by value) as r, count(*) over (partition by event_type) as n from events)
select event_type, round(median(value), 2) as median, round(max(case when r = greatest(0, floor(n * 0.25) - 1) + 1 then value end), 2) as p25, round(max(case when r = least(n - 1, floor(n * 0.75)) + 1 then value end), 2) as p75, count(*) as n from r group by 1""")
def offset_prior(t):
    return E.offset_prior(t("events"), "event_type", "value")


@query("select trim(p_name) as value, count(*) as n from part where regexp_matches(p_type, 'ECON|PRO') and trim(p_name) <> '' group by 1")
def title_candidates(t):
    return E.title_candidates(t("part"), "p_type", "p_name", "ECON|PRO")


@query("select kind, count(*) as n from (select case when p_size % 4 = 0 then 'cross_page' when p_size % 4 = 1 then 'exclude_masthead' when p_size % 4 = 2 then 'attr_hint' else '' end as kind from part) group by 1")
def note_rules(t):
    n = t("part").select(F.when(F.col("p_size") % 4 == 0, "此条跨頁").when(F.col("p_size") % 4 == 1, "報名不要").otherwise("看不清").alias("note"), F.when(F.col("p_size") % 4 == 2, "姓名").otherwise(" ").alias("hint"))
    return E.note_rules(n, "note", "hint")


@query("""with p as (select p_brand as page, 60.0 as height from part group by 1), b as (select p_brand as page, p_size::double as foot, p_partkey as k from part where p_size % 7 = 0), c as (select page, count(b.k) as n from p left join b using (page) group by 1), m as (select n, count(*) as k from c group by 1),
r as (select *, row_number() over (partition by page order by foot desc, k desc) as r from b) select (select count(*) from p) as n_pages, (select n from m order by k desc, n limit 1) as mode_bands, (select round(stddev_pop(round(foot / 60.0, 3)), 4) from r where r > 1) as boundary_sd, (select min(round(p_size / 3.0, 1)) from part) as least_gap""")
def cross_page_stability(t):
    p = t("part")
    pages = p.select(F.col("p_brand").alias("page"), F.lit(60.0).alias("height")).distinct()
    return E.cross_page(pages, p.where("p_size % 7 = 0").select(F.col("p_brand").alias("page"), F.col("p_size").cast("double").alias("foot")), p.select(F.col("p_brand").alias("page"), (F.col("p_size") / 3.0).alias("gap")))


@query("select 'o_orderstatus' as column, o_orderstatus as value, count(*) as n from orders group by 2 union all select 'o_orderpriority', o_orderpriority, count(*) from orders group by 2")
def draft_stats(t):
    return E.draft_stats(t("orders"), ["o_orderstatus", "o_orderpriority"])


@query("""with e as (select c_custkey % 50 as page, o_orderstatus = 'F' as high, o_orderstatus = 'O' as acc, o_totalprice > 100000 as ed from orders join customer on o_custkey = c_custkey), t as (select page, count(*) as items, sum(high::int) as h, sum(acc::int) as a, sum((acc and ed)::int) as d from e group by 1),
u as (select *, case when a > 0 then d / a else 0 end as rate from t), v as (select *, (1 - rate) + rate * 2 as per from u), w as (select *, items * per as e1, (h > 0)::int + (items - h) * per as e2 from v)
select page, items, h::bigint as high, items * 4 as manual_ops, round(e1, 2) as each_ops, round(e2, 2) as batch_ops, round((items * 4 - e1) / (items * 4), 4) as drop_each, round((items * 4 - e2) / (items * 4), 4) as drop_batch from w""")
def operation_estimate(t):
    e = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select((F.col("c_custkey") % 50).alias("page"), F.when(F.col("o_orderstatus") == "F", "high").otherwise("low").alias("confidence"), (F.col("o_orderstatus") == "O").alias("accepted"), (F.col("o_totalprice") > 100000).alias("edited"))
    return E.operations(e, ["page"])


TRIAGED = "with v as (select c_custkey as page, case when c_acctbal < 0 then 'suspect' when c_mktsegment = 'BUILDING' then 'unmeasurable' else 'ok' end as verdict from customer) "


def _triaged(t) -> DataFrame:
    return t("customer").select(F.col("c_custkey").alias("page"), F.when(F.col("c_acctbal") < 0, "suspect").when(F.col("c_mktsegment") == "BUILDING", "unmeasurable").otherwise("ok").alias("verdict"))


@query(TRIAGED + "select sum((verdict = 'ok')::int)::bigint as n_ok, sum((verdict = 'suspect')::int)::bigint as n_suspect, sum((verdict = 'unmeasurable')::int)::bigint as n_unmeasurable, sum((verdict = 'suspect')::int) > 0 as blocked from v")
def preflight_gate(t):
    return E.preflight(_triaged(t))


@query(TRIAGED + "select page from v where verdict <> 'suspect'")
def pages_let_through(t):
    return E.not_suspect(_triaged(t))


@query("""with f as (select p_partkey as page, p_type as pub, p_size::double as a, p_retailprice as b, (p_partkey % 17)::double as c from part), m as (select pub, avg(a) as am, stddev_pop(a) as asd, avg(b) as bm, stddev_pop(b) as bsd, avg(c) as cm, stddev_pop(c) as csd from f where a < 12 group by 1),
g as (select page, (abs(a - am) <= 3 * greatest(asd, abs(am) * 0.15))::int + (abs(b - bm) <= 3 * greatest(bsd, abs(bm) * 0.15))::int + (abs(c - cm) <= 3 * greatest(csd, abs(cm) * 0.15))::int as good from f join m using (pub))
select page, 3::bigint as n, round(good / 3, 4) as share, case when good / 3 < 0.75 then 'drift' else 'ok' end as verdict from g""")
def drift_scan(t):
    names = ["a", "b", "c"]
    f = t("part").select(F.col("p_partkey").alias("page"), F.col("p_type").alias("pub"), F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"), (F.col("p_partkey") % 17).cast("double").alias("c"))
    return E.drift_scan(f, E.feature_summary(f.where("a < 12"), names, ["pub"]), "pub", names)


@query(TRIAGED + "select page from v where verdict = 'suspect' and page % 3 <> 0")
def suspended_pages(t):
    v = _triaged(t).withColumn("verdict", F.when(F.col("verdict") == "suspect", "drift").otherwise(F.col("verdict")))
    return E.suspended(v, v.where("page % 3 = 0"))


@query("select n_name || '_' || lpad((c_custkey % 10000)::varchar, 4, '0') as name from customer join nation on c_nationkey = n_nationkey where n_name = 'NATION_1'")
def publication_pages(t):
    n = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat("n_name", F.lit("_"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")).alias("name"))
    return E.publication_pages(n, "name", "NATION_1")


@query("""with e as (select user_id, event_id, list_position(['signup', 'view', 'click', 'purchase'], event_type) as p from events), n as (select *, lead(p) over (partition by user_id order by event_id) as nx from e where p > 0),
g as (select user_id, round(count(distinct p) / 4, 4) as coverage, round(avg((nx >= p)::int), 4) as monotone from n group by 1) select u.user_id, coalesce(coverage, 0) as coverage, monotone from (select distinct user_id from events) u left join g using (user_id)""")
def contract_score(t):
    return E.contract_score(t("events"), "user_id", "event_id", "event_type", ["signup", "view", "click", "purchase"])


@query("select p_partkey as k, case when p_size > 25 then 1.0 when p_size > 10 then 0.5 else 0.0 end as sim from part")
def line_similarity(t):
    a = F.array(F.lit(0.1), F.lit(0.5))
    b = F.when(F.col("p_size") > 25, F.array(F.lit(0.101), F.lit(0.499))).when(F.col("p_size") > 10, F.array(F.lit(0.104), F.lit(0.098))).otherwise(F.array(F.lit(0.3)))
    return t("part").select(F.col("p_partkey").alias("k"), E.line_similarity(a, b).alias("sim"))


# rows that meet


@query("""with l as (select conv_id, turn as line_id, text as line from conversations), j as (select conv_id, line_id, n, t from (select *, 2 as n, line || lead(line) over w as t from l window w as (partition by conv_id order by line_id) union all select *, 3, line || lead(line) over w || lead(line, 2) over w from l window w as (partition by conv_id order by line_id)) where t is not null),
v as (select conv_id, turn as value_id, right(text, 6) || left(nx, 6) as value from (select *, lead(text) over (partition by conv_id order by turn) as nx from conversations) where nx is not null)
select conv_id, value_id, line_id, n_lines from (select v.conv_id, v.value_id, j.line_id, j.n::int as n_lines, row_number() over (partition by v.conv_id, v.value_id order by j.line_id, j.n) as r from v join j on v.conv_id = j.conv_id and contains(j.t, v.value) and length(v.value) > 0) where r = 1""")
def value_spans(t):
    from pyspark.sql import Window

    c = t("conversations")
    nx = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    values = c.select("conv_id", F.col("turn").alias("value_id"), F.concat(F.right("text", F.lit(6)), F.left(nx, F.lit(6))).alias("value")).where("value is not null")
    return groups.locate_spans(values, c.select("conv_id", F.col("turn").alias("line_id"), F.col("text").alias("line")), "conv_id", 3)


@query("""with d as (select p_brand as page, p_partkey as draft_id, case when p_size % 5 = 0 then '' else 'u' || (p_size % 9) end as uid, row_number() over (partition by p_brand order by p_partkey) - 1 as idx from part),
r as (select page, draft_id as row_id, 'u' || (draft_id % 11) as uid, (idx + 1) as idx from d), u as (select page, uid, arg_min(draft_id, idx) as x from d where uid <> '' group by all), i as (select page, idx, min(draft_id) as x from d group by all)
select r.page, r.row_id, coalesce(u.x, i.x) as draft_id from r left join u on r.page = u.page and r.uid = u.uid left join i on r.page = i.page and r.idx = i.idx where coalesce(u.x, i.x) is not null""")
def reference_match(t):
    from pyspark.sql import Window

    d = t("part").select(F.col("p_brand").alias("page"), F.col("p_partkey").alias("draft_id"), F.when(F.col("p_size") % 5 == 0, "").otherwise(F.concat(F.lit("u"), F.col("p_size") % 9)).alias("uid"), (F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1).alias("idx"))
    return groups.reference_match(d.select("page", F.col("draft_id").alias("row_id"), F.concat(F.lit("u"), F.col("draft_id") % 11).alias("uid"), (F.col("idx") + 1).alias("idx")), d, "page").where("draft_id is not null")


@query("""with a as (select o_custkey as k, o_orderstatus as s, o_orderpriority as p, row_number() over (partition by o_custkey order by o_orderkey) as n from orders where o_orderkey % 3 <> 0), b as (select o_custkey as k, o_orderstatus as s, o_orderpriority as p, row_number() over (partition by o_custkey order by o_orderkey) as n from orders where o_orderkey % 4 <> 0)
select k, position::int as position, kind as "column" from (select coalesce(a.k, b.k) as k, coalesce(a.n, b.n) as position, unnest(list_filter([case when a.k is null or b.k is null then 'count' end, case when a.s <> b.s then 's' end, case when a.p <> b.p then 'p' end], lambda x: x is not null)) as kind from a full join b on a.k = b.k and a.n = b.n)""")
def row_reconcile(t):
    o = t("orders").select(F.col("o_custkey").alias("k"), "o_orderkey", F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"))
    return groups.positional_differences(o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 4 <> 0"), "k", "o_orderkey", ["s", "p"])


@query("select o_orderkey, exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') as is_live from orders")
def live_rows(t):
    rows = t("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return groups.live_rows(t("orders").select("o_orderkey"), rows, ["o_orderkey"])


@query("with r as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as number from events) select user_id, event_id from r where number not in (1, 3) or user_id % 2 = 1")
def rows_removed(t):
    e = t("events").select("user_id", "event_id")
    numbers = e.where("user_id % 2 = 0").select("user_id").distinct().select("user_id", F.explode(F.array(F.lit(1), F.lit(3))).alias("number"))
    return groups.drop_numbered(e, "user_id", "event_id", numbers).select("user_id", "event_id")
