"""Queries of page kinds, bindings, pools, plans and learned rules over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quireworks.operators import governance as V
from quireworks.plans.catalog import LINES, numbered
from quireworks.plans.catalog_records import BOXES, _boxes
from quireworks.plans.registry import query


@query("select o_orderkey from orders where o_orderstatus not in ('F', 'P')")
def own_page_rows(t):
    mark = F.when(F.col("o_orderstatus") == "F", "prev").when(F.col("o_orderstatus") == "P", "next")
    return V.own_page(t("orders").withColumn("xp", mark), "xp").select("o_orderkey")


@query(LINES + "select doc_id, sum(regexp_matches(line, '[0-9]{2}')::int) >= 2 and sum(regexp_matches(line, 'qu|th')::int) >= 2 as is_ledger from l group by 1")
def ledger_pages(t):
    return V.ledger_pages(numbered(t), "doc_id", "line", "[0-9]{2}", "qu|th")


@query(BOXES + "select p_brand as page, count(*) >= 6 and count(distinct k % 5) >= 4 and median(length(p_name)) <= 11 and median((y2 - y1) / (x2 - x1)) <= 3 as is_table from b group by 1")
def table_pages(t):
    b = _boxes(t).select(F.col("p_brand").alias("page"), (F.col("k") % 5).alias("col_index"), F.length("p_name").alias("chars"), (F.col("b.x2") - F.col("b.x1")).alias("w"), (F.col("b.y2") - F.col("b.y1")).alias("h"))
    return V.table_pages(b, "page", 6, 4, 11)


@query("select p_partkey as page, p_size::double as x1, 40.0::double as x2 from part where p_size < 40")
def legal_zones(t):
    boxes = F.array(F.array(F.col("p_size").cast("double"), F.lit(1.0), F.lit(40.0), F.lit(9.0)), F.array(F.lit(5.0), F.lit(5.0), F.lit(2.0), F.lit(9.0)))
    return V.zones(t("part").select(F.col("p_partkey").alias("page"), boxes.alias("z")), "page", "z").select("page", "zone.x1", "zone.x2")


@query("select event_id, case when user_id >= greatest(0.5 * 100, 20) and value >= 30 then 'rule' when value >= 5 then 'content' else 'sparse' end as state from events where value is not null")
def row_states(t):
    e = t("events").where("value is not null")
    return e.select("event_id", V.row_states(F.col("value"), F.col("user_id"), F.lit(100), 20.0, rule_frac=30.0, content=5.0).alias("state"))


@query("select p_partkey as value_id, case when p_size < 15 then 'head' when p_size < 40 then 'mid' else '' end as role from part")
def region_roles(t):
    p = t("part").select(F.col("p_brand").alias("page"), F.col("p_partkey").alias("value_id"), F.col("p_size").alias("y"), F.lit(50.0).alias("height"))
    regions = p.select("page").distinct().select("page", F.inline(F.array(F.struct(F.lit(0.0).alias("lo"), F.lit(0.3).alias("hi"), F.lit("head").alias("role")), F.struct(F.lit(0.3).alias("lo"), F.lit(0.8).alias("hi"), F.lit("mid").alias("role")))))
    return V.region_roles(p, regions, "page").select("value_id", "role")


@query("select c_custkey, coalesce((select arg_max(o_orderstatus, o_orderkey) from orders where o_custkey = c_custkey), 'unknown') as verdict from customer")
def page_verdicts(t):
    v = t("orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("verdict"), F.col("o_orderkey").alias("ts"))
    return V.with_verdict(t("customer").select("c_custkey"), v, "c_custkey")


@query("select p_partkey as k, case when p_size % 4 = 0 then 'char,enum:公司性质' when p_size % 4 = 1 then 'char,currency' when p_size % 4 = 2 then 'char,address' else 'char' end as rules from part")
def rule_binding(t):
    attr = F.when(F.col("p_size") % 4 == 0, "公司性质").when(F.col("p_size") % 4 == 1, "注册资本").when(F.col("p_size") % 4 == 2, "地址").otherwise("姓名")
    return t("part").select(F.col("p_partkey").alias("k"), F.array_join(V.rule_binding(attr, ["公司性质"]), ",").alias("rules"))


@query("select o_orderkey, case when exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') then 'low' else o_orderpriority end as confidence, exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') as is_flagged from orders")
def rule_flags(t):
    v = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_returnflag") == "R", "SUSPECT").otherwise("PASS").alias("status"))
    return V.flag_suspects(t("orders").select("o_orderkey", F.col("o_orderpriority").alias("confidence")), v, ["o_orderkey"])


@query("select l_orderkey, l_linenumber, l_returnflag from lineitem where l_returnflag = 'R' and l_linestatus = 'F'")
def review_list(t):
    v = t("lineitem").withColumn("status", F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), "SUSPECT").otherwise("PASS"))
    return V.review_list(v, "l_linenumber", "status").select("l_orderkey", "l_linenumber", "l_returnflag")


@query("select o_custkey, substring(sha1(string_agg(o_orderstatus || '|' || o_orderpriority || chr(10), '' order by o_orderkey)), 1, 12) as fingerprint from orders group by 1")
def pool_fingerprints(t):
    return V.pool_fingerprints(t("orders"), "o_custkey", "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query("""with u as (select event_type, event_id from events where event_id % 3 <> 1), k as (select * from (select *, row_number() over (partition by event_type order by event_id desc) as r from u) where r <= 4)
select event_type, event_id, r::int as rank from k order by r, event_type limit 12""")
def merged_pool(t):
    e = t("events").select("event_type", "event_id")
    return V.merge_pools(e.where("event_id % 3 = 0"), e.where("event_id % 3 = 2"), "event_type", "event_id", 4, 12).select("event_type", "event_id", "rank")


@query("with l as (select distinct p_type as text from part where p_size <= 5), c as (select p_name as text, max(p_size) / 50.0 as ratio from part group by 1) select text, 'learned' as source from l union all select text, 'corpus' from c where ratio >= 0.9 and trim(text) <> '' and text not in (select text from l)")
def constants_added(t):
    p = t("part")
    return V.add_constants(p.where("p_size <= 5").select(F.col("p_type").alias("text")).distinct(), p.groupBy(F.col("p_name").alias("text")).agg((F.max("p_size") / 50.0).alias("ratio")))


@query("select p_brand, p_type, round(greatest(coalesce(1.5 * stddev_pop(p_size) / abs(avg(p_size)), 0.01), 0.01), 6) as floor from part group by all")
def deviation_floors(t):
    return V.deviation_floors(t("part"), "p_brand", "p_type", "p_size")


@query("select p_partkey from part where abs(p_size / 50.0 - 0.5) > 0.1")
def bands_revoked(t):
    return V.revoke_bands(t("part").withColumn("rel", F.col("p_size") / 50.0), "p_brand", "rel", 0.5, 0.1).select("p_partkey")


@query("select c_custkey, case when c_nationkey % 2 = 0 then c_nationkey end as cluster, c_nationkey % 2 = 0 as covered from customer")
def plan_lookup(t):
    c = t("customer")
    return V.page_lookup(c.select("c_custkey"), c.where("c_nationkey % 2 = 0").select("c_custkey", F.col("c_nationkey").alias("cluster")), "c_custkey")


@query("""with o as (select o_orderkey as k, o_orderstatus as s from orders where o_orderkey % 3 <> 0), n as (select o_orderkey as k, case when o_orderkey % 5 = 0 then 'X' else o_orderstatus end as s from orders where o_orderkey % 4 <> 0)
select coalesce(o.k, n.k) as k, case when o.k is null then 'added' when n.k is null then 'removed' when o.s = n.s then 'same' else 'changed' end as state from o full join n on o.k = n.k""")
def stale_references(t):
    o = t("orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    return V.stale_references(o.where("k % 3 <> 0"), o.where("k % 4 <> 0").withColumn("s", F.when(F.col("k") % 5 == 0, "X").otherwise(F.col("s"))), "k", "s")


@query("select event_id, case when event_type = 'view' and user_id % 2 = 0 then 'seen' else event_type end as event_type from events")
def reattributed(t):
    e = t("events").select("event_id", "user_id", "event_type")
    names = e.where("event_type = 'view' and user_id % 2 = 0").select("user_id", "event_type").distinct().withColumn("new_attr", F.lit("seen"))
    return V.reattribute(e, names, ["user_id"], "event_type").select("event_id", "event_type")


@query("""with c as (select c_nationkey as k, count(*) as pages from customer where c_nationkey % 3 <> 0 group by 1), p as (select n_nationkey as k, n_name as name from nation where n_nationkey % 4 <> 0)
select coalesce(p.k, c.k) as k, name, coalesce(pages, 0) as pages, case when p.k is null then 'unknown_profile' when pages is null then 'no_gold' else 'has_gold' end as state from p full join c on p.k = c.k""")
def gold_inventory(t):
    c = t("customer").where("c_nationkey % 3 <> 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("pages"))
    return V.inventory(c, t("nation").where("n_nationkey % 4 <> 0").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), "k")


@query("""with b as (select p_brand as page, p_partkey as block_id, p_size::double as cx, p_retailprice as cy, p_type as cluster from part), a as (select page, cluster, avg(cx) as m from b group by page, cluster), h as (select page, cluster, row_number() over (partition by page order by m desc, cluster) - 1 as col_index from a)
select b.page, block_id, col_index::int as col_index, (row_number() over (partition by b.page, b.cluster order by cy, block_id) - 1)::int as row_index from b join h on b.page = h.page and b.cluster = h.cluster""")
def assembled(t):
    b = t("part").select(F.col("p_brand").alias("page"), F.col("p_partkey").alias("block_id"), F.col("p_size").cast("double").alias("cx"), F.col("p_retailprice").alias("cy"), F.col("p_type").alias("cluster"))
    return V.assemble(b, "page")


@query(BOXES + "select p_brand as page, min(x1) as x1, max(y2) as y2, count(*) as n, count(distinct p_type) = 1 as legal from b where k % 2 = 0 group by 1")
def picked_boxes(t):
    lines = _boxes(t).select(F.col("p_brand").alias("page"), F.col("k").alias("line_id"), F.col("b").alias("box"), F.col("p_type").alias("source"))
    return V.picked_box(lines, lines.where("line_id % 2 = 0"), "page").select("page", "box.x1", "box.y2", "n", "legal")


@query(BOXES + "select k, round(y1 + (strpos(p_name, 'e') - 1) * 20.0 / length(p_name), 6) as y1 from b where contains(p_name, 'e')")
def substring_boxes(t):
    s = _boxes(t).select("k", V.substring_box(F.col("b"), F.col("p_name"), F.lit("e")).alias("s"))
    return s.where("s is not null").select("k", F.round("s.y1", 6).alias("y1"))


@query("select p_partkey as k, array_to_string(list_distinct_ordered, '|') as attrs from (select p_partkey, [trim(p_type), trim(p_brand), trim(p_name)] as list_distinct_ordered from part where p_type <> p_brand and p_type <> p_name and p_brand <> p_name)")
def attribute_lists(t):
    p = t("part").where("p_type <> p_brand and p_type <> p_name and p_brand <> p_name")
    return p.select(F.col("p_partkey").alias("k"), F.array_join(V.attribute_list(F.array(F.concat(F.lit(" "), "p_type"), F.lit(""), "p_brand", "p_name", "p_type")), "|").alias("attrs"))


@query("""with n as (select conv_id, string_agg(text, '' order by turn) as t from conversations group by 1) select conv_id, conv_id % 2 = 0 as reuse from n where t is not null and length(regexp_replace(t, '\\s', '', 'g')) > 0""")
def reusable_results(t):
    c = t("conversations").select("conv_id", F.col("turn").alias("line_id"), "text")
    old = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_id", "text"))), lambda r: r["text"]), " ").alias("text"))
    old = old.where("length(regexp_replace(text, '\\\\s', '')) > 0").withColumn("text", F.when(F.col("conv_id") % 2 == 0, F.reverse("text")).otherwise(F.concat("text", F.lit("x"))))
    return V.reusable(old, c, "conv_id", "text")


@query("select o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) as path from orders group by 1")
def newest_paths(t):
    return V.newest_path(t("orders").withColumn("path", F.col("o_orderpriority")), "o_custkey", "path", "o_orderdate", "o_orderkey")


@query("select l_returnflag, count(*) as n, sum((l_discount > 0.05)::int)::bigint as big, sum((l_tax > 0.04)::int)::bigint as taxed from lineitem group by 1")
def state_summary(t):
    li = t("lineitem").withColumns({"big": F.col("l_discount") > 0.05, "taxed": F.col("l_tax") > 0.04})
    return V.state_summary(li, "l_returnflag", ["big", "taxed"])


@query("""with g as (select p_brand as stem, p_type as attr, p_name as v from part), s as (select attr, count(distinct stem) as pages from g group by 1), e as (select attr, v, count(*) as n from g where length(v) > 0 group by all), k as (select attr from g group by 1 having count(distinct v) between 2 and 12),
p as (select attr, substring(v, 1, n::int) as prefix from g, range(2, 5) r(n) where length(v) >= n), c as (select v, count(distinct stem) as pages from g group by 1 having count(distinct stem) = (select count(distinct stem) from g) order by length(v), v limit 6)
select 'skeleton' as kind, attr as key, (row_number() over (order by pages desc, attr))::varchar as value, pages as n from s union all select 'constant', '', v, pages from c
union all select 'example', attr, v, n from (select *, row_number() over (partition by attr order by length(v) desc, n desc, v) as r from e) where r <= 4
union all select 'enum', attr, v, count(*) from g where attr in (select attr from k) group by attr, v union all select 'prefix', attr, prefix, count(*) from p group by attr, prefix having count(*) >= 2""")
def learned_rules(t):
    return V.learned_rules(t("part"), "p_brand", "p_type", "p_name")
