"""Queries over the driver's tables, one for each operator or family, and the SQL that states their results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireworks.functions import geometry as G
from quireworks.functions import rules as R
from quireworks.functions import text as T
from quireworks.operators import checks, corpus, drafts, groups, learning, lines, quotes, retrieval, review
from quireworks.plans import bands
from quireworks.plans.registry import query
from quireworks.sources import pages as page_source

LINES = """with raw as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_id from documents where text is not null),
l as (select doc_id, line, line_id, (line_id // 12)::int as col_index, line_id % 12 as row_index from raw) """


def numbered(t) -> DataFrame:
    return lines.number_lines(lines.page_lines(t("documents")))


# lines, columns, pages


@query(LINES + "select doc_id, line_id, line_id + 1 as xlsx_id, col_index, row_index, line from l")
def lines_number(t):
    return numbered(t).select("doc_id", "line_id", "xlsx_id", "col_index", "row_index", "line")


@query(LINES + """select doc_id, col_index, count(*) as line_count, sum(length(line))::bigint as char_count, min(line_id) as first_id, max(line_id) as last_id,
arg_min(line, line_id) as first_text, substring(string_agg(line, '' order by line_id), 1, 200) as preview from l group by doc_id, col_index""")
def sections_agg(t):
    return lines.sections(numbered(t))


@query(LINES + "select doc_id, count(*) as total_lines, count(distinct col_index) as total_columns, sum(length(line))::bigint as total_chars from l group by doc_id")
def page_totals(t):
    return lines.page_totals(numbered(t))


CLASS = LINES + """, s as (select doc_id, count(*) as n, avg(length(line)) as avg_len, avg(case when length(line) <= 3 then 1 else 0 end) as short_ratio from l group by doc_id) """


@query(CLASS + """select doc_id, n, round(avg_len, 4) as avg_len, round(short_ratio, 4) as short_ratio, case when n >= 30 and avg_len <= 4 then 'roster'
when n >= 15 and avg_len <= 6 and short_ratio >= 0.5 then 'roster' when n >= 8 and avg_len >= 8 then 'prose' else 'ambiguous' end as content_class from s""")
def content_class(t):
    c = lines.content_class(lines.line_stats(numbered(t)))
    return c.select("doc_id", "n", F.round("avg_len", 4).alias("avg_len"), F.round("short_ratio", 4).alias("short_ratio"), "content_class")


@query(LINES + """select doc_id, line_id, coalesce(sum(length(line)) over (partition by doc_id order by line_id rows between unbounded preceding and 1 preceding), 0)::bigint as first_char from l""")
def line_offsets(t):
    return lines.line_offsets(numbered(t)).select("doc_id", "line_id", "first_char")


@query(LINES + "select doc_id, sha1(string_agg(line, chr(31) order by line_id)) as fingerprint from l group by doc_id")
def page_fingerprint(t):
    return lines.fingerprint(numbered(t))


@query(LINES + "select doc_id, (line_id // 12)::int as chunk, count(*) as n from l group by all")
def line_chunks(t):
    return lines.chunks(numbered(t)).groupBy("doc_id", "chunk").agg(F.count("*").alias("n"))


# the corpus in numbers

PUNCT = "'[!-/:-@\\[-`{-~，。、；：？！「」『』（）《》〈〉…—·・“”‘’【】〔〕～－＋＝＜＞／＼｜]'"


@query(LINES + f""", n as (select doc_id, regexp_replace(regexp_replace(line, '\\s', '', 'g'), {PUNCT}, '', 'g') as text from l)
select text, count(distinct doc_id) as pages_hit, round(count(distinct doc_id) / (select count(distinct doc_id) from l), 4) as ratio from n where length(text) between 2 and 30 group by text""")
def const_exact_df(t):
    return corpus.exact_constants(numbered(t))


@query("""with g as (select distinct conv_id, substring(text, i::int, n::int) as gram from conversations, range(3, 7) r(n), lateral (select unnest(range(1, length(text) - n + 2)) as i) where length(text) >= n)
select gram, count(distinct conv_id) as pages_hit from g group by gram having count(distinct conv_id) >= 0.2 * (select count(distinct conv_id) from conversations)""")
def ngram_df(t):
    return corpus.gram_frequency(t("conversations"), "conv_id", "text", least_ratio=0.2)


@query(None)
def ngram_df_documents(t):
    """As ngram_df, over the whole of the documents."""
    return corpus.gram_frequency(t("documents"), "doc_id", "text", least_ratio=0.2)


SHAPE = """case when regexp_matches(trim(line), '光緒|光绪|宣統|宣统|康熙|乾隆|嘉慶|嘉庆|道光|咸豐|咸丰|同治|順治|顺治|雍正|民國|民国|明治|大正|昭和') and regexp_matches(line, '[年月日]') then 'dateish'
when regexp_matches(line, '[0-9零一二三四五六七八九十百千两兩]') and regexp_matches(line, '[元圓圆两兩万萬千股]') then 'money'
when length(trim(line)) <= 6 then 'short' when length(trim(line)) >= 12 then 'body' else 'other' end"""


@query(LINES + f"select {SHAPE} as shape, count(*) as n, round(count(*) / (select count(*) from l where trim(line) <> ''), 4) as share from l where trim(line) <> '' group by 1")
def line_shape_share(t):
    return corpus.shape_share(numbered(t))


@query(LINES + "select quantile_cont(length(line), 0.5)::double as len_median, quantile_cont(length(line), 0.9)::double as len_p90, min(length(line))::int as len_min, max(length(line))::int as len_max from l")
def line_len_percentiles(t):
    return corpus.length_percentiles(numbered(t))


@query(LINES + """, f as (select doc_id, count(*) as lines, quantile_cont(length(line), 0.5)::double as len_median from l where trim(line) <> '' group by doc_id),
a as (select d.doc_id, coalesce(f.lines, 0) as lines, f.len_median from (select distinct doc_id from documents) d left join f using (doc_id)),
m as (select quantile_cont(lines, 0.5) as lm from a), p as (select quantile_cont(length(line), 0.9) as p90 from l where trim(line) <> '')
select doc_id, lines, round(len_median, 2) as len_median, concat_ws(',', case when lines = 0 then 'empty' end, case when lines > 0 and lines < lm * 0.4 then 'thin' end, case when len_median > p90 * 1.5 then 'outlier_len' end) as flags from a, m, p""")
def page_qa_flags(t):
    return corpus.page_flags(t("documents"), numbered(t))


# retrieval: benchmark items ask, documents answer


def _asked(t) -> DataFrame:
    return t("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _cards(t) -> DataFrame:
    return t("documents").select(F.col("doc_id").alias("card_id"), "text", F.col("doc_id").alias("ord"))


RPUNCT = """'[，。！？、；：·　"''“”‘’《》（）()【】\\[\\]\\\\/!?;]'"""
TOKENS = f"""with norm_d as (select doc_id as card_id, regexp_replace(regexp_replace(coalesce(text, ''), '\\s+', '', 'g'), {RPUNCT}, '', 'g') as t from documents),
norm_q as (select item_id as query_id, regexp_replace(regexp_replace(coalesce(text, ''), '\\s+', '', 'g'), {RPUNCT}, '', 'g') as t from benchmark),
toks_d as (select card_id, unnest(list_concat(list_transform(range(1, length(t)), lambda i: substring(t, i::int, 2)), regexp_extract_all(t, '[a-zA-Z0-9]+(?:\\.[a-zA-Z0-9]+)*'))) as term from norm_d),
toks_q as (select query_id, unnest(list_concat(list_transform(range(1, length(t)), lambda i: substring(t, i::int, 2)), regexp_extract_all(t, '[a-zA-Z0-9]+(?:\\.[a-zA-Z0-9]+)*'))) as term from norm_q),
tf as (select card_id, term, count(*) as tf from toks_d group by all), dl as (select card_id, sum(tf) as dl from tf group by all),
df as (select term, count(*) as df from tf group by all), nn as (select count(*) as n_docs from documents),
av as (select sum(dl) / (select n_docs from nn) as avgdl from dl), q as (select query_id, term, count(*) as qtf from toks_q group by all),
b as (select query_id, card_id, sum(qtf * greatest(0.0, (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / greatest(1e-9, tf + 1.5 * (0.25 + 0.75 * dl / greatest(1, avgdl)))) as raw
 from q join tf using (term) join df using (term) join dl using (card_id), nn, av group by all),
br as (select *, row_number() over (partition by query_id order by round(raw, 9) desc, card_id) as rank from b where raw > 0),
idf as (select term, 1 + ln((n_docs + 1) / (df + 1)) as idf from df, nn),
w as (select card_id, term, tf / dl * idf as w from tf join dl using (card_id) join idf using (term)),
nm as (select card_id, sqrt(sum(w * w)) as norm from w group by all),
qt as (select query_id, sum(qtf) as q_total from q group by all),
qw as (select query_id, term, qtf / q_total * idf as qw from q join qt using (query_id) join idf using (term)),
qn as (select query_id, sqrt(sum(qw * qw)) as qnorm from qw group by all),
c as (select query_id, card_id, sum(w * qw) / (any_value(norm) * any_value(qnorm)) as raw from qw join w using (term) join nm using (card_id) join qn using (query_id) group by all),
cr as (select *, row_number() over (partition by query_id order by round(raw, 9) desc, card_id) as rank from c where raw > 0) """


@query(TOKENS + "select query_id, rank::int as rank, card_id, round(raw, 4) as score from br where rank <= 5")
def bm25_topk(t):
    return retrieval.bm25(_asked(t), _cards(t))


@query(TOKENS + "select query_id, rank::int as rank, card_id, round(raw, 4) as score from cr where rank <= 5")
def tfidf_topk(t):
    return retrieval.tfidf(_asked(t), _cards(t))


HYBRID = TOKENS + """, x as (select coalesce(a.query_id, k.query_id) as query_id, coalesce(a.card_id, k.card_id) as card_id, coalesce(round(a.raw, 4), 0) as bm25_score, coalesce(round(k.raw, 4), 0) as tfidf_score, a.rank as at_a, k.rank as at_b
 from (select * from br where rank <= 15) a full join (select * from cr where rank <= 15) k on a.query_id = k.query_id and a.card_id = k.card_id),
y as (select *, min(bm25_score) over (partition by query_id) as lo, max(bm25_score) over (partition by query_id) as hi from x),
z as (select *, 0.5 * case when hi > lo then (bm25_score - lo) / (hi - lo) else 0 end + 0.5 * tfidf_score as raw from y),
h as (select *, row_number() over (partition by query_id order by round(raw, 9) desc, at_a nulls last, at_b) as rank from z) """


@query(HYBRID + "select query_id, rank::int as rank, card_id, round(raw + 1e-9, 4) as score, bm25_score, tfidf_score from h where rank <= 5 and raw > 0")
def hybrid_topk(t):
    return retrieval.hybrid(_asked(t), _cards(t)).drop("ord")


@query(HYBRID + """select b.item_id as query_id, case when h.tfidf_score >= 0.06 then 'unit' else 'refused' end as route from benchmark b left join (select * from h where rank = 1 and raw > 0) h on h.query_id = b.item_id""")
def search_route(t):
    return retrieval.route(_asked(t), retrieval.hybrid(_asked(t), _cards(t)))


BARE = f"regexp_replace(regexp_replace(coalesce(%s, ''), '\\s+', '', 'g'), {RPUNCT}, '', 'g')"


@query(f"""with q as (select item_id as query_id, {BARE % "text"} as q from benchmark), v as (select doc_id as card_id, {BARE % "v"} as v from (select doc_id, unnest([lang, source]) as v from documents))
select query_id, card_id, least(count(*), 3) * 0.35 as boost from q join v on length(v) >= 2 and contains(q, v) group by all""")
def field_boost(t):
    fields = t("documents").select(F.col("doc_id").alias("card_id"), F.explode(F.array("lang", "source")).alias("value"))
    return retrieval.field_boost(_asked(t), fields)


@query("""with s as (select q.vec_id as query_id, c.vec_id, list_cosine_similarity(q.embedding::double[], c.embedding::double[]) as sim from embeddings q join embeddings c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by round(sim, 9) desc, vec_id)::int as rank from s) select query_id, rank, vec_id, round(sim, 6) as sim from r where rank <= 5""")
def dense_topk(t):
    e = t("embeddings").select("vec_id", "embedding")
    return retrieval.dense_top_k(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), e)


@query(f"""with q as (select item_id as quote_id, {BARE % "text"} as q from benchmark), d as (select doc_id as card_id, {BARE % "text"} as t from documents)
select distinct quote_id, card_id from q join d on length(q) > 0 and contains(t, q)""")
def quote_exact(t):
    return quotes.exact_quotes(t("benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote")), _cards(t))


@query("select o_orderkey as card_id, o_totalprice as amount from orders order by o_totalprice desc, o_orderkey limit 5")
def amount_topk_max(t):
    return retrieval.amount_top_k(t("orders").select(F.col("o_orderkey").alias("card_id"), F.col("o_totalprice").alias("amount")), "max")


@query("select o_orderkey as card_id, o_totalprice as amount from orders order by o_totalprice, o_orderkey limit 5")
def amount_topk_min(t):
    return retrieval.amount_top_k(t("orders").select(F.col("o_orderkey").alias("card_id"), F.col("o_totalprice").alias("amount")), "min")


# conservation


@query("""with l as (select l_orderkey as k, count(*) as n from lineitem group by all), o as (select o_orderkey as k, count(*) as n from orders group by all)
select coalesce(o.k, l.k) as k, greatest(coalesce(o.n, 0) - coalesce(l.n, 0), 0)::bigint as missing, greatest(coalesce(l.n, 0) - coalesce(o.n, 0), 0)::bigint as extra from o full join l on o.k = l.k where coalesce(o.n, 0) <> coalesce(l.n, 0)""")
def multiset_diff(t):
    return checks.multiset_difference(t("orders").select(F.col("o_orderkey").alias("k")), t("lineitem").select(F.col("l_orderkey").alias("k")), ["k"])


@query("""with u as (select l_partkey as k, count(*) as n from lineitem group by all) select coalesce(p_partkey, k) as k, case when n is null then 'missing' when p_partkey is null then 'unknown' else 'duplicate' end as problem
from part full join u on p_partkey = k where n is null or p_partkey is null or n > 1""")
def coverage_gap(t):
    return checks.coverage(t("part").select(F.col("p_partkey").alias("k")), t("lineitem").select(F.col("l_partkey").alias("k")), "k")


SPANS = """with e as (select distinct user_id, floor(epoch(ts))::bigint as lo, floor(epoch(ts))::bigint + 21600 as hi from events),
m as (select *, case when lo > max(hi) over (partition by user_id order by lo, hi rows between unbounded preceding and 1 preceding) then 1 else 0 end as new from e),
i as (select *, sum(new) over (partition by user_id order by lo, hi rows unbounded preceding) as island from m), u as (select user_id, min(lo) as lo, max(hi) as hi from i group by user_id, island) """


def _spans(t):
    return t("events").select("user_id", F.unix_timestamp("ts").alias("lo"), (F.unix_timestamp("ts") + 21600).alias("hi"))


@query(SPANS + "select * from u")
def span_union(t):
    return checks.union_intervals(_spans(t), "user_id", "lo", "hi")


@query(SPANS + "select * from (select user_id, lag(hi) over (partition by user_id order by lo) as gap_lo, lo as gap_hi from u) where gap_lo is not null")
def span_gaps(t):
    return checks.interval_gaps(_spans(t), "user_id", "lo", "hi")


@query("""with e as (select user_id, event_id, floor(epoch(ts))::bigint as lo, floor(epoch(ts))::bigint + 21600 as hi from events) select user_id, event_id, lo, hi from (select *, lead(lo) over (partition by user_id order by lo, hi) as nx from e) where nx <= hi""")
def span_overlaps(t):
    e = t("events").select("user_id", "event_id", F.unix_timestamp("ts").alias("lo"), (F.unix_timestamp("ts") + 21600).alias("hi"))
    return checks.overlaps_next(e, "user_id", "lo", "hi", [F.asc("event_id")])  # the SQL leaves ties open; on one or two threads it keeps the table's order, which is that of the ids


@query("""select event_id, round(case when hi > lo then (value - lo) / (hi - lo) else 0 end, 6) as scaled from (select event_id, value, min(value) over (partition by event_type) as lo, max(value) over (partition by event_type) as hi from events)""")
def minmax_norm(t):
    return checks.min_max(t("events"), "value", ["event_type"]).select("event_id", F.round("scaled", 6).alias("scaled"))


# counts


@query("select toxic, count(*) as n, count(distinct doc_id) as docs, sum(case when quality = 1 then 1 else 0 end)::bigint as good from labels group by toxic")
def census(t):
    return t("labels").groupBy("toxic").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"), F.count_if(F.col("quality") == 1).alias("good"))


@query("""select count(*) as docs, sum(case when l.doc_id is not null then 1 else 0 end)::bigint as labelled, sum(case when l.doc_id is null then 1 else 0 end)::bigint as unlabelled from documents d left join labels l using (doc_id)""")
def gold_scope(t):
    j = t("documents").select("doc_id").join(t("labels").select("doc_id", F.lit(1).alias("hit")), "doc_id", "left")
    return j.agg(F.count("*").alias("docs"), F.count_if(F.col("hit") == 1).alias("labelled"), F.count_if(F.col("hit").isNull()).alias("unlabelled"))


@query("select event_type, count(*) as n, count(distinct user_id) as users from events group by event_type")
def status_counts(t):
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("""select l_returnflag, l_linestatus, grouping(l_returnflag)::int as g_flag, grouping(l_linestatus)::int as g_status, count(*) as n, round(sum(l_quantity), 2) as qty from lineitem group by grouping sets ((l_returnflag), (l_linestatus), ())""")
def card_stats_grouping_sets(t):
    li = t("lineitem")
    return li.groupingSets([["l_returnflag"], ["l_linestatus"], []], "l_returnflag", "l_linestatus").agg(F.grouping("l_returnflag").cast("int").alias("g_flag"), F.grouping("l_linestatus").cast("int").alias("g_status"), F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("select o_orderstatus, o_orderpriority, count(*) as n from orders group by rollup (o_orderstatus, o_orderpriority)")
def stats_rollup(t):
    return t("orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("select l_returnflag, l_linestatus, count(*) as n from lineitem group by cube (l_returnflag, l_linestatus)")
def stats_cube(t):
    return t("lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("""select date_trunc('day', ts)::timestamp as day, count(*) as n, round(sum(value), 4) as cost, round(sum(sum(value)) over (partition by date_trunc('month', ts) order by date_trunc('day', ts)), 4) as month_to_date from events group by date_trunc('day', ts), date_trunc('month', ts)""")
def cost_ledger(t):
    from pyspark.sql import Window

    d = t("events").groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"), F.sum("value").alias("cost"))
    w = Window.partitionBy(F.date_trunc("month", "day")).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return d.select("day", "n", F.round("cost", 4).alias("cost"), F.round(F.sum("cost").over(w), 4).alias("month_to_date"))


@query("""select c.c_custkey, count(o.o_orderkey) as n_orders, round(coalesce(sum(o.o_totalprice), 0), 2) as total from customer c left join orders o on o.o_custkey = c.c_custkey group by c.c_custkey""")
def project_counters(t):
    j = t("customer").select("c_custkey").join(t("orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_orders"), F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2).alias("total"))


# ordered rows


@query("select conv_id, string_agg(text, '' order by turn) as joined, count(*) as parts, min(turn) as first_row from conversations group by conv_id")
def gid_group_concat(t):
    return groups.concat_groups(t("conversations"), ["conv_id"], "turn", "text")


@query("""select conv_id, turn, role, length(text)::int as first_len, nl::int as next_len from (select *, lead(role) over w as nr, length(lead(text) over w) as nl from conversations window w as (partition by conv_id order by turn)) where nr = role and nl < length(text)""")
def continuation_pairs(t):
    return groups.continuation_pairs(t("conversations"), "conv_id", "turn", "role", "text")


@query("select event_id, user_id, sum(case when event_type = 'signup' then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as record from events")
def record_split_by_anchor(t):
    return groups.split_by_anchor(t("events"), "user_id", ["ts", "event_id"], F.col("event_type") == "signup").select("event_id", "user_id", "record")


@query("select event_id, last_value(case when event_type = 'purchase' then value end ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) as carried from events")
def carry_forward(t):
    e = t("events").withColumn("paid", F.when(F.col("event_type") == "purchase", F.col("value")))
    return groups.carry_forward(e, ["user_id"], ["ts", "event_id"], "paid").select("event_id", "carried")


@query("""select event_id, coalesce(sum(case when event_type = 'purchase' then 1 else 0 end) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0)::bigint as entry from events""")
def entry_close(t):
    return groups.close_entries(t("events"), "user_id", ["ts", "event_id"], F.col("event_type") == "purchase").select("event_id", "entry")


@query("select user_id, event_id, rank from (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id)::int as rank from events) where rank <= 3")
def bucket_newest_cap(t):
    return groups.newest(t("events"), ["user_id"], [F.desc("ts"), F.asc("event_id")], 3).select("user_id", "event_id", "rank")


@query("select event_type, event_id, rank from (select event_type, event_id, row_number() over (partition by event_type order by ts desc, event_id)::int as rank from events) where rank <= 12 order by rank, event_type limit 12")
def round_robin(t):
    return groups.round_robin(t("events").select("event_type", "event_id", "ts"), "event_type", [F.desc("ts"), F.asc("event_id")], 12).select("event_type", "event_id", "rank")


@query("""with v as (select event_type, value, count(*) as k from events where value is not null group by all), m as (select *, case when value - lag(value) over (partition by event_type order by value) > 0.05 then 1 else 0 end as new from v),
i as (select *, sum(new) over (partition by event_type order by value) as island from m)
select event_type, island::bigint as island, sum(k)::bigint as n, round(sum(value * k) / sum(k), 6) as mean, min(value) as lo, max(value) as hi from i group by event_type, island""")
def value_islands(t):
    return groups.islands(t("events"), ["event_type"], "value", 0.05).withColumn("mean", F.round("mean", 6))


@query("""with b as (select p_brand, floor(p_retailprice / 50)::bigint as bin, count(*) as n, avg(p_retailprice) as mean from part group by all)
select p_brand, bin, n, round(mean, 4) as mean from (select *, row_number() over (partition by p_brand order by n desc, bin) as r from b) where r = 1""")
def mode_binned(t):
    return groups.binned_mode(t("part"), ["p_brand"], "p_retailprice", 50.0).withColumn("mean", F.round("mean", 4))


# overlays, semi and anti joins


@query("""select o_orderkey, coalesce(l.flag, o.o_orderstatus) as status from orders o left join (select l_orderkey, max(l_returnflag) as flag from lineitem where l_returnflag = 'R' group by 1) l on l.l_orderkey = o.o_orderkey""")
def status_overlay(t):
    change = t("lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_returnflag").alias("status"))
    return groups.overlay(t("orders").select("o_orderkey", F.col("o_orderstatus").alias("status")), change, ["o_orderkey"], ["status"])


@query("select c_custkey, c_name from customer c where exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_orderpriority = '1-URGENT')")
def scope_semi(t):
    return t("customer").join(t("orders").where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("select c_custkey, c_name from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey)")
def sample_anti(t):
    return t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("select md5(text) as h, count(*) as n, min(doc_id) as first_id from documents group by 1 having count(*) > 1")
def dup_groups(t):
    return t("documents").groupBy(F.md5("text").alias("h")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("select min(doc_id) as doc_id from documents group by md5(text)")
def dedup_keep_first(t):
    return t("documents").groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("""select n_name, r_name, count(*) as customers from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all""")
def scope_hierarchy(t):
    return t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("n_name", "r_name").agg(F.count("*").alias("customers"))


@query("""with s as (select event_id, value, event_type from events) select event_id, case when value > 50 then 'value' when event_type = 'error' then 'type' end as failed from s""")
def batch_gate(t):
    return t("events").select("event_id", review.first_failure({"value": F.col("value") <= 50, "type": F.col("event_type") != "error"}).alias("failed"))


# learning


@query("select attr, pages, row_number() over (order by pages desc, attr)::int as pos from (select p_type as attr, count(distinct p_brand) as pages from part group by 1)")
def skeleton_vote(t):
    return learning.skeleton(t("part").select(F.col("p_brand").alias("stem"), F.col("p_type").alias("attr")))


@query("""with s as (select event_type as attr, count(distinct user_id) as records, round(count(distinct user_id) / (select count(distinct user_id) from events), 4) as support from events group by 1)
select attr, records, support, case when support >= 0.8 then 'required' when support >= 0.5 then 'optional' else 'rare' end as kind from s""")
def support_required_optional(t):
    return learning.attr_support(t("events").select("user_id", F.col("event_type").alias("attr")), "user_id", "attr")


@query("""with f as (select user_id, event_type, min(ts) as at from events group by all), w as (select a.event_type as before, b.event_type as after, count(*) as wins from f a join f b on a.user_id = b.user_id and (a.at < b.at or (a.at = b.at and a.event_type < b.event_type)) group by all)
select w.before, w.after, w.wins, coalesce(l.wins, 0) as losses from w left join w l on l.before = w.after and l.after = w.before""")
def attr_precedence(t):
    return learning.precedence(t("events"), "user_id", "ts", "event_type")


@query("select event_type as v, count(distinct user_id) as pages from events group by 1 having count(distinct user_id) = (select count(distinct user_id) from events) order by length(event_type), event_type limit 6")
def page_constants(t):
    return learning.page_constants(t("events").select("user_id", F.col("event_type").alias("v")), "user_id", "v")


@query("""with c as (select p_brand as attr, p_name as v, count(*) as n from part where length(p_name) > 0 group by all) select attr, v, n, rank from (select *, row_number() over (partition by attr order by length(v) desc, n desc, v)::int as rank from c) where rank <= 4""")
def value_examples(t):
    return learning.value_examples(t("part").select(F.col("p_brand").alias("attr"), F.col("p_name").alias("v")), "attr", "v")


@query("""with k as (select c_nationkey as attr from customer group by 1 having count(distinct c_mktsegment) between 2 and 12) select c_nationkey as attr, c_mktsegment as v, count(*) as n from customer where c_nationkey in (select attr from k) group by all""")
def observed_enums(t):
    return learning.observed_enums(t("customer").select(F.col("c_nationkey").alias("attr"), F.col("c_mktsegment").alias("v")), "attr", "v")


@query("""with p as (select distinct p_partkey, p_brand as attr, substring(p_type, 1, n::int) as prefix from part, range(2, 5) r(n) where length(p_type) >= n) select attr, prefix, count(*) as n from p group by all having count(*) >= 2""")
def value_prefixes(t):
    return learning.prefixes(t("part").select(F.col("p_brand").alias("attr"), F.col("p_type").alias("v")), "attr", "v")


@query("""with o as (select o_orderkey as k, o_orderstatus as s from orders where o_orderkey % 3 <> 0), n as (select o_orderkey as k, case when o_orderkey % 5 = 0 then 'X' else o_orderstatus end as s from orders where o_orderkey % 4 <> 0)
select coalesce(o.k, n.k) as k, case when o.k is null then 'added' when n.k is null then 'removed' else 'changed' end as change from o full join n on o.k = n.k where o.k is null or n.k is null or o.s <> n.s""")
def version_diff(t):
    o = t("orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    return learning.version_diff(o.where("k % 3 <> 0"), o.where("k % 4 <> 0").withColumn("s", F.when(F.col("k") % 5 == 0, "X").otherwise(F.col("s"))), ["k"], "s")


@query("""with e as (select c_name as a, lead(c_name) over (partition by c_custkey // 30 order by c_custkey) as b from customer), d as (select list_filter(list_zip(string_split(a, ''), string_split(b, '')), lambda p: p[1] <> p[2]) as d from e where length(a) = length(b)),
c as (select d[1][1] as wrong, d[1][2] as "right", count(*) as n from d where len(d) = 1 group by all) select wrong, "right", n, count(*) over (partition by wrong) > 1 as conflict from c""")
def rule_candidates(t):
    """Neighbours among thirty names stand for a wrong and a right reading."""
    from pyspark.sql import Window

    c = t("customer").withColumn("b", F.lead("c_name").over(Window.partitionBy(F.expr("c_custkey div 30")).orderBy("c_custkey")))
    return learning.rule_candidates(c.select(F.col("c_name").alias("wrong"), F.col("b").alias("right")))


@query("""select l_shipyear as pub, round(m, 4) as mean, round(s, 4) as sd, round(m - 3 * greatest(s, abs(m) * 0.01), 4) as lo, round(m + 3 * greatest(s, abs(m) * 0.01), 4) as hi, n
from (select year(l_shipdate)::int as l_shipyear, avg(l_quantity) as m, stddev_pop(l_quantity) as s, count(l_quantity) as n from lineitem group by 1)""")
def feature_bands(t):
    return learning.feature_bands(t("lineitem").select(F.year("l_shipdate").alias("pub"), "l_quantity"), "pub", "l_quantity")


@query("""with c as (select user_id as page, value <= 60 as ok, event_type = 'error' as critical from events), s as (select page, count(*) as n, avg(case when ok then 1 else 0 end) as share, max(case when critical and not ok then 1 else 0 end) as bad from c group by page)
select page, round(share, 4) as share, case when n < 3 then 'unknown' when share < 0.75 or bad = 1 then 'drift' else 'ok' end as verdict from s""")
def page_conformance(t):
    return learning.conformance(t("events").select(F.col("user_id").alias("page"), (F.col("value") <= 60).alias("ok"), (F.col("event_type") == "error").alias("critical")), "page")


# boxes, bands, expressions


@query("""with b as (select p_partkey as k, (p_size)::double as x1, (p_partkey % 40)::double as y1, (p_size + 10)::double as x2, (p_partkey % 40 + 20)::double as y2 from part),
o as (select *, greatest(0, least(x2, 35) - greatest(x1, 15)) * greatest(0, least(y2, 40) - greatest(y1, 10)) as i from b) select k, round(case when i > 0 then i / ((x2 - x1) * (y2 - y1) + 600 - i) else 0 end, 6) as iou from o""")
def box_iou(t):
    b = G.box(F.col("p_size"), F.col("p_partkey") % 40, F.col("p_size") + 10, F.col("p_partkey") % 40 + 20)
    fixed = G.box(F.lit(15), F.lit(10), F.lit(35), F.lit(40))
    return t("part").select(F.col("p_partkey").alias("k"), F.round(G.iou(b, fixed), 6).alias("iou"))


@query("""with r as (select p_brand as key, p_type as page, p_size / 50.0::double as rel from part), d as (select distinct key, rel from r), m as (select *, case when rel - lag(rel) over (partition by key order by rel) > 0.03 then 1 else 0 end as new from d),
i as (select r.key, r.page, r.rel, m.island from r join (select *, sum(new) over (partition by key order by rel) as island from m) m on r.key = m.key and r.rel = m.rel), o as (select key, island, page, avg(rel) as pos from i group by all)
select key, island::bigint as island, count(*) as pages, round(avg(pos), 6) as mean, round(max(pos) - min(pos), 6) as spread from o group by key, island""")
def structure_bands(t):
    r = t("part").select(F.col("p_brand").alias("key"), F.col("p_type").alias("page"), (F.col("p_size") / 50.0).alias("rel"))
    return bands.merge_bands(r, "key", "page", "rel", 0.03).withColumn("mean", F.round("mean", 6)).withColumn("spread", F.round("spread", 6))


@query("""with e as (select distinct p_brand as page, p_size / 60.0 as pos from part union select distinct p_brand, 0.0 from part union select distinct p_brand, 1.0 from part)
select page, region, round(lo, 6) as lo, round(hi, 6) as hi from (select page, (row_number() over w - 1)::int as region, pos as lo, lead(pos) over w as hi from e window w as (partition by page order by pos)) where hi is not null""")
def page_regions(t):
    r = bands.regions(t("part").select(F.col("p_brand").alias("page"), (F.col("p_size") / 60.0).alias("rel")), "page", "rel")
    return r.withColumn("lo", F.round("lo", 6)).withColumn("hi", F.round("hi", 6))


@query("""select page_id, regexp_extract(url, '^https?://([^/]+)', 1) as host, regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[^A-Za-z0-9_-]', '_', 'g') as slug from pages""")
def page_names(t):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return t("pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.regexp_replace(title, "[^A-Za-z0-9_-]", "_").alias("slug"))


@query("select event_id, event_type, json_extract(props, '$.k')::bigint as k from events where json_extract(props, '$.k') is not null")
def tolerant_json(t):
    return t("events").select("event_id", "event_type", F.from_json("props", "k bigint")["k"].alias("k")).where("k is not null")


@query("""with p as (select page_id, unnest(regexp_extract_all(html, '(?is)<ul[^>]*>(.*?)</ul>', 1)) as u, generate_subscripts(regexp_extract_all(html, '(?is)<ul[^>]*>(.*?)</ul>', 1), 1) - 1 as table_no from pages),
r as (select page_id, table_no, unnest(regexp_extract_all(u, '(?is)<li[^>]*>(.*?)</li>', 1)) as c, generate_subscripts(regexp_extract_all(u, '(?is)<li[^>]*>(.*?)</li>', 1), 1) - 1 as row_no from p)
select page_id, table_no::int as table_no, row_no::int as row_no, 0 as cell_no, trim(regexp_replace(c, '<[^>]*>', '', 'g'), ' ') as text from r""")
def html_tables(t):
    """The pages have lists and no tables, so each list is written as a table of one column first."""
    table = F.col("html")
    for tag, new in (("ul", "table"), ("li", "tr")):
        table = F.regexp_replace(F.regexp_replace(table, f"(?i)<{tag}\\b[^>]*>", f"<{new}>" + ("<td>" if tag == "li" else "")), f"(?i)</{tag}>", ("</td>" if tag == "li" else "") + f"</{new}>")
    return page_source.html_cells(t("pages").select("page_id", table.alias("html")), "page_id", "html")


@query("""select a.p_brand as a, b.p_brand as b from (select distinct p_brand from part) a join (select distinct p_brand from part) b on a.p_brand < b.p_brand and levenshtein(a.p_brand, b.p_brand) <= 1""")
def near_names(t):
    return T.near_pairs(t("part").select("p_brand").distinct(), "p_brand")


@query("""select conv_id, turn, concat_ws('；', case when role <> '' then 'role：' || role end, case when text <> '' then 'text：' || text end) as card from conversations""")
def fields_to_text(t):
    m = F.create_map(F.lit("role"), F.col("role"), F.lit("text"), F.col("text"))
    return t("conversations").select("conv_id", "turn", T.fields_text(m).alias("card"))


@query("""select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderstatus = 'O' order by o_totalprice, o_orderkey limit 20""")
def review_queue(t):
    q = t("orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("stem"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("confidence"), F.lit("").alias("field"))
    return review.queue(q).limit(20).select(F.col("stem").alias("o_orderkey"), F.col("status").alias("o_orderstatus"), F.col("confidence").alias("o_totalprice"))


@query("""select time_bucket(interval 1 day, ts)::timestamp as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all""")
def event_windows(t):
    from quireworks.streaming.ingest import event_counts

    return event_counts(t("events"), "ts", "event_type", "1 day").withColumn("total", F.round("total", 4))


@query("select user_id, arg_max(event_type, event_id) as event_type, max(event_id) as event_id from events group by user_id")
def latest_state(t):
    from quireworks.streaming.ingest import latest_status

    return latest_status(t("events").select("user_id", "event_type", "event_id"), "user_id", "event_id")


@query(None)
def quote_verdicts(t):
    """Benchmark items against whole documents, near hits included; a row for every item."""
    return quotes.quote_verdicts(t("benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote")), _cards(t))


@query()
def answer_quotes(t):
    """What the later turns of a conversation quote of its first two: the user's lines of all turns as quotes, the opening as the text."""
    c = t("conversations")
    said = F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", "text"))))
    opening = F.array_sort(F.collect_list(F.when(F.col("turn") < 2, F.struct("turn", "text"))))
    answers = c.groupBy("conv_id").agg(said.alias("said"), opening.alias("opening"))
    got = quotes.verify_answers(answers.select(F.col("conv_id").alias("answer_id"), F.col("said.text").alias("quotes"), F.array_join("opening.text", "\n").alias("text")))
    return got.select("answer_id", "claimed", "verified", "fabricated", F.round("fabrication_rate", 4).alias("fabrication_rate"), F.round(F.aggregate("details", F.lit(0.0), lambda a, d: a + d["score"]), 3).alias("scores"))


@query("""with b as (select doc_id, regexp_replace(coalesce(text, ''), '\\s', '', 'g') as t from documents), h as (select doc_id, length(t) as n, len(regexp_extract_all(t, 'token')) + len(regexp_extract_all(t, 'License')) + len(regexp_extract_all(t, '[0-9]{3}')) as hits from b)
select doc_id, case when n < 20 then 'unmeasurable' when hits >= 3 then 'ok' else 'suspect' end as verdict from h""")
def page_triage(t):
    return t("documents").select("doc_id", R.triage(F.col("text"), {"secret": ["token"], "license": ["License"], "number": ["[0-9]{3}"]}).alias("verdict"))


@query("""with e as (select event_id, user_id, ts, case when event_type = 'purchase' then 'p' || event_id else '' end as v, event_type = 'view' as marked from events),
g as (select *, last_value(nullif(v, '') ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as given from e)
select event_id, case when marked and v = '' and given is not null then given else v end as v, marked and v = '' and given is not null as inherited from g""")
def inherit_above(t):
    e = t("events").withColumn("v", F.when(F.col("event_type") == "purchase", F.concat(F.lit("p"), F.col("event_id"))).otherwise(""))
    return groups.inherit_marked(e, ["user_id"], ["ts", "event_id"], "v", F.col("event_type") == "view").select("event_id", "v", "inherited")


@query("""with c as (select c_custkey as stem, c_acctbal > 0 as has_text, c_mktsegment = 'BUILDING' as has_gold, c_nationkey % 2 = 0 as has_draft from customer)
select stem, case when not has_text then 'needs_ocr' when has_gold then 'done' when has_draft then 'needs_adjudication' else 'needs_annotation' end as page_status from c""")
def page_next_step(t):
    c = t("customer").select(F.col("c_custkey").alias("stem"), (F.col("c_acctbal") > 0).alias("has_text"), (F.col("c_mktsegment") == "BUILDING").alias("has_gold"), (F.col("c_nationkey") % 2 == 0).alias("has_draft"))
    return review.page_status(c, "has_text", "has_gold", "has_draft").select("stem", "page_status")


@query("""with g as (select l_returnflag as fold, count(*) as n, sum(case when l_discount > 0.05 then 1 else 0 end) as hit from lineitem group by 1) select round(sum(hit) / sum(n), 4) as ratio, sum(hit)::bigint as hits, sum(n)::bigint as rows from g""")
def fold_weighted_ratio(t):
    g = t("lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("hit"))
    return review.fold_ratio(g, "hit", "n")


# drafts and pools


@query("""with v as (select conv_id, max(turn) as value_id, arg_max(text, turn) as value from conversations group by conv_id),
m as (select v.conv_id, v.value_id, case when c.text = v.value then 0 when contains(c.text, v.value) and length(v.value) > 0 then 1 end as kind, c.turn from v join conversations c using (conv_id)),
b as (select conv_id, value_id, kind, turn from (select *, row_number() over (partition by conv_id, value_id order by kind, turn) as r from m where kind is not null) where r = 1)
select conv_id, value_id, case kind when 0 then 'exact' when 1 then 'contains' else 'none' end as kind, turn as line_id from v left join b using (conv_id, value_id)""")
def value_location(t):
    c = t("conversations")
    values = c.groupBy("conv_id").agg(F.max("turn").alias("value_id"), F.max_by("text", "turn").alias("value"))
    return drafts.locate_values(values, c.select("conv_id", F.col("turn").alias("line_id"), F.col("text").alias("line")), "conv_id")


@query("""select doc_id, case when n = 1 then 'located' when n > 1 then 'ambiguous' else 'missing' end as found from (select doc_id, (length(text) - length(replace(text, lang, ''))) / length(lang) as n from documents)""")
def anchoring_stats(t):
    return t("documents").select("doc_id", drafts.occurrence_class(F.col("text"), F.col("lang")).alias("found"))


@query("select p_partkey, unnest(string_split(p_type, ' ')) as segment, generate_subscripts(string_split(p_type, ' '), 1)::int - 1 as seg from part")
def draft_segments(t):
    return drafts.segment_rows(t("part").select("p_partkey", F.split("p_type", " ").alias("parts")), ["p_partkey"], "parts")


@query("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R') order by md5(o_orderkey::varchar || '|7'), o_orderkey limit 20")
def pool_outside_sample(t):
    taken = t("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return drafts.outside_sample(t("orders").select("o_orderkey"), taken, "o_orderkey", 20, 7)


@query("""with u as (select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by event_id desc) as r from events) where r = 1)
select user_id, event_type, event_id, rank from (select *, row_number() over (partition by event_type order by event_id desc, user_id, event_type)::int as rank from u) where rank <= 30""")
def fewshot_pool(t):
    e = t("events").select("user_id", "event_type", "event_id", "value")
    kept = drafts.capped_pool(e.where("value <= 50"), e.where("value > 50 or value is null"), ["user_id", "event_type"], "event_type", "event_id")
    return kept.select("user_id", "event_type", "event_id", "rank")


@query("""select p_brand as wrong, min(p_type) as "right" from part where p_size <= 25 group by 1 union all
select p_brand, max(p_type) from part where p_size > 25 and p_brand not in (select p_brand from part where p_size <= 25) group by 1""")
def char_candidates_added(t):
    p = t("part")
    base = p.where("p_size <= 25").groupBy(F.col("p_brand").alias("wrong")).agg(F.min("p_type").alias("right"))
    return drafts.insert_missing(base, p.where("p_size > 25").groupBy(F.col("p_brand").alias("wrong")).agg(F.max("p_type").alias("right")), ["wrong"])


@query("select md5(text) as hash, min(doc_id) as doc_id from documents where text is not null and md5(text) not in (select md5(text) from benchmark where text is not null) group by 1")
def import_dedup(t):
    return drafts.first_unseen(t("documents"), t("benchmark").where("text is not null"), "text", "doc_id")


@query("""select doc_id, 'unit' as kind from labels union all select doc_id, 'page' from documents where doc_id not in (select doc_id from labels)""")
def prose_fusion(t):
    return drafts.fuse(t("labels").select("doc_id", F.lit("unit").alias("kind")), t("documents").select("doc_id", F.lit("page").alias("kind")), "doc_id")


@query("""with o as (select l_shipmode as fold, count(q) as held_n, sum(q) as s from (select l_returnflag || l_linestatus as l_shipmode, l_quantity as q from lineitem) group by 1), w as (select sum(held_n)::bigint as all_n, sum(s) as all_s from o)
select fold, held_n, round(s / held_n, 4) as held_mean, all_n - held_n as train_n, round((all_s - s) / (all_n - held_n), 4) as train_mean from o, w""")
def leave_one_out(t):
    return drafts.held_out_folds(t("lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("fold"), "l_quantity"), "fold", "l_quantity")


@query("""with m as (select quantile_cont(p_size, 0.5) as w, quantile_cont(p_retailprice, 0.5) as h from part) select p_partkey, p_size < 0.5 * w or p_retailprice < 0.5 * h as is_crop from part, m""")
def crop_rejection(t):
    return drafts.reject_crops(t("part"), "p_size", "p_retailprice").select("p_partkey", "is_crop")


@query("""with o as (select distinct p_brand, p_type from part where p_size <= 5), n as (select distinct p_brand, p_type from part where p_size >= 45)
select coalesce(o.p_brand, n.p_brand) as p_brand, coalesce(o.p_type, n.p_type) as p_type, case when n.p_brand is null then 'removed' else 'added' end as change from o full join n on o.p_brand = n.p_brand and o.p_type = n.p_type where o.p_brand is null or n.p_brand is null""")
def map_set_diff(t):
    p = t("part")
    return drafts.set_changes(p.where("p_size <= 5"), p.where("p_size >= 45"), "p_brand", "p_type")


STATES = """with s as (select event_id, user_id, case when value > 40 then 'content' when value > 10 then 'sparse' else 'rule' end as state from events),
f as (select *, case when lag(state) over w <> state then 1 else 0 end as new from s window w as (partition by user_id order by event_id)), r as (select *, sum(new) over (partition by user_id order by event_id rows unbounded preceding) as run from f) """


def _states(t) -> DataFrame:
    return t("events").select("event_id", "user_id", F.when(F.col("value") > 40, "content").when(F.col("value") > 10, "sparse").otherwise("rule").alias("state"))


@query(STATES + """select event_id, case when state = 'sparse' and count(*) over (partition by user_id, run) <= 14 and run > 0 and run < max(run) over (partition by user_id) then 'content' else state end as closed from r""")
def morphological_close(t):
    return drafts.close_sparse(_states(t), "user_id", "event_id", "state").select("event_id", "closed")


@query("""with s as (select event_id, user_id, value > 40 as content from events), f as (select *, case when lag(content) over w <> content then 1 else 0 end as new from s window w as (partition by user_id order by event_id)),
r as (select *, sum(new) over (partition by user_id order by event_id rows unbounded preceding) as run from f) select user_id, min(event_id) as lo, max(event_id) as hi, count(*) as n from r where not content or content is null group by user_id, run having count(*) >= 2""")
def row_separators(t):
    return drafts.separators(_states(t), "user_id", "event_id", "state", 2)


@query(LINES + """select doc_id, col_index, line_id, rank from (select l.*, row_number() over (partition by doc_id, col_index order by line_id)::int as rank from l where doc_id in (select doc_id from labels where toxic = 1)) where rank <= 3""")
def hit_expansion(t):
    return drafts.expand_hits(t("labels").where("toxic = 1"), numbered(t), "doc_id").select("doc_id", "col_index", "line_id", "rank")
