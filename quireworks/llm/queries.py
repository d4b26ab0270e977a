"""The queries of this subpackage, by name, and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from quireworks.llm.common import table
from quireworks.llm import align, decontam, divergence, langid, lm, packing, repeats, setjoin, sharding, tokens, toxicity, vafile, warc


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), cache_bytes=256 << 20)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.archive(table(spark, sf_dir, "pages"))
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op10_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_packing, op2_toxicity, op3_decontamination, op4_warc, op5_token_counts, op6_sharding, op7_set_join, op8_language, op9_language_model, op10_vector_search,
        op11_suffix_dedup, op12_source_divergence, op13_token_alignment,
    )
} | {"pipeline": corpus_pipeline.run}

ORACLE_SQL: dict[str, str] = {
    "op4_warc": """
        with p as (select page_id, encode(coalesce(html, '')) as body from pages),
        h as (select page_id, octet_length(body)::bigint as payload_bytes, sha256(body) as payload_digest from p),
        f as (select payload_digest, min(page_id) as first_id from h where payload_bytes >= 100 group by 1)
        select page_id, payload_bytes, payload_digest,
               case when first_id <> page_id then 'revisit' else 'response' end as record_type,
               case when first_id <> page_id then first_id end as refers_to
        from h left join f using (payload_digest)""",
    "op7_set_join": r"""
        with recursive w as (
            select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
        s as (select distinct doc_id, array_to_string(ws[i:i + 4], ' ') as g
              from w, lateral (select unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as i) where len(ws) > 0),
        n as (select doc_id, count(*) as n from s group by doc_id),
        p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
        l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 80 * (a.n + b.n - c)),
        e as (select x, y from l union select y, x from l),
        r(doc_id, m) as (select doc_id, doc_id from documents union select e.x, r.m from r join e on e.y = r.doc_id),
        c as (select doc_id, min(m) as component_id from r group by doc_id)
        select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id from documents d left join n using (doc_id) left join c using (doc_id)""",
    "op10_vector_search": """
        with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e
                   from embeddings where embedding is not null
                   and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select q.vec_id as query_id, c.vec_id,
                     list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint as score
              from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 50 = 0),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
        select query_id, rank, vec_id, score from r where rank <= 5""",
    "op12_source_divergence": r"""
        with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ws from documents),
        w as (select r, lang, source, unnest(ws) as term from d),
        kept as (select lang, term, count(*)::hugeint as n from w group by 1, 2 having count(distinct r) >= 3),
        c as (select lang, source, term, count(*)::hugeint as n from w join kept using (lang, term) group by 1, 2, 3),
        v as (select lang, count(*)::hugeint as v, sum(n)::hugeint as nl from kept group by 1),
        g as (select lang, source, coalesce(sum(n), 0)::hugeint as ng from (select distinct lang, source from d) left join c using (lang, source) group by 1, 2),
        p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
                     1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (ng + v.v) as p,
                     1 + (1000000000::hugeint * (k.n + 1)) // (nl + v.v) as q
              from g join kept k using (lang) join v using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
        f as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
              from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
        u as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0)::bigint as value
              from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
              union all select lang, source, 'term', term, ((p - q) * (p - q) // q)::bigint from p where n > 0 and p > q),
        r as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from u)
        select lang, source, part, item, value, rank from r where part = 'pair' or rank <= 200""",
}
