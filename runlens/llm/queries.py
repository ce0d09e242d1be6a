"""Registered queries over the given tables, one per operator, and the SQL they must agree with."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import (alignment, decontaminate, exact, main_text, merkle, near, packing, pivots, revisits, secrets,
                         token_counts, toxicity, url_trust)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str = None):
    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn
    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_url_trust(spark, sf_dir):
    return url_trust.judge_urls(table(spark, sf_dir, "pages"))


@query()
def op2_best_fit_packing(spark, sf_dir):
    return packing.packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query(r"""
with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256
           from documents),
g as (select text_sha256, min(doc_id) as keep_id, count(*) as group_size from d group by 1)
select d.doc_id, g.keep_id, g.group_size, d.doc_id is not distinct from g.keep_id as kept, d.text_sha256
from d join g using (text_sha256)""")
def op3_exact_dedup(spark, sf_dir):
    return exact.exact_copies(table(spark, sf_dir, "documents"))


@query()
def op4_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query()
def op5_near_duplicates(spark, sf_dir):
    return near.near_duplicates(table(spark, sf_dir, "documents"))


@query(r"""
with p as (select page_id, url, md5(coalesce(html, '')) as digest, to_timestamp(1704067200 + page_id * 60) as taken,
    octet_length(encode(coalesce(html, ''))) as bytes, regexp_replace(url, '#.*$', '') as plain from pages),
c as (select *, regexp_replace(regexp_replace(lower(regexp_extract(plain, '^[^:/?#]+://([^/?]*)', 1)), '^www[.]', ''),
          ':(80|443)$', '') as host,
      regexp_extract(plain, '^[^:/?#]+://[^/?]*(.*)$', 1) as rest from p),
q as (select *, regexp_extract(rest, '^([^?]*)', 1) as path,
      regexp_replace(regexp_replace(regexp_extract(rest, '[?](.*)$', 1), '(^|&)utm_[^&]*', '', 'g'), '^&|&$', '', 'g') as qs from c),
u as (select *, case when contains(url, '://') then host || regexp_replace(path, '/+$', '')
      || case when qs = '' then '' else '?' || qs end end as canon, '"' || digest[1:16] || '"' as tag from q),
f as (select page_id * 4 as id, canon, taken, digest, tag, bytes from u),
r as (select page_id * 4 + 1 as id, canon, taken + interval 2592000 second as at,
          case when page_id % 7 = 0 then '"changed"' else 'W/' || tag end as tag, 'max-age=60' as cache, 'edge' as server from u
      union all
      select page_id * 4 + 2, canon, taken - interval 3600 second, tag, 'no-cache', null from u where page_id % 5 = 0),
j as (select r.*, f.id as source, f.digest, f.bytes, f.tag as stored from r left join lateral (
      select * from f where f.canon = r.canon and f.taken < r.at order by f.taken desc, f.id desc limit 1) f on true),
s as (select *, case when source is null then 'orphan' when regexp_replace(tag, '^W/', '') = stored then 'resolved'
      else 'mismatch' end as resolution from j)
select id as record_id, canon as url, 'response' as type, 'full' as resolution, id as source_id, 200 as status, digest as payload_digest,
    'content-length=' || bytes || ';content-type=text/html;etag=' || tag || ';server=origin;vary=Accept' as headers from f
union all
select id, canon, 'revisit', resolution, source, case when resolution = 'resolved' then 200 else 304 end,
    case when resolution = 'resolved' then digest end,
    case when resolution = 'resolved' then 'cache-control=' || cache || ';content-length=' || bytes
        || ';content-type=text/html;etag=' || tag || ';server=origin;vary=Accept'
    else 'cache-control=' || cache || ';etag=' || tag || coalesce(';server=' || server, '') end from s""")
def op6_revisits(spark, sf_dir):
    found = revisits.resolve_revisits(revisits.captures_of(table(spark, sf_dir, "pages")))
    fields = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.select("record_id", "url", "type", "resolution", "source_id", "status", "payload_digest",
                        F.array_join(fields, ";").alias("headers"))


@query()
def op7_secrets(spark, sf_dir):
    return secrets.digests(secrets.find_secrets(table(spark, sf_dir, "documents")))


@query()
def op8_decontamination(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op9_main_text(spark, sf_dir):
    return main_text.extract(table(spark, sf_dir, "pages"))


@query()
def op10_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("""
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as e from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
    from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score
from s qualify rank <= 20""")
def op12_pivot_search(spark, sf_dir):
    return pivots.top_k(table(spark, sf_dir, "embeddings"))


# Digests level by level, proofs folded level by level; crc32 bit by bit from its table of 256 values.
@query("""
with recursive t(i, v, k) as (
    select range::bigint, range::bigint, 0 from range(256)
    union all select i, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, k + 1 from t where k < 8),
crc(doc_id, c, k) as (
    select distinct doc_id, 4294967295::bigint, 1 from documents where doc_id is not null
    union all select crc.doc_id, xor(crc.c >> 8, t.v), crc.k + 1 from crc
    join t on t.k = 8 and t.i = xor(crc.c & 255, ascii(substr(crc.doc_id::varchar, crc.k, 1)))
    where crc.k <= length(crc.doc_id::varchar)),
chosen as (select doc_id from crc where k > length(doc_id::varchar) and xor(c, 4294967295) % 7 = 0),
f as (select d.doc_id, d.lang, coalesce(strlen(d.doc_id::varchar) || ':' || d.doc_id, '-')
        || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') as head,
    n_chars, n_chars + (c.doc_id is not null)::int as altered, coalesce(strlen(text) || ':' || text, '-') as tail
    from documents d left join chosen c on c.doc_id = d.doc_id),
g as (select doc_id, lang, sha256(head || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || tail) as leaf,
    sha256(head || coalesce(strlen(altered::varchar) || ':' || altered, '-') || tail) as altered from f),
l as (select *, dense_rank() over (order by encode(lang) nulls first) - 1 as tree, count(*) over (partition by lang) as n,
    row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos from g),
nodes(tree, level, pos, n, digest) as (
    select tree, 0, pos, n, leaf from l
    union all select tree, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' order by pos))
    from nodes where n > 1 group by tree, level, pos // 2, n),
subroots as (select tree, digest from nodes where n = 1),
uppers(level, pos, n, digest) as (
    select 0, tree, (select count(*) from subroots), digest from subroots
    union all select level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' order by pos))
    from uppers where n > 1 group by level, pos // 2, n),
up(tree, pos, level, node, proof, i) as (
    select tree, pos, 0, altered, '', pos from l
    union all select u.tree, u.pos, u.level + 1,
        sha256(case when u.i % 2 = 1 then s.digest || u.node else u.node || coalesce(s.digest, '') end),
        u.proof || coalesce(s.digest, ''), u.i // 2
    from up u join nodes o on o.tree = u.tree and o.level = u.level and o.pos = u.i and o.n > 1
    left join nodes s on s.tree = u.tree and s.level = u.level and s.pos = xor(u.i, 1)),
half as (select u.* from up u join nodes o on o.tree = u.tree and o.level = u.level and o.pos = u.i where o.n = 1),
top(tree, pos, level, node, proof, i) as (
    select tree, pos, 0, node, proof, tree from half
    union all select u.tree, u.pos, u.level + 1,
        sha256(case when u.i % 2 = 1 then s.digest || u.node else u.node || coalesce(s.digest, '') end),
        u.proof || coalesce(s.digest, ''), u.i // 2
    from top u join uppers o on o.level = u.level and o.pos = u.i and o.n > 1
    left join uppers s on s.level = u.level and s.pos = xor(u.i, 1)),
done as (select u.* from top u join uppers o on o.level = u.level and o.pos = u.i where o.n = 1)
select l.doc_id, l.leaf, s.digest as subroot, r.digest as root, sha256(d.proof) as proof_sha256, d.node as folded_root,
    d.node = r.digest as verified
from l join subroots s using (tree) join done d on d.tree = l.tree and d.pos = l.pos
join (select digest from uppers where n = 1) r on true""")
def op13_merkle_manifest(spark, sf_dir):
    return merkle.verified(table(spark, sf_dir, "documents"))


@query()
def op11_tokenizer_alignment(spark, sf_dir):
    return alignment.alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                               public_tokenizers.path("piece_bpe_32k.model")).drop("groups")
