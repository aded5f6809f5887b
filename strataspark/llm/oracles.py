"""DuckDB SQL for the queries that have one: joins by all pairs, sharding by plain window functions."""

from __future__ import annotations

_REACH = """r as (select a as id, b as other from links union select r.id, links.b from r join links on links.a = r.other)"""

#: All pairs that share a 5-gram; links and classes from these.
JACCARD = f"""with recursive w as materialized (select doc_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') as ws from documents where doc_id is not null and text is not null),
g as materialized (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as gram from w),
n as materialized (select doc_id, count(*) as n from g group by 1),
p as materialized (select a.doc_id as a, b.doc_id as b, count(*) as c from g a join g b on a.gram = b.gram and a.doc_id <> b.doc_id group by 1, 2),
links as materialized (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 1000 * c >= 800 * (x.n + y.n - c)),
{_REACH},
low as (select id, min(least(id, other)) as class_id from r group by 1), k as (select a as id, count(*) as n_links from links group by 1)
select doc_id, coalesce(class_id, doc_id) as class_id, coalesce(n_links, 0)::bigint as n_links, coalesce(class_id, doc_id) = doc_id as kept from documents left join low on low.id = doc_id left join k on k.id = doc_id"""

#: All pairs of a label.
COSINE = f"""with recursive v as materialized (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as materialized (select x.vec_id as a, y.vec_id as b from v x join v y on x.label = y.label and x.vec_id <> y.vec_id and len(x.e) = len(y.e) where list_cosine_similarity(x.e, y.e) >= 0.98),
{_REACH},
low as (select id, min(least(id, other)) as component_id from r group by 1), k as (select a as id, count(*) as n_links from links group by 1)
select vec_id, coalesce(n_links, 0)::bigint as n_links, coalesce(component_id, vec_id) as component_id, coalesce(component_id, vec_id) = vec_id as kept from embeddings left join low on low.id = vec_id left join k on k.id = vec_id"""

#: crc32 byte by byte from a table made by its rule; ranks by window functions over whole sources.
SHARDS = """with recursive bit as (select i, i as c, 0 as k from range(256) t(i) union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bit where k < 8),
crc as (select list(c order by i) as t from bit where k = 8),
d as materialized (select doc_id, source, coalesce(text, '') as text, md5('42:' || coalesce(doc_id::varchar, '')) as h from documents),
b as materialized (select doc_id, source, h, octet_length(encode(text))::bigint + 8 as size, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(text)), '..'),
  lambda x: (strpos('0123456789ABCDEF', x[1]) * 16 + strpos('0123456789ABCDEF', x[2]) - 17)::bigint)), lambda acc, x: xor(t[(xor(acc, x) & 255) + 1], acc >> 8))) as text_crc32 from d, crc),
r as (select *, row_number() over (partition by source order by h, doc_id, text_crc32) as rank, count(*) over (partition by source) as n, count(*) over () as total from b),
o as (select *, row_number() over (order by (2 * rank - 1)::double / (2 * n)::double, source nulls first, rank) - 1 as pos from r),
s as (select *, (pos * 24) // total as shard from o)
select doc_id, size, text_crc32::bigint as text_crc32, 'rows' as law, shard::integer as shard, (pos - ceil(shard * total / 24.0))::bigint as slot, null::integer as grown_shard, source from s"""

ORACLE = {"op1_ngram_jaccard_join": JACCARD, "op5_sharding": SHARDS, "op8_embedding_near_dedup": COSINE}
