"""Queries of operators.browse and the local graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataspark.operators import browse, graph
from strataspark.plans.inputs import views, with_ctes


def graph_degree_topk(spark, sf_dir):
    supply, symbols = views(spark, sf_dir, "supply", "symbols")
    return browse.top_degree(supply, symbols, 25)


def code_map_counts(spark, sf_dir):
    supply, symbols = views(spark, sf_dir, "supply", "symbols")
    return browse.code_map(symbols, supply)


def find_paged(spark, sf_dir):
    (symbols,) = views(spark, sf_dir, "symbols")
    return browse.find_symbols(symbols, "BRAND#1", kind="class", limit=50, offset=20)


def ego_network(spark, sf_dir):
    (supply,) = views(spark, sf_dir, "supply")
    return browse.ego_network(supply, "s7")


def edge_browse_dedup(spark, sf_dir):
    (supply,) = views(spark, sf_dir, "supply")
    return browse.neighbours(supply, "s3", limit=40, offset=10)


def neighborhood_counts(spark, sf_dir):
    (supply,) = views(spark, sf_dir, "supply")
    return browse.neighbourhood_counts(supply)


def edge_grade(spark, sf_dir):
    (supply,) = views(spark, sf_dir, "supply")
    tier = F.when(F.length("src") % 2 == 0, "imported-name").otherwise("imported-resolved")
    return supply.groupBy("kind", "coverage", browse.edge_grade(F.col("kind"), F.col("coverage"), tier).alias("grade")).agg(F.count("*").alias("n"))


def induced_subgraph(spark, sf_dir):
    supply, symbols = views(spark, sf_dir, "supply", "symbols")
    chosen = symbols.where("kind in ('class', 'module')").select("id")
    return graph.induced(supply, chosen).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("src").alias("sources"))


def dangling_endpoints(spark, sf_dir):
    supply, symbols = views(spark, sf_dir, "supply", "symbols")
    return graph.placeholders(symbols.where("kind <> 'method'"), supply)


def universe_projection(spark, sf_dir):
    supply, symbols = views(spark, sf_dir, "supply", "symbols")
    return browse.universe(symbols, supply, 200)


def compact_topk(spark, sf_dir):
    (supply,) = views(spark, sf_dir, "supply")
    top = browse.top_per_group(supply.select("dst", "src", "kind"), "dst", [F.asc("src"), F.asc("kind")], 3)
    return top.select("dst", "src", "kind", F.col("rank").cast("bigint").alias("rank"), F.col("omitted").cast("bigint").alias("omitted"))


QUERIES = {f.__name__: f for f in (
    graph_degree_topk, code_map_counts, find_paged, ego_network, edge_browse_dedup, neighborhood_counts, edge_grade, induced_subgraph,
    dangling_endpoints, universe_projection, compact_topk,
)}

_DEGREE = """, ends as (select src as id, 0 as i, 1 as o from supply union all select dst, 1, 0 from supply),
deg as (select id, sum(i) as fan_in, sum(o) as fan_out, count(*) as degree from ends group by id)"""

ORACLE = {
    "graph_degree_topk": with_ctes(_DEGREE + """
select s.id, s.kind, coalesce(fan_in, 0)::bigint as fan_in, coalesce(fan_out, 0)::bigint as fan_out, coalesce(degree, 0)::bigint as degree
from symbols s left join deg d on s.id = d.id order by degree desc, s.id limit 25""", "supply", "symbols"),
    "code_map_counts": with_ctes("""
select 'kind' as section, kind as key, count(*)::bigint as n from symbols group by kind
union all select 'package', array_to_string(string_split(path, '/')[1:2], '/'), count(*) from symbols group by 2
union all select 'edge_kind', kind, count(*) from supply group by kind""", "supply", "symbols"),
    "find_paged": with_ctes(""", hits as (select * from symbols where kind = 'class' and (contains(lower(name), 'brand#1') or contains(lower(path), 'brand#1') or contains(lower(id), 'brand#1')))
select *, (select count(*) from hits)::bigint as total from hits order by id, name limit 50 offset 20""", "symbols"),
    "ego_network": with_ctes("""
select 'outgoing' as direction, dst as neighbor, kind, coverage from supply where src = 's7' and kind in ('calls', 'references', 'imports')
union all select 'incoming', src, kind, coverage from supply where dst = 's7' and kind in ('calls', 'references', 'imports')""", "supply"),
    "edge_browse_dedup": with_ctes("""
select distinct neighbor, kind from (select dst as neighbor, kind from supply where src = 's3' union all select src, kind from supply where dst = 's3')
order by neighbor, kind limit 40 offset 10""", "supply"),
    "neighborhood_counts": with_ctes(""", ends as (
  select src as id, case when kind = 'calls' then dst end as callee, null as caller, case when coverage in ('partial', 'unknown') then 1 else 0 end as x from supply
  union all select dst, null, case when kind = 'calls' then src end, case when coverage in ('partial', 'unknown') then 1 else 0 end from supply)
select id, count(distinct caller)::bigint as callers, count(distinct callee)::bigint as callees, sum(x)::bigint as inexact from ends group by id""", "supply"),
    "edge_grade": with_ctes("""
select kind, coverage, (case when coverage in ('unknown', 'unsupported') then 0
  when coverage = 'partial' then case when length(src) % 2 = 0 then 250000 else 600000 end
  when kind in ('contains', 'imports') then 500000 when length(src) % 2 = 0 then 250000 else 900000 end)::bigint as grade, count(*)::bigint as n
from supply group by 1, 2, 3""", "supply"),
    "induced_subgraph": with_ctes(""", chosen as (select id from symbols where kind in ('class', 'module'))
select kind, count(*)::bigint as n, count(distinct src)::bigint as sources from supply where src in (select id from chosen) and dst in (select id from chosen) group by kind""", "supply", "symbols"),
    "dangling_endpoints": with_ctes(""", ends as (select src as id from supply union select dst from supply)
select id, 'external' as kind from ends where id not in (select id from symbols where kind <> 'method')""", "supply", "symbols"),
    "universe_projection": with_ctes(_DEGREE + """, ranked as (select s.id, coalesce(degree, 0)::bigint as degree from symbols s left join deg d on s.id = d.id),
hubs as (select id, degree, true as hub from ranked order by degree desc, id limit 100),
rest as (select id, degree, row_number() over (order by id) - 1 as pos, count(*) over () as total from ranked where id not in (select id from hubs)),
picks as (select distinct (i * (select max(total) from rest)) // least(100, (select max(total) from rest)) as pos from range(100) t(i) where i < (select max(total) from rest))
select * from hubs union all select id, degree, false from rest where pos in (select pos from picks)""", "supply", "symbols"),
    "compact_topk": with_ctes(""", ranked as (select dst, src, kind, row_number() over (partition by dst order by src, kind) as rank, count(*) over (partition by dst) as n from supply)
select dst, src, kind, rank::bigint as rank, greatest(n - 3, 0)::bigint as omitted from ranked where rank <= 3""", "supply"),
}
