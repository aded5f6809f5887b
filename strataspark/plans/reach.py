"""Queries of reachability, impact, components and cycles over the call graph of inputs.CALLS."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataspark.operators import graph, impact
from strataspark.plans.inputs import table, views, with_ctes

KINDS = ("calls", "imports")


def _calls(spark, sf_dir):
    return views(spark, sf_dir, "calls")[0]


def _seeds(spark, sf_dir, every=33):
    return table(spark, sf_dir, "supplier").where(F.col("s_suppkey") % every == 5).select(F.col("s_suppkey").cast("bigint").alias("id"))


def bounded_forward(spark, sf_dir):
    return graph.reach(_calls(spark, sf_dir), _seeds(spark, sf_dir), 6).select("id", F.col("hops").cast("bigint").alias("hops"))


def bounded_backward(spark, sf_dir):
    return graph.reach(_calls(spark, sf_dir), _seeds(spark, sf_dir), 6, "backward").select("id", F.col("hops").cast("bigint").alias("hops"))


def impact_tiers(spark, sf_dir):
    found = impact.impact(_calls(spark, sf_dir), _seeds(spark, sf_dir), KINDS, 8, 1_000_000)
    return found.select("id", F.col("hops").cast("bigint").alias("hops"), "grade", "tier", "truncated")


def impact_shortest_paths(spark, sf_dir):
    paths = graph.shortest_paths(_calls(spark, sf_dir), _seeds(spark, sf_dir), 6)
    return paths.select("id", F.col("hops").cast("bigint").alias("hops"), F.concat_ws(">", F.col("path").cast("array<string>")).alias("path"))


def impact_summary(spark, sf_dir):
    found = impact.impact(_calls(spark, sf_dir), _seeds(spark, sf_dir), KINDS, 8, 1_000_000)
    return impact.summary(found).select("tier", "id", F.col("rank").cast("bigint").alias("rank"), F.col("omitted").cast("bigint").alias("omitted"))


def scc_cycles(spark, sf_dir):
    c = graph.cycles(_calls(spark, sf_dir))
    return c.select("component", F.col("size").cast("bigint").alias("size"), F.concat_ws(",", F.col("members").cast("array<string>")).alias("members"))


def cyclic_nodes(spark, sf_dir):
    comp = graph.strong_components(_calls(spark, sf_dir))
    return comp.groupBy("component").count().where("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("cyclic_nodes"))


def components(spark, sf_dir):
    edges = _calls(spark, sf_dir).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return graph.connected_components(edges).groupBy("component").agg(F.count("*").alias("size"))


def frontier(spark, sf_dir):
    return impact.frontier(_calls(spark, sf_dir), _seeds(spark, sf_dir, 9))


def damaged_callers(spark, sf_dir):
    edges = _calls(spark, sf_dir).where("kind = 'calls'")
    return impact.damaged_callers(edges, _seeds(spark, sf_dir, 33), 12).select("broken", "id", F.col("hops").cast("bigint").alias("hops"), "severity")


QUERIES = {f.__name__: f for f in (
    bounded_forward, bounded_backward, impact_tiers, impact_shortest_paths, impact_summary, scc_cycles, cyclic_nodes, components, frontier, damaged_callers,
)}

_SEEDS = "seeds as (select s_suppkey::bigint as id from supplier where s_suppkey % 33 = 5)"


def _walk(depth: int, back: bool, where: str = "true") -> str:
    a, b = ("dst", "src") if back else ("src", "dst")
    return f""", {_SEEDS}, e as (select {a} as u, {b} as v, max(grade) as grade from calls where src <> dst and {where} group by 1, 2),
walk as (select id, 0 as hops from seeds union select v, hops + 1 from walk join e on id = u where hops < {depth}),
hop as (select id, min(hops)::bigint as hops from walk group by id)"""


_IMPACT = _walk(8, True, "kind in ('calls', 'imports')") + """,
wide as (select id, 1000000::bigint as grade from seeds union
  select v, least(w.grade, e.grade) from wide w join e on w.id = e.u where v in (select id from hop)),
g as (select id, max(grade)::bigint as grade from wide group by id),
found as (select hop.id, hops, grade, case when grade >= 600000 then 'likely' else 'possible' end as tier, false as truncated from hop join g on hop.id = g.id where hops > 0)"""

_CLOSE = """, e as (select distinct src as u, dst as v from calls where src <> dst),
r as (select u as a, v as b from e union select a, v from r join e on b = u),
ends as (select src as id from calls union select dst from calls),
comp as (select ends.id, least(ends.id, coalesce(min(r.b), ends.id)) as component from ends left join (select r.a, r.b from r join r q on r.a = q.b and r.b = q.a) r on r.a = ends.id group by ends.id)"""

ORACLE = {
    "bounded_forward": with_ctes(_walk(6, False) + " select id, hops from hop", "calls", recursive=True),
    "bounded_backward": with_ctes(_walk(6, True) + " select id, hops from hop", "calls", recursive=True),
    "impact_tiers": with_ctes(_IMPACT + " select id, hops, grade, tier, truncated from found", "calls", recursive=True),
    "impact_summary": with_ctes(_IMPACT + """, ranked as (select *, row_number() over (partition by tier order by grade desc, hops, id) as rank, count(*) over (partition by tier) as n from found)
select tier, id, rank::bigint as rank, greatest(n - 5, 0)::bigint as omitted from ranked where rank <= 5""", "calls", recursive=True),
    "impact_shortest_paths": with_ctes(f""", {_SEEDS}, e as (select distinct src as u, dst as v from calls where src <> dst),
p as (select id, 0 as hops, [id] as path from seeds union all select v, hops + 1, list_append(path, v) from p join e on id = u where hops < 6 and not list_contains(path, v)),
best as (select id, hops, path, row_number() over (partition by id order by hops, path) as k from p)
select id, hops::bigint as hops, array_to_string(path, '>') as path from best where k = 1""", "calls", recursive=True),
    "scc_cycles": with_ctes(_CLOSE + """, big as (select component, count(*) as size, string_agg(id::varchar, ',' order by id) as members from comp group by 1)
select component, size::bigint as size, members from big where size > 1 or component in (select src from calls where src = dst)""", "calls", recursive=True),
    "cyclic_nodes": with_ctes(_CLOSE + """ select coalesce(sum(n), 0)::bigint as cyclic_nodes from (select component, count(*) as n from comp group by 1 having count(*) > 1)""", "calls", recursive=True),
    "components": with_ctes(""", e as (select src as u, dst as v from calls where src <> dst union select dst, src from calls where src <> dst),
r as (select u as a, v as b from e union select a, v from r join e on b = u)
select component, count(*)::bigint as size from (select a, least(a, min(b)) as component from r group by a) group by 1""", "calls", recursive=True),
    "frontier": with_ctes(""", changed as (select s_suppkey::bigint as id from supplier where s_suppkey % 9 = 5)
select distinct src as id from calls where dst in (select id from changed) and src not in (select id from changed)""", "calls"),
    "damaged_callers": with_ctes(f""", {_SEEDS}, e as (select distinct dst as u, src as v from calls where kind = 'calls' and src <> dst),
walk as (select id as broken, id, 0 as hops from seeds union select broken, v, hops + 1 from walk join e on id = u where hops < 12)
select broken, id, min(hops)::bigint as hops, case when min(hops) = 1 then 'breaking_error' else 'impact_path_unverified' end as severity from walk group by broken, id having min(hops) > 0""", "calls", recursive=True),
}
