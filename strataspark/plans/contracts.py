"""Queries of commit graphs, payload and parameter revisions, pacts, trace ids and the analytics report."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataspark.operators import browse, contracts, graph, history
from strataspark.plans.inputs import table, views, with_ctes


def _commits(spark, sf_dir):
    """Suppliers as commits: parents k - 1, and k - 7 for every ninth; runs of fifty."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey").cast("bigint")
    first = F.when(k % 50 != 1, F.array(k - 1)).otherwise(F.array().cast("array<bigint>"))
    return s.select(k.alias("oid"), F.when((k % 9 == 0) & (k % 50 > 8), F.array_append(first, k - 7)).otherwise(first).alias("parents"), k.alias("idx"))


def first_parent_walk(spark, sf_dir):
    return history.first_parent_walk(_commits(spark, sf_dir), 45, 30)


def topological_levels(spark, sf_dir):
    return history.topological_levels(_commits(spark, sf_dir))


def commit_decorations(spark, sf_dir):
    refs = table(spark, sf_dir, "customer").where("c_custkey % 20 = 0").select(F.col("c_name").alias("name"), (F.col("c_custkey") % 100 + 1).alias("oid"))
    c = _commits(spark, sf_dir)
    return history.decorate(c.select("oid"), refs).join(history.lanes(c), "oid")


def _facts(spark, sf_dir):
    """Parts of suppliers as payload facts of two revisions, two levels deep; some without a type, some unsure."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("subject"), F.col("l_orderkey").alias("k"), (F.col("l_partkey") % 5).cast("string").alias("p"), (F.col("l_partkey") % 25).cast("string").alias("c"))
    outer = li.groupBy("subject", F.concat(F.lit("/"), "p").alias("pointer")).agg(F.min("k").alias("k"))
    base = outer.unionAll(li.groupBy("subject", F.concat_ws("/", F.lit(""), "p", "c").alias("pointer")).agg(F.min("k").alias("k")))

    def side(keep, t, r):
        one, two = F.array(F.lit("integer")), F.array(F.lit("integer"), F.lit("null"))
        types = F.when(F.col("k") % (t + 7) == 0, F.array().cast("array<string>")).when(F.col("k") % t == 0, two).otherwise(one)
        enums = F.when(F.col("k") % (t + 2) == 0, F.array(F.lit('"a"'), F.lit('"b"')))
        return base.where(f"k % {keep} <> 0").select("subject", "pointer", types.alias("types"), enums.alias("enums"), (F.col("k") % r == 0).alias("required"), (F.col("k") % (r + 3) == 0).alias("closed"), F.when(F.col("k") % 29 == 0, "partial").otherwise("verified").alias("coverage"))

    return side(17, 4, 3), side(19, 6, 5)


def payload_changes(spark, sf_dir):
    before, after = _facts(spark, sf_dir)
    out = contracts.payload_changes(before, after, "accepted")
    for way in ("emitted", "both"):
        out = out.withColumn(way, contracts.payload_severity(F.col("kind"), way))
    return out.groupBy("kind", F.col("severity").alias("accepted"), "emitted", "both").agg(F.count("*").alias("n"), F.countDistinct("subject").alias("subjects"))


def parameter_changes(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    base = li.groupBy(F.concat(F.lit("/r"), (F.col("l_suppkey") % 50).cast("string")).alias("route"), F.when(F.col("l_orderkey") % 3 == 0, "get").otherwise("post").alias("method"), F.lit("query").alias("location"), (F.col("l_partkey") % 12).cast("string").alias("name")).agg(F.min("l_orderkey").alias("k"))
    before = base.where("k % 7 <> 0 and route <> '/r3' and (route <> '/r5' or method = 'get')").select("route", "method", "location", "name", (F.col("k") % 3 == 0).alias("required"), F.when(F.col("k") % 5 == 0, "integer").otherwise("string").alias("type"))
    after = base.where("k % 11 <> 0 and route <> '/r4' and (route <> '/r6' or method = 'get')").select("route", "method", "location", "name", (F.col("k") % 4 == 0).alias("required"), F.when(F.col("k") % 5 == 0, "number").otherwise("string").alias("type"))
    return contracts.parameter_changes(before, after).groupBy("kind", "severity").agg(F.count("*").alias("n"))


def pact_outcomes(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    path = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("/"), "event_type")).otherwise(F.concat(F.lit("/"), "event_type", F.lit("/"), F.col("user_id").cast("string")))
    calls = ev.select(F.col("event_id").alias("interaction_id"), F.when(F.col("event_id") % 3 == 0, "POST").otherwise("GET").alias("method"), path.alias("path"), (F.col("event_id") % 5 < 2).alias("has_body"), F.when(F.col("event_id") % 7 == 0, 404).otherwise(200).alias("status"))
    ops = spark.createDataFrame(OPERATIONS, "route string, method string, body_required boolean, has_body boolean, statuses array<int>")
    return contracts.pact_outcomes(calls, ops)


OPERATIONS = [
    ("/click/{id}", "get", False, False, [200]), ("/click/7", "get", False, True, [200, 404]), ("/view/{id}", "post", True, True, [200]), ("/{kind}", "get", False, False, [200, 404]),
    ("/purchase/{a}", "get", False, True, [200]), ("/purchase/{b}", "post", False, True, [200]),
]


def trace_ids(spark, sf_dir):
    """Ids are replaced by keyed digests, so spans of one user stay together and cannot be traced back."""
    ev = table(spark, sf_dir, "events")
    return ev.groupBy(F.sha2(F.concat_ws("|", F.lit("salt"), F.lit("user"), F.col("user_id").cast("string")), 256).alias("pseudonym"), "event_type").agg(F.count("*").alias("n"))


def analytics_report(spark, sf_dir):
    supply, symbols = views(spark, sf_dir, "supply", "symbols")
    nodes = symbols.agg(F.count("*").alias("nodes"))
    edges = supply.agg(F.count("*").alias("edges"), F.round(100.0 * F.count_if(F.col("coverage") == "verified") / F.count("*"), 2).alias("verified_percent"))
    hubs = browse.top_degree(supply, symbols, 10).agg(F.sum("degree").alias("hub_degree"), F.min("id").alias("first_hub"))
    lone = symbols.join(graph.degrees(supply), "id", "left_anti").agg(F.count("*").alias("isolated"))
    return nodes.crossJoin(edges).crossJoin(hubs).crossJoin(lone)


QUERIES = {f.__name__: f for f in (first_parent_walk, topological_levels, commit_decorations, payload_changes, parameter_changes, pact_outcomes, trace_ids, analytics_report)}

_COMMITS = """c as (select s_suppkey::bigint as oid, case when s_suppkey % 50 <> 1 then s_suppkey::bigint - 1 end as p1, case when s_suppkey % 9 = 0 and s_suppkey % 50 > 8 then s_suppkey::bigint - 7 end as p2 from supplier)"""
_PAY = """with li as (select l_suppkey::varchar as subject, l_orderkey as k, (l_partkey % 5)::varchar as p, (l_partkey % 25)::varchar as c from lineitem),
base as (select subject, '/' || p as pointer, min(k) as k from li group by 1, 2 union all select subject, '/' || p || '/' || c, min(k) from li group by 1, 2),
b as (select subject, pointer, case when k % 11 = 0 then ['array', 'boolean', 'integer', 'null', 'number', 'object', 'string'] when k % 4 = 0 then ['integer', 'null'] else ['integer'] end as t, k % 6 = 0 as e, k % 3 = 0 as r, k % 6 = 0 as c, k % 29 <> 0 as sure from base where k % 17 <> 0),
a as (select subject, pointer, case when k % 13 = 0 then ['array', 'boolean', 'integer', 'null', 'number', 'object', 'string'] when k % 6 = 0 then ['integer', 'null'] else ['integer'] end as t, k % 8 = 0 as e, k % 5 = 0 as r, k % 8 = 0 as c, k % 29 <> 0 as sure from base where k % 19 <> 0),
j as (select coalesce(b.subject, a.subject) as subject, coalesce(b.pointer, a.pointer) as pointer, b.subject is not null and a.subject is not null as two, two and b.sure and a.sure as ok, b.subject is null as new, a.subject is null as gone,
  b.t as bt, a.t as at_, b.e as be, a.e as ae, b.r as br, a.r as ar, b.c as bc, a.c as ac from b full join a on b.subject = a.subject and b.pointer = a.pointer),
f as (select subject, pointer, unnest(list_filter([
  case when two and not ok then 'payload_incomparable' end, case when ok and not list_has_all(at_, bt) then 'payload_type_narrowed' end, case when ok and not list_has_all(bt, at_) then 'payload_type_widened' end,
  case when ok and ae and not be then 'payload_enum_value_removed' end, case when ok and be and not ae then 'payload_enum_value_added' end,
  case when (ok and ar and not br) or (new and ar) then 'payload_requiredness_gained' end, case when ok and br and not ar then 'payload_requiredness_lost' end,
  case when gone then 'payload_property_removed' end, case when new and not ar then 'payload_property_added' end,
  case when ok and ac and not bc then 'payload_additional_properties_disallowed' end, case when ok and bc and not ac then 'payload_additional_properties_allowed' end], lambda x: x is not null)) as kind from j),
z as (select * from f where (subject, regexp_replace(pointer, '/[^/]*$', '')) not in (select (subject, pointer) from j where new or gone or (two and not ok))),
v as (select *, case when kind = 'payload_incomparable' then 'unknown' when kind in ('payload_type_narrowed', 'payload_enum_value_removed', 'payload_requiredness_gained', 'payload_property_removed', 'payload_additional_properties_disallowed') then 'breaking' else 'non_breaking' end as accepted,
  case when kind in ('payload_incomparable', 'payload_property_added', 'payload_additional_properties_allowed') then 'unknown' when kind in ('payload_type_widened', 'payload_enum_value_added', 'payload_requiredness_lost', 'payload_property_removed') then 'breaking' else 'non_breaking' end as emitted from z)"""
_PARAM = """with base as (select '/r' || (l_suppkey % 50)::varchar as route, case when l_orderkey % 3 = 0 then 'get' else 'post' end as method, (l_partkey % 12)::varchar as name, min(l_orderkey) as k from lineitem group by 1, 2, 3),
b as (select * from base where k % 7 <> 0 and route <> '/r3' and (route <> '/r5' or method = 'get')), a as (select * from base where k % 11 <> 0 and route <> '/r4' and (route <> '/r6' or method = 'get')),
kinds as (
  select 'endpoint_removed' as kind from (select distinct route from b where route not in (select route from a)) union all select 'endpoint_added' from (select distinct route from a where route not in (select route from b))
  union all select 'method_removed' from (select distinct route, method from b where route in (select route from a) and (route, method) not in (select (route, method) from a))
  union all select 'method_added' from (select distinct route, method from a where route in (select route from b) and (route, method) not in (select (route, method) from b))
  union all select case when a.k is null then 'parameter_removed' when b.k is null and a.k % 4 = 0 then 'required_parameter_added' when b.k is null then 'optional_parameter_added' when a.k % 4 = 0 and b.k % 3 <> 0 then 'parameter_became_required'
    when b.k % 3 = 0 and a.k % 4 <> 0 then 'parameter_became_optional' when a.k % 5 = 0 then 'parameter_type_widened' end
    from (select * from b where (route, method) in (select (route, method) from a)) b full join (select * from a where (route, method) in (select (route, method) from b)) a on a.route = b.route and a.method = b.method and a.name = b.name)"""

ORACLE = {
    "first_parent_walk": f"with recursive {_COMMITS}, w as (select oid, 0::bigint as step from c where oid = 45 union all select p1, step + 1 from w join c using (oid) where p1 is not null and step < 29) select oid, step from w",
    "topological_levels": f"""with recursive {_COMMITS}, k as (select * from c), e as (select oid, p1 as p from k where p1 is not null union select oid, p2 from k where p2 is not null),
w as (select oid, 0 as level from k where p1 is null or p1 not in (select oid from k) union select e.oid, level + 1 from w join e on e.p = w.oid) select oid, max(level)::bigint as level from w group by oid""",
    "commit_decorations": f"""with {_COMMITS}, r as (select c_custkey % 100 + 1 as oid, string_agg(distinct c_name, ',' order by c_name) as refs from customer where c_custkey % 20 = 0 group by 1)
select c.oid, coalesce(refs, '') as refs, (case when p2 is null then 0 else 1 + c.oid % 3 end)::bigint as lane from c left join r on c.oid = r.oid""",
    "payload_changes": _PAY + """ select kind, accepted, emitted, case when 'breaking' in (accepted, emitted) then 'breaking' when 'unknown' in (accepted, emitted) then 'unknown' else 'non_breaking' end as both, count(*)::bigint as n, count(distinct subject)::bigint as subjects from v group by 1, 2, 3, 4""",
    "parameter_changes": _PARAM + """ select kind, case when kind in ('endpoint_added', 'method_added', 'optional_parameter_added', 'parameter_became_optional', 'parameter_type_widened') then 'non_breaking' else 'breaking' end as severity, count(*)::bigint as n from kinds where kind is not null group by 1, 2""",
    "pact_outcomes": """with i as (select event_id as id, case when event_id % 3 = 0 then 'post' else 'get' end as m, case when event_id % 4 = 0 then '/' || event_type else '/' || event_type || '/' || user_id::varchar end as path, event_id % 5 < 2 as body, case when event_id % 7 = 0 then 404 else 200 end as st from events),
o as (select * from (values ('/click/{id}', 'get', false, false, [200], 1), ('/click/7', 'get', false, true, [200, 404], 0), ('/view/{id}', 'post', true, true, [200], 1), ('/{kind}', 'get', false, false, [200, 404], 1), ('/purchase/{a}', 'get', false, true, [200], 1), ('/purchase/{b}', 'post', false, true, [200], 1)) t(route, om, req, ob, sts, holes)),
h as (select *, min(holes) over (partition by id) as least from i join o on regexp_full_match(path, regexp_replace(route, '\\{[^/]*\\}', '[^/]+', 'g'))), g as (select id, count(distinct route) as r, max((om = m)::int) as d, max((om = m and req and not body)::int) as lb, max((om = m and body and not ob)::int) as eb, max((om = m and list_contains(sts, st))::int) as ok from h where holes = least group by id)
select i.id as interaction_id, case when r is null then 'pact_interaction_unmatched' when r > 1 then 'pact_ambiguous_provider_match' when d = 0 then 'pact_method_not_declared' when lb = 1 then 'pact_required_request_body_missing' when eb = 1 then 'pact_undeclared_request_body'
  when ok = 0 then 'pact_response_status_undeclared' end as finding from i left join g on i.id = g.id""",
    "trace_ids": "select sha256('salt|user|' || user_id::varchar) as pseudonym, event_type, count(*)::bigint as n from events group by 1, 2",
    "analytics_report": with_ctes(""", ends as (select src as id from supply union all select dst from supply), deg as (select id, count(*) as degree from ends group by id),
hub as (select s.id, coalesce(degree, 0) as degree from symbols s left join deg on s.id = deg.id order by degree desc, s.id limit 10)
select (select count(*) from symbols)::bigint as nodes, (select count(*) from supply)::bigint as edges, (select round(100.0::double * count(*) filter (where coverage = 'verified') / count(*), 2) from supply) as verified_percent,
  sum(degree)::bigint as hub_degree, min(id) as first_hub, (select count(*) from symbols where id not in (select id from ends))::bigint as isolated from hub""", "supply", "symbols"),
}
