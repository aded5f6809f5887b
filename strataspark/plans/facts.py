"""Queries of facts, lineage, telemetry and redaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataspark.functions.text import route_template, strip_url
from strataspark.operators import telemetry, temporal
from strataspark.plans.inputs import table, views, with_ctes


def _observations(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    day = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 86400)
    d = ev.select(day.alias("day"), F.col("user_id").cast("string").alias("subject"), "event_type").distinct()
    first = d.agg(F.min("day").alias("first"))
    obs = d.crossJoin(F.broadcast(first)).select((F.col("day") - F.col("first")).cast("bigint").alias("idx"), "subject", F.lit("does").alias("predicate"), F.col("event_type").alias("object"))
    return obs, obs.select("idx").distinct()


def _facts(spark, sf_dir):
    return temporal.fact_intervals(*_observations(spark, sf_dir))


def fact_intervals(spark, sf_dir):
    return _facts(spark, sf_dir)


def facts_active_at(spark, sf_dir):
    points = spark.createDataFrame([(3,), (11,), (29,)], "at bigint")
    return temporal.active_at(_facts(spark, sf_dir), points).select("at", "fact_id")


def journal_stats(spark, sf_dir):
    return temporal.journal_stats(_facts(spark, sf_dir))


def snapshot_digest(spark, sf_dir):
    points = spark.createDataFrame([(3,), (11,), (29,)], "at bigint")
    active = temporal.active_at(_facts(spark, sf_dir), points)
    lines = active.select(F.col("at").cast("string").alias("at"), F.concat_ws(" ", "subject", "predicate", "object").alias("line"))
    return temporal.digest_by(lines, "at", "line")


def lineage_exact(spark, sf_dir):
    return temporal.lineage_exact(*views(spark, sf_dir, "before_files", "after_files"))


def _similar(spark, sf_dir):
    path = F.concat(F.lit("src/"), F.col("doc_id").cast("string")).alias("path")
    files = table(spark, sf_dir, "documents").select(path, "text", F.expr("doc_id % 3 <> 0").alias("before"), F.expr("doc_id % 3 <> 1").alias("after"))
    return temporal.similar_files(files.where("before or after"), 0.85)


def lineage_similar(spark, sf_dir):
    return _similar(spark, sf_dir).select("from_path", "to_path", F.col("common").cast("bigint").alias("common"), F.col("union").cast("bigint").alias("all_tokens"))


def lineage_best(spark, sf_dir):
    best = temporal.best_match(_similar(spark, sf_dir))
    return best.select("from_path", "to_path", F.round("similarity", 9).alias("similarity"), "ambiguous")


def redaction_counts(spark, sf_dir):
    return telemetry.redaction_counts(table(spark, sf_dir, "documents").select("text").unionAll(table(spark, sf_dir, "conversations").select("text")))


def url_surgery(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", strip_url(F.col("url")).alias("bare"), F.col("url").contains("?").alias("had_query"), F.col("url").contains("#").alias("had_fragment"))


def _spans(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    path = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("/"), "event_type")).otherwise(F.concat(F.lit("/"), "event_type", F.lit("/"), F.col("user_id").cast("string")))
    method = F.when(F.col("event_id") % 3 == 0, "POST").when(F.col("event_id") % 3 == 1, "GET")
    return ev.select(F.col("event_id").alias("span_id"), method.alias("method"), path.alias("path"), F.concat(F.lit("svc"), (F.col("user_id") % 7).cast("string")).alias("service"))


def _routes(spark):
    return spark.createDataFrame(ROUTES, "method string, template string, operation_id string")


ROUTES = [
    ("GET", "/click/{id}", "getClick"), (None, "/click/7", "clickSeven"), ("POST", "/view/{id}", "postView"), ("GET", "/{kind}", "list"),
    ("GET", "/purchase/{id}", "purchaseA"), ("GET", "/purchase/{other}", "purchaseB"), (None, "/signup/{id}", "signup"),
]


def route_subsumption(spark, sf_dir):
    return telemetry.match_routes(_spans(spark, sf_dir), _routes(spark))


def undocumented_routes(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    return telemetry.undocumented_routes(spans, telemetry.match_routes(spans, _routes(spark)))


def route_template_match(spark, sf_dir):
    return telemetry.duplicated_routes(_routes(spark))


def dead_symbols(spark, sf_dir):
    ev = table(spark, sf_dir, "events").where("user_id % 4 <> 0").select(F.col("user_id"), F.to_date(F.col("ts").cast("timestamp")).cast("string").alias("window_id"))
    declared = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return telemetry.unseen(declared, ev, "user_id", ev, 10)


def occupancy_keys(spark, sf_dir):
    s = _spans(spark, sf_dir)
    key = telemetry.occupancy_key(F.when(F.col("span_id") % 2 == 0, F.regexp_replace("path", "[0-9]+", "{id}")), F.when(F.col("span_id") % 3 == 0, F.col("service")), F.when(F.col("span_id") % 5 == 0, F.lit("rpc.Call")))
    return s.groupBy(key.alias("key")).agg(F.count("*").alias("spans"))


QUERIES = {f.__name__: f for f in (
    fact_intervals, facts_active_at, journal_stats, snapshot_digest, lineage_exact, lineage_similar, lineage_best, redaction_counts, url_surgery,
    route_subsumption, undocumented_routes, route_template_match, dead_symbols, occupancy_keys,
)}

_FACTS = """with d as (select distinct floor(epoch(ts) / 86400)::bigint as day, user_id::varchar as subject, event_type as object from events),
o as (select day - (select min(day) from d) as idx, subject, object from d), r as (select *, idx - row_number() over (partition by subject, object order by idx) as island from o),
s as (select subject, object, min(idx) as opened_idx, max(idx) as last_idx from r group by subject, object, island),
facts as (select sha256(subject || chr(0) || 'does' || chr(0) || object || chr(0) || opened_idx::varchar || chr(0)) as fact_id, subject, 'does' as predicate, object, opened_idx,
  case when last_idx < (select max(idx) from o) then last_idx + 1 end as closed_idx from s),
active as (select p.at_ as "at", facts.* from facts join (values (3::bigint), (11), (29)) p(at_) on opened_idx <= at_ and (closed_idx is null or closed_idx > at_))"""

_SIM = """with d as (select 'src/' || doc_id::varchar as path, doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) as t from documents),
b as (select path, unnest(t) as w, len(t) as n from d where doc_id % 3 <> 0), a as (select path, unnest(t) as w, len(t) as n from d where doc_id % 3 <> 1),
c as (select b.path as f, a.path as t, count(*) as common, min(b.n) + min(a.n) - count(*) as u from b join a on b.w = a.w and b.path <> a.path group by 1, 2),
pairs as (select * from c where common >= u * 0.85)"""

_ROUTE = """with spans as (select event_id as span_id, case event_id % 3 when 0 then 'POST' when 1 then 'GET' end as method,
  case when event_id % 5 = 0 then '/' || event_type else '/' || event_type || '/' || user_id::varchar end as path, 'svc' || (user_id % 7)::varchar as service from events),
routes as (select * from (values ('GET', '/click/{id}', 'getClick'), (null, '/click/7', 'clickSeven'), ('POST', '/view/{id}', 'postView'), ('GET', '/{kind}', 'list'),
  ('GET', '/purchase/{id}', 'purchaseA'), ('GET', '/purchase/{other}', 'purchaseB'), (null, '/signup/{id}', 'signup')) t(method, template, operation_id)),
hits as (select span_id, operation_id, len(regexp_extract_all(template, '\\{[^/]*\\}')) as holes from spans join routes r
  on regexp_full_match(path, regexp_replace(template, '\\{[^/]*\\}', '[^/]+', 'g')) and (r.method is null or spans.method is null or r.method = spans.method)),
best as (select span_id, operation_id from (select *, rank() over (partition by span_id order by holes) as k from hits) where k = 1),
m as (select span_id, count(distinct operation_id) as n, min(operation_id) as operation_id from best group by 1),
matches as (select s.span_id, operation_id, case when n is null then 'undocumented' when n > 1 then 'ambiguous' else 'matched' end as outcome from spans s left join m on s.span_id = m.span_id)"""

ORACLE = {
    "fact_intervals": _FACTS + " select * from facts",
    "facts_active_at": _FACTS + ' select "at", fact_id from active',
    "journal_stats": _FACTS + " select count(*)::bigint as total, count(*) filter (where closed_idx is null)::bigint as active, count(closed_idx)::bigint as retired from facts",
    "snapshot_digest": _FACTS + """, h as (select distinct "at"::varchar as "at", sha256(subject || ' does ' || object) as h from active),
p6 as (select "at", substr(h, 1, 6) as b, count(*) as n, sha256(string_agg(h, '' order by h)) as part from h group by 1, 2),
p4 as (select "at", substr(b, 1, 4) as b, sum(n) as n, sha256(string_agg(part, '' order by p6.b)) as part from p6 group by 1, substr(p6.b, 1, 4)),
p2 as (select "at", substr(b, 1, 2) as b, sum(n) as n, sha256(string_agg(part, '' order by p4.b)) as part from p4 group by 1, substr(p4.b, 1, 2))
select "at", sum(n)::bigint as n, sha256(string_agg(part, '' order by p2.b)) as digest from p2 group by 1""",
    "lineage_exact": with_ctes(""", gone as (select * from before_files where path not in (select path from after_files)), new as (select * from after_files where path not in (select path from before_files)),
g as (select content_hash as h, count(*) as nf, min(path) as f from gone group by 1), n as (select content_hash as h, count(*) as nt, min(path) as t from new group by 1), both_ as (select g.h, nf, f, nt, t from g join n on g.h = n.h)
select 'renamed' as kind, f as from_path, t as to_path, 'verified' as coverage from both_ where nf = 1 and nt = 1
union all select 'renamed', path, null, 'partial' from gone where content_hash in (select h from both_ where nf > 1 or nt > 1)
union all select 'renamed', null, path, 'partial' from new where content_hash in (select h from both_ where nf > 1 or nt > 1)""", "before_files", "after_files"),
    "lineage_similar": _SIM + " select f as from_path, t as to_path, common::bigint as common, u::bigint as all_tokens from pairs",
    "lineage_best": _SIM + """, k as (select f, t, common / u as s, row_number() over (partition by f order by common / u desc, t) as k, lead(common / u) over (partition by f order by common / u desc, t) as nx from pairs)
select f as from_path, t as to_path, round(s, 9) as similarity, coalesce(s - nx < 0.05, false) as ambiguous from k where k = 1""",
    "url_surgery": r"""select page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^([A-Za-z][A-Za-z0-9+.\-]*://)[^/]*@', '\1') as bare, contains(url, '?') as had_query, contains(url, '#') as had_fragment from pages""",
    "redaction_counts": r"""with w as (select unnest(regexp_split_to_array(text, '[ \t\n\r\f\v]+')) as w from (select text from documents union all select text from conversations)),
c as (select w, list_transform(range(length(w)), lambda i: (substr(reverse(w), i + 1, 1)::int) * (1 + i % 2)) as d from w where regexp_full_match(w, '[0-9]{13,19}')),
l as (select w, list_sum(list_transform(d, lambda x: case when x > 9 then x - 9 else x end)) % 10 = 0 as ok from c)
select kind, count(*)::bigint as n from (
  select case when regexp_full_match(w, 'eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*') then 'jwt' when regexp_full_match(w, '(AKIA|ASIA)[A-Z0-9]{16}') then 'aws_key'
    when regexp_full_match(w, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}') then 'email'
    when regexp_full_match(w, '((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])') then 'ipv4'
    when regexp_full_match(w, '([0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}') then 'mac'
    when regexp_full_match(w, '([0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(([0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4})?::(([0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4})?') then 'ipv6' end as kind from w
  union all select 'card' from l where ok) where kind is not null group by 1""",
    "route_subsumption": _ROUTE + " select * from matches",
    "undocumented_routes": _ROUTE + r""", lost as (select * from spans where span_id in (select span_id from matches where outcome = 'undocumented'))
select regexp_replace(regexp_replace(path, '/[0-9]+/', '/{}/', 'g'), '/[0-9]+$', '/{}') as shape, method, min(path) as example, string_agg(distinct service, ',' order by service) as services, count(*)::bigint as invocations from lost group by 1, 2""",
    "route_template_match": _ROUTE + r""" select regexp_replace(template, '\{[^/]*\}', '{}', 'g') as shape, method, count(*)::bigint as n from routes group by 1, 2 having count(*) > 1""",
    "dead_symbols": """with ev as (select user_id, ts::date as w from events where user_id % 4 <> 0)
select c_custkey as user_id, case when (select count(distinct w) from ev) >= 10 then 'dead' else 'insufficient_evidence' end as verdict from customer where c_custkey not in (select user_id from ev)""",
    "occupancy_keys": _ROUTE + r""" select case when span_id % 2 = 0 then 'route:' || regexp_replace(path, '/[0-9]+', '/{}', 'g') when span_id % 3 = 0 then 'function:' || service when span_id % 5 = 0 then 'rpc:rpc.Call' else 'uncorrelated' end as key,
  count(*)::bigint as spans from spans group by 1""",
}
