"""Queries of test selection, catalog, contracts, sessions and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataspark.operators import catalog, events, impact, selection
from strataspark.plans.inputs import table, views, with_ctes


def _hits(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.concat(F.lit("t"), (F.col("l_orderkey") % 40).cast("string")).alias("suite_id"), F.col("l_suppkey").cast("bigint").alias("source"), F.when(F.col("l_quantity") > 25, F.col("l_quantity")).otherwise(0).cast("bigint").alias("hits"))


def _affected(spark, sf_dir):
    (calls,) = views(spark, sf_dir, "calls")
    changed = table(spark, sf_dir, "supplier").where("s_suppkey % 50 = 4").select(F.col("s_suppkey").cast("bigint").alias("id"))
    return selection.affected_sources(calls, changed)


def test_selection(spark, sf_dir):
    hits = _hits(spark, sf_dir).where("source % 3 = 0")
    suites = _hits(spark, sf_dir).select("suite_id").distinct().withColumn("coverage", F.when(F.length("suite_id") == 2, "verified").otherwise("partial"))
    imports = _hits(spark, sf_dir).where("source % 7 = 1 and hits > 48").select("suite_id", "source").distinct()
    return selection.plan(suites, imports, hits, _affected(spark, sf_dir))


def predictive_ranking(spark, sf_dir):
    return selection.rank_suites(_hits(spark, sf_dir).where("hits > 45"), _affected(spark, sf_dir))


def coverage_merge(spark, sf_dir):
    h = _hits(spark, sf_dir).withColumn("path", F.col("source").cast("string"))
    a = h.where("source % 2 = 0").select("suite_id", "path", F.lit("verified").alias("coverage"))
    b = h.where("source % 9 = 3 and length(suite_id) = 2").select("suite_id", "path", F.lit("partial").alias("coverage"))
    return selection.merge_matrices(a, b)


def coverage_fold(spark, sf_dir):
    (supply,) = views(spark, sf_dir, "supply")
    from strataspark.functions.coverage import fold

    return supply.groupBy("src").agg(fold(F.col("coverage")).alias("coverage"))


def lcov_carry_forward(spark, sf_dir):
    o = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("t"), (F.col("l_orderkey") % 40).cast("string")).alias("suite_id"), (F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10 + F.col("l_suppkey") % 10).alias("line_no"), "l_linenumber", "l_partkey", "l_quantity").groupBy("suite_id", "line_no").agg(F.min("l_linenumber").alias("k"), F.min("l_partkey").alias("p"), F.min("l_quantity").cast("bigint").alias("q"))
    text = F.when(F.col("k") == 1, F.concat(F.lit("SF:src/"), F.col("p").cast("string"))).otherwise(F.concat(F.lit("DA:"), (F.col("p") % 20).cast("string"), F.lit(","), F.col("q").cast("string")))
    return selection.lcov_hits(o.select("suite_id", "line_no", text.alias("text")))


def bench_metrics(spark, sf_dir):
    h = _hits(spark, sf_dir)
    return selection.classification_metrics(h.where("source % 3 <> 0").select(F.col("suite_id").alias("task"), F.col("source").alias("item")), h.where("source % 4 <> 0 and hits > 30").select(F.col("suite_id").alias("task"), F.col("source").alias("item")))


def _entities(spark, sf_dir):
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(
        s.s_name.alias("reference"), n.n_name.alias("owner"), r.r_name.alias("domain"), F.when(s.s_suppkey % 11 == 0, n.n_name).alias("system"), s.s_suppkey.alias("k"))


def ownership_rollup(spark, sf_dir):
    e = _entities(spark, sf_dir)
    return catalog.rollup(e, "owner").withColumnRenamed("owner", "key").unionAll(catalog.rollup(e, "domain"))


def dangling_refs(spark, sf_dir):
    refs = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("target"))
    known = table(spark, sf_dir, "supplier").where("s_suppkey % 8 <> 3").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("reference"))
    return catalog.dangling(refs, known)


def subcomponent_chain(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    ref = F.col("s_suppkey").cast("string")
    e = s.select(ref.alias("reference"), F.when(F.col("s_suppkey") % 12 == 0, F.concat(F.lit("sys"), ref)).alias("system"), F.when(F.col("s_suppkey") % 10 != 9, (F.col("s_suppkey") + 1).cast("string")).alias("parent"))
    return catalog.resolve_systems(e).select("reference", "system", F.col("hops").cast("bigint").alias("hops"))


def org_blast_radius(spark, sf_dir):
    e = _entities(spark, sf_dir).select(F.concat(F.lit("s"), F.col("k").cast("string")).alias("reference"), "owner")
    (calls,) = views(spark, sf_dir, "calls")
    dep = calls.select(F.concat(F.lit("s"), F.col("src").cast("string")).alias("reference"), F.concat(F.lit("s"), F.col("dst").cast("string")).alias("target"))
    li = table(spark, sf_dir, "lineitem")
    uses = li.where("l_linenumber > 4").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("reference"), F.col("l_partkey").alias("api"))
    gives = li.where("l_linenumber = 1").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("reference"), F.col("l_partkey").alias("api"))
    return catalog.org_blast_radius(e, dep, gives, uses, "s7")


def enclosing_package(spark, sf_dir):
    (symbols,) = views(spark, sf_dir, "symbols")
    packages = symbols.select(F.substring_index("path", "/", 1).alias("directory")).union(symbols.where("kind = 'class'").select(F.substring_index("path", "/", 2))).distinct()
    return catalog.enclosing_package(symbols.select("path").distinct(), packages.withColumn("package", F.concat(F.lit("pkg:"), "directory")))


def schema_compat(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    base = li.groupBy(F.col("l_suppkey").alias("subject"), (F.col("l_partkey") % 9).cast("string").alias("field")).agg(F.min("l_orderkey").alias("k"))
    old = base.where("k % 5 <> 0").select("subject", F.lit("old").alias("side"), "field", (F.col("k") % 2 == 0).alias("required"))
    new = base.where("k % 7 <> 0").select("subject", F.lit("new").alias("side"), "field", (F.col("k") % 3 == 0).alias("required"))
    out = [catalog.schema_compatibility(old.unionAll(new), m).withColumn("mode", F.lit(m)) for m in ("strict", "backward", "forward", "full")]
    return out[0].unionAll(out[1]).unionAll(out[2]).unionAll(out[3])


def async_flow_pairs(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    side = li.groupBy((F.col("l_partkey") % 60).cast("string").alias("channel"), (F.col("l_suppkey") % 4).cast("string").alias("message"), F.col("l_returnflag").alias("r")).agg(F.array_sort(F.collect_set((F.col("l_orderkey") % 6).cast("string"))).alias("fields"))
    prod = side.where("r = 'A' and channel <> '5'").select("channel", "message", F.concat_ws("-", F.lit("p"), "channel", "message").alias("id"), "fields")
    cons = side.where("r = 'R' and message <> '1'").select("channel", "message", F.concat_ws("-", F.lit("c"), "channel", "message").alias("id"), "fields")
    return catalog.flow_pairs(prod, cons)


def change_severity(spark, sf_dir):
    kinds = spark.createDataFrame([(k,) for k in CHANGE_KINDS], "kind string")
    return kinds.select("kind", catalog.severity(F.col("kind")).alias("severity"))


CHANGE_KINDS = [*catalog.BREAKING, *catalog.NON_BREAKING, *catalog.UNDECIDED]


def change_verdicts(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    kind = F.element_at(F.array(*[F.lit(k) for k in CHANGE_KINDS]), (F.col("event_id") % len(CHANGE_KINDS) + 1).cast("int"))
    return catalog.verdict(ev.select(F.col("user_id").alias("subject"), catalog.severity(kind).alias("severity")))


def session_ledger(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return events.ledger(ev.select(F.col("user_id").alias("session_id"), (F.col("event_type") == "view").alias("hit"), F.length("props").cast("bigint").alias("spent"), (F.col("event_id") % 50).alias("saved")))


def event_cursor_page(spark, sf_dir):
    return events.cursor_page(table(spark, sf_dir, "events").select(F.col("event_id").alias("seq_id"), "event_type", F.col("props").alias("data_json")), 4321, 100)


def event_merge(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq_id"), "event_type")
    return events.merge_replay(ev.where("seq_id % 5 = 0").withColumn("event_type", F.upper("event_type")), ev.where("seq_id % 3 = 0"))


def debounce_batches(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    out = events.debounce(ev.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("path")), "2 hours")
    return out.select("key", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"), "paths", "n")


def incident_candidates(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    deployments = ev.where("event_type = 'purchase'").select(F.col("event_id").alias("commit"), ms.alias("ts"))
    windows = ev.where("event_type = 'signup' and event_id % 5 = 0").select(F.concat(F.lit("svc"), F.col("user_id").cast("string")).alias("service"), (ms - 3_600_000).alias("start_ms"), ms.alias("end_ms"))
    return events.incident_candidates(deployments, windows, 3_600_000)


def session_receipts(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return events.receipts(ev.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("idx"), F.when(F.col("event_id") % 4 != 3, (F.col("event_id") % 4 == 2).cast("int")).alias("exit_code")))


def layout_golden_angle(spark, sf_dir):
    return events.golden_angle_layout(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")))


def overload_ids(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return events.disambiguate(p.select(F.concat_ws("#", "p_brand", "p_type", F.col("p_size").cast("string")).alias("id"), F.concat_ws("/", "p_name", F.col("p_partkey").cast("string")).alias("signature")))


def edit_verdict(spark, sf_dir):
    """An edit removes every 33rd supplier from the call graph: broken references, callers, newly dead nodes, verdict."""
    (calls,) = views(spark, sf_dir, "calls")
    removed = table(spark, sf_dir, "supplier").where("s_suppkey % 33 = 5").select(F.col("s_suppkey").cast("bigint").alias("id"))
    broken = calls.where("kind in ('imports', 'calls', 'references')").join(removed.withColumnRenamed("id", "dst"), "dst", "left_semi").join(removed.withColumnRenamed("id", "src"), "src", "left_anti")
    callers = impact.damaged_callers(calls.where("kind = 'calls'"), removed, 64)
    lost = calls.where("kind = 'calls'").join(removed.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct().join(removed, "id", "left_anti")
    kept = calls.where("kind = 'calls'").join(removed.withColumnRenamed("id", "src"), "src", "left_anti").select(F.col("dst").alias("id"))
    counts = [broken.agg(F.count("*").alias("broken_refs")), callers.agg(F.count_if(F.col("severity") == "breaking_error").alias("direct_callers"), F.count("*").alias("callers")), lost.join(kept, "id", "left_anti").agg(F.count("*").alias("newly_dead"))]
    one = counts[0].crossJoin(counts[1]).crossJoin(counts[2])
    return one.withColumn("verdict", F.when(F.col("direct_callers") > 0, "FAIL").when((F.col("broken_refs") > 0) | (F.col("newly_dead") > 0), "WARN").otherwise("PASS"))


QUERIES = {f.__name__: f for f in (
    test_selection, predictive_ranking, coverage_merge, coverage_fold, lcov_carry_forward, bench_metrics, ownership_rollup, dangling_refs, subcomponent_chain,
    org_blast_radius, enclosing_package, schema_compat, async_flow_pairs, change_severity, change_verdicts, session_ledger, event_cursor_page, event_merge,
    debounce_batches, incident_candidates, session_receipts, layout_golden_angle, overload_ids, edit_verdict,
)}

_HITS = """, hits as (select 't' || (l_orderkey % 40)::varchar as suite_id, l_suppkey::bigint as source, (case when l_quantity > 25 then l_quantity else 0 end)::bigint as hits from lineitem),
e as (select distinct dst as u, src as v from calls where src <> dst),
aff as (select s_suppkey::bigint as id from supplier where s_suppkey % 50 = 4 union select v from aff join e on u = id)"""
_ENT = """with ent as (select s_name as reference, n_name as owner, r_name as domain, s_suppkey as k from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""
_SEV = f"case when list_contains({catalog.BREAKING}, kind) then 'breaking' when list_contains({catalog.NON_BREAKING}, kind) then 'non_breaking' else 'unknown' end"
_KINDS = "['" + "', '".join(CHANGE_KINDS) + "']"

ORACLE = {
    "test_selection": with_ctes(_HITS + """, st as (select distinct suite_id from hits where source % 7 = 1 and hits > 48 and source in (select id from aff)),
dy as (select distinct suite_id from hits where source % 3 = 0 and hits > 0 and source in (select id from aff)), su as (select distinct suite_id from hits)
select suite_id, case when (select count(*) from aff) = 0 then 'run_all' when suite_id in (select suite_id from st) then 'run_static' when suite_id in (select suite_id from dy) then 'run_dynamic'
  when length(suite_id) <> 2 then 'run_unruled' else 'skip' end as decision from su""", "calls", recursive=True),
    "predictive_ranking": with_ctes(_HITS + """, t as (select count(*) as total from aff)
select suite_id, count(distinct source)::bigint as observed, (select total from t)::bigint as total, round(count(distinct source) / (select total from t), 9) as probability from hits where hits > 45 and source in (select id from aff) group by 1""", "calls", recursive=True),
    "coverage_merge": with_ctes(_HITS + """, m as (select suite_id, source, 0 as r from hits where source % 2 = 0 union all select suite_id, source, 1 from hits where source % 9 = 3 and length(suite_id) = 2)
select suite_id, count(distinct source)::bigint as files, case max(r) when 0 then 'verified' else 'partial' end as coverage from m group by 1""", "calls", recursive=True),
    "coverage_fold": with_ctes(""" select src, case max(case coverage when 'verified' then 0 when 'partial' then 1 when 'unsupported' then 2 else 3 end) when 0 then 'verified' when 1 then 'partial' when 2 then 'unsupported' else 'unknown' end as coverage from supply group by 1""", "supply"),
    "lcov_carry_forward": """with o as (select 't' || (l_orderkey % 40)::varchar as suite_id, l_orderkey * 100 + l_linenumber * 10 + l_suppkey % 10 as line_no, min(l_linenumber) as k, min(l_partkey) as p, min(l_quantity)::bigint as q from lineitem group by 1, 2),
w as (select *, last_value(case when k = 1 then 'src/' || p::varchar end ignore nulls) over (partition by suite_id order by line_no rows unbounded preceding) as path from o)
select suite_id, path, (p % 20)::int as line, sum(q)::bigint as hits from w where k <> 1 group by 1, 2, 3""",
    "bench_metrics": with_ctes(_HITS + """, p as (select distinct suite_id as task, source from hits where source % 3 <> 0), t as (select distinct suite_id as task, source from hits where source % 4 <> 0 and hits > 30),
c as (select coalesce(p.task, t.task) as task, count(*) filter (where p.task is not null and t.task is not null) as tp, count(*) filter (where t.task is null) as fp, count(*) filter (where p.task is null) as fn from p full join t on p.task = t.task and p.source = t.source group by 1)
select task, tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, case when tp + fp = 0 then 0.0 else round(tp / (tp + fp), 9) end as precision, case when tp + fn = 0 then 0.0 else round(tp / (tp + fn), 9) end as recall,
  case when 2 * tp + fp + fn = 0 then 0.0 else round(2 * tp / (2 * tp + fp + fn), 9) end as f1 from c""", "calls", recursive=True),
    "ownership_rollup": _ENT + " select owner as key, count(*)::bigint as n, min(reference) as first, max(reference) as last from ent group by 1 union all select domain, count(*), min(reference), max(reference) from ent group by 1",
    "dangling_refs": "select 's' || l_suppkey::varchar as target, count(*)::bigint as n from lineitem where not exists (select 1 from supplier where s_suppkey = l_suppkey and s_suppkey % 8 <> 3) group by 1",
    "subcomponent_chain": """with recursive e as (select s_suppkey::bigint as r, case when s_suppkey % 12 = 0 then 'sys' || s_suppkey::varchar end as system, case when s_suppkey % 10 <> 9 then s_suppkey + 1 end as parent from supplier),
w as (select r as reference, system, parent, 0 as hops from e union all select w.reference, e.system, e.parent, hops + 1 from w left join e on e.r = w.parent where w.system is null and w.parent is not null and hops < 32)
select reference::varchar as reference, system, hops::bigint as hops from w where system is not null or parent is null""",
    "org_blast_radius": with_ctes(""", ent as (select s_suppkey as k, n_name as owner from supplier join nation on s_nationkey = n_nationkey),
hit as (select src as k from calls where dst = 7 union select l_suppkey from lineitem where l_linenumber > 4 and l_partkey in (select l_partkey from lineitem where l_linenumber = 1 and l_suppkey = 7))
select owner, count(distinct k)::bigint as n from ent where k in (select k from hit) and k <> 7 group by 1""", "calls"),
    "enclosing_package": with_ctes(""", pk as (select split_part(path, '/', 1) as d from symbols union select split_part(path, '/', 1) || '/' || split_part(path, '/', 2) from symbols where kind = 'class'),
f as (select distinct path from symbols) select path, (select 'pkg:' || d from pk where starts_with(path, d || '/') order by length(d) desc limit 1) as package from f""", "symbols"),
    "schema_compat": """with base as (select l_suppkey as subject, (l_partkey % 9)::varchar as field, min(l_orderkey) as k from lineitem group by 1, 2),
c as (select subject, count(*) filter (where k % 5 = 0 and k % 7 <> 0 and k % 3 = 0) as ar, count(*) filter (where k % 5 = 0 and k % 7 <> 0 and k % 3 <> 0) as ao, count(*) filter (where k % 7 = 0 and k % 5 <> 0) as rm,
  count(*) filter (where k % 7 = 0 and k % 5 <> 0 and k % 2 = 0) as rr from base where k % 5 <> 0 or k % 7 <> 0 group by 1)
select subject, ar::bigint as added_required, ao::bigint as added_optional, rm::bigint as removed, case mode when 'strict' then ar + ao + rm = 0 when 'backward' then ar = 0 when 'forward' then rr = 0 else ar = 0 and rr = 0 end as compatible, mode
from c cross join (values ('strict'), ('backward'), ('forward'), ('full')) m(mode)""",
    "async_flow_pairs": """with side as (select (l_partkey % 60)::varchar as channel, (l_suppkey % 4)::varchar as message, l_returnflag as r, list(distinct (l_orderkey % 6)::varchar) as fields from lineitem group by 1, 2, 3),
p as (select * from side where r = 'A' and channel <> '5'), c as (select * from side where r = 'R' and message <> '1'),
j as (select coalesce(p.channel, c.channel) as channel, coalesce(p.message, c.message) as message, case when p.r is not null then 'p-' || p.channel || '-' || p.message end as producer, case when c.r is not null then 'c-' || c.channel || '-' || c.message end as consumer,
  case when p.r is not null and c.r is not null then list_sort(list_filter(c.fields, lambda x: not list_contains(p.fields, x))) end as missing from p full join c on p.channel = c.channel and p.message = c.message)
select channel, message, producer, consumer, array_to_string(missing, ',') as missing, case when missing is null then 'unchecked' when len(missing) > 0 then 'incompatible' else 'compatible' end as verdict from j""",
    "change_severity": f"select kind, {_SEV} as severity from (select unnest({_KINDS}) as kind)",
    "change_verdicts": f"""with c as (select user_id as subject, {_KINDS}[event_id % {len(CHANGE_KINDS)} + 1] as kind from events), s as (select subject, {_SEV} as severity from c)
select subject, case when bool_or(severity = 'breaking') then 'breaking' when bool_or(severity = 'unknown') then 'unknown' else 'compatible' end as verdict from s group by 1""",
    "session_ledger": """with g as (select user_id as session_id, count(*) as queries, count(*) filter (where event_type = 'view') as hits, sum(length(props)) as spent, sum(event_id % 50) as saved from events group by 1)
select session_id, queries::bigint as queries, hits::bigint as hits, spent::bigint as spent, saved::bigint as saved, (saved * 3)::bigint as cost, round(case when spent + saved = 0 then 0.0 else least(99.9, greatest(0.0, 100.0::double * saved / (spent + saved))) end, 6) as saved_percent, round(hits / queries, 6) as hit_ratio from g""",
    "event_cursor_page": "select event_id as seq_id, event_type, props as data_json from events where event_id > 4321 order by 1 limit 100",
    "event_merge": "select event_id as seq_id, case when event_id % 5 = 0 then upper(event_type) else event_type end as event_type from events where event_id % 5 = 0 or event_id % 3 = 0",
    "debounce_batches": """with o as (select user_id as key, ts, event_type, case when lag(ts) over (partition by user_id order by ts) is null or ts - lag(ts) over (partition by user_id order by ts) >= interval 2 hour then 1 else 0 end as new from events),
b as (select *, sum(new) over (partition by key order by ts rows unbounded preceding) as b from o)
select key, epoch_us(min(ts)) as first_us, epoch_us(max(ts)) as last_us, string_agg(distinct event_type, ',' order by event_type) as paths, count(*)::bigint as n from b group by key, b""",
    "incident_candidates": """select d.event_id as "commit", (epoch_us(d.ts) // 1000) as ts, 'svc' || w.user_id::varchar as service, (epoch_us(w.ts) // 1000) - 3600000 as start_ms, (epoch_us(w.ts) // 1000) as end_ms
from events d join events w on w.event_type = 'signup' and w.event_id % 5 = 0 and (epoch_us(d.ts) // 1000) between (epoch_us(w.ts) // 1000) - 3600000 and (epoch_us(w.ts) // 1000) where d.event_type = 'purchase'""",
    "session_receipts": """select user_id as session_id, count(*)::bigint as steps, count(*) filter (where event_id % 4 = 2)::bigint as failed,
  case max(event_id) % 4 when 3 then 'UNKNOWN' when 2 then 'FAIL' else 'PASS' end as verdict from events group by 1""",
    "layout_golden_angle": """with n as (select p_partkey as id, row_number() over (order by p_partkey) - 1 as i, count(*) over () as total from part),
z as (select id, 1 - 2 * (i + 0.5::double) / total as z, i * (3.141592653589793::double * (3 - sqrt(5::double))) as a from n)
select id, round(sqrt(greatest(0.0, 1 - z * z)) * cos(a) * 10, 4) as x, round(sqrt(greatest(0.0, 1 - z * z)) * sin(a) * 10, 4) as y, round(z * 10, 4) as z from z""",
    "overload_ids": """with s as (select p_brand || '#' || p_type || '#' || p_size::varchar as id, p_name || '/' || p_partkey::varchar as signature from part),
k as (select *, row_number() over (partition by id order by signature) as k, count(*) over (partition by id) as n from s) select case when n > 1 then id || ':overload:' || k::varchar else id end as id, signature from k""",
    "edit_verdict": with_ctes(""", rm as (select s_suppkey::bigint as id from supplier where s_suppkey % 33 = 5), b as (select count(*) as n from calls where dst in (select id from rm) and src not in (select id from rm)),
e as (select distinct dst as u, src as v from calls where kind = 'calls' and src <> dst),
walk as (select id as broken, id, 0 as hops from rm union select broken, v, hops + 1 from walk join e on id = u where hops < 64),
c as (select broken, id, min(hops) as hops from walk group by 1, 2 having min(hops) > 0),
d as (select count(distinct dst) as n from calls where kind = 'calls' and src in (select id from rm) and dst not in (select id from rm) and dst not in (select dst from calls where kind = 'calls' and src not in (select id from rm)))
select (select n from b)::bigint as broken_refs, count(*) filter (where hops = 1)::bigint as direct_callers, count(*)::bigint as callers, (select n from d)::bigint as newly_dead,
  case when count(*) filter (where hops = 1) > 0 then 'FAIL' when (select n from b) > 0 or (select n from d) > 0 then 'WARN' else 'PASS' end as verdict from c""", "calls", recursive=True),
}
