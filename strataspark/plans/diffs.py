"""Queries of snapshot diffs, contracts, policies and commit trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataspark.operators import diff, policy
from strataspark.plans.inputs import table, views, with_ctes


def file_diff_renames(spark, sf_dir):
    return diff.file_diff(*views(spark, sf_dir, "before_files", "after_files"))


def _symbols(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    cols = [
        p.p_partkey.cast("string").alias("id"), F.concat(F.lower("p_type"), F.lit("/"), (p.p_partkey % 97).cast("string")).alias("path"),
        F.when(p.p_size % 2 == 0, "function").otherwise("class").alias("kind"), F.when(p.p_partkey % 17 != 0, p.p_name).alias("signature"),
        F.when(p.p_partkey % 4 == 0, "private").otherwise("public").alias("visibility"), p.p_size.alias("line"),
    ]
    before = p.where("p_partkey % 19 <> 0").select(*cols)
    moved = p.where("p_partkey % 23 <> 0").select(
        F.when(p.p_partkey % 29 == 0, F.concat(F.lit("n"), cols[0])).otherwise(p.p_partkey.cast("string")).alias("id"), cols[1], cols[2],
        F.when(p.p_partkey % 31 == 0, F.lit("changed")).otherwise(F.when(p.p_partkey % 17 != 0, p.p_name)).alias("signature"),
        F.when((p.p_partkey % 4 == 0) | (p.p_partkey % 37 == 0), "private").otherwise("public").alias("visibility"),
        (p.p_size + F.when(p.p_partkey % 41 == 0, 1).otherwise(0)).alias("line"),
    )
    return before, moved


def symbol_diff(spark, sf_dir):
    return diff.symbol_diff(*_symbols(spark, sf_dir))


def _parameters(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    base = li.groupBy(F.col("l_orderkey").alias("owner"), F.col("l_linenumber").cast("string").alias("name")).agg(
        F.min("l_returnflag").alias("type"), (F.min("l_partkey") % 5 == 0).alias("optional"), F.min("l_partkey").alias("k")
    )
    before = base.where("k % 13 <> 0").select("owner", "name", "type", "optional")
    kind = F.when(F.col("k") % 17 == 0, "X").otherwise(F.col("type"))
    after = base.where("k % 11 <> 0").select("owner", "name", kind.alias("type"), F.when(F.col("k") % 19 == 0, ~F.col("optional")).otherwise(F.col("optional")).alias("optional"))
    return before, after


def contract_diff(spark, sf_dir):
    r = diff.parameter_reasons(*_parameters(spark, sf_dir))
    return r.groupBy("reason", "breaking").agg(F.count("*").alias("n"), F.countDistinct("owner").alias("owners"))


def api_verdicts(spark, sf_dir):
    before, after = _parameters(spark, sf_dir)
    coverage = after.select("owner").distinct().withColumn("coverage", F.when(F.col("owner") % 4 == 0, "partial").otherwise("verified"))
    return diff.api_verdict(diff.parameter_reasons(before, after), coverage)


def edge_diff(spark, sf_dir):
    (supply,) = views(spark, sf_dir, "supply")
    before = supply.where("length(src) + length(dst) <> 7 or kind <> 'calls'")
    after = supply.where("kind <> 'imports' or coverage <> 'partial'")
    d = diff.full_diff(before, after, ["src", "dst", "kind"], ["coverage"])
    return d.groupBy("type", "kind").agg(F.count("*").alias("n"))


def diff_summary(spark, sf_dir):
    files = file_diff_renames(spark, sf_dir).select(F.lit("file").alias("family"), "type")
    symbols = symbol_diff(spark, sf_dir).select(F.lit("symbol").alias("family"), "type")
    return diff.diff_summary(files.unionAll(symbols))


def forbidden_dep(spark, sf_dir):
    supply, symbols = views(spark, sf_dir, "supply", "symbols")
    bad = policy.forbidden_dependencies(policy.with_paths(supply, symbols), "*/brand#1*", "supply/[!0-4]/*")
    return bad.select("src", "dst", "kind", "src_path", "dst_path")


def layers(spark, sf_dir):
    supply, symbols = views(spark, sf_dir, "supply", "symbols")
    bad = policy.layer_violations(policy.with_paths(supply, symbols), ["supply/1", "brand#2", "supply", "brand#1"])
    return bad.groupBy("src_layer", "dst_layer").agg(F.count("*").alias("n")).select(F.col("src_layer").cast("bigint").alias("src_layer"), F.col("dst_layer").cast("bigint").alias("dst_layer"), "n")


def new_cycles(spark, sf_dir):
    (calls,) = views(spark, sf_dir, "calls")
    found = policy.new_cycles(calls, calls.where("src % 10 <> 6"))
    return found.select("component", F.concat_ws(",", F.col("members").cast("array<string>")).alias("members"))


def debt_waiver(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    findings = o.select(F.col("o_orderkey").cast("string").alias("finding_id"), F.concat(F.lit("r"), (F.col("o_custkey") % 4).cast("string")).alias("rule_id"),
                        F.when(F.col("o_orderstatus") == "F", "fail").otherwise("unknown").alias("status"), F.col("o_orderpriority").alias("entity"))
    debts = spark.createDataFrame([("r0", "*", "all of r0"), ("r1", "URGENT", "urgent is known"), ("r1", "HIGH", "high is known"), ("r2", "1003", "one order")], "rule_id string, fingerprint string, waived_reason string")
    return policy.waive(findings, debts).select("finding_id", "rule_id", "status", "waived_reason")


def _tree(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.select((F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 86400)).alias("day"), "user_id", "event_type").groupBy("day", F.concat_ws("/", "user_id", "event_type").alias("path")).agg(F.count("*").cast("string").alias("blob"))


def _entries(spark, sf_dir):
    t = _tree(spark, sf_dir)
    first = t.agg(F.min("day").alias("first"))
    return t.crossJoin(F.broadcast(first)).select((F.col("day") - F.col("first")).cast("bigint").alias("idx"), "path", "blob")


def tree_diff_lag(spark, sf_dir):
    return diff.tree_changes(_entries(spark, sf_dir))


def commit_forensics(spark, sf_dir):
    return diff.commit_forensics(diff.tree_changes(_entries(spark, sf_dir)))


def positional_divergence(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    left = li.where("l_linenumber = 1").select(F.col("l_orderkey").alias("pos"), F.col("l_returnflag").alias("value")).groupBy("pos").agg(F.min("value").alias("value"))
    right = li.where("l_linenumber = 2").select(F.col("l_orderkey").alias("pos"), F.col("l_returnflag").alias("value")).groupBy("pos").agg(F.min("value").alias("value"))
    return diff.positional_divergence(left, right)


QUERIES = {f.__name__: f for f in (
    file_diff_renames, symbol_diff, contract_diff, api_verdicts, edge_diff, diff_summary, forbidden_dep, layers, new_cycles, debt_waiver,
    tree_diff_lag, commit_forensics, positional_divergence,
)}

_FILES = """, d as (select coalesce(b.path, a.path) as path, b.content_hash as oh, a.content_hash as nh,
  case when b.path is null then 'added' when a.path is null then 'removed' when b.content_hash <> a.content_hash then 'modified' end as type
  from before_files b full join after_files a on b.path = a.path),
g as (select oh as h, min(path) as f from d where type = 'removed' group by 1 having count(*) = 1),
n as (select nh as h, min(path) as t from d where type = 'added' group by 1 having count(*) = 1),
moved as (select f, t from g join n on g.h = n.h),
files as (select type, path, null as old_path from d where type is not null and not (type = 'removed' and path in (select f from moved)) and not (type = 'added' and path in (select t from moved))
  union all select 'renamed', t, f from moved)"""

_SYMS = """, p as (select *, p_partkey::varchar as pid, lower(p_type) || '/' || (p_partkey % 97)::varchar as path, case when p_size % 2 = 0 then 'function' else 'class' end as kind,
  case when p_partkey % 17 <> 0 then p_name end as sig from part),
sb as (select pid as id, path, kind, sig, case when p_partkey % 4 = 0 then 'private' else 'public' end as vis, p_size as line from p where p_partkey % 19 <> 0),
sa as (select case when p_partkey % 29 = 0 then 'n' || pid else pid end as id, path, kind, case when p_partkey % 31 = 0 then 'changed' else sig end as sig,
  case when p_partkey % 4 = 0 or p_partkey % 37 = 0 then 'private' else 'public' end as vis, p_size + case when p_partkey % 41 = 0 then 1 else 0 end as line from p where p_partkey % 23 <> 0),
sd as (select coalesce(b.id, a.id) as id, case when b.id is null then 'added' when a.id is null then 'removed' when b.sig is distinct from a.sig then 'signature_modified'
  when b.vis <> a.vis then 'visibility_modified' when b.line <> a.line or b.path <> a.path or b.kind <> a.kind then 'body_modified' end as type,
  b.path as bp, b.kind as bk, b.sig as bs, a.path as ap, a.kind as ak, a.sig as asg from sb b full join sa a on b.id = a.id),
sg as (select bp, bk, bs, min(id) as f from sd where type = 'removed' and bs is not null group by 1, 2, 3 having count(*) = 1),
sn as (select ap, ak, asg, min(id) as t from sd where type = 'added' and asg is not null group by 1, 2, 3 having count(*) = 1),
sm as (select f, t from sg join sn on bp = ap and bk = ak and bs = asg),
syms as (select type, id, null as old_id from sd where type is not null and not (type = 'removed' and id in (select f from sm)) and not (type = 'added' and id in (select t from sm))
  union all select 'renamed', t, f from sm)"""

_PARAMS = """with base as (select l_orderkey as owner, l_linenumber::varchar as name, min(l_returnflag) as type, min(l_partkey) % 5 = 0 as optional, min(l_partkey) as k from lineitem group by 1, 2),
b as (select owner, name, type, optional from base where k % 13 <> 0),
a as (select owner, name, case when k % 17 = 0 then 'X' else type end as type, case when k % 19 = 0 then not optional else optional end as optional from base where k % 11 <> 0),
o as (select owner from b intersect select owner from a),
r as (select coalesce(b.owner, a.owner) as owner, case when a.name is null then 'parameter_removed' when b.name is null and a.optional then 'optional_parameter_added' when b.name is null then 'required_parameter_added'
  when b.type <> a.type then 'type_changed' when b.optional and not a.optional then 'became_required' when a.optional and not b.optional then 'became_optional' end as reason
  from (select * from b where owner in (select owner from o)) b full join (select * from a where owner in (select owner from o)) a on b.owner = a.owner and b.name = a.name),
rr as (select *, reason not in ('optional_parameter_added', 'became_optional') as breaking from r where reason is not null)"""

_CYCLES = """, e0 as (select src as u, dst as v from calls where src <> dst), e1 as (select u, v from e0 where u % 10 <> 6),
r0 as (select u as a, v as b from e0 union select a, v from r0 join e0 on b = u), r1 as (select u as a, v as b from e1 union select a, v from r1 join e1 on b = u),
c0 as (select x.a, min(x.b) as component from r0 x join r0 y on x.a = y.b and x.b = y.a group by 1), c1 as (select x.a, min(x.b) as component from r1 x join r1 y on x.a = y.b and x.b = y.a group by 1),
m0 as (select component, string_agg(a::varchar, ',' order by a) as members from c0 group by 1 union select src, src::varchar from calls where src = dst and src not in (select a from c0)),
m1 as (select component, string_agg(a::varchar, ',' order by a) as members from c1 group by 1 union select src, src::varchar from calls where src = dst and src % 10 <> 6 and src not in (select a from c1))"""

_TREE = """with t as (select floor(epoch(ts) / 86400)::bigint as day, user_id::varchar || '/' || event_type as path, count(*)::varchar as blob from events group by 1, 2),
e as (select day - (select min(day) from t) as idx, path, blob from t), last as (select max(idx) as last from e),
ch as (select a.idx, a.path, case when b.path is null then 'added' else 'modified' end as change from e a left join e b on a.path = b.path and b.idx = a.idx - 1 where a.idx > 0 and (b.path is null or a.blob <> b.blob)
  union all select b.idx + 1, b.path, 'deleted' from e b left join e a on a.path = b.path and a.idx = b.idx + 1 where a.path is null and b.idx < (select last from last))"""

ORACLE = {
    "file_diff_renames": with_ctes(_FILES + " select * from files", "before_files", "after_files"),
    "symbol_diff": "with " + _SYMS.lstrip(", ") + " select * from syms",
    "contract_diff": _PARAMS + " select reason, breaking, count(*)::bigint as n, count(distinct owner)::bigint as owners from rr group by 1, 2",
    "api_verdicts": _PARAMS + """, agg as (select owner, bool_or(breaking) as breaking, string_agg(distinct reason, ',' order by reason) as reasons from rr group by 1),
cov as (select distinct owner, case when owner % 4 = 0 then 'partial' else 'verified' end as coverage from a)
select cov.owner, case when coalesce(breaking, false) then 'breaking' when coverage <> 'verified' then 'unknown' else 'compatible' end as verdict, coalesce(reasons, '') as reasons from cov left join agg on cov.owner = agg.owner""",
    "edge_diff": with_ctes(""", b as (select * from supply where length(src) + length(dst) <> 7 or kind <> 'calls'), a as (select * from supply where kind <> 'imports' or coverage <> 'partial')
select case when b.src is null then 'added' else 'removed' end as type, coalesce(b.kind, a.kind) as kind, count(*)::bigint as n
from b full join a on b.src = a.src and b.dst = a.dst and b.kind = a.kind where b.src is null or a.src is null group by 1, 2""", "supply"),
    "diff_summary": with_ctes(_FILES + _SYMS + " select 'file' as family, type, count(*)::bigint as n from files group by type union all select 'symbol', type, count(*) from syms group by type", "before_files", "after_files"),
    "forbidden_dep": with_ctes("""
select src, dst, supply.kind, coalesce(a.path, src) as src_path, coalesce(b.path, dst) as dst_path from supply left join symbols a on a.id = src left join symbols b on b.id = dst
where regexp_full_match(coalesce(a.path, src), '.*/brand#1.*') and regexp_full_match(coalesce(b.path, dst), 'supply/[^0-4]/.*')""", "supply", "symbols"),
    "layers": with_ctes(""", e as (select coalesce(a.path, src) as sp, coalesce(b.path, dst) as dp from supply left join symbols a on a.id = src left join symbols b on b.id = dst),
l as (select case when contains(sp, 'brand#1') then 3 when contains(sp, 'brand#2') then 1 when contains(sp, 'supply') then 2 end as sl,
  case when contains(dp, 'brand#1') then 3 when contains(dp, 'brand#2') then 1 when contains(dp, 'supply') then 2 end as dl from e)
select sl::bigint as src_layer, dl::bigint as dst_layer, count(*)::bigint as n from l where dl < sl group by 1, 2""", "supply", "symbols"),
    "new_cycles": with_ctes(_CYCLES + " select component, members from m0 where members not in (select members from m1)", "calls", recursive=True),
    "debt_waiver": """with f as (select o_orderkey::varchar as finding_id, 'r' || (o_custkey % 4)::varchar as rule_id, case when o_orderstatus = 'F' then 'fail' else 'unknown' end as status, o_orderpriority as entity from orders),
d as (select * from (values ('r0', '*', 'all of r0'), ('r1', 'URGENT', 'urgent is known'), ('r1', 'HIGH', 'high is known'), ('r2', '1003', 'one order')) t(rule_id, fingerprint, waived_reason)),
h as (select finding_id, min(waived_reason) as waived_reason from f join d on f.rule_id = d.rule_id and (fingerprint = finding_id or fingerprint = '*' or contains(entity, fingerprint)) group by 1)
select f.finding_id, rule_id, case when waived_reason is not null and status = 'fail' then 'pass' else status end as status, waived_reason from f left join h on f.finding_id = h.finding_id""",
    "tree_diff_lag": _TREE + " select idx, path, change from ch",
    "commit_forensics": _TREE + """, c as (select idx, count(*) filter (where change = 'added') as added, count(*) filter (where change = 'modified') as modified, count(*) filter (where change = 'deleted') as deleted from ch group by 1)
select idx, added::bigint as added, modified::bigint as modified, deleted::bigint as deleted, (2 * modified + added + 3 * deleted)::bigint as blast, case when deleted > 2 or modified > 10 then 'WARN' else 'PASS' end as verdict from c""",
    "positional_divergence": """with l as (select l_orderkey as pos, min(l_returnflag) as v from lineitem where l_linenumber = 1 group by 1), r as (select l_orderkey as pos, min(l_returnflag) as v from lineitem where l_linenumber = 2 group by 1)
select coalesce(l.pos, r.pos) as pos, l.v as left_value, r.v as right_value from l full join r on l.pos = r.pos where l.v is distinct from r.v""",
}
