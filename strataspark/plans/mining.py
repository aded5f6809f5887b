"""Queries of operators.mining: an order is a commit, its parts are the changed paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataspark.operators import mining
from strataspark.plans.inputs import table

DAYS, MAX_FILES = 1500, 8


def _inputs(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    parents = F.when(F.col("o_orderkey") % 50 == 7, 2).when(F.col("o_orderkey") == 1, 0).otherwise(1)
    seconds = F.when(F.col("o_orderkey") % 97 != 5, F.unix_timestamp(F.col("o_orderdate").cast("timestamp")))
    commits = orders.select(F.col("o_orderkey").alias("oid"), parents.alias("n_parents"), seconds.alias("ts"))
    changes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("oid"), F.col("l_partkey").alias("path"))
    accounted = mining.account(commits, changes, DAYS * 86_400, MAX_FILES)
    return accounted, mining.considered(accounted, changes)


def cochange_pairs(spark, sf_dir):
    return mining.cochange(_inputs(spark, sf_dir)[1], 2, 500)


def cochange_accounting(spark, sf_dir):
    return mining.accounting(_inputs(spark, sf_dir)[0])


def never_coupled(spark, sf_dir):
    return mining.never_coupled(_inputs(spark, sf_dir)[1], 2)


def hidden_coupling(spark, sf_dir):
    """Users that trigger the same event types at the same hour of the same day share a resource."""
    ev = table(spark, sf_dir, "events")
    uses = ev.select(F.concat_ws(":", "event_type", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH")).alias("resource"), F.col("user_id").alias("path"))
    return mining.hidden_coupling(uses)


QUERIES = {f.__name__: f for f in (cochange_pairs, cochange_accounting, never_coupled, hidden_coupling)}

_ITEMS = f"""with commits as (select o_orderkey as oid, case when o_orderkey % 50 = 7 then 2 when o_orderkey = 1 then 0 else 1 end as n_parents,
  case when o_orderkey % 97 <> 5 then epoch(o_orderdate)::bigint end as ts from orders),
sizes as (select l_orderkey as oid, count(distinct l_partkey) as n_paths from lineitem group by 1),
acc as (select c.oid, case when n_parents > 1 then 'merge_commit' when n_parents = 0 then 'root_commit' when ts is null then 'missing_timestamp'
  when ts < (select max(ts) from commits) - {DAYS * 86_400} then 'outside_window' when coalesce(n_paths, 0) > {MAX_FILES} then 'mass_commit'
  when coalesce(n_paths, 0) = 0 then 'no_changed_paths' end as reason from commits c left join sizes s on c.oid = s.oid),
items as (select distinct l_orderkey as oid, l_partkey as path from lineitem where l_orderkey in (select oid from acc where reason is null)),
pairs as (select x.path as a, y.path as b, count(*) as together from items x join items y on x.oid = y.oid and x.path < y.path group by 1, 2 having count(*) >= 2)"""


def _wilson(x: str, n: str, name: str) -> str:
    """SQL for the exact integer bounds, as columns name_lower and name_upper."""
    lifted = f"((4::hugeint * {x} * ({n} - {x}) * 10000 + 38416 * {n}) * 1000000000000 // {n})"
    guess = f"floor(sqrt({lifted}::double))::hugeint"
    root = f"(case when {guess} * {guess} > {lifted} then {guess} - 1 when ({guess} + 1) * ({guess} + 1) <= {lifted} then {guess} + 1 else {guess} end)"
    half = f"((98 * {root} * 1000000) // (({n} * 10000 + 38416)::hugeint * 1000000))"
    centre = f"((({x} * 10000 + 19208)::hugeint * 1000000) // ({n} * 10000 + 38416))"
    return f"""(case when {x} = 0 then 0 else greatest({centre} - {half}, 0) end)::bigint as {name}_lower,
  (case when {x} = {n} then 1000000 else least({centre} + {half}, 1000000) end)::bigint as {name}_upper"""


ORACLE = {
    "cochange_pairs": _ITEMS + f""", n as (select path, count(*) as n from items group by path), t as (select count(distinct oid) as total from items),
m as (select a, b, together, na.n as with_a, nb.n as with_b, total from pairs join n na on a = na.path join n nb on b = nb.path cross join t)
select a, b, together::bigint as together, with_a::bigint as with_a, with_b::bigint as with_b, total::bigint as total,
  (together * 1000000 // total)::bigint as support_ppm, (together * 1000000 // with_a)::bigint as conf_ab_ppm, {_wilson('together', 'with_a', 'conf_ab')},
  (together * 1000000 // with_b)::bigint as conf_ba_ppm, {_wilson('together', 'with_b', 'conf_ba')},
  (together * total * 1000000 // (with_a * with_b))::bigint as lift_ppm
from m order by lift_ppm desc, together desc, a, b limit 500""",
    "cochange_accounting": _ITEMS + " select coalesce(reason, 'considered') as reason, count(*)::bigint as n from acc group by 1",
    "never_coupled": _ITEMS + " select distinct path from items where path not in (select a from pairs union all select b from pairs)",
    "hidden_coupling": """with u as (select distinct event_type || ':' || strftime(ts, '%Y-%m-%d %H') as resource, user_id as path from events)
select x.path as a, y.path as b, count(*)::bigint as resources from u x join u y on x.resource = y.resource and x.path < y.path group by 1, 2""",
}
