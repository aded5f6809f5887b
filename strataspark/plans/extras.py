"""Queries of graph edits, records, names, imports, revisions and searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataspark.functions import names
from strataspark.operators import browse, contracts, edits, graph, impact, records, temporal
from strataspark.plans import browse as browse_plans
from strataspark.plans import services
from strataspark.plans.contracts import _PAY, _commits
from strataspark.plans.contracts import _facts as payload_facts
from strataspark.plans.diffs import _symbols
from strataspark.plans.inputs import table, views, with_ctes


def graph_replace_files(spark, sf_dir):
    """Files of nation 3 are read again: their modules come back under new names, and one edge each."""
    supply, symbols = views(spark, sf_dir, "supply", "symbols")
    at = F.concat(F.lit("supply/"), F.col("s_nationkey").cast("string"), F.lit("/"), F.col("s_suppkey").cast("string"), F.lit(".py"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), at.alias("path"), "s_nationkey")
    held = supply.join(s.select(F.col("id").alias("dst"), "path"), "dst").select("src", "dst", "kind", "path")
    files = s.where("s_nationkey = 3").select("path")
    again = s.where("s_nationkey = 3").select(F.concat(F.lit("n"), "id").alias("id"), "path")
    nodes, edges = edits.replace_files(s.select("id", "path"), held, files, again, again.select(F.lit("root").alias("src"), F.col("id").alias("dst"), F.lit("calls").alias("kind"), "path"))
    return edges.join(nodes.select(F.col("id").alias("dst"), F.lit(True).alias("there")), "dst", "left").groupBy("kind", F.coalesce("there", F.lit(False)).alias("known")).agg(F.count("*").alias("n"))


def graph_remove_symbols(spark, sf_dir):
    supply, symbols = views(spark, sf_dir, "supply", "symbols")
    nodes, edges = edits.remove_symbols(symbols, supply, symbols.where("kind = 'class'").select("id"))
    return edges.groupBy("kind").agg(F.count("*").alias("edges")).crossJoin(F.broadcast(nodes.agg(F.count("*").alias("nodes"))))


def graph_last_wins(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey", "o_orderstatus")
    nodes, _ = edits.build_graph(o, o.select(F.col("id").alias("src"), F.col("o_orderkey").alias("dst"), F.lit("has").alias("kind")), "o_orderkey")
    return nodes


def graph_row_form(spark, sf_dir):
    supply, symbols = views(spark, sf_dir, "supply", "symbols")
    nodes, edges = edits.graph_rows(symbols.where("kind <> 'method'"), supply)
    return nodes.groupBy(F.lit("node").alias("row"), "kind", F.col("coverage").alias("state")).agg(F.count("*").alias("n")).unionAll(edges.groupBy(F.lit("edge"), "kind", "confidence").agg(F.count("*")))


def symbol_statuses(spark, sf_dir):
    return edits.symbol_status(*_symbols(spark, sf_dir))


def folder_clusters(spark, sf_dir):
    (symbols,) = views(spark, sf_dir, "symbols")
    return edits.folder_clusters(symbols.select("path").distinct()).select("path", "folder", F.col("cluster").cast("bigint").alias("cluster"))


def semantic_verdicts(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("commit", F.col("l_suppkey"))
    changes = li.where("l_quantity > 48").select("commit", (F.col("l_discount") > 0.085).alias("breaking"))
    frontier = li.where("l_quantity < 2").select("commit", F.col("l_partkey").alias("id"))
    coverage = li.select("commit", F.when(F.col("l_suppkey") % 13 == 0, "unknown").when(F.col("l_suppkey") % 5 == 0, "partial").otherwise("verified").alias("coverage"))
    return edits.semantic_verdict(changes, frontier, coverage)


def overall_coverage(spark, sf_dir):
    (supply,) = views(spark, sf_dir, "supply")
    parts = supply.select(F.lit("file").alias("kind"), "coverage")
    out = [edits.overall_coverage(parts.where(c)).withColumn("case", F.lit(n)) for n, c in (("all", "true"), ("none", "false"), ("known", "coverage <> 'unknown'"), ("sure", "coverage = 'verified'"))]
    out.append(edits.overall_coverage(parts.where("coverage = 'verified'").withColumn("kind", F.lit("incomplete"))).withColumn("case", F.lit("cut")))
    rows = out[0]
    for o in out[1:]:
        rows = rows.unionByName(o)
    return rows


def edge_priority(spark, sf_dir):
    (supply,) = views(spark, sf_dir, "supply")
    return edits.edge_priority(supply, 200)


def event_numbers(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_type", "event_id", "user_id")
    return edits.numbered(ev, "event_type", ["event_id"])


def coverage_counts(spark, sf_dir):
    (supply,) = views(spark, sf_dir, "supply")
    return records.coverage_counts(supply)


def federation_coverage(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("workspace_id"), F.element_at(F.array(F.lit("verified"), F.lit("partial"), F.lit("unsupported"), F.lit("odd")), (F.col("s_suppkey") % 4 + 1).cast("int")).alias("coverage"))
    return records.federation_coverage(s.where("coverage <> 'odd' or workspace_id % 3 = 0"))


def evidence_integrity(spark, sf_dir):
    """Digests of orders, one in seven of which was made of another status."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("finding_id"), "o_orderstatus", "o_orderpriority", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")).alias("was"))
    with_digest = o.withColumn("digest", F.sha2(F.concat("finding_id", F.lit("\0"), "was", F.lit("\0"), "o_orderpriority", F.lit("\0")), 256))
    return records.evidence_integrity(with_digest, "finding_id", "o_orderstatus", "o_orderpriority").groupBy("o_orderstatus", "intact").agg(F.count("*").alias("n"))


def explain_finding(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    findings = o.select(F.col("o_orderkey").alias("finding_id"), F.col("o_orderstatus").alias("rule_id"), F.col("o_orderpriority").alias("message"))
    evidence = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("finding_id"), F.col("l_partkey").alias("entity"), F.col("l_linenumber").alias("line"))
    first = o.agg(F.min("o_orderkey")).first()[0]
    return records.explain(findings, evidence, first)


def run_findings(spark, sf_dir):
    runs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"))
    findings = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderpriority").alias("rule_id"), F.col("o_orderkey").alias("finding_id"))
    return records.findings_of_run(runs, findings, 7)


def team_references(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.concat(F.when(F.col("c_custkey") % 4 == 0, "group:").otherwise("component:"), F.lower("c_name")).alias("reference"))
    return records.teams(c)


def declared_at(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.lower("c_name").alias("reference"), F.when(F.col("c_custkey") % 3 == 0, "api").otherwise("component").alias("kind"), F.concat(F.lit("services/"), F.lower("c_mktsegment"), F.lit("/catalog-info.yaml")).alias("source_path"), F.concat(F.lit("Org/"), F.col("c_nationkey").cast("string")).alias("project"))
    one, two = records.at_directory(c, "services/machinery/"), records.for_project(c, "org/7")
    return one.withColumn("how", F.lit("directory")).unionAll(two.withColumn("how", F.lit("project")))


def package_dependents(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    p = li.groupBy(F.concat(F.lit("p"), (F.col("l_suppkey") % 50).cast("string")).alias("package")).agg(F.collect_set(F.concat(F.lit("p"), (F.col("l_partkey") % 50).cast("string"))).alias("dependencies"))
    return records.package_dependents(p, "p7")


def touched_entities(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("reference")).agg(F.min("o_orderpriority").alias("owner"), F.max(F.when(F.col("o_orderstatus") == "F", F.lit("closed"))).alias("system"), F.collect_set("o_orderstatus").alias("depends_on"))
    return records.touched_entities(o).select("reference", F.array_join("touched", "|").alias("touched"))


def session_events(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("event_seq"), "event_type")
    return records.session_range(ev, "7", 100, 9000)


def risk_and_dead(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    commits = s.select(F.col("s_suppkey").alias("oid"), F.when(F.col("s_suppkey") % 9 == 0, "BREAKING").otherwise("PASS").alias("verdict"), (F.col("s_suppkey") % 4 - 1).alias("blast"))
    nodes = s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("path"), (F.col("s_acctbal") < 0).alias("is_dead_code"))
    return records.risk_commits(commits).select(F.lit("risk").alias("what"), F.col("oid").alias("id")).unionAll(records.dead_inventory(nodes).select(F.lit("dead"), "id"))


def latest_snapshot(spark, sf_dir):
    return records.latest_snapshot(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rowid"), F.col("o_orderstatus").alias("snapshot_id")))


def change_order(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("kind"), F.col("l_suppkey").cast("string").alias("subject"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("detail"))
    return records.ordered_changes(li, ["O", "F"])


def unknown_symbols(spark, sf_dir):
    ids = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"))
    out = records.named_unknown(ids, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")))
    return out.select("n", F.array_join("sample", ",").alias("sample"))


def seeds_and_paths(spark, sf_dir):
    before, after = views(spark, sf_dir, "before_files", "after_files")
    seeds = records.seed_union(table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id")), before)
    paths = records.merged_paths(before, after)
    return seeds.agg(F.lit("seeds").alias("what"), F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last")).unionAll(paths.agg(F.lit("paths"), F.count("*"), F.min("path"), F.max("path")))


def source_packages(spark, sf_dir):
    (symbols,) = views(spark, sf_dir, "symbols")
    return records.packages_of(symbols)


def narrowing(spark, sf_dir):
    return records.narrowing_ratio(services.test_selection(spark, sf_dir))


def suite_files(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("t"), (F.col("l_orderkey") % 40).cast("string")).alias("suite_id"), F.col("l_suppkey").cast("string").alias("path"), F.col("l_suppkey").alias("source"))
    return records.suites_importing(li, 5).select(F.lit("suite").alias("what"), F.col("suite_id").alias("name")).unionAll(records.instrumented_files(li).select(F.lit("file"), "path"))


def service_names(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return records.service_names(ev.select(F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("svc"), (F.col("user_id") % 7).cast("string"))).alias("service")))


def timeline_ends(spark, sf_dir):
    c = _commits(spark, sf_dir).select("idx", "oid")
    return records.timeline_at(c).withColumn("at", F.lit("head")).unionAll(records.timeline_at(c, 5).withColumn("at", F.lit("five")))


def revision_expressions(spark, sf_dir):
    c = _commits(spark, sf_dir)
    refs = spark.createDataFrame([("HEAD", 45), ("v1", 60)], "name string, oid bigint")
    rows = [records.resolve_revision(c, refs, e).withColumn("expression", F.lit(e)) for e in ("HEAD", "HEAD~1", "HEAD~13", "v1~2~", "17~3", "HEAD~99")]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionAll(r)
    return out


def tree_files(spark, sf_dir):
    """Parts as files in folders by type and size."""
    p = table(spark, sf_dir, "part").select(F.lower("p_type").alias("t"), F.concat_ws("/", F.lower("p_type"), F.col("p_size").cast("string")).alias("s"), F.col("p_size").cast("string").alias("z"), F.col("p_partkey").cast("string").alias("k"))

    def tree(at, name, to):
        return p.select(at.alias("tree"), name.alias("name"), F.lit("tree").alias("kind"), F.lit(40000).alias("mode"), to.alias("child")).distinct()

    entries = tree(F.lit(""), F.col("t"), F.col("t")).unionAll(tree(F.col("t"), F.col("z"), F.col("s"))).unionAll(p.select("s", "k", F.lit("blob"), F.lit(644), F.sha2("k", 256)))
    return records.flatten_trees(entries, spark.createDataFrame([("",)], "tree string")).select("path", "mode", "blob")


def lexical_hits(spark, sf_dir):
    """Words of the first benchmark lines looked for in all documents."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.slice(F.split("text", " "), 1, 3)).alias("name")).where("name rlike '^[A-Za-z0-9_]+$'")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return records.lexical_search(docs, words).groupBy("name").agg(F.count("*").alias("lines"), F.countDistinct("path").alias("files"))


def promotion(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    m = li.groupBy(F.element_at(F.array(F.lit("candidate"), F.lit("grep"), F.lit("lsp")), (F.col("l_suppkey") % 3 + 1).cast("int")).alias("engine")).agg(
        F.round(F.avg("l_discount") * 10, 6).alias("recall"), F.round(F.avg("l_tax") * 10, 6).alias("precision"), F.sum(F.col("l_linenumber").cast("bigint")).alias("tokens"), F.countDistinct("l_returnflag").alias("classes"))
    return records.promotion_gate(m).select(F.round("recall_lift", 6).alias("recall_lift"), F.round("cost_cut", 6).alias("cost_cut"), "new_classes", "passed")


def span_symbols(spark, sf_dir):
    """Spans name a part by its colour; some say where it lies."""
    name = F.substring_index("p_name", " ", 1)
    symbols = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(name).alias("name"), F.concat(F.lit("src/"), (F.col("p_partkey") % 500).cast("string")).alias("path"))
    ev = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 3000).alias("k"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_name")
    spans = ev.join(p, "k", "left").select(F.col("event_id").alias("span_id"), F.when(F.col("event_id") % 2 == 0, F.col("p_name")).otherwise(name).alias("function"), F.when(F.col("event_id") % 5 < 2, F.concat(F.lit("./src/"), (F.col("k") % 500).cast("string"))).alias("path"))
    return records.span_symbols(spans, symbols)


def import_targets(spark, sf_dir):
    """Documents import their neighbours, by relative paths and through an alias; every third file lacks the extension
    that is tried first."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), "source")
    name = F.concat(F.lit("src/"), "source", F.lit("/m"), F.col("k").cast("string"))
    files = d.select(F.concat(name, F.element_at(F.array(F.lit(".ts"), F.lit("/index.ts"), F.lit(".js")), (F.col("k") % 3 + 1).cast("int"))).alias("path"))
    here = F.concat(name, F.lit(".ts")).alias("path")
    spec = F.when(F.col("k") % 4 == 0, F.concat(F.lit("./m"), (F.col("k") + 1).cast("string"))).when(F.col("k") % 4 == 1, F.concat(F.lit("../"), "source", F.lit("/./m"), (F.col("k") - 1).cast("string"))).when(F.col("k") % 4 == 2, F.concat(F.lit("@/"), "source", F.lit("/m"), F.col("k").cast("string"))).otherwise(F.lit("left-pad"))
    return records.resolve_imports(d.select(here, spec.alias("specifier")), files, prefixes={"@/": "src/"})


def commits_newest_first(spark, sf_dir):
    return records.newest_first(_commits(spark, sf_dir))


def symbol_names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    path, kind = F.concat(F.translate(F.lower("p_brand"), "#", "-"), F.lit(".ts")), F.when(F.col("p_size") % 2 == 0, "method").otherwise("function")
    sid = names.stable_id(path, kind, F.lit("T"), F.col("p_name"))
    return p.select(sid.alias("id"), names.qualified_name(path, F.when(F.col("p_size") % 2 == 0, "T").otherwise(""), F.col("p_name")).alias("qualified"), names.signature_fingerprint(F.col("p_type")).alias("fingerprint"), names.is_canonical(sid).alias("canonical"), names.is_canonical(F.col("p_name")).alias("bare"))


def author_lines(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    line = F.concat("c_name", F.lit(" <c@example.org> "), (F.lit(1_700_000_000) + F.col("c_custkey")).cast("string"), F.lit(" +0100"))
    oid = F.sha2(F.col("c_custkey").cast("string"), 256)
    version = F.concat_ws(".", (F.col("c_custkey") % 5).cast("string"), (F.col("c_custkey") % 7).cast("string"), F.lit("9"))
    query = F.concat(F.lit("x=1&name="), F.replace("c_name", F.lit("#"), F.lit("%23")), F.lit("&name=2"))
    return c.select(names.display_author(line).alias("author"), names.git_timestamp(line).alias("ts"), names.git_timestamp(F.col("c_name")).alias("none"), names.short_oid(oid).alias("oid"), names.major_minor(version).alias("version"), names.query_parameter(query, "name").alias("name"), names.percent_decode(F.lit("a%20b+c")).alias("plain"))


def key_redactions(spark, sf_dir):
    keys = spark.createDataFrame([(k,) for k in KEYS], "key string")
    ev = table(spark, sf_dir, "events").select((F.col("event_id") % len(KEYS)).alias("k"))
    key = F.element_at(F.array(*[F.lit(k) for k in KEYS]), (F.col("k") + 1).cast("int"))
    return ev.groupBy(names.key_rule(key).alias("kind")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(keys.agg(F.count("*").alias("keys"))))


KEYS = ["http.request.header.Authorization", "cookie", "a/x-api-key", "db.password", "tls.private_key", "x.id_token", "session", "http.query", "enduser.id", "db.statement", "my.enduser.id", "token.count", "user.name"]


def impact_cut(spark, sf_dir):
    """A budget that cuts: the nearest thirty of what reaches one supplier."""
    (calls,) = views(spark, sf_dir, "calls")
    seeds = spark.createDataFrame([(64,)], "id bigint")
    return impact.impact(calls, seeds, ("calls", "imports"), 60, 12).select("id", "hops", "truncated")


def universe_edges(spark, sf_dir):
    supply, symbols = views(spark, sf_dir, "supply", "symbols")
    return graph.induced(supply, browse.universe(symbols, supply, 200).select("id"))


def lineage_counts(spark, sf_dir):
    return temporal.lineage_summary(temporal.lineage_exact(*views(spark, sf_dir, "before_files", "after_files")))


def flow_check(spark, sf_dir):
    """The facts of `payload_changes` as what is sent and what is expected."""
    sent, expected = (x.withColumnRenamed("subject", "flow") for x in payload_facts(spark, sf_dir))
    return contracts.flow_findings(sent, expected).groupBy("finding").agg(F.count("*").alias("n"), F.countDistinct("flow").alias("flows"))


def message_ways(spark, sf_dir):
    """Orders as messages, line items as operations on them."""
    messages = table(spark, sf_dir, "orders").select(F.lit("d").alias("path"), F.lit("message").alias("row"), F.col("o_orderkey").cast("string").alias("id"), F.lit(None).cast("string").alias("action"), F.array().cast("array<string>").alias("messages"))
    action = F.when(F.col("l_returnflag") == "A", "send").when(F.col("l_returnflag") == "R", "receive")
    ops = table(spark, sf_dir, "lineitem").select(F.lit("d"), F.lit("operation"), F.concat_ws("-", "l_orderkey", "l_linenumber"), action, F.array(F.col("l_orderkey").cast("string")))
    return contracts.message_directions(messages.unionAll(ops)).groupBy("direction").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    flow_check, message_ways, graph_replace_files, graph_remove_symbols, graph_last_wins, graph_row_form, symbol_statuses, folder_clusters, semantic_verdicts, overall_coverage, edge_priority,
    event_numbers, coverage_counts, federation_coverage, evidence_integrity, explain_finding, run_findings, team_references, declared_at, package_dependents,
    touched_entities, session_events, risk_and_dead, latest_snapshot, change_order, unknown_symbols, seeds_and_paths, source_packages, narrowing, suite_files,
    service_names, timeline_ends, revision_expressions, tree_files, lexical_hits, promotion, span_symbols, import_targets, commits_newest_first, symbol_names,
    author_lines, key_redactions, impact_cut, universe_edges, lineage_counts,
)}

_C = """c as (select s_suppkey::bigint as oid, case when s_suppkey % 50 <> 1 then s_suppkey::bigint - 1 end as p1, case when s_suppkey % 9 = 0 and s_suppkey % 50 > 8 then s_suppkey::bigint - 7 end as p2 from supplier)"""

_SUPPLY = with_ctes(" select * from supply", "supply")

_SIDES = _PAY[: _PAY.index("f as (select subject")].replace("['array', 'boolean', 'integer', 'null', 'number', 'object', 'string']", "[]::varchar[]")

ORACLE = {
    "flow_check": _SIDES + """x as (select subject, regexp_replace(pointer, '/[^/]*$', '') as pointer from j where gone),
f as (select subject, pointer, unnest(list_filter([case when two and not ok then 'uncheckable' end, case when new and ar then 'required_property_not_produced' end, case when ok and len(at_) > 0 and not list_has_all(at_, bt) then 'type_not_accepted' end,
  case when ok and ae and not be then 'enum_value_not_accepted' end, case when ok and ac and (not bc or (subject, pointer) in (select (subject, pointer) from x)) then 'additional_properties_rejected' end], lambda x: x is not null)) as finding from j)
select finding, count(*)::bigint as n, count(distinct subject)::bigint as flows from f where (subject, regexp_replace(pointer, '/[^/]*$', '')) not in (select (subject, pointer) from j where not two or not ok) group by 1""",
    "message_ways": """with m as (select o_orderkey, bool_or(l_returnflag = 'A') as s, bool_or(l_returnflag = 'R') as r from orders left join lineitem on l_orderkey = o_orderkey group by 1)
select case when s and r then 'both' when s then 'emitted' when r then 'accepted' end as direction, count(*)::bigint as n from m group by 1""",
    "narrowing": f"select (count(*) filter (where decision <> 'skip'))::bigint as selected, count(*)::bigint as total, round(1 - (count(*) filter (where decision <> 'skip')) / count(*), 9) as ratio from ({services.ORACLE['test_selection']})",
    "universe_edges": f"with u as ({browse_plans.ORACLE['universe_projection']}) select * from ({_SUPPLY}) where src in (select id from u) and dst in (select id from u)",
    "graph_replace_files": with_ctes(""", held as (select src, dst, kind, s_nationkey as n from supply join supplier on dst = 's' || s_suppkey::varchar), e as (select dst, kind from held where n <> 3 union all select 'ns' || s_suppkey::varchar, 'calls' from supplier where s_nationkey = 3),
ids as (select case when s_nationkey = 3 then 'n' else '' end || 's' || s_suppkey::varchar as id from supplier) select kind, dst in (select id from ids) as known, count(*)::bigint as n from e group by 1, 2""", "supply"),
    "graph_remove_symbols": with_ctes(""", g as (select id from symbols where kind = 'class') select kind, count(*)::bigint as edges, (select count(*) from symbols where kind <> 'class')::bigint as nodes from supply where src not in (select id from g) and dst not in (select id from g) group by 1""", "supply", "symbols"),
    "graph_last_wins": "select o_custkey as id, max(o_orderkey) as o_orderkey, arg_max(o_orderstatus, o_orderkey) as o_orderstatus from orders group by 1",
    "graph_row_form": with_ctes(""", s as (select * from symbols where kind <> 'method'), ends as (select src as id from supply union select dst from supply),
n as (select kind, 'verified' as state from s union all select 'file', 'verified' from (select distinct path from s) union all select 'unknown', 'unknown' from ends where id not in (select id from s)),
e as (select kind, case coverage when 'verified' then 'exact' when 'partial' then 'heuristic' else 'dynamic_unknown' end as state from supply union all select 'contains', 'exact' from s)
select 'node' as row, kind, state, count(*)::bigint as n from n group by 1, 2, 3 union all select 'edge', kind, state, count(*) from e group by 1, 2, 3""", "supply", "symbols"),
    "symbol_statuses": """with p as (select *, p_partkey::varchar as pid, lower(p_type) || '/' || (p_partkey % 97)::varchar as path, case when p_partkey % 17 <> 0 then p_name end as sig from part),
b as (select pid as id, path, sig from p where p_partkey % 19 <> 0), a as (select case when p_partkey % 29 = 0 then 'n' || pid else pid end as id, path, case when p_partkey % 31 = 0 then 'changed' else sig end as sig from p where p_partkey % 23 <> 0)
select coalesce(b.id, a.id) as id, coalesce(a.path, b.path) as path, case when b.id is null then 'added' when a.id is null then 'deleted' when b.sig is not distinct from a.sig and b.path = a.path then 'unchanged' else 'modified' end as status from b full join a on b.id = a.id""",
    "folder_clusters": with_ctes(""", f as (select distinct path, regexp_replace(path, '/[^/]*$', '') as folder from symbols) select path, folder, dense_rank() over (order by folder) - 1 as cluster from f""", "symbols"),
    "semantic_verdicts": """with k as (select l_suppkey as commit, bool_or(l_quantity > 48 and l_discount > 0.085) as breaking, count(distinct l_partkey) filter (where l_quantity < 2) as blast from lineitem group by 1)
select commit, case when commit % 13 = 0 then 'UNKNOWN' when breaking then 'BREAKING' when blast > 0 then 'WARN' else 'PASS' end as verdict, blast::bigint as blast from k""",
    "overall_coverage": "select * from (values ('unknown', 'all'), ('unknown', 'none'), ('unsupported', 'known'), ('verified', 'sure'), ('partial', 'cut')) t(coverage, \"case\")",
    "edge_priority": with_ctes(" select * from supply order by kind = 'calls' desc, coverage = 'verified' desc, src, dst, kind limit 200", "supply"),
    "event_numbers": "select event_type, event_id, user_id, row_number() over (partition by event_type order by event_id) as seq from events",
    "coverage_counts": with_ctes(" select coverage, count(*)::bigint as n from supply group by 1", "supply"),
    "federation_coverage": """with w as (select s_suppkey as k, s_suppkey % 4 as r from supplier where s_suppkey % 4 <> 3 or s_suppkey % 3 = 0)
select count(*) filter (where r = 0) as verified, count(*) filter (where r = 1) as partial, count(*) filter (where r = 2) as unsupported, count(*) filter (where r = 3) as unknown, ['verified', 'partial', 'unsupported', 'unknown'][max(r) + 1] as worst from w""",
    "evidence_integrity": "select o_orderstatus, not (o_orderkey % 7 = 0) as intact, count(*)::bigint as n from orders group by 1, 2",
    "explain_finding": "select o_orderkey as finding_id, o_orderstatus as rule_id, o_orderpriority as message, l_partkey as entity, l_linenumber as line from orders left join lineitem on l_orderkey = o_orderkey where o_orderkey = (select min(o_orderkey) from orders)",
    "run_findings": "select o_custkey as run_id, o_orderpriority as rule_id, o_orderkey as finding_id from orders where o_custkey = 7",
    "team_references": "select 'group:' || lower(c_name) as reference from customer where c_custkey % 4 = 0",
    "declared_at": "select lower(c_name) as reference, 'directory' as how from customer where c_custkey % 3 <> 0 and lower(c_mktsegment) = 'machinery' union all select lower(c_name), 'project' from customer where c_custkey % 3 <> 0 and c_nationkey = 7",
    "package_dependents": "select distinct 'p' || (l_suppkey % 50)::varchar as package from lineitem where l_partkey % 50 = 7",
    "touched_entities": """with e as (select o_custkey::varchar as r, min(o_orderpriority) as o, max(case when o_orderstatus = 'F' then 'closed' end) as s, list(distinct o_orderstatus) as d from orders group by 1)
select r as reference, array_to_string(list_sort(list_distinct(list_concat(list_filter([r, o, s], lambda x: x is not null), d))), '|') as touched from e""",
    "session_events": "select '7' as session_id, event_id as event_seq, event_type from events where user_id = 7 and event_id between 100 and 9000",
    "risk_and_dead": "select 'risk' as what, s_suppkey as id from supplier where s_suppkey % 9 = 0 or s_suppkey % 4 - 1 > 0 union all select 'dead', s_suppkey from supplier where s_acctbal < 0",
    "latest_snapshot": "select o_orderkey as rowid, o_orderstatus as snapshot_id from orders where o_orderkey = (select max(o_orderkey) from orders)",
    "change_order": "select distinct l_linestatus as kind, l_suppkey::varchar as subject, case when l_returnflag <> 'N' then l_returnflag end as detail from lineitem",
    "unknown_symbols": """with u as (select distinct user_id as id from events where user_id not in (select s_suppkey from supplier)), f as (select id from u order by id limit 5)
select (select count(*) from u)::bigint as n, (select string_agg(id::varchar, ',' order by id) from f) as sample""",
    "seeds_and_paths": with_ctes(""", s as (select 'p' || p_partkey::varchar as id from part union select 'file::' || path from before_files), p as (select path from before_files union select path from after_files)
select 'seeds' as what, count(*)::bigint as n, min(id) as first, max(id) as last from s union all select 'paths', count(*), min(path), max(path) from p""", "before_files", "after_files"),
    "source_packages": with_ctes(" select distinct split_part(path, '/', 1) as package from symbols", "symbols"),
    "suite_files": "select distinct 'suite' as what, 't' || (l_orderkey % 40)::varchar as name from lineitem where l_suppkey = 5 union all select distinct 'file', l_suppkey::varchar from lineitem",
    "service_names": "select distinct 'svc' || (user_id % 7)::varchar as service from events where event_id % 3 > 0",
    "timeline_ends": f"with {_C} select oid as idx, oid, 'head' as at from c where oid = (select max(oid) from c) union all select oid, oid, 'five' from c where oid = 5",
    "revision_expressions": f"""with recursive {_C}, s as (select * from (values ('HEAD', 45::bigint, 0), ('HEAD~1', 45, 1), ('HEAD~13', 45, 13), ('v1~2~', 60, 3), ('17~3', 17, 3), ('HEAD~99', 45, 99)) t(expression, oid, n)),
w as (select expression, s.oid, n from s join c using (oid) union all select expression, p1, n - 1 from w join c using (oid) where n > 0 and p1 is not null) select oid::varchar as oid, expression from w where n = 0""",
    "tree_files": "select lower(p_type) || '/' || p_size::varchar || '/' || p_partkey::varchar as path, 644 as mode, sha256(p_partkey::varchar) as blob from part",
    "lexical_hits": r"""with n as (select distinct unnest(list_slice(string_split(text, ' '), 1, 3)) as name from benchmark), w as (select distinct name from n where regexp_full_match(name, '[A-Za-z0-9_]+')),
l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as k from documents), h as (select distinct doc_id, k, unnest(regexp_extract_all(line, '[A-Za-z0-9_]+')) as name from l)
select name, count(*)::bigint as lines, count(distinct doc_id)::bigint as files from h where name in (select name from w) group by 1""",
    "promotion": """with m as (select ['candidate', 'grep', 'lsp'][l_suppkey % 3 + 1] as engine, round(avg(l_discount) * 10, 6) as recall, round(avg(l_tax) * 10, 6) as precision, sum(l_linenumber) as tokens, count(distinct l_returnflag) as classes from lineitem group by 1),
b as (select max(recall) as br, max(precision) as bp, min(tokens) as bt, max(classes) as bc from m where engine <> 'candidate')
select round((recall - br) * 100, 6) as recall_lift, round((bt - tokens) / bt * 100, 6) as cost_cut, (classes - bc)::bigint as new_classes, (recall - br) * 100 >= 10 or ((bt - tokens) / bt * 100 >= 40 and recall >= br and precision >= bp) or classes > bc as passed from m, b where engine = 'candidate'""",
    "span_symbols": """with sy as (select p_partkey as id, case when p_partkey % 3 = 0 then p_name else split_part(p_name, ' ', 1) end as name, 'src/' || (p_partkey % 500)::varchar as path from part),
ex as (select path, name, max(id) as id from sy group by 1, 2), bn as (select name, count(*) as n, min(id) as id from sy group by 1),
sp as (select event_id, case when event_id % 2 = 0 then p_name else split_part(p_name, ' ', 1) end as f, case when event_id % 5 < 2 then 'src/' || (event_id % 3000 % 500)::varchar end as path from events left join part on p_partkey = event_id % 3000),
j as (select event_id as span_id, f, ex.id as eid, bn.n, bn.id as bid from sp left join ex on ex.path = sp.path and ex.name = f left join bn on bn.name = f)
select span_id, case when f is null then null when eid is not null then eid when n = 1 then bid end as symbol, case when f is null then 'uncorrelated' when eid is not null or n = 1 then 'matched' when n > 1 then 'ambiguous' else 'unmatched' end as outcome from j""",
    "import_targets": """with f as (select doc_id as k, source, 'src/' || source || '/m' || doc_id::varchar || ['.ts', '/index.ts', '.js'][doc_id % 3 + 1] as path from documents),
i as (select k, source, 'src/' || source || '/m' || k::varchar || '.ts' as path, case k % 4 when 0 then './m' || (k + 1)::varchar when 1 then '../' || source || '/./m' || (k - 1)::varchar when 2 then '@/' || source || '/m' || k::varchar else 'left-pad' end as specifier,
  case k % 4 when 0 then k + 1 when 1 then k - 1 when 2 then k end as to_ from f)
select i.path, specifier, case when k_ is not null then t.path when i.k % 4 in (2, 3) then 'external::' || specifier end as target, case when k_ is not null then 'resolved' when i.k % 4 in (0, 1) then 'unresolved' else 'external' end as tier
from i left join (select k as k_, source as s_, path from f) t on t.k_ = to_ and t.s_ = i.source""",
    "commits_newest_first": f"""with recursive {_C}, e as (select p1 as oid, oid as child from c where p1 is not null union select p2, oid from c where p2 is not null), e2 as (select * from e where oid in (select oid from c)),
w as (select oid, 0 as level from c where oid not in (select oid from e2) union select e2.oid, level + 1 from w join e2 on e2.child = w.oid) select oid, max(level)::bigint as level from w group by 1""",
    "symbol_names": """with p as (select *, replace(lower(p_brand), '#', '-') || '.ts' as path, p_size % 2 = 0 as m from part), s as (select *, path || case when m then '#method:T.' else '#function:' end || p_name as id from p)
select id, path || case when m then '::T::' else '::' end || p_name as qualified, substr(sha256(p_type), 1, 12) as fingerprint, true as canonical, false as bare from s""",
    "author_lines": """select c_name as author, 1700000000 + c_custkey as ts, null::bigint as "none", substr(sha256(c_custkey::varchar), 1, 7) as oid, (c_custkey % 5)::varchar || '.' || (c_custkey % 7)::varchar as version, c_name as name, 'a b+c' as plain from customer""",
    "key_redactions": """with k as (select ['authorization_header', 'cookie_header', 'api_key', 'credential', 'private_key_material', 'token', 'session_key', 'query_string', 'user_identity', 'payload', null, null, null][event_id % 13 + 1] as kind from events) select kind, count(*)::bigint as n, 13::bigint as keys from k group by 1""",
    "impact_cut": with_ctes(""", e as (select distinct dst as u, src as v from calls where src <> dst and kind in ('calls', 'imports')), w as (select 64::bigint as id, 0 as hops union select v, hops + 1 from w join e on u = id where hops < 60),
m as (select id, min(hops) as hops from w where id <> 64 group by 1), t as (select count(*) > 12 as truncated from m) select id, hops, truncated from m, t order by hops, id limit 12""", "calls", recursive=True),
    "lineage_counts": with_ctes(""", gone as (select * from before_files where path not in (select path from after_files)), new as (select * from after_files where path not in (select path from before_files)),
g as (select content_hash as h, count(*) as nf from gone group by 1), n as (select content_hash as h, count(*) as nt from new group by 1), b as (select nf, nt from g join n on g.h = n.h)
select 'renamed' as kind, sum(case when nf = 1 and nt = 1 then 1 else nf + nt end)::bigint as n, (count(*) filter (where nf = 1 and nt = 1))::bigint as identity_preserved, sum(case when nf = 1 and nt = 1 then 0 else nf + nt end)::bigint as partial from b having count(*) > 0""", "before_files", "after_files"),
}
