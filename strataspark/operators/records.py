"""Lookups and small reports over stored records: runs, findings, evidence, entities, sessions, revisions, searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataspark.functions.coverage import fold, rank
from strataspark.functions.storage import forget, written


def explain(findings: DataFrame, evidence: DataFrame, finding_id: str) -> DataFrame:
    """The evidence rows of a finding with its rule and message; none for an unknown id."""
    one = findings.where(F.col("finding_id") == finding_id).select("finding_id", "rule_id", "message")
    return one.join(evidence, "finding_id", "left")


def findings_of_run(runs: DataFrame, findings: DataFrame, run_id: str) -> DataFrame:
    """Findings of a run, by rule and id."""
    return findings.join(runs.where(F.col("run_id") == run_id).select("run_id"), "run_id", "left_semi").orderBy("rule_id", "finding_id")


def evidence_digest(*columns: str) -> Column:
    """SHA-256 over the columns, each ended by a null character."""
    return F.sha2(F.concat(*[F.concat(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\0")) for c in columns]), 256)


def evidence_integrity(evidence: DataFrame, *columns: str) -> DataFrame:
    """evidence with `intact`: its digest is that of the columns."""
    return evidence.withColumn("intact", F.coalesce(F.col("digest") == evidence_digest(*columns), F.lit(False)))


def coverage_counts(rows: DataFrame, by: str = "coverage") -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n"))


def federation_coverage(workspaces: DataFrame) -> DataFrame:
    """(verified, partial, unsupported, unknown, worst) of workspaces(workspace_id, coverage); a state that is not listed is
    unknown."""
    r = rank(F.col("coverage"))
    counts = [F.count_if(r == k).alias(s) for k, s in enumerate(("verified", "partial", "unsupported", "unknown"))]
    return workspaces.agg(*counts, fold(F.col("coverage")).alias("worst"))


def register(workspaces: DataFrame) -> DataFrame:
    """workspaces(workspace_id, ...) in the order of ids; an id that occurs twice is an error."""
    twice = workspaces.groupBy("workspace_id").count().where("count > 1").orderBy("workspace_id").limit(1).collect()
    if twice:
        raise ValueError(f"workspace {twice[0]['workspace_id']!r} is registered twice")
    return workspaces.orderBy("workspace_id")


def at_directory(entities: DataFrame, directory: str) -> DataFrame:
    """References of components that are declared in a directory, sorted."""
    here = F.regexp_replace(F.col("source_path"), "/?[^/]*$", "") == directory.strip("/")
    return entities.where((F.col("kind") == "component") & here).select("reference").orderBy("reference")


def for_project(entities: DataFrame, project: str) -> DataFrame:
    return entities.where((F.col("kind") == "component") & (F.lower("project") == project.lower())).select("reference").orderBy("reference")


def teams(entities: DataFrame) -> DataFrame:
    """References that begin with group:."""
    return entities.where(F.col("reference").startswith("group:")).select("reference").orderBy("reference")


def package_dependents(packages: DataFrame, name: str) -> DataFrame:
    """Packages(package, dependencies array) that depend on one, sorted."""
    return packages.where(F.array_contains("dependencies", name)).select("package").orderBy("package")


def touched_entities(entities: DataFrame) -> DataFrame:
    """(reference, touched): all that an entity names, itself included, sorted and distinct; columns that are missing or
    null name nothing."""
    none = F.array().cast("array<string>")
    single = [F.when(F.col(c).isNotNull(), F.array(F.col(c))).otherwise(none) for c in ("reference", "owner", "system", "domain", "parent") if c in entities.columns]
    many = [F.coalesce(F.col(c), none) for c in ("depends_on", "provides_apis", "consumes_apis") if c in entities.columns]
    return entities.select("reference", F.array_sort(F.array_distinct(F.concat(*single, *many))).alias("touched"))


def session_range(events: DataFrame, session_id: str, first: int, last: int) -> DataFrame:
    """Events of a session with event_seq from first to last, both included, in order."""
    return events.where((F.col("session_id") == session_id) & F.col("event_seq").between(first, last)).orderBy("event_seq")


def dead_inventory(nodes: DataFrame) -> DataFrame:
    return nodes.where("is_dead_code").select("id", "path").orderBy("id")


def risk_commits(commits: DataFrame) -> DataFrame:
    """Commits that break something or reach something."""
    return commits.where("verdict = 'BREAKING' or blast > 0")


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """The row with the greatest rowid."""
    whole = F.struct(*[F.col(f"`{c}`") for c in snapshots.columns])
    return snapshots.agg(F.max_by(whole, F.col("rowid")).alias("r")).where("r is not null").select("r.*")


def ordered_changes(changes: DataFrame, kinds: list[str]) -> DataFrame:
    """Distinct changes(kind, subject, detail) in the order of the list of kinds, then subject and detail."""
    place = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind")), F.lit(0))
    return changes.select("kind", "subject", "detail").distinct().orderBy(F.when(place > 0, place).otherwise(len(kinds) + 1), "subject", F.asc_nulls_first("detail"))


def ordered_lineage(moves: DataFrame) -> DataFrame:
    return moves.orderBy(F.asc_nulls_first("from_path"), F.asc_nulls_first("to_path"), "kind")


def named_unknown(symbols: DataFrame, known: DataFrame, k: int = 5) -> DataFrame:
    """(n, sample): how many symbols(id) are not known(id), and the first k of them."""
    lost = symbols.select("id").distinct().join(known.select("id"), "id", "left_anti")
    first = lost.orderBy("id").limit(k).agg(F.array_sort(F.collect_list("id")).alias("sample"))  # k rows
    return lost.agg(F.count("*").alias("n")).crossJoin(F.broadcast(first))


def seed_union(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(id): changed symbols(id) and the file nodes of changed files(path)."""
    return symbols.select("id").union(files.select(F.concat(F.lit("file::"), "path"))).distinct()


def merged_paths(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("path").union(right.select("path")).distinct()


def packages_of(sources: DataFrame) -> DataFrame:
    """(package): distinct top directories of sources(path); a file at the top is in none."""
    return sources.where(F.col("path").contains("/")).select(F.substring_index("path", "/", 1).alias("package")).distinct()


def narrowing_ratio(plan: DataFrame) -> DataFrame:
    """(selected, total, ratio) of a test plan(suite_id, decision): the share of suites that need not run."""
    run = F.count_if(F.col("decision") != "skip")
    return plan.agg(run.alias("selected"), F.count("*").alias("total")).withColumn("ratio", F.when(F.col("total") > 0, F.round(1 - F.col("selected") / F.col("total"), 9)).otherwise(0.0))


def suites_importing(imports: DataFrame, source: str) -> DataFrame:
    return imports.where(F.col("source") == source).select("suite_id").distinct()


def instrumented_files(hits: DataFrame) -> DataFrame:
    return hits.select("path").distinct()


def towards(pairs: DataFrame, path: str) -> DataFrame:
    """(other, confidence, lower, upper) of co-change pairs in the direction of a path: how often its partner's commits
    touch it too."""
    def pick(a: str, b: str) -> Column:
        return F.when(F.col("b") == path, F.col(a)).otherwise(F.col(b))

    near = pairs.where((F.col("a") == path) | (F.col("b") == path))
    return near.select(pick("a", "b").alias("other"), pick("a_to_b", "b_to_a").alias("confidence"), pick("a_to_b_lower", "b_to_a_lower").alias("lower"), pick("a_to_b_upper", "b_to_a_upper").alias("upper"))


def service_names(spans: DataFrame) -> DataFrame:
    return spans.where("service is not null").select("service").distinct()


def timeline_at(timeline: DataFrame, idx: int | None = None) -> DataFrame:
    """The revision at an index; the last one (head) without."""
    if idx is not None:
        return timeline.where(F.col("idx") == idx)
    return timeline.agg(F.max_by(F.struct(*timeline.columns), "idx").alias("r")).where("r is not null").select("r.*")


def resolve_revision(commits: DataFrame, refs: DataFrame, expression: str) -> DataFrame:
    """(oid) of a revision: a ref name (HEAD, a branch, a tag) or an object id, or a unique head of one of four letters or
    more, followed by any number of ~N steps to first parents. No row where that leads nowhere or is not unique."""
    name, *steps = expression.split("~")
    n = sum(int(s) if s else 1 for s in steps)
    ids = commits.select(F.col("oid").cast("string").alias("oid"), F.get("parents", F.lit(0)).cast("string").alias("parent"))
    start = refs.where(F.col("name") == name).select(F.col("oid").cast("string").alias("oid")).unionAll(ids.where(F.col("oid") == name).select("oid"))
    if len(name) >= 4:
        start = start.unionAll(ids.where(F.col("oid").startswith(name)).select("oid"))
    now = start.distinct()
    now = now.join(F.broadcast(now.agg(F.count("*").alias("n"))), F.col("n") == 1).select("oid")
    jump = ids.where("parent is not null")
    while n:  # powers of two: log(N) joins, each written
        if n % 2:
            now = written(now.join(jump, "oid").select(F.col("parent").alias("oid")), "revision")
        n //= 2
        if n:
            further = jump.select(F.col("oid").alias("parent"), F.col("parent").alias("next"))
            old, jump = jump, written(jump.join(further, "parent").select("oid", F.col("next").alias("parent")), "jumps")
            forget(old)
    return now


def flatten_trees(entries: DataFrame, roots: DataFrame, depth: int = 64) -> DataFrame:
    """(root, path, mode, blob) of the files below roots(tree) in entries(tree, name, kind tree|blob, mode, child). Level by
    level, all roots at once; trees that hold themselves end at `depth`."""
    level = roots.select(F.col("tree").alias("root"), "tree", F.lit("").alias("head")).distinct()
    files = []
    for _ in range(depth):
        met = level.join(entries, "tree").withColumn("path", F.concat("head", "name"))
        met = written(met.select("root", "path", "kind", "mode", "child"), "tree")
        files.append(met.where("kind = 'blob'").select("root", "path", "mode", F.col("child").alias("blob")))
        level = met.where("kind = 'tree'").select("root", F.col("child").alias("tree"), F.concat("path", F.lit("/")).alias("head"))
        if level.isEmpty():
            break
    out = files[0]
    for f in files[1:]:
        out = out.unionAll(f)
    return out


def lexical_search(files: DataFrame, names: DataFrame) -> DataFrame:
    """(name, path, line): lines of files(path, content) that hold names(name) as a whole word. Words are joined, not
    looked for one by one; a name of other characters than letters, digits and _ has no hit."""
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("at", "text"))
    words = lines.select("path", (F.col("at") + 1).cast("bigint").alias("line"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Za-z0-9_]+)"), F.lit(1)))).alias("name"))
    return words.join(names.select("name").distinct(), "name").select("name", "path", "line")


def promotion_gate(metrics: DataFrame) -> DataFrame:
    """(recall_lift, cost_cut, new_classes, passed) of metrics(engine, recall, precision, tokens, classes), where engine is
    `candidate` or any baseline: passed if recall rises by ten points, or tokens fall by 40 % at no loss of recall and
    precision, or a class of failures is found that no baseline finds."""
    c = metrics.where("engine = 'candidate'").select("recall", "precision", "tokens", "classes")
    b = metrics.where("engine <> 'candidate'").agg(F.max("recall").alias("br"), F.max("precision").alias("bp"), F.min("tokens").alias("bt"), F.max("classes").alias("bc"))
    lift, cut = (F.col("recall") - F.col("br")) * 100, F.when(F.col("bt") > 0, (F.col("bt") - F.col("tokens")) / F.col("bt") * 100).otherwise(0.0)
    rows = c.crossJoin(F.broadcast(b)).select(lift.alias("recall_lift"), cut.alias("cost_cut"), (F.col("classes") - F.col("bc")).alias("new_classes"), (F.col("recall") >= F.col("br")).alias("r"), (F.col("precision") >= F.col("bp")).alias("p"))
    return rows.select("recall_lift", "cost_cut", "new_classes", ((F.col("recall_lift") >= 10) | ((F.col("cost_cut") >= 40) & F.col("r") & F.col("p")) | (F.col("new_classes") > 0)).alias("passed"))


def span_symbols(spans: DataFrame, symbols: DataFrame) -> DataFrame:
    """(span_id, symbol, outcome) of spans(span_id, function, path) against symbols(id, name, path): the symbol of that
    path and name, else the only one of that name (`matched`), else `ambiguous` or `unmatched`; `uncorrelated` without
    a function."""
    exact = symbols.where("path is not null").groupBy("path", "name").agg(F.max("id").alias("exact"))
    by_name = symbols.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("only"))
    s = spans.select("span_id", F.col("function").alias("name"), F.regexp_replace(F.translate("path", "\\", "/"), r"^(\./)+", "").alias("path"))
    j = s.join(exact, ["path", "name"], "left").join(by_name, "name", "left")
    outcome = F.when(F.col("name").isNull(), "uncorrelated").when(F.col("exact").isNotNull() | (F.col("n") == 1), "matched").when(F.col("n") > 1, "ambiguous").otherwise("unmatched")
    return j.select("span_id", F.when(outcome == "matched", F.coalesce("exact", "only")).alias("symbol"), outcome.alias("outcome"))


# What is tried behind an import without an extension, in this order.
CANDIDATES = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", ".py", "/__init__.py")


def resolve_imports(imports: DataFrame, files: DataFrame, candidates: tuple[str, ...] = CANDIDATES, prefixes: dict[str, str] | None = None) -> DataFrame:
    """(path, specifier, target, tier) of imports(path, specifier) in files(path): relative specifiers from the importing
    file's folder, others by `prefixes` (alias to folder); the first candidate that is a file wins (`resolved`).
    Relative ones without a file are `unresolved`; others are external::specifier."""
    spec = F.col("specifier")
    relative = spec.startswith(".")
    aliased = F.lit(None).cast("string")
    for alias, folder in sorted((prefixes or {}).items(), key=lambda kv: len(kv[0])):  # the longest alias is tested first
        aliased = F.when(spec.startswith(alias), F.concat(F.lit(folder), F.expr(f"substring(specifier, {len(alias) + 1})"))).otherwise(aliased)
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    steps = F.split(F.when(relative, F.concat_ws("/", folder, spec)).otherwise(aliased), "/")
    # a step .. takes the step before it away, . and empty ones nothing
    none = F.array().cast("array<string>")
    clean = F.aggregate(steps, none, lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when((x == ".") | (x == ""), acc).otherwise(F.array_append(acc, x)))
    each = imports.select("path", "specifier").distinct().withColumn("base", F.array_join(clean, "/")).withColumn("relative", relative)
    tried = each.where("base is not null").select("path", "specifier", "base", F.posexplode(F.array(*[F.lit(c) for c in candidates])).alias("rank", "tail"))
    hit = tried.withColumn("target", F.concat("base", "tail")).join(files.select(F.col("path").alias("target")).distinct(), "target")
    best = hit.groupBy("path", "specifier").agg(F.min_by("target", "rank").alias("target"))
    tier = F.when(F.col("target").isNotNull(), "resolved").when(F.col("relative"), "unresolved").otherwise("external")
    out = each.join(best, ["path", "specifier"], "left")
    return out.select("path", "specifier", F.coalesce("target", F.when(~F.col("relative"), F.concat(F.lit("external::"), spec))).alias("target"), tier.alias("tier"))


def newest_first(commits: DataFrame) -> DataFrame:
    """(oid, level) of commits(oid, parents): 0 for commits that no other has as a parent, else one more than the
    greatest level of their children."""
    from strataspark.operators.history import topological_levels

    edges = commits.select(F.col("oid").alias("child"), F.explode("parents").alias("oid"))
    children = edges.groupBy("oid").agg(F.collect_set("child").alias("parents"))
    turned = commits.select("oid").join(children, "oid", "left").select("oid", F.coalesce("parents", F.expr("array()")).alias("parents"))
    return topological_levels(turned)


def ranked_candidates(hits: DataFrame, here: str) -> DataFrame:
    """(cursor, id, outcome) of hits(cursor, order, id, path, start_line, end_line, line, declared): the smallest
    declaration around the cursor that has its name; else of the first candidate's hits those in the same file `here`,
    if any; one is `exact`, more are `ambiguous`."""
    around = hits.where("declared and line between start_line and end_line")
    w = Window.partitionBy("cursor").orderBy(F.col("end_line") - F.col("start_line"), "id")
    inner = around.withColumn("k", F.row_number().over(w)).where("k = 1").select("cursor", "id", F.lit("exact").alias("outcome"))
    rest = hits.join(inner.select("cursor"), "cursor", "left_anti")
    first = rest.join(rest.groupBy("cursor").agg(F.min("order").alias("order")), ["cursor", "order"])
    own = first.where(F.col("path") == here)
    pool = own.unionByName(first.join(own.select("cursor"), "cursor", "left_anti")).select("cursor", "id").distinct()
    n = pool.groupBy("cursor").agg(F.count("*").alias("n"))
    return inner.unionByName(pool.join(n, "cursor").select("cursor", "id", F.when(F.col("n") == 1, "exact").otherwise("ambiguous").alias("outcome")))
