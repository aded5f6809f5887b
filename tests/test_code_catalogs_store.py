"""Code adapters, import resolution, catalogs, monorepos, rules, settings, stores, and operators without SQL."""

import json

import pytest

from strataspark.functions import names
from strataspark.operators import edits, records, temporal
from strataspark.sinks import reports, store
from strataspark.sources import catalogs, code

TS = """import { save, load as fetch } from './db';
import axios from "axios";
// class Ghost { }
export class Shop {
  private cart: Cart;
  constructor(readonly name: string) {}
  async buy(item: string, n = 1): Promise<void> {
    if (n > 0) { this.check(item); save(item); }
    const c = new Cart(); c.add(item);
    const s = "helper(1) {";
  }
  private check(item: string) { return helper(item); }
}
class Cart { add(x: string) { axios(x); } }
export function helper(x: string) { return x; }
const twice = (x: number) => { return helper(x); };
"""
GO = 'package a\n\nimport "fmt"\n\ntype Box struct { n int }\n\nfunc (b *Box) Open() { b.n = 1; fmt.Println(b); inner() }\n\nfunc inner() {}\n'
RUST = "use std::fs::read;\npub struct Kit { n: u8 }\nimpl Kit {\n    pub fn run(&self) { self.step(); helper(); read(); }\n    fn step(&self) {}\n}\nfn helper() {}\n"
JAVA = "import java.util.List;\n\npublic class Plan {\n    @Override\n    public int go(int k) {\n        if (k > 1) { return step(k); }\n        return this.step(2);\n    }\n    private int step(int k) { return k; }\n}\n"


def read(spark, **files):
    return code.analyse(spark.createDataFrame([(p.replace("__", "."), c) for p, c in files.items()], "path string, content string"))


def test_adapters(spark):
    rows = read(spark, a__ts=TS, b__go=GO, c__rs=RUST, d__java=JAVA, e__txt="class X {}", f__js="eval('x'); function f(a) {", g__ts=None).collect()
    symbols = {(r["path"], r["kind"], r["scope"], r["name"], r["visibility"]) for r in rows if r["row"] == "symbol"}
    assert symbols == {
        ("a.ts", "class", None, "Shop", "public"), ("a.ts", "method", "Shop", "constructor", "public"), ("a.ts", "method", "Shop", "buy", "public"), ("a.ts", "method", "Shop", "check", "private"), ("a.ts", "class", None, "Cart", "public"),
        ("a.ts", "method", "Cart", "add", "public"), ("a.ts", "function", None, "helper", "public"), ("a.ts", "function", None, "twice", "public"), ("b.go", "struct", None, "Box", "public"), ("b.go", "method", "Box", "Open", "public"),
        ("b.go", "function", None, "inner", "private"), ("c.rs", "struct", None, "Kit", "public"), ("c.rs", "method", "Kit", "run", "public"), ("c.rs", "method", "Kit", "step", "private"), ("c.rs", "function", None, "helper", "private"),
        ("d.java", "class", None, "Plan", "public"), ("d.java", "method", "Plan", "go", "public"), ("d.java", "method", "Plan", "step", "private"), ("f.js", "function", None, "f", "public"),
    }
    edges = {(r["id"], r["target"], r["tier"]) for r in rows if r["row"] == "edge"}
    assert {("a.ts#method:Shop.buy", "a.ts#method:Shop.check", "this-method"), ("a.ts#method:Shop.buy", "./db#save", "imported-name"), ("a.ts#method:Shop.buy", "a.ts#method:Cart.add", "typed-receiver"),
            ("a.ts#method:Shop.check", "a.ts#function:helper", "local"), ("a.ts#function:twice", "a.ts#function:helper", "local"), ("b.go#method:Box.Open", "b.go#function:inner", "local"),
            ("c.rs#method:Kit.run", "c.rs#method:Kit.step", "this-method"), ("c.rs#method:Kit.run", "c.rs#function:helper", "local"), ("d.java#method:Plan.go", "d.java#method:Plan.step", "this-method")} <= edges
    assert not any("Ghost" in str(r) for r in rows)
    assert {r["specifier"] for r in rows if r["row"] == "import"} >= {"./db", "axios", "fmt", "std::fs::read", "java.util.List"}
    coverage = {r["path"]: r["coverage"] for r in rows if r["row"] == "file"}
    assert coverage["a.ts"] == "verified" and coverage["f.js"] == "unknown" and "e.txt" not in coverage


def test_discovery_and_entities(spark):
    paths = [("a/catalog-info.yaml", 10), ("node_modules/x/catalog-info.yaml", 10), ("b/catalog-info.yaml", 9999), ("c/other.yaml", 1), ("/".join("d" * 20) + "/catalog-info.yaml", 1), ("z/catalog-info.yaml", 1)]
    got = {r["path"]: r["skipped"] for r in catalogs.discover(spark.createDataFrame(paths, "path string, length long"), max_bytes=100, most=1).collect()}
    assert [got[p] for p, _ in paths if p in got] == [None, "pruned", "too_large", "too_deep", "too_many"]
    v = {"apiVersion": "backstage.io/v1alpha1"}
    shop = v | {"kind": "Component", "metadata": {"name": "Shop", "annotations": {"github.com/project-slug": "o/shop"}}, "spec": {"owner": "core", "system": "sales", "dependsOn": ["resource:db", "pay"], "providesApis": ["orders"]}}
    odd = v | {"kind": "Widget", "metadata": {"name": "w", "namespace": "x"}, "spec": {"extra": 1}}
    docs = [("a", json.dumps(shop)), ("b", json.dumps(odd)), ("c", json.dumps({"kind": "API", "metadata": {"name": "n"}})), ("d", "{"), ("e", None), ("f", "[1]")]
    rows = {r["reference"]: r for r in catalogs.entities(spark.createDataFrame(docs, "path string, content string")).collect()}
    assert set(rows) == {"component:default/shop", "widget:x/w"}
    s = rows["component:default/shop"]
    assert (s["owner"], s["owner_kind"], s["system"], s["depends_on"], s["provides_apis"], s["project"], s["coverage"]) == ("group:default/core", "group", "system:default/sales", ["component:default/pay", "resource:default/db"], ["api:default/orders"], "o/shop", "verified")
    assert not rows["widget:x/w"]["modelled"] and rows["widget:x/w"]["coverage"] == "partial"


def test_workspaces(spark):
    files = [
        ("package.json", '{"name": "root", "workspaces": ["packages/*"]}'), ("packages/a/package.json", '{"name": "@x/a", "dependencies": {"@x/b": "1", "left": "2"}}'), ("packages/b/package.json", '{"name": "@x/b"}'),
        ("tools/c/package.json", '{"name": "c"}'), ("Cargo.toml", '[workspace]\nmembers = ["crates/*"]\n'), ("go.work", "go 1.22\nuse (\n  ./m\n  ./n\n)\n"), ("pom.xml", "<modules><module> core </module></modules>"), ("settings.gradle", "include ':app', ':lib:x'\n"),
        ("nx.json", "{}"), ("bad/Cargo.toml", "["),
    ]
    docs = spark.createDataFrame(files, "path string, content string")
    patterns = catalogs.workspace_patterns(docs)
    assert {(r["tool"], r["pattern"]) for r in patterns.collect()} == {("npm", "packages/*"), ("cargo", "crates/*"), ("go", "m"), ("go", "n"), ("maven", "core"), ("gradle", "app"), ("gradle", "lib/x"), ("nx", None)}
    packages = catalogs.packages(docs, patterns.where("tool = 'npm'"))
    assert {(r["package"], r["directory"], tuple(r["dependencies"])) for r in packages.collect()} == {("@x/a", "packages/a", ("@x/b",)), ("@x/b", "packages/b", ())}
    spec = spark.createDataFrame([("@x/a/deep/file",), ("@x/b",), ("react",)], "specifier string")
    assert {tuple(r) for r in catalogs.package_imports(spec, packages).collect()} == {("@x/a/deep/file", "@x/a", "deep/file"), ("@x/b", "@x/b", "")}


def test_rules_and_settings():
    good = [{"id": "a", "kind": "layers", "severity": "info"}, {"id": "b", "kind": "no_new_cycle"}]
    assert [r["severity"] for r in catalogs.read_rules(json.dumps({"rules": good}))] == ["info", "error"]
    for bad in ([{"kind": "layers"}], [good[0], good[0]], [{"id": "x", "kind": "other"}], [{"id": "x", "kind": "layers", "severity": "?"}]):
        with pytest.raises(ValueError, match="rule"):
            catalogs.read_rules(json.dumps(bad))
    assert catalogs.read_settings('[scan]\nmax_files = 3\n')["max_files"] == 3
    for bad in ("[scan]\nmax_files = -1\n", "[scan]\nother = 1\n", '[scan]\nmax_bytes = "1"\n'):
        with pytest.raises(ValueError, match="setting"):
            catalogs.read_settings(bad)


def test_store(spark, tmp_path):
    findings = spark.createDataFrame([("f1", "r", "m"), ("f2", "r", "n")], "finding_id string, rule_id string, message string")
    evidence = spark.createDataFrame([("f1", "a.py")], "finding_id string, path string")
    root = str(tmp_path / "runs")
    for run in ("one", "two", "one"):
        store.save_run(run, findings, evidence, root)
    assert store.load_runs(spark, root, "findings").groupBy("run_id").count().count() == 2 and store.load_runs(spark, root, "findings").count() == 4
    with pytest.raises(ValueError, match="duplicate"):
        store.save_run("x", findings.unionAll(findings), evidence, root)
    files = spark.createDataFrame([("a", "text"), ("b", "text"), ("c", "other"), ("d", None)], "path string, content string")
    at = str(tmp_path / "cas")
    store.put_contents(files, at)
    store.put_contents(files, at)
    assert spark.read.parquet(at).count() == 2
    back = store.get_contents(files.selectExpr("path", "sha2(content, 256) as content_hash").unionAll(spark.createDataFrame([("e", "0")], "path string, h string")), at)
    assert {(r["path"], r["content"], r["intact"]) for r in back.collect()} == {("a", "text", True), ("b", "text", True), ("c", "other", True), ("d", None, False), ("e", None, False)}
    events = spark.createDataFrame([("s", 2, "y"), ("s", 1, "x"), ("t", 1, "z")], "session_id string, event_seq long, data string")
    store.export_session(events, "s", str(tmp_path / "s"))
    assert [r["data"] for r in store.import_session(spark, str(tmp_path / "s"), events.schema).collect()] == ["x", "y"]


def test_publication(spark, tmp_path):
    spark.createDataFrame([(1, "view", "{}")], "seq_id long, event_type string, data_json string").write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema("seq_id long, event_type string, data_json string").parquet(str(tmp_path / "in"))
    store.publish(live, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out"), wholetext=True).collect() if r["value"]] == ["id: 1\nevent: view\ndata: {}\n\n"]


def test_matches_that_consume_targets(spark):
    """Taking turns, against the deferred rounds."""
    import random

    rnd = random.Random(3)
    pairs = {(f"f{i}", f"t{j}"): rnd.randint(50, 99) for i in range(25) for j in range(20) if rnd.random() < 0.4}
    df = spark.createDataFrame([(a, b, n, 100) for (a, b), n in pairs.items()], "from_path string, to_path string, common long, `union` long")
    taken, want = set(), {}
    for a in sorted({a for a, _ in pairs}):
        left = sorted(((-n, b) for (x, b), n in pairs.items() if x == a and b not in taken))
        if left:
            want[a] = left[0][1]
            taken.add(left[0][1])
    assert {r["from_path"]: r["to_path"] for r in temporal.consume_matches(df).collect()} == want


def test_moves_use_leftovers(spark):
    text = " ".join(f"w{k}" for k in range(40))
    before = spark.createDataFrame([("a", "h1", "x y"), ("b", "h2", text), ("c", "h3", text + " more")], "path string, content_hash string, text string")
    after = spark.createDataFrame([("z", "h1", "x y"), ("n", "h4", text + " less")], "path string, content_hash string, text string")
    assert [(r["from_path"], r["to_path"]) for r in temporal.lineage_moves(before, after).collect()] == [("b", "n")]


def test_asof_beyond_the_broadcast(spark, monkeypatch):
    facts = spark.createDataFrame([(k, k % 7, k % 7 + k % 5 + 1 if k % 3 else None) for k in range(60)], "fact long, opened_idx long, closed_idx long")
    points = spark.range(0, 15).withColumnRenamed("id", "at")
    want = {tuple(r) for r in temporal.active_at(facts, points).select("fact", "at").collect()}
    monkeypatch.setattr(temporal, "MAX_POINTS", 3)
    monkeypatch.setattr(temporal, "SLOTS", 4)
    rows = temporal.active_at(facts, points).select("fact", "at").collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want) > 100


def test_small_records(spark):
    w = spark.createDataFrame([("a", "verified"), ("a", "odd")], "workspace_id string, coverage string")
    with pytest.raises(ValueError, match="twice"):
        records.register(w)
    pairs = spark.createDataFrame([("x", "y", 1, 2, 3, 4, 5, 6)], "a string, b string, a_to_b int, a_to_b_lower int, a_to_b_upper int, b_to_a int, b_to_a_lower int, b_to_a_upper int")
    assert tuple(records.towards(pairs, "x").first()) == ("y", 4, 5, 6) and tuple(records.towards(pairs, "y").first()) == ("x", 1, 2, 3)
    hits = [(1, 0, "in", "f", 1, 9, 4, True), (1, 0, "out", "f", 1, 99, 4, True), (2, 1, "b", "g", 0, 0, 4, False), (2, 1, "c", "f", 0, 0, 4, False), (2, 2, "d", "f", 0, 0, 4, False), (3, 1, "e", "g", 0, 0, 1, False), (3, 1, "h", "i", 0, 0, 1, False)]
    df = spark.createDataFrame(hits, "cursor int, `order` int, id string, path string, start_line int, end_line int, line int, declared boolean")
    assert {tuple(r) for r in records.ranked_candidates(df, "f").collect()} == {(1, "in", "exact"), (2, "c", "exact"), (3, "e", "ambiguous"), (3, "h", "ambiguous")}
    nodes, edges = edits.time_travel_frame(spark.createDataFrame([("a", "x/p", "1")], "id string, path string, signature string"), spark.createDataFrame([("a", "x/p", "2"), ("b", "y/p", "1")], "id string, path string, signature string"), spark.createDataFrame([("a", "b"), ("a", "q")], "src string, dst string"))
    assert {(r["id"], r["status"], r["cluster"]) for r in nodes.collect()} == {("a", "modified", 0), ("b", "added", 1)} and edges.count() == 1
    urn = "urn:space:entity:github:org:repo#./a\\b.ts::C.m"
    parts = spark.range(1).select(names.entity_parts(names.F.lit(urn)).alias("p"), names.entity_parts(names.F.lit("urn:x")).alias("n")).first()
    assert tuple(parts["p"]) == ("github", "org", "repo", "a/b.ts", "C.m") and parts["n"] is None


def test_lcov_over_blocks(spark, monkeypatch):
    from strataspark.operators import selection

    monkeypatch.setattr(selection, "LCOV_BLOCK", 3)
    lines = ["TN:", "SF:" + "a" * 5000, "DA:1,2", "DA:2,0", "end_of_record", "x", "x", "x", "DA:1,3", "SF:b", "DA:7,1", "DA:oops", "DA:1,2,hash"]
    df = spark.createDataFrame([("s", k, t) for k, t in enumerate(lines)], "suite_id string, line_no long, text string")
    got = {(r["path"][:1], r["line"]): r["hits"] for r in selection.lcov_hits(df).collect()}
    assert got == {("a", 1): 5, ("a", 2): 0, ("b", 7): 1, ("b", 1): 2}
    assert [r["text"] for r in selection.lcov_errors(df).collect()] == ["DA:oops"]


def test_sarif_of_unused_rules_is_empty(spark):
    none = spark.createDataFrame([], "finding_id string, rule_id string, severity string, message string")
    assert reports.sarif_results(none, spark.createDataFrame([], "finding_id string, path string, line int")).count() == 0


def test_ignore_rules(spark):
    from strataspark.sources import files

    rules = ["# note", "", "*.log", "/out", "docs/*.md", "cache/", "!keep.log", "**/tmp/**", "a?c"]
    paths = {"x.log": True, "d/x.log": True, "keep.log": False, "out/f": True, "d/out/f": False, "docs/a.md": True, "docs/d/a.md": False, "cache/f": True, "d/cache/f": True, "cache": False, "d/tmp/e/f": True, "abc": True, "abbc": False, "src/a.py": False}
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r["path"]: r["i"] for r in df.select("path", files.ignored(records.F.col("path"), rules).alias("i")).collect()} == paths


def test_scan_heeds_its_ignore_file(spark, tmp_path):
    from strataspark.sources import files

    for p, text in {".gitignore": "*.log\n", "a.py": "x = 1\r\n", "b.log": "z", "big.py": "y" * 500}.items():
        (tmp_path / p).write_bytes(text.encode())
    rows = {r["path"]: r for r in files.scan(spark, str(tmp_path), max_bytes=100).collect()}
    assert set(rows) == {"a.py", "big.py"} and rows["a.py"]["content"] == "x = 1\n" and rows["big.py"]["skipped"] == "too_large" and rows["big.py"]["content"] is None


def test_suite_imports(spark):
    from strataspark.sources import files

    f = spark.createDataFrame([("src/a.ts", ""), ("src/a.test.ts", "import { x } from './a';\nimport y from 'jest';\nimport z from './gone';")], "path string, content string")
    assert {tuple(r) for r in files.suite_imports(f).collect()} == {("src/a.test.ts", "src/a.ts", "resolved"), ("src/a.test.ts", "external::jest", "external"), ("src/a.test.ts", None, "unresolved")}


def test_plugins(spark):
    from strataspark import plugins

    assert plugins.members("layout") == ["golden-angle"]
    with pytest.raises(ValueError, match="unknown"):
        plugins.register("other", "x")
    with pytest.raises(ValueError, match="twice"):
        plugins.register("layout", "golden-angle")(lambda *_: None)
    with pytest.raises(KeyError, match="golden-angle"):
        plugins.get("layout", "none")
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    assert plugins.get("layout", "golden-angle")(nodes, None).count() == 2
    files = spark.createDataFrame([("a.ts", "import {q} from './q';\nfunction f() { g(); }\nfunction g() {}")], "path string, content string")
    got = {tuple(r) for r in plugins.get("extractor", "code")(files).collect()}
    assert ("a.ts#function:f", "calls", "a.ts#function:g") in got and ("a.ts", "imports", "./q") in got


def test_rules_are_dispatched(spark):
    from strataspark.operators import policy

    nodes = spark.createDataFrame([("a", "ui/a"), ("b", "db/b")], "id string, path string")
    edges = spark.createDataFrame([("a", "b", "calls")], "src string, dst string, kind string")
    rules = [{"id": "r", "kind": "forbidden_dependency", "scope_source": "ui/*", "scope_target": "db/*"}, {"id": "s", "kind": "api_compatibility"}]
    assert {tuple(r) for r in policy.evaluate_rules(rules, edges, nodes).collect()} == {("r", "error", "a", "b", "fail"), ("s", "error", None, None, "unknown")}
    with pytest.raises(ValueError, match="unknown kind"):
        policy.evaluate_rules([{"id": "x", "kind": "other"}], edges, nodes)


def test_symbols_follow_moved_files(spark):
    from strataspark.operators import diff

    cols = "id string, path string, kind string, signature string, visibility string, line int"
    before, after = spark.createDataFrame([("old#f", "old.py", "function", "(x)", "public", 1)], cols), spark.createDataFrame([("new#f", "new.py", "function", "(x)", "public", 1)], cols)
    moved = spark.createDataFrame([("new.py", "old.py")], "path string, old_path string")
    assert {tuple(r) for r in diff.symbol_diff(before, after, moved).collect()} == {("renamed", "new#f", "old#f")}
    assert {r["type"] for r in diff.symbol_diff(before, after).collect()} == {"added", "removed"}
