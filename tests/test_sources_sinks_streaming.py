import json

import pytest

from strataspark.functions.storage import shared_dir
from strataspark.sinks import reports
from strataspark.sources import files, interfaces, specs
from strataspark.streaming import live


def test_scan(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_bytes(b"x = 1\r\ny = 2\r\n")
    (tmp_path / "src/gen.ts").write_text("// @generated by a tool\nlet a = process.env.HOME_DIR\n")
    (tmp_path / "big.go").write_text("x" * 5000)
    (tmp_path / "skip.md").write_text("no")
    rows = {r["path"]: r for r in files.scan(spark, str(tmp_path), ("*.md",), max_bytes=4000).collect()}
    assert sorted(rows) == ["big.go", "src/a.py", "src/gen.ts"]
    assert rows["src/a.py"]["content"] == "x = 1\ny = 2\n" and rows["src/a.py"]["language"] == "python"
    assert rows["src/gen.ts"]["is_generated"] and not rows["src/a.py"]["is_generated"]
    assert rows["big.go"]["skipped"] == "too_large" and rows["big.go"]["content"] is None
    f = files.scan(spark, str(tmp_path))
    assert files.snapshot_digest(f).first() == files.snapshot_digest(f.repartition(5)).first()
    assert {(r["resource"], r["path"]) for r in files.resource_uses(f.where("content is not null")).collect()} == {("env:HOME_DIR", "src/gen.ts")}


def test_inventory(spark):
    docs = spark.createDataFrame([("tests/test_a.py", "def test_one():\n    pass\n"), ("src/b.spec.ts", "it('does it', f)\n"), ("src/a.py", "def test_no(): 1")], "path string, content string")
    assert {(r["suite_id"], r["name"], r["line"]) for r in files.test_inventory(docs).collect()} == {("tests/test_a.py", "test_one", 1), ("src/b.spec.ts", "does it", 1)}


def test_python_symbols(spark):
    code = "import os\nfrom m import g\n\ndef f(a, b=1):\n    g(a)\n    os.getcwd()\n    return h()\n\ndef h():\n    pass\n\nclass C:\n    def m(self):\n        self.n()\n    def n(self):\n        f(1)\n"
    rows = specs.python_symbols(spark.createDataFrame([("a.py", code), ("bad.py", "def ("), ("null.py", None)], "path string, content string")).collect()
    symbols = {(r["id"], r["kind"], r["signature"]) for r in rows if r["row"] == "symbol"}
    assert symbols == {("a.py#f", "function", "a, b=1"), ("a.py#h", "function", ""), ("a.py#C", "class", ""), ("a.py#C.m", "method", "self"), ("a.py#C.n", "method", "self"), ("bad.py", "syntax_error", None)}
    edges = {(r["id"], r["target"], r["tier"]) for r in rows if r["row"] == "edge"}
    assert edges == {("a.py#f", "m.g", "imported-name"), ("a.py#f", "os.getcwd", "imported-name"), ("a.py#f", "a.py#h", "local"), ("a.py#C.m", "a.py#C.n", "this-method"), ("a.py#C.n", "a.py#f", "local")}


def test_manifests(spark):
    docs = [
        ("x/package.json", json.dumps({"dependencies": {"a": "^1", "b": "workspace:*"}, "devDependencies": {"c": "git+ssh://x"}})),
        ("requirements.txt", "Foo[bar]>=1.2 # c\n# only\nbaz\n"),
        ("go.mod", "module m\nrequire (\n\texample.com/x v1.2.3\n\texample.com/y v0.1.0 // indirect\n)\n"),
        ("Cargo.toml", '[dependencies]\ns = "1"\np = { path = "../p" }\n'),
        ("bad/package.json", "{"),
    ]
    got = {tuple(r)[1:] for r in specs.manifests(spark.createDataFrame(docs, "path string, content string")).collect()}
    assert got == {("npm", "a", "^1", "runtime", "registry"), ("npm", "b", "workspace:*", "runtime", "workspace"), ("npm", "c", "git+ssh://x", "dev", "git"), ("pypi", "foo", ">=1.2", "runtime", "registry"),
                   ("pypi", "baz", "", "runtime", "registry"), ("go", "example.com/x", "v1.2.3", "runtime", "registry"), ("go", "example.com/y", "v0.1.0", "indirect", "registry"), ("cargo", "s", "1", "runtime", "registry"), ("cargo", "p", "", "runtime", "path")}


def test_openapi_and_otlp(spark):
    api = {"paths": {"/o/{id}": {"get": {"operationId": "g", "parameters": [{"$ref": "#/components/parameters/id"}, {"in": "query", "name": "q", "schema": {"type": "string"}}]}, "post": {}}}, "components": {"parameters": {"id": {"in": "path", "name": "id", "required": True, "schema": {"type": "integer"}}}}}
    rows = {tuple(r)[1:] for r in interfaces.openapi_parameters(spark.createDataFrame([("a.json", json.dumps(api)), ("b", "x")], "path string, content string")).collect()}
    assert rows == {("/o/{id}", "get", "g", "path", "id", True, "integer"), ("/o/{id}", "get", "g", "query", "q", False, "string"), ("/o/{id}", "post", None, None, None, False, None)}
    span = {"traceId": "AA", "spanId": "B1", "parentSpanId": "", "name": "n", "kind": 2, "startTimeUnixNano": "5", "endTimeUnixNano": "9", "attributes": [{"key": "http.route", "value": {"stringValue": "/o/{id}"}}]}
    doc = {"resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "svc"}}]}, "scopeSpans": [{"spans": [span]}]}]}
    (r,) = specs.otlp_spans(spark.createDataFrame([("w1", json.dumps(doc))], "path string, content string")).collect()
    assert (r["window_id"], r["trace_id"], r["span_id"], r["parent_span_id"], r["service"], r["route"], r["end_unix_nano"]) == ("w1", "aa", "b1", None, "svc", "/o/{id}", 9)


def test_reports(spark, tmp_path):
    findings = spark.createDataFrame([("f1", "r1", "error", "bad"), ("f2", "r1", "info", "meh"), ("f3", "r2", "warning", "hm")], "finding_id string, rule_id string, severity string, message string")
    evidence = spark.createDataFrame([("f1", "a.py", 3), ("f1", "b.py", 1), ("f1", "a.py", 3)], "finding_id string, path string, line int")
    at = str(tmp_path / "sarif")
    reports.write_sarif(findings, evidence, at)
    runs = [json.loads(r["value"]) for r in spark.read.text(at).collect()]
    results = [x for r in runs for x in r["runs"][0]["results"]]
    assert len(runs) == 2 and {x["level"] for x in results} == {"error", "note", "warning"}
    (one,) = [x for x in results if x["level"] == "error"]
    assert [(p["physicalLocation"]["artifactLocation"]["uri"], p["physicalLocation"]["region"]["startLine"]) for p in one["locations"]] == [("a.py", 3), ("b.py", 1)]
    assert reports.text_report(findings).first()["line"] == "[error] r1: bad"
    assert json.loads(reports.canonical_json(findings).first()["json"]) == {"finding_id": "f1", "message": "bad", "rule_id": "r1", "severity": "error"}


def test_upsert(spark, tmp_path):
    at = str(tmp_path / "t")
    reports.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), at, ["k"])
    reports.upsert(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), at, ["k"])
    assert sorted(map(tuple, spark.read.parquet(at).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    with pytest.raises(ValueError):
        reports.upsert(spark.createDataFrame([(2, "c"), (2, "d")], "k int, v string"), at, ["k"])


def _stream(spark, tmp_path, batches, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return live.read_events(spark, str(tmp_path / "in"), schema)


def _run(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_replay_once_and_debounce(spark, tmp_path):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    s = lambda k: t0 + timedelta(seconds=k)
    schema = "seq_id long, key string, ts timestamp, path string"
    batches = [[(1, "k", s(0), "a"), (2, "k", s(1), "b")], [(2, "k", s(1), "b"), (3, "k", s(2), "a")], [(4, "k", s(60), "z")], [(5, "z", s(9000), "end")]]
    events = _stream(spark, tmp_path, batches, schema)
    assert sorted(r["seq_id"] for r in _run(live.once(events), "once", "append")) == [1, 2, 3, 4, 5]
    got = [(r["key"], r["n"], r["paths"]) for r in _run(live.debounced(events, "5 seconds", "10 seconds"), "debounced", "append")]
    assert ("k", 4, ["a", "b"]) in got and ("k", 1, ["z"]) in got


def test_ledger_cache_and_fixed_delay(spark, tmp_path):
    schema = "session_id string, hit boolean, spent long, saved long"
    rows = _run(live.running_ledger(_stream(spark, tmp_path / "l", [[("s", True, 5, 2)], [("s", False, 1, 0), ("t", True, 1, 1)]], schema)), "ledger", "update")
    assert ("s", 2, 1, 6, 2) in {tuple(r) for r in rows} and ("t", 1, 1, 1, 1) in {tuple(r) for r in rows}
    rows = _run(live.cache_hits(_stream(spark, tmp_path / "c", [[("k", "d1"), ("k", "d1")], [("k", "d1")], [("k", "d2")]], "cache_key string, digest string")), "cache", "update")
    assert sorted((r["digest"], r["hits"]) for r in rows) == [("d1", 1), ("d1", 2), ("d2", 0)]
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    ms = lambda k: t0 + timedelta(milliseconds=k)
    batches = [[("k", ms(0), "a"), ("k", ms(150), "b"), ("k", ms(190), "a"), ("k", ms(300), "c")], [("z", ms(90_000), "end")], [("z", ms(99_000), "end")]]
    rows = _run(live.fixed_delay(_stream(spark, tmp_path / "d", batches, "key string, ts timestamp, path string"), 200), "delay", "append")
    got = sorted((r["key"], r["n"], r["paths"]) for r in rows)
    assert ("k", 3, ["a", "b"]) in got and ("k", 1, ["c"]) in got


def test_reindex(spark, tmp_path):
    schema = "seq_id long, id string, v string"
    events = _stream(spark, tmp_path, [[(1, "a", "x"), (2, "a", "y")], [(3, "b", "z")]], schema)
    live.reindex(events, str(tmp_path / "index"), ["id"], f"{shared_dir(spark)}/reindex-{tmp_path.name}").awaitTermination(120)
    assert sorted(tuple(r)[1:] for r in spark.read.parquet(str(tmp_path / "index")).collect()) == [("a", "y"), ("b", "z")]
