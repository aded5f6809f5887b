import json

from strataspark.operators import contracts, history


def test_blame_and_hunks(spark):
    v = spark.createDataFrame([("f", 0, "c0", "a\nb\nc"), ("f", 1, "c1", "a\nx\nb\nc"), ("f", 2, "c2", "a\nx\nb\nd"), ("g", 0, "c0", "")], "path string, idx int, oid string, content string")
    got = {(r["path"], r["line"]): (r["text"], r["oid"]) for r in history.blame(v).collect()}
    assert got == {("f", 1): ("a", "c0"), ("f", 2): ("x", "c1"), ("f", 3): ("b", "c0"), ("f", 4): ("d", "c2"), ("g", 1): ("", "c0")}
    h = history.hunks(spark.createDataFrame([("f", "a\nb\nc", "a\nx\nb"), ("new", None, "q")], "path string, before string, after string"))
    assert {tuple(r) for r in h.collect()} == {("f", "insert", 2, 0, 2, 1), ("f", "delete", 3, 1, 4, 0), ("new", "insert", 1, 0, 1, 1)}


def test_first_parent_walk_of_a_long_chain(spark):
    c = spark.range(1, 41).selectExpr("id as oid", "case when id > 1 then array(id - 1) else array() end as parents")
    for limit in (1, 2, 7, 100):
        got = sorted((r["step"], r["oid"]) for r in history.first_parent_walk(c, 40, limit).collect())
        assert got == [(k, 40 - k) for k in range(min(limit, 40))]


def test_topological_levels_skip_cycles(spark):
    c = spark.createDataFrame([(1, []), (2, [1]), (3, [1, 2]), (4, [5]), (5, [4])], "oid long, parents array<long>")
    assert {r["oid"]: r["level"] for r in history.topological_levels(c).collect()} == {1: 0, 2: 1, 3: 2}


def test_schema_facts_and_payload_changes(spark):
    old = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}, "b": {"enum": ["x", "y"]}, "c": {"type": "array", "items": {"type": "string"}}}}
    new = {"type": "object", "additionalProperties": False, "required": ["a", "d"], "properties": {"a": {"type": ["integer", "null"]}, "b": {"enum": ["x"]}, "c": {"$ref": "#/defs/c"}, "d": {"type": "string", "pattern": "."}}, "defs": {"c": {"type": "array", "items": {"type": "string"}}}}
    f = contracts.schema_facts(spark.createDataFrame([("old", json.dumps(old)), ("new", json.dumps(new)), ("bad", "{")], "path string, content string"))
    rows = {(r["path"], r["pointer"]): (r["types"], r["required"], r["coverage"]) for r in f.collect()}
    assert rows[("old", "/c/[]")] == (["string"], False, "verified") and rows[("new", "/c")][0] == ["array"]
    assert rows[("new", "/d")] == (["string"], True, "partial") and rows[("new", "/a")][0] == ["integer", "null"]
    side = lambda p: f.where(f"path = '{p}'").selectExpr("'s' as subject", "pointer", "types", "enums", "required", "closed", "coverage")
    got = {(r["pointer"], r["kind"], r["severity"]) for r in contracts.payload_changes(side("old").where("pointer <> ''"), side("new").where("pointer <> ''"), "accepted").collect()}
    assert got == {("/a", "payload_type_widened", "non_breaking"), ("/b", "payload_enum_value_removed", "breaking"), ("/d", "payload_requiredness_gained", "breaking")}


def facts(spark, docs):
    return contracts.schema_facts(spark.createDataFrame([(k, v if isinstance(v, str) else json.dumps(v)) for k, v in docs.items()], "path string, content string"))


def test_schemas_that_refer_to_themselves_end(spark):
    tree = {"type": "object", "properties": {"left": {"$ref": "#"}, "right": {"$ref": "#"}, "name": {"type": "string"}}}
    loop = {"properties": {"a": {"$ref": "#/properties/b"}, "b": {"$ref": "#/properties/a"}, "c": {"$ref": "#/x/0/y"}, "d": {"$ref": "#/list/1"}}, "list": [1, {"type": "null"}]}
    rows = {(r["path"], r["pointer"]): (r["types"], r["coverage"]) for r in facts(spark, {"tree": tree, "loop": loop, "top": [1], "none": "null", "bad": "{"}).collect()}
    assert rows["tree", "/name"] == (["string"], "verified") and rows["tree", "/left/left"] == ([], "unknown")
    assert rows["loop", "/a"] == ([], "unknown") and rows["loop", "/c"] == ([], "unknown") and rows["loop", "/d"] == (["null"], "verified")
    assert rows["top", ""] == ([], "unknown") and len(rows) < 30


def test_payloads_by_direction(spark):
    """Absent types, whole payloads, and what lies below an incomparable or removed node."""
    old = {"properties": {"t": {}, "n": {"type": "object", "pattern": "x", "properties": {"x": {"type": "string"}}}, "gone": {"type": "object", "properties": {"y": {"type": "string"}}}}}
    new = {"properties": {"t": {"type": "string"}, "n": {"type": "object", "properties": {"x": {"type": "integer"}}}, "more": {"type": "string"}}}
    f = facts(spark, {"old": old, "new": new})
    side = lambda p: f.where(f"path = '{p}'").selectExpr("'s' as subject", "pointer", "types", "enums", "required", "closed", "coverage")
    want = {"accepted": ("breaking", "non_breaking"), "emitted": ("non_breaking", "unknown"), "both": ("breaking", "unknown")}
    for way, (narrowed, added) in want.items():
        got = {(r["pointer"], r["kind"], r["severity"]) for r in contracts.payload_changes(side("old"), side("new"), way).collect()}
        assert got == {("/t", "payload_type_narrowed", narrowed), ("/n", "payload_incomparable", "unknown"), ("/gone", "payload_property_removed", "breaking"), ("/more", "payload_property_added", added)}
    whole = {(r["pointer"], r["kind"], r["severity"]) for r in contracts.payload_changes(side("old"), side("new").limit(0), "emitted").collect()}
    assert whole == {("", "message_payload_removed", "breaking")}
