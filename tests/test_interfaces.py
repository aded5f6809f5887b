"""Interface descriptions read and compared: OpenAPI, AsyncAPI, pacts."""

import json

import pytest

from strataspark.operators import contracts
from strataspark.sources import interfaces


def docs(spark, **by_path):
    return spark.createDataFrame([(k, v if isinstance(v, str) else json.dumps(v)) for k, v in by_path.items()], "path string, content string")


def body(schema, required=False, media="application/json"):
    return {"required": required, "content": {media: {"schema": schema}}}


def api(**paths):
    return {"openapi": "3.0.0", "paths": {"/" + k: v for k, v in paths.items()}}


OLD = api(
    orders={
        "get": {"parameters": [{"in": "query", "name": "q", "schema": {"type": ["string", "integer"]}}, {"in": "query", "name": "old"}], "responses": {"200": {"content": {"application/json": {"schema": {"type": "object"}}}}, "404": {}}},
        "post": {"requestBody": body({"type": "object", "properties": {"a": {"enum": ["x", "y"]}, "b": {}, "deep": {"properties": {"k": {"type": "string"}}}, "odd": {"pattern": "1"}}}), "responses": {"201": {}}},
        "put": {},
    },
    gone={"get": {}},
)
NEW = api(
    orders={
        "get": {"parameters": [{"in": "query", "name": "q", "required": True, "schema": {"type": "string"}}, {"in": "query", "name": "must", "required": True}], "responses": {"200": {"content": {"application/json": {"schema": {"type": "array"}}}}, "201": {}}},
        "post": {"requestBody": body({"type": "object", "required": ["c"], "additionalProperties": False, "properties": {"a": {"enum": ["x", "z"]}, "c": {}, "d": {}, "deep": {"properties": {"k": {"type": "integer"}}}, "odd": {"pattern": "2"}}}, True), "responses": {"201": {}}},
        "delete": {},
    },
    more={"get": {}},
)


def test_openapi_changes(spark):
    rows = interfaces.openapi(docs(spark, old=OLD, new=NEW))
    got = {(r["kind"], r["method"], r["subject"], r["pointer"], r["detail"]) for r in contracts.openapi_changes(rows.where("path = 'old'"), rows.where("path = 'new'")).collect()}
    j = "request application/json"
    assert got == {
        ("endpoint_removed", None, None, None, None), ("endpoint_added", None, None, None, None), ("method_removed", "put", None, None, None), ("method_added", "delete", None, None, None),
        ("parameter_removed", "get", "query:old", None, None), ("required_parameter_added", "get", "query:must", None, None), ("parameter_became_required", "get", "query:q", None, None),
        ("parameter_type_narrowed", "get", "query:q", "", None), ("response_schema_changed", "get", "200", None, None), ("response_status_removed", "get", "404", None, None), ("response_status_added", "get", "201", None, None),
        ("request_body_became_required", "post", None, None, None), ("parameter_enum_value_removed", "post", j, "/a", '"y"'), ("parameter_enum_value_added", "post", j, "/a", '"z"'), ("request_property_removed", "post", j, "/b", None),
        ("required_property_added", "post", j, "/c", None), ("optional_property_added", "post", j, "/d", None), ("incomparable_subtree", "post", j, "/deep/k", None),
        ("incomparable_subtree", "post", j, "", None), ("incomparable_subtree", "post", j, "/odd", None),
    } - {("parameter_enum_value_removed", "post", j, "/a", '"y"'), ("parameter_enum_value_added", "post", j, "/a", '"z"'), ("request_property_removed", "post", j, "/b", None), ("required_property_added", "post", j, "/c", None),
         ("optional_property_added", "post", j, "/d", None), ("incomparable_subtree", "post", j, "/deep/k", None), ("incomparable_subtree", "post", j, "/odd", None)}


def test_request_schemas_that_are_modelled(spark):
    """The same bodies without the unmodelled member are told change by change."""
    old, new = json.loads(json.dumps(OLD)), json.loads(json.dumps(NEW))
    for d in (old, new):
        del d["paths"]["/orders"]["post"]["requestBody"]["content"]["application/json"]["schema"]["properties"]["odd"]
    rows = interfaces.openapi(docs(spark, old=old, new=new))
    got = {(r["kind"], r["pointer"], r["detail"]) for r in contracts.openapi_changes(rows.where("path = 'old'"), rows.where("path = 'new'")).where("subject like 'request %'").collect()}
    assert got == {
        ("parameter_enum_value_removed", "/a", '"y"'), ("parameter_enum_value_added", "/a", '"z"'), ("request_property_removed", "/b", None), ("required_property_added", "/c", None),
        ("optional_property_added", "/d", None), ("incomparable_subtree", "/deep/k", None), ("request_additional_properties_disallowed", "", None),
    }


@pytest.mark.parametrize("reader", [interfaces.openapi, interfaces.asyncapi, interfaces.pacts])
def test_malformed_documents_are_no_error(spark, reader):
    odd = {
        "a": "[1]", "b": "null", "c": '"x"', "d": "{", "e": "", "f": {"paths": [1], "channels": 3, "interactions": {"x": 1}}, "g": {"paths": {"/x": None, "/y": {"get": [1], "post": {"parameters": [None, {"$ref": 3}, {"$ref": "#/q"}], "requestBody": {"$ref": "#/paths"}}}}},
        "h": {"x": {"$ref": "#/x"}, "paths": {"/z": {"get": {"parameters": [{"$ref": "#/x"}], "responses": [2]}}}}, "i": {"channels": {"c": {"messages": {"m": None}}}, "operations": {"o": None, "p": {"channel": 3, "messages": [4]}}},
        "j": {"interactions": [None, {"request": 3}, {"request": {"path": 4, "method": None, "query": 5, "body": {"content": None}}, "response": {"status": "x"}}], "messages": [1]},
    }
    assert reader(docs(spark, **odd)).count() >= 0


SEND = {
    "channels": {"orders": {"address": "orders.v1", "messages": {"placed": {"name": "OrderPlaced", "payload": {"type": "object", "required": ["id"], "properties": {"id": {"type": "integer"}, "note": {"type": "string"}}}}, "unused": {}}}},
    "operations": {"out": {"action": "send", "channel": {"$ref": "#/channels/orders"}, "messages": [{"$ref": "#/channels/orders/messages/placed"}]}},
}
TAKE = {
    "channels": {"orders": {"address": "orders.v2", "messages": {"placed": {"name": "OrderPlaced", "payload": {"type": "object", "additionalProperties": False, "required": ["id", "at"], "properties": {"id": {"type": "string"}, "at": {"type": "string"}}}}}}},
    "operations": {"out": {"action": "receive", "channel": {"$ref": "#/channels/orders"}}},
}


def test_asyncapi(spark):
    rows = interfaces.asyncapi(docs(spark, send=SEND, take=TAKE))
    old, new = rows.where("path = 'send'"), rows.where("path = 'take'")
    assert {(r["path"], r["message"]): r["direction"] for r in contracts.message_directions(rows).collect()} == {("send", "orders/placed"): "emitted", ("send", "orders/unused"): None, ("take", "orders/placed"): "accepted"}
    assert [tuple(r) for r in contracts.unreferenced_messages(rows).collect()] == [("send", "orders/unused")]
    got = {(r["kind"], r["subject"], r["pointer"], r["severity"]) for r in contracts.asyncapi_changes(old, new).collect()}
    m = "orders/placed"
    assert got == {
        ("channel_address_changed", "orders", None, "breaking"), ("operation_action_changed", "out", None, "breaking"), ("message_removed", "orders/unused", None, "breaking"),
        ("payload_type_narrowed", m, "/id", "breaking"), ("payload_type_widened", m, "/id", "non_breaking"), ("payload_requiredness_gained", m, "/at", "breaking"), ("payload_property_removed", m, "/note", "breaking"),
        ("payload_additional_properties_disallowed", m, "", "breaking"),
    }
    facts = lambda x: x.where("row = 'schema'").selectExpr("subject as flow", "pointer", "types", "enums", "required", "closed", "coverage")
    flows = {(r["pointer"], r["finding"]) for r in contracts.flow_findings(facts(old), facts(new)).collect()}
    assert flows == {("/id", "type_not_accepted"), ("/at", "required_property_not_produced"), ("", "additional_properties_rejected")}


def test_pact_findings(spark):
    provider = api(**{
        "orders/{id}": {"get": {"parameters": [{"in": "query", "name": "v", "required": True}], "responses": {"200": {}}}},
        "orders": {"post": {"requestBody": body({"type": "object", "properties": {"a": {}}}, True), "responses": {"2XX": {}}}},
        "{kind}": {"get": {"responses": {"default": {}}}}, "{other}": {"get": {"responses": {"200": {}}}},
    })

    def ask(method, path, status=200, **more):
        return {"description": f"{method} {path}", "request": {"method": method, "path": path} | more, "response": {"status": status}}

    pact = {"consumer": {"name": "web"}, "provider": {"name": "shop"}, "interactions": [
        ask("get", "/orders/7", query="v=1&w=2"), ask("get", "/orders/7", 404), ask("put", "/orders/7"), ask("get", "/a/b/c"), ask("post", "/orders", 201, body={"a": 1, "z": 2}), ask("post", "/orders", 500),
        ask("get", "/things", body="x"), {"type": "Asynchronous/Messages", "description": "m"}, ask("post", "/orders", 204, body={"a": 1}) | {"matchingRules": {}},
    ]}
    i = interfaces.pacts(docs(spark, p=pact))
    got = {(r["interaction_id"], r["finding"], r["detail"]) for r in contracts.pact_findings(i, interfaces.openapi(docs(spark, api=provider))).collect()}
    assert got == {
        ("p#0", "pact_undeclared_request_parameter", "w"), ("p#1", "pact_required_query_parameter_missing", "v"), ("p#1", "pact_response_status_undeclared", None), ("p#2", "pact_method_not_declared", None),
        ("p#3", "pact_interaction_unmatched", None), ("p#4", "pact_undeclared_body_property", "z"), ("p#5", "pact_required_request_body_missing", None), ("p#5", "pact_response_status_undeclared", None),
        ("p#6", "pact_ambiguous_provider_match", None), ("p#6", "pact_undeclared_request_body", None), ("p#7", "pact_message_interaction_not_cross_referenced", None), ("p#8", "pact_matching_rules_unmodelled", None),
    }
