"""Readers of interface descriptions: OpenAPI 3, AsyncAPI 3, consumer pacts. Each takes documents (path, content) and
gives one flat table; a document or part that is malformed gives fewer rows and a lower coverage, never an error."""

from __future__ import annotations

from urllib.parse import parse_qsl, unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.sources.documents import escape, fingerprint, listing, load, mapping, read_rows, resolve, schema_rows

METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")
OPENAPI = (
    "path string, row string, route string, method string, operation_id string, location string, name string, required boolean, "
    "media_type string, status string, subject string, pointer string, types array<string>, enums array<string>, closed boolean, "
    "fingerprint string, coverage string"
)
_OPENAPI_NAMES = [c.split()[0] for c in OPENAPI.split(", ")]


def openapi(docs: DataFrame) -> DataFrame:
    """OPENAPI rows: `operation`, `parameter`, `body`, `media` (request), `response` (one row for each media type, or
    one without), and `schema` facts of each parameter and request media type (subject)."""

    def read(path, content):
        doc = mapping(load(content))

        def row(kind, **values):
            full = {"path": path, "row": kind, "coverage": "verified"} | values
            return tuple(full.get(n) for n in _OPENAPI_NAMES)

        def schema(at, doc, subject, node):
            rows = list(schema_rows(doc, node))
            for k, (pointer, types, enums, required, closed, coverage) in enumerate(rows):
                below = [list(r) for r in rows[k:] if r[0] == pointer or r[0].startswith(pointer + "/")]
                yield row("schema", **at, subject=subject, pointer=pointer, types=types, enums=enums, required=required, closed=closed, coverage=coverage, fingerprint=fingerprint(below))

        for route, item in sorted(mapping(doc.get("paths")).items()):
            item = mapping(resolve(doc, item))
            for method in METHODS:
                if method not in item:
                    continue
                op = mapping(item[method])
                at = {"route": route, "method": method}
                yield row("operation", **at, operation_id=op.get("operationId") if isinstance(op.get("operationId"), str) else None, coverage="verified" if isinstance(item[method], dict) else "unknown")
                params = {}
                for p in [*listing(item.get("parameters")), *listing(op.get("parameters"))]:  # an operation's own win
                    p = mapping(resolve(doc, p))
                    if isinstance(p.get("name"), str) and isinstance(p.get("in"), str):
                        params[p["in"], p["name"]] = p
                for (location, name), p in sorted(params.items()):
                    subject = f"{location}:{name}"
                    yield row("parameter", **at, location=location, name=name, required=p.get("required") is True, subject=subject)
                    yield from schema(at, doc, subject, p.get("schema", {}))
                body = resolve(doc, op.get("requestBody"))
                if isinstance(body, dict):
                    yield row("body", **at, required=body.get("required") is True)
                    for media, m in sorted(mapping(body.get("content")).items()):
                        subject = f"request {media}"
                        yield row("media", **at, media_type=media, subject=subject)
                        yield from schema(at, doc, subject, mapping(m).get("schema", {}))
                for status, r in sorted(mapping(op.get("responses")).items(), key=lambda kv: str(kv[0])):
                    r = mapping(resolve(doc, r))
                    medias = sorted(mapping(r.get("content")).items()) or [(None, {})]
                    for media, m in medias:
                        facts = [list(f) for f in schema_rows(doc, mapping(m).get("schema", {}))] if media else []
                        yield row("response", **at, status=str(status), media_type=media, fingerprint=fingerprint(facts))

    return read_rows(docs, read, OPENAPI)


def openapi_parameters(docs: DataFrame) -> DataFrame:
    """(path, route, method, operation_id, location, name, required, type) of OpenAPI documents; an operation without
    parameters gives one row with null names."""
    rows = openapi(docs)
    ops = rows.where("row = 'operation'").select("path", "route", "method", "operation_id")
    params = rows.where("row = 'parameter'").select("path", "route", "method", "location", "name", "required", "subject")
    types = rows.where("row = 'schema' and pointer = ''").select("path", "route", "method", "subject", F.when(F.size("types") == 1, F.col("types")[0]).alias("type"))
    out = ops.join(params, ["path", "route", "method"], "left").join(types, ["path", "route", "method", "subject"], "left")
    return out.select("path", "route", "method", "operation_id", "location", "name", F.coalesce("required", F.lit(False)).alias("required"), "type")


ASYNCAPI = (
    "path string, row string, id string, address string, action string, channel string, messages array<string>, name string, "
    "content_type string, has_payload boolean, subject string, pointer string, types array<string>, enums array<string>, "
    "required boolean, closed boolean, coverage string"
)
_ASYNCAPI_NAMES = [c.split()[0] for c in ASYNCAPI.split(", ")]


def asyncapi(docs: DataFrame) -> DataFrame:
    """ASYNCAPI rows: `channel` (id, address), `operation` (id, action send|receive, channel, message keys), `message`
    (id = channel/key, name, content_type) and `schema` facts of each message's payload (subject = message id). An
    operation that names no messages has all of its channel's."""

    def read(path, content):
        doc = mapping(load(content))

        def row(kind, **values):
            full = {"path": path, "row": kind, "coverage": "verified"} | values
            return tuple(full.get(n) for n in _ASYNCAPI_NAMES)

        held: dict[str, list[str]] = {}
        for cid, raw in sorted(mapping(doc.get("channels")).items()):
            channel = mapping(resolve(doc, raw))
            address = channel.get("address")
            yield row("channel", id=cid, address=address if isinstance(address, str) else None)
            for key, m in sorted(mapping(channel.get("messages")).items()):
                m = resolve(doc, m)
                mid = f"{cid}/{key}"
                held.setdefault(cid, []).append(mid)
                good = isinstance(m, dict)
                m = mapping(m)
                name = m.get("name") if isinstance(m.get("name"), str) else key
                kind = m.get("contentType", doc.get("defaultContentType"))
                yield row("message", id=mid, channel=cid, name=name, content_type=kind if isinstance(kind, str) else None, has_payload="payload" in m, coverage="verified" if good else "unknown")
                if "payload" in m:
                    for pointer, types, enums, required, closed, coverage in schema_rows(doc, m["payload"]):
                        yield row("schema", subject=mid, pointer=pointer, types=types, enums=enums, required=required, closed=closed, coverage=coverage)
        for oid, raw in sorted(mapping(doc.get("operations")).items()):
            op = mapping(resolve(doc, raw))
            cid = last_step(mapping(op.get("channel")).get("$ref"), "#/channels/")
            own = [f"{cid}/{key}" for m in listing(op.get("messages")) if (key := last_step(mapping(m).get("$ref"), f"#/channels/{escape(cid or '')}/messages/"))]
            action = op.get("action") if op.get("action") in ("send", "receive") else None
            yield row("operation", id=oid, action=action, channel=cid, messages=sorted(own or held.get(cid, [])), coverage="verified" if action and cid in held else "partial")

    def last_step(ref, head):
        return ref[len(head):].replace("~1", "/").replace("~0", "~") if isinstance(ref, str) and ref.startswith(head) else None

    return read_rows(docs, read, ASYNCAPI)


PACT = (
    "path string, consumer string, provider string, interaction_id string, description string, kind string, method string, "
    "route string, query array<string>, has_body boolean, body_keys array<string>, status int, has_rules boolean, coverage string"
)


def pacts(docs: DataFrame) -> DataFrame:
    """PACT rows, one for each interaction of pact files of versions 1 to 4. query: the names of the parameters sent,
    sorted; body_keys: the keys of a JSON object body (matchers unwrapped); kind http or message."""

    def unwrap(node):
        while isinstance(node, dict) and "pact:matcher:type" in node and "value" in node:
            node = node["value"]
        return node

    def read(path, content):
        doc = mapping(load(content))
        consumer, provider = (mapping(doc.get(k)).get("name") for k in ("consumer", "provider"))
        entries = [(i, None) for i in listing(doc.get("interactions"))] + [(m, "message") for m in listing(doc.get("messages"))]
        for k, (i, kind) in enumerate(entries):
            i = mapping(i)
            kind = kind or ("http" if "http" in str(i.get("type", "Synchronous/HTTP")).lower() else "message")
            request, response = mapping(i.get("request")), mapping(i.get("response"))
            query = request.get("query")
            if isinstance(query, str):
                names = {n for n, _ in parse_qsl(query, keep_blank_values=True)}
            else:
                names = set(mapping(query))
            body = request.get("body")
            if isinstance(body, dict) and set(body) <= {"content", "contentType", "encoded", "contentTypeHint"} and "content" in body:
                body = body["content"]  # version 4 wraps it
            body = unwrap(body)
            status = response.get("status")
            method, route = request.get("method"), request.get("path")
            route = unwrap(route)
            ok = kind == "message" or (isinstance(method, str) and isinstance(route, str))
            rules = any("matchingRules" in mapping(x) for x in (i, request, response))
            yield (
                path, consumer if isinstance(consumer, str) else None, provider if isinstance(provider, str) else None, f"{path}#{k}", str(i.get("description", "")), kind,
                method.upper() if isinstance(method, str) else None, unquote(route.split("?")[0]) if isinstance(route, str) else None, sorted(names),
                body is not None, sorted(map(str, body)) if isinstance(body, dict) else [], status if isinstance(status, int) and abs(status) < 1 << 31 else None, rules, "verified" if ok else "partial",
            )

    return read_rows(docs, read, PACT)
