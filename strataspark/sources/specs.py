"""Readers of specifications and manifests. Each takes documents (path, content) and gives rows; what a document holds
beyond the model is counted in `unmodelled`, never dropped in silence."""

from __future__ import annotations

import ast
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.sources.documents import read_rows as _rows


def otlp_spans(docs: DataFrame) -> DataFrame:
    """Spans of OTLP/JSON exports(path, content), JVM-side: resourceSpans, scopeSpans, spans; attributes as a map (arrays as
    JSON text), names of events, ids of linked spans, status."""
    attr = "array<struct<key:string,value:struct<stringValue:string,intValue:string,boolValue:boolean,doubleValue:double,arrayValue:struct<values:array<struct<stringValue:string,intValue:string>>>>>>"
    event = f"struct<timeUnixNano:string,name:string,attributes:{attr}>"
    link = f"struct<traceId:string,spanId:string,attributes:{attr}>"
    status = "struct<code:string,message:string>"
    span = f"struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:string,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{attr},events:array<{event}>,links:array<{link}>,status:{status}>"
    schema = f"struct<resourceSpans:array<struct<resource:struct<attributes:{attr}>,scopeSpans:array<struct<spans:array<{span}>>>>>>"

    def as_map(c):
        return F.map_from_entries(F.transform(c, lambda a: F.struct(a["key"].alias("k"), F.coalesce(a["value"]["stringValue"], a["value"]["intValue"], a["value"]["boolValue"].cast("string"), a["value"]["doubleValue"].cast("string"), F.to_json(a["value"]["arrayValue"]["values"])).alias("v"))))

    r = docs.select("path", F.explode(F.from_json("content", schema)["resourceSpans"]).alias("r"))
    s = r.select("path", as_map(F.col("r.resource.attributes"))["service.name"].alias("service"), F.explode("r.scopeSpans").alias("s")).select("path", "service", F.explode("s.spans").alias("s"))
    a = as_map(F.col("s.attributes"))
    return s.select(
        F.col("path").alias("window_id"), F.lower("s.traceId").alias("trace_id"), F.lower("s.spanId").alias("span_id"), F.nullif(F.lower("s.parentSpanId"), F.lit("")).alias("parent_span_id"),
        "service", "s.name", "s.kind", F.col("s.startTimeUnixNano").cast("bigint").alias("start_unix_nano"), F.col("s.endTimeUnixNano").cast("bigint").alias("end_unix_nano"),
        a["http.route"].alias("route"), a["http.request.method"].alias("http_method"), a["code.function"].alias("code_function"), a["code.filepath"].alias("code_filepath"),
        F.greatest(F.coalesce(F.size("s.events"), F.lit(0)), F.lit(0)).alias("events"), F.transform("s.events", lambda e: e["name"]).alias("event_names"), F.transform("s.links", lambda x: F.lower(x["spanId"])).alias("linked"),
        F.when(F.col("s.status.code").isin("2", "STATUS_CODE_ERROR"), "error").when(F.col("s.status.code").isin("1", "STATUS_CODE_OK"), "ok").otherwise("unset").alias("status"),
    )


def manifests(docs: DataFrame) -> DataFrame:
    """(path, ecosystem, package, requirement, scope, source) of package.json, requirements.txt, go.mod and Cargo.toml."""

    def source(req):
        for prefix, kind in (("workspace:", "workspace"), ("file:", "path"), ("link:", "path"), ("git", "git"), ("http", "url")):
            if req.startswith(prefix):
                return kind
        return "registry"

    def read(path, content):
        name = path.rsplit("/", 1)[-1]
        if name == "package.json":
            try:
                doc = json.loads(content)
            except ValueError:
                return
            for key, scope in (("dependencies", "runtime"), ("devDependencies", "dev"), ("peerDependencies", "peer"), ("optionalDependencies", "optional")):
                for p, req in sorted((doc.get(key) or {}).items()):
                    yield (path, "npm", p, str(req), scope, source(str(req)))
        elif name == "requirements.txt":
            for line in content.splitlines():
                m = re.match(r"^\s*([A-Za-z0-9._-]+)(?:\[[^\]]*\])?\s*([^;#]*)", line)
                if m:
                    yield (path, "pypi", m[1].lower(), m[2].strip(), "runtime", "registry")
        elif name == "go.mod":
            for m in re.finditer(r"^\s*(?:require\s+)?([\w.\-/]+\.[\w.\-/]+)\s+(v\S+)(\s*// indirect)?", content, re.M):
                yield (path, "go", m[1], m[2], "indirect" if m[3] else "runtime", "registry")
        elif name == "Cargo.toml":
            import tomllib

            try:
                doc = tomllib.loads(content)
            except ValueError:
                return
            for key, scope in (("dependencies", "runtime"), ("dev-dependencies", "dev"), ("build-dependencies", "build")):
                for p, v in sorted(doc.get(key, {}).items()):
                    d = {"version": v} if isinstance(v, str) else v
                    kind = "path" if "path" in d else "git" if "git" in d else "workspace" if d.get("workspace") else "registry"
                    yield (path, "cargo", p, str(d.get("version", "")), scope, kind)

    return _rows(docs, read, "path string, ecosystem string, package string, requirement string, scope string, source string")


def python_symbols(docs: DataFrame) -> DataFrame:
    """(path, row, id, kind, start_line, end_line, signature, target, tier): symbols and call edges of Python files, by
    the standard parser. A file that does not parse gives one row of kind `syntax_error`."""

    def read(path, content):
        try:
            tree = ast.parse(content)
        except (SyntaxError, ValueError):
            yield (path, "symbol", path, "syntax_error", None, None, None, None, None)
            return
        defs, imported = {}, {}

        def declare(node, prefix):
            for child in ast.iter_child_nodes(node):
                if isinstance(child, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                    name = f"{prefix}.{child.name}" if prefix else child.name
                    defs[name] = child
                    declare(child, name)
                else:
                    declare(child, prefix)

        declare(tree, "")
        for node in ast.walk(tree):
            if isinstance(node, ast.Import):
                imported |= {a.asname or a.name.split(".")[0]: a.name for a in node.names}
            elif isinstance(node, ast.ImportFrom):
                imported |= {a.asname or a.name: f"{'.' * node.level}{node.module or ''}.{a.name}" for a in node.names}
        for name, node in defs.items():
            kind = "class" if isinstance(node, ast.ClassDef) else "method" if "." in name and isinstance(defs.get(name.rsplit(".", 1)[0]), ast.ClassDef) else "function"
            signature = "" if kind == "class" else ast.unparse(node.args)
            yield (path, "symbol", f"{path}#{name}", kind, node.lineno, node.end_lineno, signature, None, None)
            if kind == "class":
                continue
            owner = name.rsplit(".", 1)[0]
            inner = {id(x) for n, d in defs.items() if n.startswith(name + ".") for x in ast.walk(d)}
            for call in ast.walk(node):
                if not isinstance(call, ast.Call) or id(call) in inner:
                    continue
                f = call.func
                if isinstance(f, ast.Name) and f.id in defs:
                    yield (path, "edge", f"{path}#{name}", "calls", call.lineno, None, None, f"{path}#{f.id}", "local")
                elif isinstance(f, ast.Name) and f.id in imported:
                    yield (path, "edge", f"{path}#{name}", "calls", call.lineno, None, None, imported[f.id], "imported-name")
                elif isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name):
                    if f.value.id in ("self", "cls") and f"{owner}.{f.attr}" in defs:
                        yield (path, "edge", f"{path}#{name}", "calls", call.lineno, None, None, f"{path}#{owner}.{f.attr}", "this-method")
                    elif f.value.id in imported:
                        yield (path, "edge", f"{path}#{name}", "calls", call.lineno, None, None, f"{imported[f.value.id]}.{f.attr}", "imported-name")

    return _rows(docs, read, "path string, row string, id string, kind string, start_line int, end_line int, signature string, target string, tier string")
