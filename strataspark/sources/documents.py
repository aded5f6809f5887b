"""Structured documents: JSON, and YAML where a parser is installed; pointers, references, canonical text, digests."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

try:  # optional: without it only JSON is read
    import yaml
except ImportError:
    yaml = None

#: References that are followed one from the other, at most.
REF_DEPTH = 24


def read_rows(docs: DataFrame, read, schema: str) -> DataFrame:
    """read(path, content) -> tuples of schema, run on Arrow batches of docs(path, content); null content is empty."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for p, c in zip(pdf["path"], pdf["content"], strict=True) for r in read(p, c if isinstance(c, str) else "")]
            yield pd.DataFrame(rows, columns=names).astype(object)

    return docs.select("path", "content").mapInPandas(run, schema)


def load(content: str):
    """The first document of JSON or YAML text; None if it is neither."""
    return next(iter(load_all(content)), None)


def load_all(content: str) -> list:
    """All documents of JSON or YAML text; none if it is neither (or nested beyond what the parser takes)."""
    try:
        return [json.loads(content)]
    except (ValueError, RecursionError):
        pass
    if yaml is None:
        return []
    try:
        return [d for d in yaml.safe_load_all(content) if d is not None]
    except (yaml.YAMLError, RecursionError, ValueError):
        return []


def mapping(node) -> dict:
    return node if isinstance(node, dict) else {}


def listing(node) -> list:
    return node if isinstance(node, list) else []


def escape(step: str) -> str:
    """A step of a JSON pointer."""
    return step.replace("~", "~0").replace("/", "~1")


def unescape(step: str) -> str:
    return step.replace("~1", "/").replace("~0", "~")


def at_pointer(root, pointer: str):
    """What a local pointer (#/a/0/b) points at; None if it points nowhere or elsewhere."""
    if not isinstance(pointer, str) or not (pointer == "#" or pointer.startswith("#/")):
        return None
    node = root
    for step in pointer[2:].split("/") if len(pointer) > 2 else []:
        step = unescape(step)
        if isinstance(node, dict):
            node = node.get(step)
        elif isinstance(node, list) and step.isdigit() and int(step) < len(node):
            node = node[int(step)]
        else:
            return None
    return node


def resolve(root, node):
    """node behind its chain of references; None if the chain is broken, longer than REF_DEPTH, or comes back."""
    seen: set[str] = set()
    while isinstance(node, dict) and "$ref" in node:
        ref = node["$ref"]
        if not isinstance(ref, str) or ref in seen or len(seen) >= REF_DEPTH:
            return None
        seen.add(ref)
        node = at_pointer(root, ref)
    return node


def canonical(node) -> str:
    """JSON text with sorted keys and no blanks."""
    return json.dumps(node, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)


def fingerprint(node) -> str:
    return hashlib.sha256(canonical(node).encode()).hexdigest()


# Keywords of a schema that are modelled, and how deep one is read.
MODELLED = {"type", "enum", "properties", "required", "additionalProperties", "items", "nullable", "description", "title", "$ref"}
DEPTH = 64


def schema_rows(root, node, pointer: str = "", required: bool = True, depth: int = 0, on_path: tuple = ()):
    """(pointer, types, enums, required, closed, coverage) of a schema and what is below it. A reference that points
    nowhere, or to a schema that it lies in, and a schema below DEPTH levels are one unknown row, not read further."""
    while isinstance(node, dict) and "$ref" in node:
        ref = node["$ref"]
        if not isinstance(ref, str) or ref in on_path or len(on_path) >= REF_DEPTH:
            node = None
            break
        on_path = (*on_path, ref)
        node = at_pointer(root, ref)
    if not isinstance(node, dict) or depth >= DEPTH:
        yield (pointer, [], None, required, False, "unknown")
        return
    types = node.get("type", [])
    types = [types] if isinstance(types, str) else [t for t in listing(types) if isinstance(t, str)]
    types = sorted({*types, *(["null"] if node.get("nullable") is True else [])})
    enums = sorted(canonical(e) for e in node["enum"]) if isinstance(node.get("enum"), list) else None
    extra = node.get("additionalProperties", True)
    partial = set(node) - MODELLED or not isinstance(extra, bool)
    yield (pointer, types, enums, required, extra is False, "partial" if partial else "verified")
    needed = {x for x in listing(node.get("required")) if isinstance(x, str)}
    for name, child in sorted(mapping(node.get("properties")).items()):
        yield from schema_rows(root, child, f"{pointer}/{escape(str(name))}", name in needed, depth + 1, on_path)
    if "items" in node:
        yield from schema_rows(root, node["items"], f"{pointer}/[]", False, depth + 1, on_path)
