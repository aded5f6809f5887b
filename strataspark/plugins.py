"""Extension points: what callers may register by kind and id, listed in the order of ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

#: Kinds and what their members do: `resolver` (imports, files) -> targets; `layout` (nodes, edges) -> places; `extractor`
#: (files of a revision) -> observations; `reachability` (edges, seeds) -> ids; `store` (rows, name) -> None.
KINDS = ("resolver", "layout", "extractor", "reachability", "store")
_MEMBERS: dict[tuple[str, str], Callable] = {}


def register(kind: str, member_id: str):
    """Decorator; an unknown kind and an id that is taken are errors."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}")

    def add(f: Callable) -> Callable:
        if (kind, member_id) in _MEMBERS:
            raise ValueError(f"{kind} {member_id!r} is registered twice")
        _MEMBERS[kind, member_id] = f
        return f

    return add


def members(kind: str) -> list[str]:
    return sorted(i for k, i in _MEMBERS if k == kind)


def get(kind: str, member_id: str) -> Callable:
    """The member; an error that names those there are if there is none."""
    if (kind, member_id) not in _MEMBERS:
        raise KeyError(f"no {kind} {member_id!r}, there are {members(kind)}")
    return _MEMBERS[kind, member_id]


@register("layout", "golden-angle")
def _golden_angle(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    from strataspark.operators.events import golden_angle_layout

    return golden_angle_layout(nodes)


@register("resolver", "relative")
def _relative(imports: DataFrame, files: DataFrame) -> DataFrame:
    from strataspark.operators.records import resolve_imports

    return resolve_imports(imports, files)


@register("reachability", "backward")
def _backward(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    from strataspark.operators.graph import reach

    return reach(edges, seeds, None, "backward").select("id")


@register("extractor", "code")
def _code(files: DataFrame) -> DataFrame:
    """Observations (subject, predicate, object) of files(path, content): who declares, calls and imports what."""
    from pyspark.sql import functions as F

    from strataspark.sources.code import code_rows

    rows = code_rows(files)
    target = F.coalesce("target", "specifier", "id")
    said = F.create_map(F.lit("symbol"), F.lit("declares"), F.lit("edge"), F.lit("calls"), F.lit("import"), F.lit("imports"))[F.col("row")]
    return rows.where("row in ('symbol', 'edge', 'import')").select(F.when(F.col("row") == "edge", F.col("id")).otherwise(F.col("path")).alias("subject"), said.alias("predicate"), target.alias("object")).distinct()


@register("store", "upsert")
def _upsert(rows: DataFrame, name: str) -> None:
    from strataspark.sinks.reports import upsert

    upsert(rows, name, [rows.columns[0]])
