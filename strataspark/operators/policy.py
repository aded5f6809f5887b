"""Architecture policies over edges and nodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataspark.functions.text import matches
from strataspark.operators.graph import cycles


def with_paths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with src_path and dst_path; a node without a row or path stands under its id."""
    for end in ("src", "dst"):
        paths = nodes.select(F.col("id").alias(end), F.col("path").alias("__p"))
        edges = edges.join(paths, end, "left").withColumn(f"{end}_path", F.coalesce("__p", end)).drop("__p")
    return edges


def forbidden_dependencies(edges: DataFrame, source_glob: str, target_glob: str) -> DataFrame:
    """Edges of any kind from a path that fits the one glob to a path that fits the other."""
    return edges.where(matches(F.col("src_path"), source_glob) & matches(F.col("dst_path"), target_glob))


def layer_of(path: Column, layers: list[str]) -> Column:
    """Declared index of the first layer, in the order of names, that the path holds as a substring; else null."""
    out = F.lit(None).cast("int")
    for name in sorted(layers, reverse=True):
        out = F.when(path.contains(name), layers.index(name)).otherwise(out)
    return out


def layer_violations(edges: DataFrame, layers: list[str]) -> DataFrame:
    """Edges that point from a layer to one declared before it."""
    e = edges.withColumn("src_layer", layer_of(F.col("src_path"), layers)).withColumn("dst_layer", layer_of(F.col("dst_path"), layers))
    return e.where("dst_layer < src_layer")


def new_cycles(now: DataFrame, baseline: DataFrame) -> DataFrame:
    """Cycles of now whose member set is no cycle of baseline."""
    return cycles(now).join(cycles(baseline).select("members"), "members", "left_anti")


def waive(findings: DataFrame, debts: DataFrame) -> DataFrame:
    """findings(finding_id, rule_id, status, entity) with status `pass` and the reason where a debt of the same rule
    names the finding, everything (`*`) or a part of its entity. The least reason wins among several."""
    d = debts.select(F.col("rule_id").alias("debt_rule"), "fingerprint", "waived_reason")
    hit = (F.col("rule_id") == F.col("debt_rule")) & ((F.col("fingerprint") == F.col("finding_id")) | (F.col("fingerprint") == "*") | F.col("entity").contains(F.col("fingerprint")))
    found = findings.join(d, hit).groupBy("finding_id").agg(F.min("waived_reason").alias("waived_reason"))
    out = findings.join(found, "finding_id", "left")
    return out.withColumn("status", F.when(F.col("waived_reason").isNotNull() & (F.col("status") == "fail"), "pass").otherwise(F.col("status")))


GATES: dict = {}


def gate(gate_id: str):
    """Register a verification gate: a function of a dict of DataFrames that returns findings."""

    def add(f):
        GATES[gate_id] = f
        return f

    return add


def evaluate_gates(inputs: dict[str, DataFrame]) -> DataFrame | None:
    """The findings of all registered gates with their gate_id, in the order of ids."""
    parts = [GATES[g](inputs).withColumn("gate_id", F.lit(g)) for g in sorted(GATES)]
    return reduce(lambda a, b: a.unionByName(b), parts) if parts else None


def evaluate_rules(rules: list[dict], edges: DataFrame, nodes: DataFrame, baseline_edges: DataFrame | None = None) -> DataFrame | None:
    """(rule_id, severity, src, dst, status) of rules as `sources.catalogs.read_rules` gives them, over edges(src, dst, kind) and
    nodes(id, path); a kind that is not known here is an error, a rule without what it compares with is `unknown`."""
    located, out = with_paths(edges, nodes), []
    for r in rules:
        kind = r["kind"]
        if kind == "forbidden_dependency":
            found = forbidden_dependencies(located, r.get("scope_source", "*"), r.get("scope_target", "*")).select("src", "dst")
        elif kind == "layers":
            found = layer_violations(located, r.get("layers", [])).select("src", "dst")
        elif kind == "no_new_cycle" and baseline_edges is not None:
            found = new_cycles(edges, baseline_edges).select(F.col("component").alias("src"), F.element_at("members", -1).alias("dst"))
        elif kind in ("no_new_cycle", "api_compatibility"):
            found = edges.limit(0).select("src", "dst")
        else:
            raise ValueError(f"rule {r['id']!r} is of the unknown kind {kind!r}")
        rows = found.select(F.lit(r["id"]).alias("rule_id"), F.lit(r.get("severity", "error")).alias("severity"), F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.lit("fail").alias("status"))
        if kind == "api_compatibility" or (kind == "no_new_cycle" and baseline_edges is None):
            nothing = F.lit(None).cast("string")
            one = edges.sparkSession.range(1)
            rows = one.select(F.lit(r["id"]).alias("rule_id"), F.lit(r.get("severity", "error")).alias("severity"), nothing.alias("src"), nothing.alias("dst"), F.lit("unknown").alias("status"))
        out.append(rows)
    return reduce(lambda a, b: a.unionByName(b), out) if out else None
