"""Service catalog: ownership, systems, packages, contracts between producers and consumers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Default severities of change kinds.
BREAKING = (
    "endpoint_removed method_removed required_parameter_added parameter_removed parameter_became_required parameter_type_narrowed "
    "parameter_enum_value_removed request_body_added request_body_became_required request_body_removed media_type_removed "
    "request_property_removed required_property_added request_additional_properties_disallowed request_enum_value_removed "
    "response_status_removed channel_removed channel_address_changed operation_removed operation_action_changed "
    "operation_channel_changed message_removed message_content_type_changed producer_consumer_incompatible "
    "pact_interaction_unmatched pact_method_not_declared pact_required_query_parameter_missing pact_required_request_body_missing "
    "pact_response_status_undeclared"
).split()
NON_BREAKING = (
    "endpoint_added method_added optional_parameter_added parameter_became_optional parameter_type_widened parameter_enum_value_added "
    "optional_request_body_added request_body_became_optional media_type_added optional_property_added response_status_added "
    "channel_added operation_added message_added"
).split()
UNDECIDED = (
    "response_schema_changed incomparable_subtree payload_property_removed payload_property_added payload_requiredness_gained "
    "payload_requiredness_lost payload_type_narrowed payload_type_widened payload_enum_value_removed payload_enum_value_added "
    "payload_additional_properties_disallowed payload_additional_properties_allowed payload_incomparable message_payload_added "
    "message_payload_removed pact_undeclared_request_parameter pact_undeclared_request_body pact_undeclared_body_property "
    "pact_matching_rules_unmodelled pact_ambiguous_provider_match pact_message_interaction_not_cross_referenced"
).split()


def severity(kind):
    """breaking, non_breaking, or unknown for kinds without a default."""
    return F.when(kind.isin(*BREAKING), "breaking").when(kind.isin(*NON_BREAKING), "non_breaking").otherwise("unknown")


def verdict(changes: DataFrame, coverage_ok: bool = True) -> DataFrame:
    """(subject, verdict): breaking if any change is; unknown if any is or the documents were not read in full."""
    worst = changes.groupBy("subject").agg(F.max((F.col("severity") == "breaking").cast("int")).alias("b"), F.max((F.col("severity") == "unknown").cast("int")).alias("u"))
    return worst.select("subject", F.when(F.col("b") == 1, "breaking").when((F.col("u") == 1) | F.lit(not coverage_ok), "unknown").otherwise("compatible").alias("verdict"))


def rollup(entities: DataFrame, by: str) -> DataFrame:
    """(by, n, first, last) over entities(reference, ...): how many each owner, system or domain has."""
    return entities.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), F.min("reference").alias("first"), F.max("reference").alias("last"))


def dangling(references: DataFrame, entities: DataFrame) -> DataFrame:
    """(target, n): referenced entities that are not declared, and from how many places."""
    return references.join(entities.select(F.col("reference").alias("target")), "target", "left_anti").groupBy("target").agg(F.count("*").alias("n"))


def first_declared(entities: DataFrame) -> DataFrame:
    """One row for each reference, the one with the least source_path; `duplicates` counts the others."""
    w = Window.partitionBy("reference").orderBy("source_path")
    n = F.count("*").over(Window.partitionBy("reference")) - 1
    return entities.withColumn("place", F.row_number().over(w)).withColumn("duplicates", n).where("place = 1").drop("place")


def resolve_systems(entities: DataFrame, depth: int = 32) -> DataFrame:
    """(reference, system, hops): the first system along the chain of parents; null where none is found in `depth`
    steps (a loop included). Rows that found theirs leave the loop, so it ends as soon as the deepest has."""
    from strataspark.functions.storage import written

    info = entities.select(F.col("reference").alias("p_ref"), F.col("system").alias("p_system"), F.col("parent").alias("p_parent"))
    walk = entities.select("reference", "system", "parent", F.lit(0).alias("hops"))
    done = []
    for step in range(1, depth + 1):
        done.append(walk.where("system is not null or parent is null").select("reference", "system", "hops"))
        up = walk.where("system is null and parent is not null").join(info, F.col("parent") == F.col("p_ref"), "left")
        walk = written(up.select("reference", F.col("p_system").alias("system"), F.col("p_parent").alias("parent"), F.lit(step).alias("hops")), "chain")
        if walk.isEmpty():
            break
    done.append(walk.select("reference", "system", "hops"))
    out = done[0]
    for d in done[1:]:
        out = out.unionAll(d)
    return out


def org_blast_radius(entities: DataFrame, depends: DataFrame, provides: DataFrame, consumes: DataFrame, component: str) -> DataFrame:
    """(owner, n): owners of the components that depend on this one or consume an API that it provides."""
    direct = depends.where(F.col("target") == component).select("reference")
    apis = provides.where(F.col("reference") == component).select("api")
    by_api = consumes.join(apis, "api", "left_semi").select("reference")
    hit = direct.union(by_api).distinct().where(F.col("reference") != component)
    return entities.join(hit, "reference", "left_semi").groupBy("owner").agg(F.countDistinct("reference").alias("n"))


def enclosing_package(files: DataFrame, packages: DataFrame) -> DataFrame:
    """(path, package): the package whose directory is the longest prefix of the path. Every prefix of a path is a join
    key, so no path meets all packages."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    each = files.select("path", F.explode(prefixes).alias("directory"))
    hit = each.join(packages.select("package", "directory"), "directory")
    return files.select("path").join(hit.groupBy("path").agg(F.max_by("package", F.struct(F.length("directory"), "package")).alias("package")), "path", "left")


def schema_compatibility(fields: DataFrame, mode: str) -> DataFrame:
    """(subject, added_required, added_optional, removed, compatible) of fields(subject, side old|new, field, required)
    under strict, backward, forward or full."""
    p = fields.groupBy("subject", "field").agg(F.max((F.col("side") == "old").cast("int")).alias("o"), F.max((F.col("side") == "new").cast("int")).alias("n"), F.max(((F.col("side") == "new") & F.col("required")).cast("int")).alias("req"), F.max(((F.col("side") == "old") & F.col("required")).cast("int")).alias("oreq"))
    c = p.groupBy("subject").agg(F.expr("count_if(o = 0 and req = 1)").alias("added_required"), F.expr("count_if(o = 0 and req = 0)").alias("added_optional"), F.expr("count_if(n = 0)").alias("removed"), F.expr("count_if(n = 0 and oreq = 1)").alias("removed_required"))
    ok = {
        "strict": "added_required + added_optional + removed = 0",
        "backward": "added_required = 0",
        "forward": "removed_required = 0",
        "full": "added_required = 0 and removed_required = 0",
    }[mode]
    return c.withColumn("compatible", F.expr(ok)).drop("removed_required")


def flow_pairs(producers: DataFrame, consumers: DataFrame) -> DataFrame:
    """(channel, producer, consumer, missing, verdict) of messages on one channel with equal names: fields(array) that
    the consumer requires and the producer does not declare; channels with one side only are unchecked."""
    p = producers.select("channel", "message", F.col("id").alias("producer"), F.col("fields").alias("p_fields"))
    c = consumers.select("channel", "message", F.col("id").alias("consumer"), F.col("fields").alias("c_fields"))
    out = p.join(c, ["channel", "message"], "full")
    missing = F.array_sort(F.array_except("c_fields", "p_fields"))
    v = F.when(F.col("producer").isNull() | F.col("consumer").isNull(), "unchecked").when(F.size(missing) > 0, "incompatible").otherwise("compatible")
    return out.select("channel", "message", "producer", "consumer", F.array_join(missing, ",").alias("missing"), v.alias("verdict"))
