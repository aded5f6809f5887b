"""API contracts as flattened facts: payload revisions, requests, responses, messages, consumer pacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataspark.functions.text import subsumes
from strataspark.operators.catalog import severity
from strataspark.sources.documents import load, read_rows, schema_rows

FACTS = "path string, pointer string, types array<string>, enums array<string>, required boolean, closed boolean, coverage string"
# What an absent type stands for.
JSON_TYPES = ("array", "boolean", "integer", "null", "number", "object", "string")


def schema_facts(docs: DataFrame) -> DataFrame:
    """FACTS of JSON schemas(path, content): one row for each property, array items under `[]`. Keywords beyond the model,
    schemas that are no objects, and references that point nowhere or come back lower the coverage. Text that is no
    document gives no rows."""

    def read(path, content):
        root = load(content)
        return [] if root is None else [(path, *row) for row in schema_rows(root, root)]

    return read_rows(docs, read, FACTS)


def above(pointer: Column) -> Column:
    """The pointers that a pointer lies below, nearest last."""
    steps = F.split(pointer, "/")
    return F.when(pointer == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda k: F.array_join(F.slice(steps, 1, k), "/")))


def not_below(rows: DataFrame, stops: DataFrame, keys: list[str]) -> DataFrame:
    """rows(*keys, pointer, ...) that lie below no pointer of stops(*keys, pointer). Pointers that hold no `/` lie
    below nothing."""
    each = rows.where(F.col("pointer").contains("/")).select(*keys, F.col("pointer"), F.explode(above(F.col("pointer"))).alias("__above"))
    at = stops.select(*keys, F.col("pointer").alias("__above")).distinct()
    lost = each.join(at, [*keys, "__above"], "left_semi").select(*keys, "pointer").distinct()
    return rows.join(lost, [*keys, "pointer"], "left_anti")


def _sides(before: DataFrame, after: DataFrame, keys: list[str], extra: tuple[str, ...] = ()) -> DataFrame:
    cols = ["types", "enums", "required", "closed", "coverage", *extra]
    b = before.select(*keys, "pointer", *[F.col(c).alias(f"b_{c}") for c in cols], F.lit(True).alias("in_b"))
    a = after.select(*keys, "pointer", *[F.col(c).alias(f"a_{c}") for c in cols], F.lit(True).alias("in_a"))
    return b.join(a, [*keys, "pointer"], "full")


def _kinds(tests: dict[str, Column]) -> Column:
    """Every kind whose test holds, one row each."""
    return F.explode(F.filter(F.array(*[F.when(F.coalesce(t, F.lit(False)), k) for k, t in tests.items()]), lambda k: k.isNotNull()))


def payload_changes(before: DataFrame, after: DataFrame, direction: str = "accepted") -> DataFrame:
    """(subject, pointer, kind, severity) of FACTS-like rows (subject, pointer, types, enums, required, closed, coverage).

    An absent type is every type. Facts that are not verified on both sides are incomparable, and neither what lies
    below them nor below what was added or removed is judged. direction: `accepted` (we take it in: a narrower schema
    breaks callers), `emitted` (we send it: a wider one does) or `both` (the worse)."""
    j = _sides(before, after, ["subject"])
    both = F.col("in_a") & F.col("in_b")
    sure = both & (F.col("b_coverage") == "verified") & (F.col("a_coverage") == "verified")
    every = F.array(*[F.lit(t) for t in JSON_TYPES])
    bt, at = (F.when(F.size(F.coalesce(f"{s}_types", F.array().cast("array<string>"))) == 0, every).otherwise(F.col(f"{s}_types")) for s in "ba")
    lost, gained = F.size(F.array_except(bt, at)) > 0, F.size(F.array_except(at, bt)) > 0
    fewer = F.col("a_enums").isNotNull() & (F.col("b_enums").isNull() | (F.size(F.array_except("b_enums", "a_enums")) > 0))
    more = F.col("b_enums").isNotNull() & (F.col("a_enums").isNull() | (F.size(F.array_except("a_enums", "b_enums")) > 0))
    root, gone, new = F.col("pointer") == "", F.col("in_a").isNull(), F.col("in_b").isNull()
    stops = j.where(gone | new | (both & ~sure)).select("subject", "pointer")
    tests = {
        "payload_incomparable": both & ~sure,
        "payload_type_narrowed": sure & lost,
        "payload_type_widened": sure & gained,
        "payload_enum_value_removed": sure & fewer,
        "payload_enum_value_added": sure & more,
        "payload_requiredness_gained": F.when(both, sure & F.col("a_required") & ~F.col("b_required")).otherwise(new & ~root & F.col("a_required")),
        "payload_requiredness_lost": sure & F.col("b_required") & ~F.col("a_required"),
        "payload_property_removed": gone & ~root,
        "payload_property_added": new & ~root & ~F.col("a_required"),
        "message_payload_removed": gone & root,
        "message_payload_added": new & root,
        "payload_additional_properties_disallowed": sure & F.col("a_closed") & ~F.col("b_closed"),
        "payload_additional_properties_allowed": sure & F.col("b_closed") & ~F.col("a_closed"),
    }
    out = not_below(j.select("subject", "pointer", _kinds(tests).alias("kind")), stops, ["subject"])
    return out.withColumn("severity", payload_severity(F.col("kind"), direction))


# What breaks the other side when we accept a payload and when we send one, and what cannot be told.
ACCEPTED_BREAKS = "payload_type_narrowed payload_enum_value_removed payload_requiredness_gained payload_property_removed payload_additional_properties_disallowed message_payload_added".split()
EMITTED_BREAKS = "payload_type_widened payload_enum_value_added payload_requiredness_lost payload_property_removed message_payload_removed".split()
EMITTED_UNKNOWN = "payload_property_added payload_additional_properties_allowed message_payload_added".split()


def payload_severity(kind: Column, direction: str | Column) -> Column:
    """breaking, unknown or non_breaking; a null or unlisted direction is unknown."""
    way = F.lit(direction) if isinstance(direction, str) else direction
    accepted = F.when(kind == "payload_incomparable", "unknown").when(kind.isin(*ACCEPTED_BREAKS), "breaking").otherwise("non_breaking")
    emitted = F.when((kind == "payload_incomparable") | kind.isin(*EMITTED_UNKNOWN), "unknown").when(kind.isin(*EMITTED_BREAKS), "breaking").otherwise("non_breaking")
    worse = F.when((accepted == "breaking") | (emitted == "breaking"), "breaking").when((accepted == "unknown") | (emitted == "unknown"), "unknown").otherwise("non_breaking")
    return F.when(way == "accepted", accepted).when(way == "emitted", emitted).when(way == "both", worse).otherwise("unknown")


def request_schema_changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, pointer, kind, detail, severity) of schema facts (*keys, pointer, types, enums, required, closed, coverage,
    fingerprint) of parameters and request bodies that both revisions have. An absent type is not compared; enum
    values are told one by one; subtrees that are not verified are incomparable if they differ, and not entered."""
    subjects = before.select(*keys).distinct().join(after.select(*keys).distinct(), keys, "left_semi")
    j = _sides(before.join(subjects, keys, "left_semi"), after.join(subjects, keys, "left_semi"), keys, ("fingerprint",))
    both = F.col("in_a") & F.col("in_b")
    sure = both & (F.col("b_coverage") == "verified") & (F.col("a_coverage") == "verified")
    typed = sure & (F.size("b_types") > 0) & (F.size("a_types") > 0)
    lost, gained = F.size(F.array_except("b_types", "a_types")) > 0, F.size(F.array_except("a_types", "b_types")) > 0
    gone, new = F.col("in_a").isNull(), F.col("in_b").isNull()
    # a subtree is as sure as all that lies in it, so one unsure fact makes its ancestors incomparable too
    unsure = j.where(both & ~sure).select(*keys, F.explode(F.array_append(above(F.col("pointer")), F.col("pointer"))).alias("pointer")).distinct()
    stops = j.where(gone | new).select(*keys, "pointer").union(unsure)
    tests = {
        "incomparable_subtree": typed & lost & gained,
        "parameter_type_narrowed": (typed & lost & ~gained) | (sure & F.col("b_enums").isNull() & F.col("a_enums").isNotNull()),
        "parameter_type_widened": (typed & gained & ~lost) | (sure & F.col("a_enums").isNull() & F.col("b_enums").isNotNull()),
        "request_property_removed": gone,
        "required_property_added": new & F.col("a_required"),
        "optional_property_added": new & ~F.col("a_required"),
        "request_additional_properties_disallowed": sure & F.col("a_closed") & ~F.col("b_closed"),
    }
    judged = not_below(j, stops, keys)
    known = judged.join(unsure, [*keys, "pointer"], "left_anti")
    nothing = F.lit(None).cast("string").alias("detail")
    parts = [known.select(*keys, "pointer", _kinds(tests).alias("kind"), nothing)]
    for one, two, kind in (("b_enums", "a_enums", "parameter_enum_value_removed"), ("a_enums", "b_enums", "parameter_enum_value_added")):
        parts.append(known.where(sure).select(*keys, "pointer", F.lit(kind).alias("kind"), F.explode(F.array_except(one, two)).alias("detail")))
    parts.append(judged.join(unsure, [*keys, "pointer"], "left_semi").where(both & (F.col("b_fingerprint") != F.col("a_fingerprint"))).select(*keys, "pointer", F.lit("incomparable_subtree").alias("kind"), nothing))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("severity", severity(F.col("kind")))


def openapi_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(kind, route, method, subject, pointer, detail, severity) between two revisions of interface rows (OPENAPI):
    endpoints, methods, parameters, request bodies and media types, request schemas, response statuses and schemas."""
    op = ["route", "method"]

    def of(df, row):
        return df.where(F.col("row") == row)

    def only(one, two, keys):
        return one.select(*keys).distinct().join(two.select(*keys).distinct(), keys, "left_anti")

    def out(rows, kind):
        have = set(rows.columns)
        return rows.select(F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), *[(F.col(c) if c in have else F.lit(None)).cast("string").alias(c) for c in ("route", "method", "subject", "pointer", "detail")])

    b_ops, a_ops = of(before, "operation"), of(after, "operation")
    shared_routes = b_ops.select("route").distinct().join(a_ops.select("route").distinct(), "route", "left_semi")
    shared = b_ops.select(*op).distinct().join(a_ops.select(*op).distinct(), op, "left_semi")
    parts = [out(only(b_ops, a_ops, ["route"]), "endpoint_removed"), out(only(a_ops, b_ops, ["route"]), "endpoint_added")]
    parts += [out(only(one, two, op).join(shared_routes, "route", "left_semi"), kind) for one, two, kind in ((b_ops, a_ops, "method_removed"), (a_ops, b_ops, "method_added"))]
    b, a = before.join(shared, op, "left_semi"), after.join(shared, op, "left_semi")

    def pair(row, *keys):
        left = of(b, row).select(*op, *keys, F.col("required").alias("br"), F.lit(True).alias("in_b"))
        return left.join(of(a, row).select(*op, *keys, F.col("required").alias("ar"), F.lit(True).alias("in_a")), [*op, *keys], "full")

    gone, new = F.col("in_a").isNull(), F.col("in_b").isNull()
    p = pair("parameter", "subject")
    kind = F.when(gone, "parameter_removed").when(new & F.col("ar"), "required_parameter_added").when(new, "optional_parameter_added")
    parts.append(out(p, kind.when(F.col("ar") & ~F.col("br"), "parameter_became_required").when(F.col("br") & ~F.col("ar"), "parameter_became_optional")))
    kind = F.when(gone, "request_body_removed").when(new & F.col("ar"), "request_body_added").when(new, "optional_request_body_added")
    bodies = pair("body")
    parts.append(out(bodies, kind.when(F.col("ar") & ~F.col("br"), "request_body_became_required").when(F.col("br") & ~F.col("ar"), "request_body_became_optional")))
    kept_body = bodies.where(F.col("in_a") & F.col("in_b")).select(*op)
    parts.append(out(pair("media", "subject").join(kept_body, op, "left_semi"), F.when(gone, "media_type_removed").when(new, "media_type_added")))
    schemas = request_schema_changes(of(b, "schema"), of(a, "schema"), [*op, "subject"])
    parts.append(out(schemas, F.col("kind")))
    digests = [of(x, "response").groupBy(*op, F.col("status").alias("subject")).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.concat_ws(" ", F.coalesce("media_type", F.lit("")), "fingerprint"))), "|"), 256).alias(n)) for x, n in ((b, "bf"), (a, "af"))]
    r = digests[0].join(digests[1], [*op, "subject"], "full")
    parts.append(out(r, F.when(F.col("af").isNull(), "response_status_removed").when(F.col("bf").isNull(), "response_status_added").when(F.col("af") != F.col("bf"), "response_schema_changed")))
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x)
    return rows.where("kind is not null").distinct().withColumn("severity", severity(F.col("kind")))


def message_directions(rows: DataFrame) -> DataFrame:
    """(path, message, direction) of interface rows (ASYNCAPI): emitted, accepted, both; null where no operation that
    has an action refers to the message."""
    used = rows.where("row = 'operation'").select("path", F.explode("messages").alias("message"), "action")
    ways = used.groupBy("path", "message").agg(F.max((F.col("action") == "send").cast("int")).alias("out"), F.max((F.col("action") == "receive").cast("int")).alias("in"))
    held = rows.where("row = 'message'").select("path", F.col("id").alias("message"))
    way = F.when((F.col("out") == 1) & (F.col("in") == 1), "both").when(F.col("out") == 1, "emitted").when(F.col("in") == 1, "accepted")
    return held.join(ways, ["path", "message"], "left").select("path", "message", way.alias("direction"))


def unreferenced_messages(rows: DataFrame) -> DataFrame:
    return message_directions(rows).where("direction is null").select("path", "message")


def asyncapi_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(kind, subject, pointer, severity) between two revisions of interface rows (ASYNCAPI): channels, operations,
    messages, and their payloads in the direction that the later revision gives the message."""

    def pair(row, *cols):
        left, right = (x.where(F.col("row") == row).select("id", *[F.col(c).alias(f"{n}_{c}") for c in cols], F.lit(True).alias(f"in_{n}")) for x, n in ((before, "b"), (after, "a")))
        return left.join(right, "id", "full")

    def differs(col):
        return ~F.col(f"b_{col}").eqNullSafe(F.col(f"a_{col}"))

    gone, new = F.col("in_a").isNull(), F.col("in_b").isNull()
    nothing = F.lit(None).cast("string").alias("pointer")

    def rows(df, tests):
        return df.select(_kinds(tests).alias("kind"), F.col("id").alias("subject"), nothing)

    same = F.col("in_a") & F.col("in_b")
    parts = [
        rows(pair("channel", "address"), {"channel_removed": gone, "channel_added": new, "channel_address_changed": same & differs("address")}),
        rows(pair("operation", "action", "channel"), {"operation_removed": gone, "operation_added": new, "operation_action_changed": same & differs("action"), "operation_channel_changed": same & differs("channel")}),
        rows(pair("message", "content_type"), {"message_removed": gone, "message_added": new, "message_content_type_changed": same & differs("content_type")}),
    ]
    surface = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("severity", severity(F.col("kind")))
    shared = before.where("row = 'message'").select(F.col("id").alias("subject")).join(after.where("row = 'message'").select(F.col("id").alias("subject")), "subject", "left_semi").distinct()
    facts = [x.where("row = 'schema'").join(shared, "subject", "left_semi") for x in (before, after)]
    ways = message_directions(after).select(F.col("message").alias("subject"), "direction")
    payload = payload_changes(*facts).drop("severity").join(ways, "subject", "left").withColumn("severity", payload_severity(F.col("kind"), F.col("direction")))
    return surface.unionByName(payload.select("kind", "subject", "pointer", "severity"))


def flow_findings(producers: DataFrame, consumers: DataFrame) -> DataFrame:
    """(flow, pointer, finding) of payload facts (flow, pointer, types, enums, required, closed, coverage) of what is
    sent and what is expected in the same flow: required_property_not_produced, type_not_accepted,
    enum_value_not_accepted, additional_properties_rejected; uncheckable where a side is not verified. Properties that
    both sides have are entered."""
    j = _sides(producers, consumers, ["flow"])  # b: produced, a: expected
    both = F.col("in_a") & F.col("in_b")
    sure = both & (F.col("b_coverage") == "verified") & (F.col("a_coverage") == "verified")
    types = sure & (F.size("a_types") > 0) & (F.size(F.array_except("b_types", "a_types")) > 0)
    enums = sure & F.col("a_enums").isNotNull() & (F.col("b_enums").isNull() | (F.size(F.array_except("b_enums", "a_enums")) > 0))
    parent = F.when(F.col("pointer").contains("/"), F.regexp_replace("pointer", "/[^/]*$", ""))
    extra = j.where(F.col("in_a").isNull()).select("flow", parent.alias("pointer")).distinct().withColumn("extra", F.lit(True))
    j = j.join(extra, ["flow", "pointer"], "left")
    tests = {
        "uncheckable": both & ~sure,
        "required_property_not_produced": F.col("in_b").isNull() & F.col("a_required") & (F.col("pointer") != ""),
        "type_not_accepted": types,
        "enum_value_not_accepted": enums,
        "additional_properties_rejected": sure & F.col("a_closed") & (~F.col("b_closed") | F.coalesce("extra", F.lit(False))),
    }
    stops = j.where(~F.coalesce(both, F.lit(False)) | (both & ~sure)).select("flow", "pointer")
    return not_below(j.select("flow", "pointer", _kinds(tests).alias("finding")), stops, ["flow"])


def pact_findings(interactions: DataFrame, surface: DataFrame) -> DataFrame:
    """(interaction_id, finding, detail) of consumer interactions (PACT) against a provider's rows (OPENAPI): eleven kinds,
    of which an interaction may have several; messages and matching rules are told, not checked. Query parameters that
    nobody declares are only told where the provider declares some."""
    ops = surface.where("row = 'operation'").select("route", "method")
    bodies = surface.where("row = 'body'").select("route", "method", "required", F.lit(True).alias("has_body"))
    status = surface.where("row = 'response'").groupBy("route", "method").agg(F.collect_set("status").alias("statuses"))
    query = surface.where("row = 'parameter' and location = 'query'").groupBy("route", "method").agg(F.collect_set("name").alias("declared"), F.collect_set(F.when(F.col("required"), F.col("name"))).alias("needed"))
    props = surface.where("row = 'schema' and subject like 'request %' and pointer rlike '^/[^/]+$'").groupBy("route", "method").agg(F.collect_set(F.expr("substring(pointer, 2)")).alias("properties"))
    o = ops.join(bodies, ["route", "method"], "left").join(status, ["route", "method"], "left").join(query, ["route", "method"], "left").join(props, ["route", "method"], "left")
    o = o.select(F.col("route").alias("template"), F.upper("method").alias("o_method"), F.coalesce("required", F.lit(False)).alias("body_required"), F.coalesce("has_body", F.lit(False)).alias("o_body"), "statuses", "declared", "needed", "properties")
    o = o.withColumn("segments", F.size(F.split("template", "/"))).withColumn("holes", F.size(F.regexp_extract_all("template", F.lit(r"(\{[^/]*\})"), F.lit(1))))
    i = interactions.where("kind = 'http' and method is not null and route is not null").withColumn("segments", F.size(F.split("route", "/")))
    hit = i.join(o, "segments").where(subsumes(F.col("template"), F.col("route")))
    own = hit.where(F.col("o_method") == F.col("method"))
    least = own.groupBy("interaction_id").agg(F.min("holes").alias("least"))
    best = own.join(least, "interaction_id").where("holes = least")
    ties = best.groupBy("interaction_id").agg(F.min("template").alias("template"), F.count("*").alias("n"))
    chosen = best.join(ties, ["interaction_id", "template"])
    nothing = F.lit(None).cast("string").alias("detail")

    def told(df, finding):
        return df.select("interaction_id", F.lit(finding).alias("finding"), nothing)

    def each(df, finding, names):
        return df.select("interaction_id", F.lit(finding).alias("finding"), F.explode(names).alias("detail"))

    none = F.array().cast("array<string>")
    declared, properties = F.coalesce("declared", none), F.coalesce("properties", none)
    any_status = F.exists(F.coalesce("statuses", none), lambda s: (s == F.col("status").cast("string")) | (s == "default") | (s == F.concat(F.substring(F.col("status").cast("string"), 1, 1), F.lit("XX"))))
    parts = [
        told(i.join(hit.select("interaction_id"), "interaction_id", "left_anti"), "pact_interaction_unmatched"),
        told(i.join(hit.select("interaction_id"), "interaction_id", "left_semi").join(own.select("interaction_id"), "interaction_id", "left_anti"), "pact_method_not_declared"),
        told(chosen.where("n > 1"), "pact_ambiguous_provider_match"),
        each(chosen, "pact_required_query_parameter_missing", F.array_except(F.coalesce("needed", none), "query")),
        each(chosen.where(F.size(declared) > 0), "pact_undeclared_request_parameter", F.array_except("query", declared)),
        told(chosen.where("body_required and not has_body"), "pact_required_request_body_missing"),
        told(chosen.where("has_body and not o_body"), "pact_undeclared_request_body"),
        each(chosen.where(F.col("has_body") & F.col("o_body") & (F.size(properties) > 0)), "pact_undeclared_body_property", F.array_except("body_keys", properties)),
        told(chosen.where(F.col("status").isNotNull() & ~any_status), "pact_response_status_undeclared"),
        told(interactions.where("kind = 'http' and has_rules"), "pact_matching_rules_unmodelled"),
        told(interactions.where("kind = 'message'"), "pact_message_interaction_not_cross_referenced"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def findings_by_channel(findings: DataFrame) -> DataFrame:
    """(channel, n, kinds) of findings(channel, finding)."""
    return findings.groupBy("channel").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("finding")), ",").alias("kinds"))


def parameter_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(kind, route, method, name, severity) of parameters(route, method, location, name, required, type) in two revisions,
    endpoints and methods included. An absent type is not compared."""
    def ends(df, *keys):
        return df.select(*keys).distinct()

    out = []
    for what, keys in (("endpoint", ["route"]), ("method", ["route", "method"])):
        b, a = ends(before, *keys), ends(after, *keys)
        if what == "method":  # of endpoints that are in both
            b, a = b.join(ends(after, "route"), "route", "left_semi"), a.join(ends(before, "route"), "route", "left_semi")
        for change, rows in (("removed", b.join(a, keys, "left_anti")), ("added", a.join(b, keys, "left_anti"))):
            out.append(rows.select(F.lit(f"{what}_{change}").alias("kind"), "route", F.col("method") if what == "method" else F.lit(None).cast("string").alias("method"), F.lit(None).cast("string").alias("name")))
    keys = ["route", "method", "location", "name"]
    both = ends(before, "route", "method").join(ends(after, "route", "method"), ["route", "method"])
    b = before.where("name is not null").join(both, ["route", "method"], "left_semi").select(*keys, F.col("required").alias("br"), F.col("type").alias("bt"), F.lit(True).alias("in_b"))
    a = after.where("name is not null").join(both, ["route", "method"], "left_semi").select(*keys, F.col("required").alias("ar"), F.col("type").alias("at"), F.lit(True).alias("in_a"))
    j = b.join(a, keys, "full")
    kind = (
        F.when(F.col("in_a").isNull(), "parameter_removed")
        .when(F.col("in_b").isNull() & F.col("ar"), "required_parameter_added")
        .when(F.col("in_b").isNull(), "optional_parameter_added")
        .when(F.col("ar") & ~F.col("br"), "parameter_became_required")
        .when(F.col("br") & ~F.col("ar"), "parameter_became_optional")
        .when(F.col("at") != F.col("bt"), F.when((F.col("bt") == "integer") & (F.col("at") == "number"), "parameter_type_widened").when((F.col("bt") == "number") & (F.col("at") == "integer"), "parameter_type_narrowed").otherwise("incomparable_subtree"))
    )
    out.append(j.select(kind.alias("kind"), "route", "method", "name").where("kind is not null"))
    rows = out[0]
    for o in out[1:]:
        rows = rows.unionByName(o)
    return rows.withColumn("severity", severity(F.col("kind")))


def pact_outcomes(interactions: DataFrame, operations: DataFrame) -> DataFrame:
    """(interaction_id, finding) of interactions(interaction_id, method, path, has_body, status) against provider operations
    (route, method, body_required, has_body, statuses array); null finding where the provider satisfies it. Joined on the
    number of segments; the most specific route counts."""
    i = interactions.withColumn("segments", F.size(F.split("path", "/")))
    o = operations.select("route", F.col("method").alias("o_method"), "body_required", F.col("has_body").alias("o_body"), "statuses", F.size(F.split("route", "/")).alias("segments"), F.size(F.regexp_extract_all("route", F.lit(r"(\{[^/]*\})"), F.lit(1))).alias("holes"))
    hit = i.join(o, "segments").where(subsumes(F.col("route"), F.col("path")))
    least = hit.groupBy("interaction_id").agg(F.min("holes").alias("least"))
    best = hit.join(least, "interaction_id").where("holes = least")
    same = F.upper("o_method") == F.upper("method")
    g = best.groupBy("interaction_id").agg(
        F.countDistinct("route").alias("routes"), F.max(same.cast("int")).alias("declared"),
        F.max((same & F.col("body_required") & ~F.col("has_body")).cast("int")).alias("lacks_body"), F.max((same & F.col("has_body") & ~F.col("o_body")).cast("int")).alias("extra_body"),
        F.max((same & F.array_contains("statuses", F.col("status"))).cast("int")).alias("status_ok"),
    )
    finding = (
        F.when(F.col("routes").isNull(), "pact_interaction_unmatched")
        .when(F.col("routes") > 1, "pact_ambiguous_provider_match")
        .when(F.col("declared") == 0, "pact_method_not_declared")
        .when(F.col("lacks_body") == 1, "pact_required_request_body_missing")
        .when(F.col("extra_body") == 1, "pact_undeclared_request_body")
        .when(F.col("status_ok") == 0, "pact_response_status_undeclared")
    )
    return interactions.select("interaction_id").join(g, "interaction_id", "left").select("interaction_id", finding.alias("finding"))
