"""Identifiers, versions and encodings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags of symbol kinds, and redaction kinds by key: of the last segment, or of the whole key.
SYMBOL_TAGS = "function class method interface type enum variable constant module namespace property field struct trait record constructor".split()
KEY_SEGMENTS = {
    "authorization_header": "authorization proxy-authorization proxy_authorization",
    "cookie_header": "cookie set-cookie set_cookie",
    "api_key": "x-api-key x_api_key api-key apikey",
    "credential": "password passwd secret client_secret client-secret",
    "private_key_material": "private_key private-key",
    "token": "token access_token refresh_token id_token x-auth-token x-csrf-token csrf_token",
    "session_key": "session session_id sessionid",
    "query_string": "query",
}
WHOLE_KEYS = {"user_identity": "enduser.id enduser.scope user.id", "payload": "db.statement http.request.body.content http.response.body.content"}


def key_rule(key: Column) -> Column:
    """The redaction kind of an attribute key, by the whole key or by its last segment after `.` or `/`; else null."""
    low = F.lower(key)
    last = F.regexp_extract(low, r"([^./]*)$", 1)
    out = F.lit(None).cast("string")
    for kind, words in reversed(KEY_SEGMENTS.items()):
        out = F.when(last.isin(*words.split()), kind).otherwise(out)
    for kind, words in reversed(WHOLE_KEYS.items()):
        out = F.when(low.isin(*words.split()), kind).otherwise(out)
    return out


def qualified_name(path: Column, scope: Column, name: Column) -> Column:
    return F.concat_ws("::", path, F.nullif(scope, F.lit("")), name)


def stable_id(path: Column, kind: Column, scope: Column, name: Column) -> Column:
    """{path}#{kind}:{name}, for methods {path}#method:{scope}.{name}."""
    return F.concat(path, F.lit("#"), kind, F.lit(":"), F.when(kind == "method", F.concat(scope, F.lit("."), name)).otherwise(name))


def is_canonical(symbol_id: Column) -> Column:
    """Whether an id has a path, a known kind and a name."""
    return symbol_id.rlike(rf"^[^#]+#({'|'.join(SYMBOL_TAGS)}):(?s:.+)$")


def signature_hash(signature: Column) -> Column:
    return F.sha2(signature, 256)


def signature_fingerprint(signature: Column) -> Column:
    return F.substring(signature_hash(signature), 1, 12)


_ENTITY = r"^urn:([a-z0-9][a-z0-9-]*):entity:([a-z]+):([A-Za-z0-9._-]+):([A-Za-z0-9._-]+)(?:#([^#:]+(?::[^#:]+)*?)(?:::(.+))?)?$"


def entity_parts(urn: Column) -> Column:
    """A struct (provider, org, repo, path, symbol) of urn:<space>:entity:<provider>:<org>:<repo>[#path[::symbol]]; null if it is
    none. Paths are given with forward slashes and without leading ./"""
    part = [F.nullif(F.regexp_extract(urn, _ENTITY, k), F.lit("")) for k in range(2, 7)]
    path = F.regexp_replace(F.translate(part[3], "\\", "/"), r"^(\./)+", "")
    return F.when(urn.rlike(_ENTITY), F.struct(part[0].alias("provider"), part[1].alias("org"), part[2].alias("repo"), path.alias("path"), part[4].alias("symbol")))


def major_minor(version: Column) -> Column:
    """The first two numbers of a version, null without them."""
    return F.nullif(F.regexp_extract(version, r"^\s*v?([0-9]+\.[0-9]+)", 1), F.lit(""))


def percent_decode(text: Column) -> Column:
    """Percent escapes replaced (a plus stays); text with a bad escape is given as it is."""
    return F.coalesce(F.call_function("try_url_decode", F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def query_parameter(query: Column, name: str) -> Column:
    """The first value of a parameter in a query string, decoded (a plus is a blank); null if it is not there."""
    hit = F.filter(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1) == name)
    value = F.get(hit, F.lit(0))
    return percent_decode(F.translate(F.regexp_replace(value, "^[^=]*=?", ""), "+", " "))


def display_author(author: Column) -> Column:
    """The name before ` <`."""
    return F.substring_index(author, " <", 1)


def short_oid(oid: Column) -> Column:
    return F.substring(oid, 1, 7)


def git_timestamp(line: Column) -> Column:
    """Seconds of an author or committer line (`Name <mail> 1700000000 +0100`); null without them."""
    return F.nullif(F.regexp_extract(line, r">\s+([0-9]{1,18})(?:\s+[+-][0-9]{4})?\s*$", 1), F.lit("")).cast("bigint")
