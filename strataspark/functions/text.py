"""Scalar functions on strings: tokens, identifiers, routes, URLs, redaction shapes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Sorted distinct lower-case runs of ASCII letters, digits and underscores."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)"), F.lit(1))))


def jaccard(a: Column, b: Column) -> Column:
    """|a & b| / |a | b|, 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def package_key(path: Column) -> Column:
    """The first two segments of a path."""
    return F.substring_index(path, "/", 2)


def short_name(qualified: Column) -> Column:
    return F.substring_index(F.substring_index(qualified, "::", -1), ".", -1)


def glob_to_regex(pattern: str) -> str:
    """A whole-string regular expression for a glob in which `*` also crosses '/'. Unbalanced brackets: see matches."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        if c == "*":
            while k + 1 < len(pattern) and pattern[k + 1] == "*":
                k += 1
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[":
            end = pattern.find("]", k + 2)
            if end < 0:
                raise ValueError("unclosed bracket")
            inner = pattern[k + 1 : end]
            out += "[" + ("^" + inner[1:] if inner[:1] == "!" else inner).replace("\\", "\\\\") + "]"
            k = end
        else:
            out += re.escape(c)
        k += 1
    return f"(?s)^{out}$"


def matches(path: Column, pattern: str) -> Column:
    """Glob predicate; a pattern that is no glob is looked for as a substring."""
    if pattern == "*":
        return F.lit(True)
    try:
        return path.rlike(glob_to_regex(pattern))
    except ValueError:
        return path.contains(pattern)


def normal_path(path: Column) -> Column:
    """Forward slashes, without leading './'."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^(\./)+", "")


def route_template(path: Column) -> Column:
    """Query and fragment cut, every whole-segment placeholder erased to {}."""
    return F.regexp_replace(F.regexp_replace(path, r"[?#].*$", ""), r"(?<=/|^)\{[^/{}]*\}(?=/|$)", "{}")


def subsumes(template: Column, path: Column) -> Column:
    """Whether a route template covers a path: as many segments, each equal or a placeholder."""
    t, p = F.split(template, "/"), F.split(path, "/")
    each = F.zip_with(t, p, lambda a, b: a.rlike(r"^\{[^/]*\}$") & (b != "") | (a == b))
    return (F.size(t) == F.size(p)) & F.forall(each, lambda x: F.coalesce(x, F.lit(False)))


def strip_url(url: Column) -> Column:
    """The URL without userinfo, query and fragment."""
    bare = F.regexp_replace(url, r"[?#].*$", "")
    return F.regexp_replace(bare, r"^([A-Za-z][A-Za-z0-9+.\-]*://)[^/]*@", "$1")


# Shapes of whole values that are redacted, in the order of the tests.
SHAPES = {
    "jwt": r"^eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*$",
    "aws_key": r"^(AKIA|ASIA)[A-Z0-9]{16}$",
    "email": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$",
    "ipv4": r"^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$",
    "mac": r"^([0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}$",
    "ipv6": r"^(([0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(([0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4})?::(([0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4})?)$",
    "auth_scheme": r"^(?i:bearer|basic|digest)\s+\S+$",
    "private_key": r"^-----BEGIN ([A-Z0-9]+ ){0,3}PRIVATE KEY-----",
}


def redaction_kind(value: Column) -> Column:
    """The first shape that the whole value has; digits of 13 to 19 with a right check digit are a card; else null."""
    out = F.when(value.rlike("^[0-9]{13,19}$") & F.call_function("luhn_check", value), "card")
    for kind, shape in reversed(SHAPES.items()):
        out = F.when(value.rlike(shape), kind).otherwise(out)
    return out


def token_estimate(text: Column) -> Column:
    return F.floor((F.length(text) + 3) / 4).cast("bigint")
