"""Coverage lattice verified < partial < unsupported < unknown; combining keeps the worse."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STATES = ("verified", "partial", "unsupported", "unknown")


def rank(state: Column) -> Column:
    """0..3; a null or unlisted state is unknown."""
    out = F.lit(3)
    for k, s in enumerate(STATES[:3]):
        out = F.when(state == s, k).otherwise(out)
    return out


def state(rank_: Column) -> Column:
    out = F.lit(STATES[3])
    for k, s in enumerate(STATES[:3]):
        out = F.when(rank_ == k, s).otherwise(out)
    return out


def worse(*states: Column) -> Column:
    return state(F.greatest(*[rank(s) for s in states])) if len(states) > 1 else state(rank(states[0]))


def fold(states: Column) -> Column:
    """Aggregate: the worst state of a group (unknown for none)."""
    return state(F.coalesce(F.max(rank(states)), F.lit(3)))
