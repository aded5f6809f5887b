"""Ratios in parts per million, as exact integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio_ppm(n: Column, d: Column) -> Column:
    """floor(n * 10**6 / d), 0 where d is 0."""
    n, d = n.cast("bigint"), d.cast("bigint")
    return F.when(d == 0, F.lit(0).cast("bigint")).otherwise(F.floor((n * 1_000_000 - F.pmod(n * 1_000_000, d)) / d).cast("bigint"))


def _int_div(a: str, b: str) -> str:
    return f"(({a}) div ({b}))"


def wilson_ppm(x: str, n: str) -> tuple[Column, Column]:
    """Lower and upper 95 % Wilson bound of x successes in n trials (bigint expressions), in ppm.

    z = 1.96 is kept as the ratio 196/100. Wide products are decimals; quotients are taken as (a - a % b) / b, since
    `div` on wide decimals wraps at 64 bits. x is taken as at most n; without trials the interval is everything."""
    x = f"least({x}, {n})"
    num = f"cast(cast(4 * {x} * ({n} - {x}) * 10000 + 38416 * {n} as decimal(20,0)) * cast(1000000000000 as decimal(13,0)) as decimal(38,0))"
    d = f"cast({n} as decimal(12,0))"
    lifted = f"cast(({num} - ({num} % {d})) / {d} as decimal(38,0))"
    guess = f"cast(floor(sqrt(cast({lifted} as double))) as bigint)"
    square = "cast({0} as decimal(18,0)) * cast({0} as decimal(18,0))"
    root = (
        f"(case when {square.format(guess)} > {lifted} then {guess} - 1 "
        f"when {square.format(f'({guess} + 1)')} <= {lifted} then {guess} + 1 else {guess} end)"
    )
    half = _int_div(f"cast(98 * cast({root} as decimal(20,0)) * 1000000 as decimal(38,0))", f"cast(({n} * 10000 + 38416) * cast(1000000 as decimal(7,0)) as decimal(30,0))")
    centre = _int_div(f"({x} * 10000 + 19208) * 1000000", f"({n} * 10000 + 38416)")
    upper = f"case when {n} = 0 or {x} = {n} then 1000000 else least({centre} + {half}, 1000000) end"
    lower = f"case when {n} = 0 or {x} = 0 then 0 else greatest({centre} - {half}, 0) end"
    return F.expr(f"cast({lower} as bigint)"), F.expr(f"cast({upper} as bigint)")
