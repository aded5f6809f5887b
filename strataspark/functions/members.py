"""Membership of keys in a table, told by a bitmap of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df does not have, so that extra columns never clash with ours."""
    taken = {c.lower() for c in df.columns}
    name = f"__{base}"
    while name.lower() in taken:
        name += "_"
    return name


def may_hold(rows: DataFrame, key: str, ids: DataFrame, id_: str, flag: str, bits: int = 1 << 26) -> DataFrame:
    """rows with a boolean column `flag`: false only if no row of ids has the key. A bitmap of hashed ids, `bits` / 8
    bytes at most whatever the input, is broadcast in pieces of 4 KB; where it fills up, more rows are flagged and
    nothing else changes. It keeps texts that a join would drop from being shuffled."""
    piece, word, at_name = (fresh(rows, n) for n in ("piece", "bits", "place"))

    def place(c: str) -> Column:
        return F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(bits))

    pieces = ids.select(place(id_).alias("h")).groupBy(F.floor(F.col("h") / 32768).alias(piece))
    pieces = pieces.agg(F.bitmap_construct_agg(F.pmod(F.col("h"), F.lit(32768))).alias(word))
    out = rows.withColumn(at_name, place(key)).join(F.broadcast(pieces), F.floor(F.col(at_name) / 32768) == F.col(piece), "left")
    byte = F.expr(f"cast(conv(hex(substring(`{word}`, cast(`{at_name}` % 32768 div 8 as int) + 1, 1)), 16, 10) as int)")
    hit = F.getbit(byte.cast("int"), F.pmod(F.col(at_name), F.lit(8)).cast("int")) == 1
    return out.withColumn(flag, F.coalesce(hit, F.lit(False))).drop(at_name, piece, word)
