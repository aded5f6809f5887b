"""Validity-interval facts and lineage of files."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataspark.functions.members import may_hold
from strataspark.functions.storage import forget, written
from strataspark.functions.text import tokens

#: Points of an as-of join that are broadcast, and slots of the timeline beyond that.
MAX_POINTS, SLOTS = 1000, 64
#: Buckets by which the rarity of tokens is told, 64-bit words of parity bits a set, tokens of a block of similar sets.
LEVEL_BUCKETS, PARITY_WORDS, BLOCK_TOKENS = 1 << 21, 4, 400_000


def fact_intervals(observations: DataFrame, timeline: DataFrame) -> DataFrame:
    """Facts (fact_id, subject, predicate, object, opened_idx, closed_idx) from observations(idx, subject, predicate,
    object) on a timeline(idx) without gaps: a fact opens at its first observation and closes at the first index
    where it is absent (null while it holds); if it comes back that is a new fact."""
    key = ["subject", "predicate", "object"]
    seen = observations.select("idx", *key).distinct()
    run = seen.withColumn("island", F.col("idx") - F.row_number().over(Window.partitionBy(*key).orderBy("idx")))
    spans = run.groupBy(*key, "island").agg(F.min("idx").alias("opened_idx"), F.max("idx").alias("last_idx"))
    last = timeline.agg(F.max("idx").alias("end"))
    out = spans.crossJoin(F.broadcast(last)).withColumn("closed_idx", F.when(F.col("last_idx") < F.col("end"), F.col("last_idx") + 1))
    fact_id = F.sha2(F.concat(*[F.concat(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\0")) for c in (*key, "opened_idx")]), 256)
    return out.select(fact_id.alias("fact_id"), *key, "opened_idx", "closed_idx")


def active_at(facts: DataFrame, points: DataFrame) -> DataFrame:
    """(at, fact) for each point(at): facts with opened_idx <= at and (open or closed_idx > at). Up to MAX_POINTS points
    are broadcast; with more, points and facts meet in the SLOTS that the timeline is cut into."""
    holds = (F.col("opened_idx") <= F.col("at")) & (F.col("closed_idx").isNull() | (F.col("closed_idx") > F.col("at")))
    if points.limit(MAX_POINTS + 1).count() <= MAX_POINTS:
        return facts.join(F.broadcast(points), holds)
    low, high = points.agg(F.min("at"), F.max("at")).first()
    width = max(1, -(-(high - low + 1) // SLOTS))

    def slot(at: Column) -> Column:
        return F.floor((F.greatest(at, F.lit(low)) - F.lit(low)) / F.lit(width))

    last = F.least(F.coalesce(F.col("closed_idx"), F.lit(high + 1)), F.lit(high + 1))
    near = facts.where((F.col("opened_idx") <= high) & (last > low))
    near = near.withColumn("__slot", F.explode(F.sequence(slot(F.col("opened_idx")), slot(last))))
    return near.join(points.withColumn("__slot", slot(F.col("at"))), "__slot").where(holds).drop("__slot")


def journal_stats(facts: DataFrame) -> DataFrame:
    return facts.agg(F.count("*").alias("total"), F.count_if(F.col("closed_idx").isNull()).alias("active"), F.count_if(F.col("closed_idx").isNotNull()).alias("retired"))


def digest_by(rows: DataFrame, group: str, line: str) -> DataFrame:
    """(group, n, digest): sha256 over the sorted distinct lines of each group, by way of digests of buckets, so one
    large group is not one task's string: lines are dealt by the heads of their own digests, six, four and two digits
    of them in turn, which keeps their order. Of n lines a task joins about n / 16**6 at most."""
    part = rows.select(group, F.sha2(line, 256).alias("part")).distinct().select(group, "part", F.col("part").alias("bucket"), F.lit(1).cast("bigint").alias("n"))
    for digits in (6, 4, 2, 0):
        pairs = F.transform(F.array_sort(F.collect_list(F.struct("bucket", "part"))), lambda x: x["part"])
        part = part.withColumn("to", F.substring("bucket", 1, digits)).groupBy(group, "to").agg(F.sum("n").alias("n"), F.sha2(F.array_join(pairs, ""), 256).alias("part")).withColumnRenamed("to", "bucket")
    return part.select(group, "n", F.col("part").alias("digest"))


def lineage_exact(before: DataFrame, after: DataFrame) -> DataFrame:
    """(kind, from_path, to_path, coverage): files gone from before and new in after with equal digests. One to one is a
    verified rename; groups of several are partial, each file named with no partner."""
    gone = before.join(after.select("path"), "path", "left_anti").select("content_hash", "path")
    new = after.join(before.select("path"), "path", "left_anti").select("content_hash", "path")
    g = gone.groupBy("content_hash").agg(F.count("*").alias("n_from"), F.min("path").alias("one_from"))
    n = new.groupBy("content_hash").agg(F.count("*").alias("n_to"), F.min("path").alias("one_to"))
    both = g.join(n, "content_hash")
    sure = both.where("n_from = 1 and n_to = 1").select(F.lit("renamed").alias("kind"), F.col("one_from").alias("from_path"), F.col("one_to").alias("to_path"), F.lit("verified").alias("coverage"))
    unsure = both.where("n_from > 1 or n_to > 1").select("content_hash")
    nothing = F.lit(None).cast("string")
    left = gone.join(unsure, "content_hash", "left_semi").select(F.lit("renamed"), "path", nothing, F.lit("partial"))
    right = new.join(unsure, "content_hash", "left_semi").select(F.lit("renamed"), nothing, "path", F.lit("partial"))
    return sure.unionAll(left).unionAll(right)


def _sketch(levels: Broadcast):
    """A function of token hashes that gives the levels of the tokens and PARITY_WORDS words, bit b of which tells
    whether an odd number of tokens falls on it: sets that differ in d tokens differ in d bits at most."""

    @F.arrow_udf("struct<levels array<tinyint>, bits array<bigint>>")
    def sketch(hashes: pa.Array) -> pa.Array:
        at = np.concatenate(([0], np.cumsum(hashes.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int32)
        h = hashes.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        place = (h >> np.uint64(40)) % np.uint64(64 * PARITY_WORDS)
        mask, word = np.uint64(1) << (place & np.uint64(63)), place >> np.uint64(6)
        words = [np.bitwise_xor.reduceat(np.where(word == k, mask, np.uint64(0)), at[:-1]) for k in range(PARITY_WORDS)] if len(h) else []
        bits = np.stack(words, 1).reshape(-1).view(np.int64) if words else np.zeros(0, np.int64)
        level = levels.value[(h & np.uint64(LEVEL_BUCKETS - 1)).astype(np.int64)]
        return pa.StructArray.from_arrays(
            [pa.ListArray.from_arrays(pa.array(at), pa.array(level)), pa.ListArray.from_arrays(pa.array(np.arange(len(at), dtype=np.int32) * PARITY_WORDS), pa.array(bits))], ["levels", "bits"]
        )

    return sketch


def _levels(sets: DataFrame) -> np.ndarray:
    """A number for each of LEVEL_BUCKETS buckets of token hashes that grows with the rows that hold its tokens: 0 if one
    row does or none, 127 at most. The driver gets the buckets above 0, 5 bytes each."""
    buckets = sets.select(F.explode(F.transform("tokens", lambda x: F.xxhash64(x).bitwiseAND(F.lit(LEVEL_BUCKETS - 1)).cast("int"))).alias("bucket"))
    held = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    got = held.select("bucket", F.least(F.lit(127), F.ceil(F.log2("n") * 5)).cast("tinyint").alias("level")).toArrow()
    out = np.zeros(LEVEL_BUCKETS, np.int8)
    out[got["bucket"].to_numpy()] = got["level"].to_numpy()
    return out


def _candidates(sets: DataFrame, threshold: float) -> DataFrame:
    """(i, j, ni, nj), i < j, of sets(id, tokens) that may be similar; none that is gets lost. Copies share their id.

    Prefix filter: with tokens in any order that all sets share, here by levels of rarity and then by name, two similar
    sets share one of the first |s| - ceil(threshold |s|) + 1. A pair meets where both have another token before one that
    they share, so at the first that they share; it stays if sizes, parity bits and that place allow it."""
    n = F.size("tokens")
    sketch = _sketch(sets.sparkSession.sparkContext.broadcast(_levels(sets)))
    rated = sets.select("id", n.alias("n"), "tokens", sketch(F.transform("tokens", lambda x: F.xxhash64(x))).alias("s"))
    ranked = F.array_sort(F.zip_with("s.levels", "tokens", lambda level, w: F.struct(level.alias("level"), w.alias("w"))))
    first = F.slice(ranked, F.lit(1), (F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1).cast("int"))
    bits = [F.col("s.bits")[k].alias(f"b{k}") for k in range(PARITY_WORDS)]
    each = rated.select("id", "n", *bits, first.alias("first")).select("*", F.posexplode("first").alias("at", "token"))
    # a token of level 0 is in one row only; copies leave as rows of a partition that are equal
    last = F.when(F.col("at") > 0, F.col("first")[F.col("at") - 1]["w"]).alias("last")
    each = each.where("token.level > 0").select(F.col("token.w").alias("w"), last, "id", "n", (F.col("at") + 1).alias("at"), *[f"b{k}" for k in range(PARITY_WORDS)]).repartition("w").distinct()
    x, y = each.alias("x"), each.alias("y")
    both = F.col("x.n") + F.col("y.n")
    apart = sum((F.bit_count(F.col(f"x.b{k}").bitwiseXOR(F.col(f"y.b{k}"))) for k in range(PARITY_WORDS)), F.lit(0))
    like = (F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * F.lit(threshold) - 1e-6) & (apart <= both * F.lit((1 - threshold) / (1 + threshold)) + 1e-6)
    met = x.join(y, (F.col("x.w") == F.col("y.w")) & (F.col("x.id") < F.col("y.id")) & ~F.coalesce(F.col("x.last") == F.col("y.last"), F.lit(False)) & like)
    met = met.groupBy(F.col("x.id").alias("i"), F.col("y.id").alias("j"), F.col("x.n").alias("ni"), F.col("y.n").alias("nj"))
    met = met.agg(F.min("x.at").alias("ai"), F.min("y.at").alias("aj"))
    most = F.least(F.col("ni") - F.col("ai"), F.col("nj") - F.col("aj")) + 1
    return met.where(most >= (F.col("ni") + F.col("nj")) * F.lit(threshold / (1 + threshold)) - 1e-6).select("i", "j", "ni", "nj")


def _shared_tokens(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(i, j, common, union) of pairs(i, j, ni, nj) of ids of sets(id, tokens), counted on the tokens themselves.

    Sets that are alike have the same home, the least id that they or a partner of theirs have; a home is cut into
    blocks of about BLOCK_TOKENS tokens, pairs meet by pairs of blocks, and a set goes to each of these once."""
    ends = pairs.select(F.col("i").alias("id"), F.col("ni").alias("n"), F.col("i").alias("near")).unionAll(pairs.select("j", "nj", "i"))
    homes = ends.groupBy("id").agg(F.min("near").alias("home"), F.min("n").alias("n"))
    sizes = homes.groupBy("home").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).alias("blocks"))
    block = F.struct("home", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("part"))
    homes = written(homes.join(sizes, "home").select("id", block.alias("block")), "homes")
    placed = pairs.join(homes.select(F.col("id").alias("i"), F.col("block").alias("bi")), "i").join(homes.select(F.col("id").alias("j"), F.col("block").alias("bj")), "j")
    placed = written(placed.select(F.struct("bi", "bj").alias("key"), "i", "j"), "placed")
    # only sets of pairs are shuffled
    held = may_hold(sets.select("id", "tokens", F.xxhash64("id").alias("hash")), "hash", homes.select(F.xxhash64("id").alias("hash")), "hash", "asked")
    held = held.where("asked").select("id", F.arrow_udf(_packed, "binary")(F.array_join("tokens", " ")).alias("packed")).dropDuplicates(["id"])
    members = placed.select("key", F.col("i").alias("id")).unionAll(placed.select("key", "j")).distinct()
    found = members.join(held, "id").groupBy("key").agg(F.collect_list(F.struct("id", "packed")).alias("found"))
    asked = placed.groupBy("key").agg(F.collect_list(F.struct("i", "j")).alias("asked"))
    counted = F.arrow_udf(_counted, "array<struct<i binary, j binary, common int, union int>>")
    return found.join(asked, "key").select(F.explode(counted("found", "asked")).alias("p")).select("p.*")


def _packed(texts: pa.Array) -> pa.Array:
    return pa.array([zlib.compress(t.encode()) for t in texts.to_pylist()], pa.binary())


def _counted(found: pa.Array, asked: pa.Array) -> pa.Array:
    out = []
    for sets, pairs in zip(found, asked, strict=True):
        known = {s["id"]: frozenset(zlib.decompress(s["packed"]).split(b" ")) for s in sets.as_py()}
        out.append([])
        for p in pairs.as_py():
            left, right = known[p["i"]], known[p["j"]]
            common = len(left & right)
            out[-1].append({"i": p["i"], "j": p["j"], "common": common, "union": len(left) + len(right) - common})
    return pa.array(out, pa.list_(pa.struct([("i", pa.binary()), ("j", pa.binary()), ("common", pa.int32()), ("union", pa.int32())])))


def similar_files(files: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(from_path, to_path, common, union) of files(path, text, before, after), two flags that tell the sides a file is
    on, of different paths whose token sets have Jaccard similarity >= threshold, exactly.

    Tokens are written once. Only rare tokens of a set, and the sets of pairs that may be similar, are shuffled; equal
    sets stand once until the end."""
    sets = files.select("path", "before", "after", tokens(F.col("text")).alias("tokens"))
    # equal ids: equal digests of 128 bits
    sets = sets.select("*", F.unhex(F.substring(F.sha2(F.array_join("tokens", " "), 256), 1, 32)).alias("id"))
    sets = written(sets, "tokens").where(F.size("tokens") > 0)
    pairs = written(_candidates(sets.select("id", "tokens"), threshold), "candidates")
    links = written(_shared_tokens(sets.select("id", "tokens"), pairs).where(F.col("common") >= F.col("union") * F.lit(threshold)), "links")
    copies = sets.groupBy("id").agg(F.max(F.size("tokens")).alias("n"), F.count("*").alias("rows"), F.max("before").alias("before"), F.max("after").alias("after"))
    copies = copies.where("rows > 1 and before and after").select(F.col("id").alias("f"), F.col("id").alias("t"), "n", "n")
    ways = links.select(F.col("i").alias("f"), F.col("j").alias("t"), "common", "union").unionAll(links.select("j", "i", "common", "union")).unionAll(copies)
    left, right = sets.where("before").select(F.col("id").alias("f"), F.col("path").alias("from_path")), sets.where("after").select(F.col("id").alias("t"), F.col("path").alias("to_path"))
    return ways.join(left, "f").join(right, "t").where("from_path <> to_path").select("from_path", "to_path", "common", "union")


def similar_pairs(before: DataFrame, after: DataFrame, threshold: float = 0.85) -> DataFrame:
    """similar_files of two tables files(path, text)."""
    yes, no = F.lit(True), F.lit(False)
    sides = before.select("path", "text", yes.alias("before"), no.alias("after")).unionAll(after.select("path", "text", no, yes))
    return similar_files(sides, threshold)


def best_match(pairs: DataFrame, margin: float = 0.05) -> DataFrame:
    """(from_path, to_path, similarity, ambiguous): the most similar target of each source; ambiguous where the
    runner-up is within the margin. Similarity alone is never more than partial evidence."""
    s = pairs.withColumn("similarity", F.col("common") / F.col("union"))
    w = Window.partitionBy("from_path").orderBy(F.desc("similarity"), "to_path")
    ranked = s.withColumn("k", F.row_number().over(w)).withColumn("next", F.lead("similarity").over(w))
    return ranked.where("k = 1").select("from_path", "to_path", "similarity", F.coalesce(F.col("similarity") - F.col("next") < margin, F.lit(False)).alias("ambiguous"))


def lineage_leftovers(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files(path, content_hash, ...) of both sides that `lineage_exact` did not use up; files that exist on both sides
    are among them."""
    used = written(lineage_exact(before, after), "exact")
    gone = used.where("from_path is not null").select(F.col("from_path").alias("path"))
    new = used.where("to_path is not null").select(F.col("to_path").alias("path"))
    return before.join(gone, "path", "left_anti"), after.join(new, "path", "left_anti")


def consume_matches(pairs: DataFrame, margin: float = 0.05) -> DataFrame:
    """(from_path, to_path, similarity, ambiguous): sources in the order of paths each take their most similar target
    (ties: the least path) that no earlier source took. `ambiguous`: the next best one left was within the margin.

    Every source proposes to its best target left, and a target keeps the least source that proposed; refused pairs are
    struck out until nobody is refused. That ends in what taking turns gives, in far fewer rounds than sources."""
    left = written(pairs.select("from_path", "to_path", (F.col("common") / F.col("union")).alias("similarity")), "proposals")
    w = Window.partitionBy("from_path").orderBy(F.desc("similarity"), "to_path")
    while True:
        best = left.withColumn("k", F.row_number().over(w)).withColumn("next", F.lead("similarity").over(w)).where("k = 1")
        asked = written(best.withColumn("first", F.min("from_path").over(Window.partitionBy("to_path"))), "proposals")
        refused = asked.where("from_path <> first").select("from_path", "to_path")
        if refused.isEmpty():
            break
        rest = written(left.join(refused, ["from_path", "to_path"], "left_anti"), "proposals")
        forget(left)
        forget(asked)
        left = rest
    return asked.select("from_path", "to_path", "similarity", F.coalesce(F.col("similarity") - F.col("next") < margin, F.lit(False)).alias("ambiguous"))


def lineage_moves(before: DataFrame, after: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(from_path, to_path, similarity, ambiguous) between the leftovers of files(path, content_hash, text); partial
    evidence, whatever the similarity."""
    b, a = lineage_leftovers(before, after)
    return consume_matches(similar_pairs(b.select("path", "text"), a.select("path", "text"), threshold))


def lineage_summary(moves: DataFrame) -> DataFrame:
    """(kind, n, identity_preserved, partial) of lineage rows (kind, from_path, to_path, coverage)."""
    kept = F.col("from_path").isNotNull() & F.col("to_path").isNotNull()
    return moves.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(kept).alias("identity_preserved"), F.count_if(F.col("coverage") != "verified").alias("partial"))
