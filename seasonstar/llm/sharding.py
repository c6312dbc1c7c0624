"""Sharding by a Feistel permutation of global row numbers.

Every row gets a global number, the number is permuted by a seeded Feistel
network with cycle walking, and shard and slot are remainder and quotient of the
permuted number. Given the row number, the seed and the row count, anyone can
compute shard and slot, and the inverse, without looking at another row.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Row numbers run through this many hash buckets in turn. The table of bucket
#: offsets has at most this many rows, which bounds its broadcast.
BUCKETS = 4096
ROUNDS = 4


def number_rows(rows: DataFrame, key: str, tie: list[str], buckets: int = BUCKETS) -> DataFrame:
    """``rows`` with ``row_number``: 0 to count - 1, decided by the rows alone.

    Rows are ordered by a hash bucket of ``key`` and ``tie``, then ``key``, then ``tie``.
    Each bucket is numbered on its own and shifted by the rows of the buckets before it,
    so no task ever holds more than a bucket's sorted, spillable run, and a key that many
    different rows share is spread over all buckets. Rows equal in ``key`` and ``tie`` are
    interchangeable, and one run. A NULL key is a key like any other.
    """
    bucket = F.pmod(F.xxhash64(F.col(key), *tie), F.lit(buckets)).cast("int")
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.select(bucket.alias("__bucket"))
        .groupBy("__bucket")
        .agg(F.count(F.lit(1)).alias("__rows"))
        .select("__bucket", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset"))
    )
    inside = Window.partitionBy("__bucket").orderBy(key, *tie)
    return (
        rows.withColumn("__bucket", bucket)
        .withColumn("__place", F.row_number().over(inside))
        .join(F.broadcast(offsets), "__bucket")
        .withColumn("row_number", F.col("__offset") + F.col("__place") - 1)
        .drop("__bucket", "__place", "__offset")
    )


def radices(count: int) -> tuple[int, int]:
    """Sizes of the two halves: their product is the smallest near-square cover of ``count``."""
    left = isqrt(count - 1) + 1 if count > 1 else 1
    return left, -(-count // left) if count else 1


def _network(
    number: Column, count: int, seed: int, rounds: int, inverse: bool = False
) -> Column:
    """One pass of the Feistel network over [0, left * right), or its inverse."""
    left, right = radices(count)
    order = range(rounds - 1, -1, -1) if inverse else range(rounds)
    keys = F.array(*[F.lit(seed * 1_000_003 + i).cast("long") for i in order])

    def mixed(half: Column, key: Column, side: int, radix: int) -> Column:
        return F.pmod(F.xxhash64(half, key, F.lit(side)), F.lit(radix).cast("long"))

    def step(state: Column, key: Column) -> Column:
        if inverse:
            new_right = F.pmod(state["r"] - mixed(state["l"], key, 1, right), F.lit(right))
            new_left = F.pmod(state["l"] - mixed(new_right, key, 0, left), F.lit(left))
        else:
            new_left = (state["l"] + mixed(state["r"], key, 0, left)) % left
            new_right = (state["r"] + mixed(new_left, key, 1, right)) % right
        return F.struct(new_left.alias("l"), new_right.alias("r"))

    number = number.cast("long")
    start = F.struct(
        ((number - number % right) / right).cast("long").alias("l"), (number % right).alias("r")
    )
    return F.aggregate(keys, start, step, lambda s: s["l"] * F.lit(right).cast("long") + s["r"])


def _walk(number: Column, steps: int, count: int, seed: int, rounds: int) -> Column:
    if not steps:
        return number
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        number,
        lambda at, _: F.when(at < count, at).otherwise(_network(at, count, seed, rounds)),
    )


def walk_bound(spark: SparkSession, count: int, seed: int, rounds: int = ROUNDS) -> int:
    """Steps after which every walk that left [0, count) is back inside.

    The cover exceeds ``count`` by less than about its square root, so trying every outside
    number that a number inside leads to is a small distributed job, and the bound is
    proven, not assumed. Such a walk always ends, since its cycle holds the start.
    """
    left, right = radices(count)
    if left * right == count:
        return 0
    entered = spark.range(count, left * right).filter(
        _network(F.col("id"), count, seed, rounds, inverse=True) < count
    )
    steps = 4
    while True:
        walked = _walk(F.col("id"), steps, count, seed, rounds)
        if entered.filter(walked >= count).isEmpty():
            return steps
        steps *= 2


def permuted(
    spark: SparkSession, number: Column, count: int, seed: int, rounds: int = ROUNDS
) -> Column:
    """A seeded bijection of [0, count): Feistel rounds, then cycle walking."""
    steps = walk_bound(spark, count, seed, rounds)
    return _walk(_network(number, count, seed, rounds), steps, count, seed, rounds)


def shard_rows(
    rows: DataFrame, key: str, tie: list[str], shards: int, seed: int = 1, rounds: int = ROUNDS
) -> DataFrame:
    """``rows`` with ``row_number``, ``shard`` and ``slot``.

    Shard sizes differ by one row at most and slots of a shard run from 0 without
    gaps, whatever the keys: a hot, repeated or NULL key changes nothing. An empty
    table gives an empty result. Columns named like the results are replaced.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    rows = rows.drop("row_number", "shard", "slot")
    count = rows.count()
    numbered = number_rows(rows, key, tie)
    place = permuted(rows.sparkSession, F.col("row_number"), count, seed, rounds)
    return (
        numbered.withColumn("__at", place)
        .withColumn("shard", (F.col("__at") % shards).cast("int"))
        .withColumn("slot", ((F.col("__at") - F.col("__at") % shards) / shards).cast("long"))
        .drop("__at")
    )


def op1_sharding(documents: DataFrame, shards: int = 8, seed: int = 1) -> DataFrame:
    """The sharding digest of ``documents``: law ``rows``, so no grown shard."""
    text = F.coalesce("text", F.lit(""))
    narrow = documents.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
    )
    return shard_rows(narrow, "doc_id", ["text_crc32", "size"], shards, seed).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )
