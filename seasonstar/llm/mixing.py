"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Blocks of ``block_words`` words are seats. Sources get seats by the highest quotients
target / (2 s + 1); the seats of a source beyond whole passes over it are dealt to its
shards, again by highest quotients. In each shard the documents stand in a seeded order,
and the words of the first blocks of that order are taken once more than the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasonstar.llm.common import WORD, written

#: Words of a block.
BLOCK_WORDS = 32
#: Shards per source, the unit of the seeded order; more for more documents.
SHARDS = 64
ROWS_PER_SHARD = 1_000_000
MAX_PASSES = 3


def _over(keys: list[str]):
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def apportion(parties: DataFrame, name: str, size: str, seats: Column, keys: list[str]) -> DataFrame:
    """``parties`` with ``seats``: Sainte-Lague within each group of ``keys``.

    The seat count ``seats`` is the same for all rows of a group. With V the sum of sizes,
    S parties and N seats, dividing by V / (N - S / 2) gives at most N seats and by
    V / (N + S / 2) at least N, so only the quotients between the two, 2 S at most, have
    to be ranked. Ties go to the smaller ``name``, NULL last. Parties of size 0 get none.
    """
    group = _over(keys)
    count = F.sum(F.when(F.col(size) > 0, 1).otherwise(0)).over(group)
    share = F.col(size) / F.sum(F.col(size).cast("double")).over(group)
    rounded = lambda x: F.floor(x + 0.5).cast("long")
    low = F.when(F.col("__n") > F.col("__s") / 2, rounded(share * (F.col("__n") - F.col("__s") / 2)))
    bounded = (
        parties.withColumn("__n", seats.cast("double"))
        .withColumn("__s", count)
        .withColumn("__low", F.when(F.col(size) > 0, F.coalesce(low, F.lit(0))).otherwise(0))
        .withColumn(
            "__high",
            F.when(
                F.col(size) > 0, rounded(share * (F.col("__n") + F.col("__s") / 2)) + 1
            ).otherwise(0),
        )
        .withColumn("__left", F.col("__n") - F.sum("__low").over(group))
    )
    quotients = bounded.withColumn(
        "__seat",
        F.explode_outer(
            F.when(
                F.col("__high") > F.col("__low"),
                F.sequence(F.col("__low"), F.col("__high") - 1),
            )
        ),
    ).withColumn("__quotient", F.col(size) / (2 * F.col("__seat") + 1))
    order = group.orderBy(
        F.desc_nulls_last("__quotient"), F.asc_nulls_last(name), F.asc("__seat")
    )
    won = F.when(
        F.col("__seat").isNotNull() & (F.row_number().over(order) <= F.col("__left")), 1
    ).otherwise(0)
    kept = [c for c in parties.columns]
    return (
        quotients.withColumn("__won", won)
        .groupBy(*kept, "__low")
        .agg(F.sum("__won").alias("__won"))
        .withColumn("seats", F.col("__low") + F.col("__won"))
        .select(*kept, "seats")
    )


def targets(sources: DataFrame, size: str, weight: Column, most: float = MAX_PASSES) -> DataFrame:
    """``sources`` with ``target``: all words shared by weight, no more than ``most`` sizes each.

    Sharing the excess over a cap again and again ends at one level per unit of weight; the
    capped sources are those whose cap per weight lies below the level of all sources after
    them, so cumulated sums in that order give the end of the process at once.
    """
    everyone = _over([])
    by_cap = Window.partitionBy(F.lit(0)).orderBy("__ratio", "__rank")
    upto = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(0, Window.unboundedFollowing)
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("source")))
    ranked = (
        sources.withColumn("__rank", rank)
        .withColumn("__weight", weight)
        .withColumn("__cap", most * F.col(size).cast("double"))
        .withColumn("__ratio", F.col("__cap") / F.col("__weight"))
        .withColumn("__all", F.sum(F.col(size).cast("double")).over(everyone))
        .withColumn(
            "__level",
            (F.col("__all") - F.coalesce(F.sum("__cap").over(upto), F.lit(0.0)))
            / F.sum("__weight").over(onward),
        )
        .withColumn("__open", F.col("__level") <= F.col("__ratio"))
    )
    level = F.min(F.when(F.col("__open"), F.struct("__ratio", "__rank", "__level"))).over(everyone)
    return (
        ranked.withColumn("__final", level["__level"])
        .withColumn(
            "target",
            F.coalesce(
                F.least("__cap", F.col("__weight") * F.col("__final")), F.col("__cap")
            ),
        )
        .drop("__rank", "__weight", "__cap", "__ratio", "__all", "__level", "__open", "__final")
    )


def mix(
    documents: DataFrame,
    seed: int = 1,
    block_words: int = BLOCK_WORDS,
    shards: int = SHARDS,
    rows_per_shard: int = ROWS_PER_SHARD,
) -> DataFrame:
    """Per row of ``documents``: doc_id, source, size, source_size, target, ``taken`` words, and
    ``row_hash``, which is equal for rows that are interchangeable.

    Weights are 1, 2, 3 and again, by the code point order of sources, NULL last. A NULL or
    empty text has size 0 and nothing is taken of it. Documents stand in a shard by a seeded
    hash of doc_id, source and text, so reruns agree and rows equal in all of them are
    interchangeable. A hot source is spread over all shards. Other columns are ignored, and an
    empty table gives an empty result.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = written(
        documents.select(
            "doc_id",
            "source",
            size.alias("size"),
            row_hash(seed).alias("__order"),
        ),
        "mix-sizes",
    )
    shards = max(shards, -(-sized.count() // rows_per_shard))
    sized = sized.withColumn("__shard", F.pmod("__order", F.lit(shards)).cast("int"))
    cells = sized.groupBy("source", "__shard").agg(F.sum("size").alias("__cell"))
    sources = cells.groupBy("source").agg(F.sum("__cell").alias("source_size"))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("source")))
    weight = ((rank - 1) % 3 + 1).cast("double")
    aimed = targets(sources, "source_size", weight)
    total = F.round(F.sum("target").over(_over([])) / block_words)
    quota = (
        apportion(aimed, "source", "target", total, [])
        .withColumn(
            "__words",
            F.least(
                F.col("seats") * block_words, F.col("source_size") * MAX_PASSES
            ),
        )
        .withColumn(
            "__passes",
            F.when(
                F.col("source_size") > 0,
                (F.col("__words") - F.col("__words") % F.col("source_size"))
                / F.col("source_size"),
            )
            .otherwise(0)
            .cast("long"),
        )
        .withColumn(
            "__blocks",
            F.round((F.col("__words") - F.col("__passes") * F.col("source_size")) / block_words),
        )
        .select("source", "source_size", "target", "__passes", "__blocks")
        .withColumnRenamed("source", "__source")
    )
    dealt = apportion(
        cells.join(quota, F.col("source").eqNullSafe(F.col("__source"))).drop("__source"),
        "__shard",
        "__cell",
        F.col("__blocks"),
        ["source"],
    ).select(
        F.col("source").alias("__source"),
        F.col("__shard").alias("__place"),
        "source_size",
        "target",
        "__passes",
        (F.col("seats") * block_words).alias("__first"),
    )
    order = Window.partitionBy("source", "__shard").orderBy("__order", "doc_id", "size")
    before = F.coalesce(
        F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    placed = sized.withColumn("__before", before)
    same = F.col("source").eqNullSafe(F.col("__source")) & (F.col("__shard") == F.col("__place"))
    once_more = F.greatest(
        F.lit(0), F.least(F.col("size"), F.col("__first") - F.col("__before"))
    )
    return placed.join(dealt, same).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("__passes") * F.col("size") + once_more).cast("long").alias("taken"),
        F.col("__order").alias("row_hash"),
    )


def row_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "doc_id", "source", "text")


def repeat_to_mix(documents: DataFrame, seed: int = 1) -> DataFrame:
    """``documents`` as often as the mix takes them, rounded to whole documents.

    A document is repeated up to three times and left out where less than half of it is taken.
    The few that a block boundary cuts round both ways, so sources stay near their targets.
    Columns are unchanged; interchangeable rows share their repetitions.
    """
    times = F.coalesce(F.round(F.try_divide("taken", "size")), F.lit(0)).cast("int")
    plan = (
        mix(documents, seed)
        .groupBy("row_hash")
        .agg(F.sum(times).alias("__times"))
        .filter(F.col("__times") > 0)
        .withColumnRenamed("row_hash", "__planned")
    )
    marked = documents.withColumn("__hash", row_hash(seed))
    chosen = marked.join(plan, F.col("__hash") == F.col("__planned")).dropDuplicates(["__hash"])
    repeated = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times")))
    return chosen.withColumn("__pass", repeated).select(*documents.columns)


def op8_mixing(documents: DataFrame) -> DataFrame:
    """The mix over all documents."""
    return mix(documents).select("doc_id", "size", "source_size", "target", "taken", "source")
