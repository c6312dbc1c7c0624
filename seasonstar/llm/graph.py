"""Connected components of an edge table, without any node's neighbours in one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonstar.llm.common import sent_by_value, written

sent_by_value(__name__)


def _hooked(pairs: DataFrame) -> DataFrame:
    """Every pair (u, v) with the smallest node that u is paired with."""
    least = pairs.groupBy("u").agg(F.min("v").alias("least"))
    return pairs.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node move to its smallest neighbour (or itself)."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    moved = _hooked(both).filter(F.col("v") > F.col("u"))
    return moved.select(F.col("v").alias("u"), F.least("least", "u").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of a node, and the node, move to its smallest neighbour."""
    hooked = _hooked(edges)
    moved = hooked.select(F.col("v").alias("u"), F.col("least").alias("v"))
    own = hooked.select("u", F.col("least").alias("v"))
    return moved.unionAll(own).filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it is connected to, for nodes other than roots.

    ``edges`` has columns ``u`` and ``v`` of one orderable type; loops, repeats and both
    directions may occur. Large and small stars alternate until every edge leads to a root,
    which takes about log2 squared of the nodes rounds at most and few in practice. Each round
    is a written table; sums over nodes are pre-aggregated, and a hot node only occurs as the
    small side of an equi-join, whose other side adaptive execution splits.
    """
    ordered = edges.filter(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    current = written(ordered.distinct(), "edges")
    state = _state(current)
    while state[0]:
        current = written(_small_star(_large_star(current)), "edges")
        after = _state(current)
        if after == state:
            break
        state = after
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _state(edges: DataFrame) -> tuple:
    """Count and an order-free checksum: equal for equal edge sets."""
    mixed = F.xxhash64("u", "v")
    return tuple(
        edges.agg(
            F.count(F.lit(1)), F.bit_xor(mixed), F.sum(F.pmod(mixed, F.lit(1 << 31)))
        ).first()
    )


def roots_of(count: int, pairs: np.ndarray) -> np.ndarray:
    """The smallest place that each of ``count`` places is connected to by ``pairs``."""
    root = np.arange(count)
    while len(pairs):
        low = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
        after = root.copy()
        for side in (0, 1):
            np.minimum.at(after, pairs[:, side], low)
            np.minimum.at(after, root[pairs[:, side]], low)
        after = after[after]
        if (after == root).all():
            break
        root = after
    return root
