"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Rotations that balance binary codes are learned on a bounded sample. Every vector is coded; the
substrings of its code are the keys of as many tables. Vectors that share a key and whose
whole codes are near are joined to clusters, and within clusters all pairs are compared by
their original vectors in double precision.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasonstar.llm.common import sent_by_value, written
from seasonstar.llm.graph import components, roots_of

sent_by_value(__name__)

THRESHOLD = 0.95
#: Vectors that rotations are learned on, in expectation.
SAMPLE = 4096
ITERATIONS = 20
MOST_BITS = 128
#: Share of simulated pairs at the threshold that the tables have to bring together; tables
#: are added until then, up to the last number, and keys shortened if that is not enough.
FOUND, MOST_TABLES = 0.995, 256
#: The radius holds this share of simulated pairs at the threshold.
INSIDE = 0.9999
#: Rows of a bucket and of a cluster that are compared at a time.
BUCKET_ROWS, BLOCK_ROWS = 512, 1024


@dataclass(frozen=True)
class Coder:
    """Learned mean and projections, bits of a table's key, tables, and the Hamming radius."""

    mean: np.ndarray
    projection: np.ndarray
    key_bits: int
    tables: int
    radius: int

    def bits(self, vectors: np.ndarray) -> np.ndarray:
        unit = _unit(vectors)
        return (unit - self.mean) @ self.projection > 0

    def keys(self, bits: np.ndarray) -> np.ndarray:
        """The key of each vector in each table."""
        weight = 1 << np.arange(self.key_bits, dtype=np.int64)
        cut = bits[:, : self.tables * self.key_bits].reshape(len(bits), self.tables, self.key_bits)
        return cut.astype(np.int64) @ weight


def _unit(vectors: np.ndarray) -> np.ndarray:
    """By the largest component first: the square of a tiny or a huge one is no double."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _rotation(projected: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Iterative quantisation: the rotation that brings the rows near to their signs."""
    rotation = np.linalg.qr(random.standard_normal((projected.shape[1],) * 2))[0]
    for _ in range(ITERATIONS):
        signs = np.sign(projected @ rotation)
        left, _, right = np.linalg.svd(projected.T @ signs)
        rotation = left @ right
    return rotation


def learn(sample: np.ndarray, count: int, threshold: float = THRESHOLD, seed: int = 1) -> Coder:
    """Codes for about ``count`` vectors: keys as long as a bucket of one vector asks for, shorter
    if MOST_TABLES of them bring too few pairs together.

    How many tables that takes, and the radius, come from simulated partners of the sample at
    exactly the threshold. Each rotation starts from another random one.
    """
    random = np.random.default_rng(seed)
    unit = _unit(sample)
    mean = unit.mean(axis=0)
    noise = random.standard_normal(unit.shape)
    noise -= (noise * unit).sum(axis=1, keepdims=True) * unit
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
    partner = threshold * unit + np.sqrt(max(0.0, 1 - threshold**2)) * noise
    axes = np.linalg.svd(unit - mean, full_matrices=False)[2][:MOST_BITS].T
    key_bits = min(60, max(8, ceil(log2(max(count, 2)))))
    projections: list[np.ndarray] = []
    while True:
        projections.append(axes @ _rotation((unit - mean) @ axes, random))
        projection = np.hstack(projections)
        one, two = (unit - mean) @ projection > 0, (partner - mean) @ projection > 0
        tables = min(MOST_TABLES, projection.shape[1] // key_bits)
        if not tables:
            continue
        same = (one == two)[:, : tables * key_bits].reshape(len(one), tables, key_bits).all(axis=2)
        found = np.maximum.accumulate(same, axis=1).mean(axis=0)
        if found[-1] >= FOUND or tables == MOST_TABLES:
            tables = min(tables, int(np.argmax(found >= FOUND)) + 1) if found[-1] >= FOUND else tables
            break
    while found[-1] < FOUND and key_bits:
        key_bits -= 1
        tables = tables if key_bits else 1  # one cell of all vectors, as for a sample of one
        same = (one == two)[:, : tables * key_bits].reshape(len(one), tables, key_bits).all(axis=2)
        found = np.maximum.accumulate(same, axis=1).mean(axis=0)
    if found[-1] < FOUND:
        raise ValueError(f"{tables} tables bring together {found[-1]:.4f} of the pairs at {threshold}")
    projection = projection[:, : max(tables * key_bits, 256)]
    distance = (one != two)[:, : projection.shape[1]].sum(axis=1)
    radius = int(np.quantile(distance, INSIDE)) + 1
    return Coder(mean, projection, key_bits, tables, radius)


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of doubles, shorter ones filled up with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(lists), width))
    rows = np.repeat(np.arange(len(lists)), sizes)
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    out[rows, np.arange(len(values)) - np.repeat(starts, sizes)] = values
    return out


def _is_vector(column: str) -> Column:
    bad = F.exists(
        column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    )
    some = F.exists(column, lambda x: x != 0)
    return F.coalesce(~bad & some, F.lit(False))


def _coded(classes: DataFrame, coder: Coder, width: int) -> DataFrame:
    """A row per class and table: the table's key there, and the whole code."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bits = coder.bits(_matrix(batch.column("vector"), width))
            keys = coder.keys(bits)
            cells = keys * coder.tables + np.arange(coder.tables)
            packed = np.packbits(bits, axis=1)
            codes = pa.array([row.tobytes() for row in packed], pa.binary())
            rows = pa.array(np.repeat(np.arange(batch.num_rows), coder.tables))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells.ravel()), batch.column("key").take(rows), codes.take(rows)],
                ["cell", "key", "code"],
            )

    rows = classes.select("key", "vector")
    return rows.mapInArrow(code, "cell long, key binary, code binary")


def _near(cells: DataFrame, radius: int) -> DataFrame:
    """Edges that connect, within each cell, the classes whose codes are within ``radius``.

    Cells come sorted, and neighbours at growing distance in that order are compared while they
    are in one cell. No more edges than rows are returned.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            place = table.column("cell").to_numpy()
            whole = int(np.searchsorted(place, place[-1])) if len(place) else 0
            if whole:
                yield from edges(table.slice(0, whole))
            rest = table.slice(whole)
        if rest is not None and rest.num_rows:
            yield from edges(rest)

    def edges(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cell = table.column("cell").to_numpy()
        keys = table.column("key").combine_chunks()
        packed = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8)
        codes = packed.reshape(len(cell), -1)
        pairs, left = [], np.arange(len(cell))
        for step in range(1, len(cell)):
            left = left[left + step < len(cell)]
            left = left[cell[left] == cell[left + step]]
            if not len(left):
                break
            apart = np.bitwise_count(codes[left] ^ codes[left + step]).sum(axis=1)
            hit = left[apart <= radius]
            pairs.append(np.stack([hit, hit + step], axis=1))
        if pairs:
            root = roots_of(len(cell), np.concatenate(pairs))
            moved = np.flatnonzero(root != np.arange(len(cell)))
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(moved)), keys.take(pa.array(root[moved]))], ["u", "v"]
            )

    dealt = cells.select("cell", "key", "code").repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(compare, "u binary, v binary").distinct()


def _in_blocks(rows: DataFrame, group: str, size: int, cell: str | None = None) -> DataFrame:
    """Rows of a large group cut into blocks, each row once for every block it has to meet."""
    whole = Window.partitionBy(group)
    numbered = (
        rows.withColumn("block", F.floor((F.row_number().over(whole.orderBy("key")) - 1) / size))
        .withColumn("last", F.max("block").over(whole))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
        .withColumn("low", F.least("block", "other"))
        .withColumn("high", F.greatest("block", "other"))
    )
    if cell:
        numbered = numbered.withColumn(
            cell,
            F.when(F.col("last") == 0, F.col(cell)).otherwise(F.xxhash64(cell, "low", "high")),
        )
    return numbered


def _compared(blocks: DataFrame, threshold: float, width: int) -> DataFrame:
    """Links within each pair of blocks: per linked class the vectors it is linked to there and
    the first class of its connected part. Nothing is returned for each pair."""

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        keys = table.column("key").to_pylist()
        block = table.column("block").to_numpy()
        copies = table.column("copies").to_numpy()
        sizes = np.diff(table.column("vector").combine_chunks().offsets.to_numpy())
        vectors = _matrix(table.column("vector"), width)
        vectors /= np.abs(vectors).max(axis=1, keepdims=True)
        norms = np.sqrt((vectors**2).sum(axis=1))
        low = np.flatnonzero(block == table.column("low")[0].as_py())
        high = np.flatnonzero(block == table.column("high")[0].as_py())
        cosine = (vectors[low] @ vectors[high].T) / np.outer(norms[low], norms[high])
        one, two = np.nonzero((cosine >= threshold) & (sizes[low][:, None] == sizes[high]))
        pairs = np.stack([low[one], high[two]], axis=1)
        same = len(low) == len(high) and (low == high).all()
        pairs = pairs[pairs[:, 0] < pairs[:, 1]] if same else pairs
        linked = np.zeros(len(keys), dtype=np.int64)
        np.add.at(linked, pairs[:, 0], copies[pairs[:, 1]])
        np.add.at(linked, pairs[:, 1], copies[pairs[:, 0]])
        root = roots_of(len(keys), pairs)
        used = np.flatnonzero(linked)
        return pa.table(
            {
                "key": pa.array([keys[i] for i in used], pa.binary()),
                "linked": pa.array(linked[used], pa.int64()),
                "first": pa.array([keys[root[i]] for i in used], pa.binary()),
            }
        )

    return blocks.groupBy("cluster", "low", "high").applyInArrow(
        compare, "key binary, linked long, first binary"
    )


def _keyed(vectors: DataFrame) -> DataFrame:
    """Digest of each vector's components: equal vectors are one class."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            ends = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False)
            keys = [
                hashlib.blake2b(values[ends[i] : ends[i + 1]].tobytes(), digest_size=16).digest()
                for i in range(len(lists))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), lists, pa.array(keys, pa.binary())],
                ["vec_id", "vector", "key"],
            )

    schema = vectors.select("vec_id", "vector").schema.add("key", "binary")
    return vectors.select("vec_id", "vector").mapInArrow(digest, schema)


def near_vectors(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    threshold: float = THRESHOLD,
    sample: int = SAMPLE,
) -> DataFrame:
    """Per row: vec_id, n_links, component_id and kept.

    Rows are linked when the cosine of their vectors is at least ``threshold``; a pair that the
    tables never bring into one cluster is missed, a pair below the threshold is never linked.
    ``component_id`` is the smallest id reachable by links. A vector that is NULL, zero, or has a
    NULL or non-finite component links with nothing, and so do vectors of different lengths.
    Equal vectors are handled once, however many; repeated rows count as other vectors. Other
    columns are ignored; an empty table gives an empty result.
    """
    rows = vectors.select(F.col(id_column).alias("vec_id"), F.col(vector_column).alias("vector"))
    valid = rows.filter(_is_vector("vector"))
    keyed = written(_keyed(valid).select("vec_id", "key", "vector"), "vectors-keyed")
    classes = written(
        keyed.groupBy("key").agg(
            F.min("vec_id").alias("vec_id"),
            F.count(F.lit(1)).alias("copies"),
            F.first("vector").alias("vector"),
        ),
        "vectors-classes",
    )
    count, width = classes.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    alone = rows.filter(~_is_vector("vector")).select(
        "vec_id",
        F.lit(0).cast("long").alias("n_links"),
        F.col("vec_id").alias("component_id"),
        F.lit(True).alias("kept"),
    )
    if not count:
        return alone
    scale = 1 << 30
    share = min(scale, sample * scale // count)
    chosen = classes.filter(F.pmod(F.xxhash64("key"), F.lit(scale)) < share).orderBy("key")
    picked = chosen.select("vector").toArrow().column("vector")
    if not len(picked):  # a few vectors, none of them chosen
        picked = classes.orderBy("key").limit(sample).select("vector").toArrow().column("vector")
    coder = learn(_matrix(picked, width), count, threshold)
    cells = _in_blocks(_coded(classes, coder, width), "cell", BUCKET_ROWS, "cell")
    clusters = components(written(_near(cells, coder.radius), "vectors-near"))
    members = (
        clusters.select(F.col("node").alias("key"), F.col("root").alias("cluster"))
        .unionAll(clusters.select(F.col("root").alias("key"), F.col("root").alias("cluster")))
        .distinct()
        .join(classes.select("key", "copies", "vector"), "key")
    )
    blocks = _in_blocks(members, "cluster", BLOCK_ROWS)
    links = written(
        _compared(
            blocks.select("cluster", "low", "high", "block", "key", "copies", "vector"),
            threshold,
            width,
        ),
        "vectors-links",
    )
    found = links.groupBy("key").agg(F.sum("linked").alias("linked"))
    joined = components(links.select(F.col("key").alias("u"), F.col("first").alias("v")))
    rooted = (
        classes.select("key", "vec_id", "copies")
        .join(found, "key", "left")
        .join(joined.withColumnRenamed("node", "key"), "key", "left")
        .withColumn("root", F.coalesce("root", "key"))
    )
    least = rooted.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    named = rooted.join(least, "root").select(
        "key",
        "component_id",
        (F.coalesce(F.col("linked"), F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    return (
        keyed.select("vec_id", "key")
        .join(named, "key")
        .select(
            "vec_id",
            "n_links",
            "component_id",
            (F.col("vec_id") == F.col("component_id")).alias("kept"),
        )
        .unionAll(alone)
    )


def op9_embeddings(embeddings: DataFrame) -> DataFrame:
    return near_vectors(embeddings)
