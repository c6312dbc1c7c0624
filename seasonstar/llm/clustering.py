"""Centroid clustering in exact integers, with heap-ordered bounds.

Components become integers, so sums, means and squared distances do not depend on task order. The
vectors are kept in blocks, each with its state: of every vector its centroid, and for every
centroid a heap of its vectors by the gap between a lower bound of the distance to the second
nearest centroid and an upper bound of the distance to its own. A round moves the centroids; the
gap of a vector shrinks at most by how far its own centroid moved and how far any other one did.
These drifts are added up per centroid, and a gap is pushed with the drift of that time on top, so
nothing in a heap has to be touched: the vectors whose gap has expired are those on top of a heap
with a key no larger than the drift. Only they are popped and compared with all centroids, exactly.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonstar.llm.common import sent_by_value, written

sent_by_value(__name__)

CENTROIDS, ROUNDS, WIDTH = 16, 3, 64
#: Integer components are floor(SCALE * x).
SCALE = 64
#: Vectors of a block at most.
BLOCK_ROWS = 8192
#: Bounds are rounded outwards by this share, far above the error of a square root.
MARGIN = 1e-12
#: Sums are handed on as signed digits of so many bits.
LIMB = 40
LONGEST = (1 << 63) - 1

STATE = (
    "ids array<bigint>, vectors binary, kind string, clusters binary, heap_keys array<binary>,"
    " heap_rows array<binary>, counts array<bigint>,"
    " sums array<struct<cluster:int,place:int,limb:int,value:bigint>>, rescanned bigint"
)


def _safe(width: int) -> int:
    """Components up to this give squared distances that doubles hold exactly."""
    return math.isqrt((1 << 53) // (4 * width))


def to_integers(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of doubles: as doubles where all are small, else as Python integers."""
    if not vectors.size or np.abs(vectors).max() * SCALE < _safe(vectors.shape[1]):
        return np.floor(vectors * SCALE)
    exact = [
        [int(x) * SCALE if abs(x) >= 2.0**60 else math.floor(x * SCALE) for x in row]
        for row in vectors.tolist()
    ]
    return np.array(exact, dtype=object)


def squared_distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, a column per centroid."""
    if vectors.dtype != object and centroids.dtype != object:
        own, other = (vectors * vectors).sum(axis=1), (centroids * centroids).sum(axis=1)
        return own[:, None] - 2.0 * (vectors @ centroids.T) + other
    exact = _integers(vectors)
    return np.stack([((exact - c) ** 2).sum(axis=1) for c in _integers(centroids)], axis=1)


def own_distances(vectors: np.ndarray, clusters: np.ndarray, centroids: np.ndarray) -> list[int]:
    """Squared distance of every vector to its own centroid."""
    if vectors.dtype == object or centroids.dtype == object:
        vectors, centroids = _integers(vectors), _integers(centroids)
    return [int(x) for x in ((vectors - centroids[clusters]) ** 2).sum(axis=1)]


def _integers(values: np.ndarray) -> np.ndarray:
    if values.dtype == object:
        return values
    return np.array([[int(x) for x in row] for row in values.tolist()], dtype=object)


def _matrix(rows: list[list[int]]) -> np.ndarray:
    """Centroids as doubles if all components are small, else as Python integers."""
    if max((abs(x) for row in rows for x in row), default=0) < _safe(len(rows[0])):
        return np.array(rows, dtype=np.float64)
    return np.array(rows, dtype=object)


@dataclass
class Block:
    """Some vectors and the state of their assignment."""

    ids: list
    vectors: np.ndarray
    clusters: np.ndarray
    heaps: list[list[tuple[float, int]]]
    counts: list[int]
    sums: np.ndarray
    rescanned: int = field(default=0)

    @classmethod
    def new(cls, ids: list, vectors: np.ndarray, centroids: int) -> Block:
        sums = np.zeros((centroids, vectors.shape[1]), dtype=object)
        start = np.full(len(ids), -1, dtype=np.int32)
        return cls(ids, vectors, start, [[] for _ in range(centroids)], [0] * centroids, sums)

    def assign(self, centroids: np.ndarray, drift: list[float]) -> None:
        """Pop the vectors whose gap has expired and rescan them; at first, scan all."""
        if len(self.clusters) and self.clusters[0] < 0:
            expired = list(range(len(self.clusters)))
        else:
            expired = []
            for heap, moved in zip(self.heaps, drift, strict=True):
                while heap and heap[0][0] <= moved:
                    expired.append(heapq.heappop(heap)[1])
        self.rescanned = len(expired)
        if not expired:
            return
        rows = np.array(sorted(expired))
        vectors = self.vectors[rows]
        distances = squared_distances(vectors, centroids)
        nearest = distances.argmin(axis=1).astype(np.int32)
        for row, cluster, gap in zip(
            rows.tolist(), nearest.tolist(), _gaps(distances, nearest), strict=True
        ):
            # beyond doubles every key has expired, whatever it is
            key = gap + drift[cluster] if math.isfinite(drift[cluster]) else gap
            heapq.heappush(self.heaps[cluster], (key, row))
        before = self.clusters[rows]
        for cluster in range(len(self.heaps)):
            for sign, there in ((-1, before == cluster), (1, nearest == cluster)):
                changed = there & (before != nearest)
                if changed.any():
                    self.counts[cluster] += sign * int(changed.sum())
                    total = vectors[changed].sum(axis=0)
                    self.sums[cluster] += sign * np.array([int(x) for x in total], dtype=object)
        self.clusters[rows] = nearest


def _gaps(distances: np.ndarray, nearest: np.ndarray) -> list[float]:
    """Lower bound of the second distance less upper bound of the first, for every row.

    Minus infinity, which is always expired, where a distance is too large for a double.
    """
    count = distances.shape[1]
    if count == 1:
        return [math.inf] * len(nearest)
    first = distances[np.arange(len(nearest)), nearest]
    rest = distances.copy()
    rest[np.arange(len(nearest)), nearest] = rest[np.arange(len(nearest)), (nearest + 1) % count]
    second = rest.min(axis=1)

    def gap(near: float, far: float) -> float:
        try:
            return math.sqrt(far) * (1 - MARGIN) - math.sqrt(near) * (1 + MARGIN)
        except OverflowError:
            return -math.inf

    return [gap(a, b) for a, b in zip(first.tolist(), second.tolist(), strict=True)]


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    place = 0
    while value:
        if abs(value) >> LIMB:
            yield place, value & ((1 << LIMB) - 1)
            value >>= LIMB
        else:
            yield place, value
            value = 0
        place += 1


def _packed(block: Block) -> dict:
    """A block as a row of STATE: components in the narrowest integers that hold them."""
    if block.vectors.dtype == object:
        kind, data = "text", " ".join(str(x) for x in block.vectors.ravel()).encode()
    else:
        most = np.abs(block.vectors).max()
        kind = "i1" if most < 128 else "i2" if most < 1 << 15 else "i4"
        data = block.vectors.astype(f"<{kind}").tobytes()
    sums = [
        {"cluster": c, "place": i, "limb": limb, "value": value}
        for (c, i), total in np.ndenumerate(block.sums)
        for limb, value in _limbs(total)
    ]
    return {
        "ids": block.ids,
        "vectors": data,
        "kind": kind,
        "clusters": block.clusters.astype("<i4").tobytes(),
        "heap_keys": [np.array([k for k, _ in h], "<f8").tobytes() for h in block.heaps],
        "heap_rows": [np.array([r for _, r in h], "<i4").tobytes() for h in block.heaps],
        "counts": block.counts,
        "sums": sums,
        "rescanned": block.rescanned,
    }


def _vectors(row: dict, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of a block and the numbers of their centroids."""
    if row["kind"] == "text":
        flat = np.array([int(x) for x in row["vectors"].split()], dtype=object)
    else:
        flat = np.frombuffer(row["vectors"], f"<{row['kind']}").astype(np.float64)
    return flat.reshape(-1, width), np.frombuffer(row["clusters"], "<i4").copy()


def _unpacked(row: dict, width: int) -> Block:
    vectors, clusters = _vectors(row, width)
    heaps = [
        list(zip(np.frombuffer(k, "<f8").tolist(), np.frombuffer(r, "<i4").tolist(), strict=True))
        for k, r in zip(row["heap_keys"], row["heap_rows"], strict=True)
    ]
    sums = np.zeros((len(heaps), width), dtype=object)
    for x in row["sums"]:
        sums[x["cluster"], x["place"]] += x["value"] << (LIMB * x["limb"])
    return Block(row["ids"], vectors, clusters, heaps, row["counts"], sums)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _cut(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[list, np.ndarray]]:
    """Ids and integer vectors, BLOCK_ROWS at most at a time; small and large components apart."""
    waiting: dict[bool, tuple[list, list]] = {False: ([], []), True: ([], [])}

    def done(large: bool) -> tuple[list, np.ndarray]:
        ids, parts = waiting[large]
        waiting[large] = ([], [])
        return ids, to_integers(np.vstack(parts))

    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(start, BLOCK_ROWS)
            values = part.column("vector").flatten().to_numpy(zero_copy_only=False)
            vectors = values.astype(np.float64).reshape(-1, width)
            with np.errstate(over="ignore"):
                is_large = np.abs(vectors).max(axis=1) * SCALE >= _safe(width)
            ids = part.column("vec_id").to_pylist()
            for large in (False, True):
                chosen = np.flatnonzero(is_large == large)
                if not len(chosen):
                    continue
                if waiting[large][0] and len(waiting[large][0]) + len(chosen) > BLOCK_ROWS:
                    yield done(large)
                waiting[large][0].extend(ids[i] for i in chosen)
                waiting[large][1].append(vectors[chosen])
    for large in (False, True):
        if waiting[large][0]:
            yield done(large)


def usable(vectors: DataFrame, width: int = WIDTH) -> DataFrame:
    """``vec_id`` and ``vector`` of the rows with ``width`` components, all of them finite."""
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall(
        vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))
    )
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
    kept = F.when(F.size(vector) == width, finite)
    return rows.filter(F.coalesce(kept, F.lit(False)))


def first_centroids(kept: DataFrame, count: int) -> list[list[int]]:
    """The vectors with the smallest hashes of their ids; a NULL id counts as an empty one."""
    text = F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    order = F.sha2(F.encode(text, "utf-8"), 256)
    rows = kept.orderBy(order, "vector").limit(count).select("vector").collect()
    return [[int(x) for x in to_integers(np.array([r["vector"]]))[0]] for r in rows]


@dataclass(frozen=True)
class Clustering:
    """``rows`` has vec_id, cluster and distance; what follows is per cluster."""

    rows: DataFrame
    centroids: list[list[int]]
    inertia: list[int | None]
    rescanned: list[int]


def cluster(
    vectors: DataFrame,
    centroids: int = CENTROIDS,
    rounds: int = ROUNDS,
    width: int = WIDTH,
) -> Clustering:
    """Assign every vector of ``width`` finite components to the nearest of ``centroids``.

    ``vectors`` has ``vec_id`` and ``embedding``; other columns are ignored. A round assigns all
    vectors, ties to the smaller number, and moves every centroid that has some to their mean,
    rounded down; after the rounds vectors are assigned once more. Vectors that are NULL, of another
    length, or hold NULL, NaN or an infinity get no row. Repeated rows and ids count, and are
    returned, as often as they occur. With fewer vectors than ``centroids`` every one is a centroid.
    Squared distances from 2 ** 63 up, and sums that hold one or reach that, are NULL.

    The state is a written table per assignment: a row per block of BLOCK_ROWS vectors at most. No
    vector is shuffled; per block go its sums, aggregated before the driver, which gets ``centroids``
    times ``width`` sums in a few digits each.
    """
    kept = usable(vectors, width)
    start = first_centroids(kept, centroids)
    spark = vectors.sparkSession
    result = "vec_id bigint, cluster int, distance bigint"
    if not start:
        return Clustering(spark.createDataFrame([], result), [], [], [])
    count = len(start)
    drift = [0.0] * count
    current, rescanned = start, []
    arrow = _arrow_state()

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = _matrix(start)
        for ids, vectors_of in _cut(batches, width):
            block = Block.new(ids, vectors_of, count)
            block.assign(matrix, [0.0] * count)
            yield _batch([_packed(block)], arrow)

    state = written(kept.mapInArrow(begin, STATE), "clustering")
    for _ in range(rounds):
        rescanned.append(state.agg(F.sum("rescanned")).first()[0])
        moved = _means(state, current)
        drift = _drifted(drift, current, moved)
        current = moved

        def step(
            batches: Iterator[pa.RecordBatch], now: list = current, by: list = drift
        ) -> Iterator[pa.RecordBatch]:
            matrix = _matrix(now)
            for row in _rows(batches):
                block = _unpacked(row, width)
                block.assign(matrix, by)
                yield _batch([_packed(block)], arrow)

        state = written(state.mapInArrow(step, STATE), "clustering")
    rescanned.append(state.agg(F.sum("rescanned")).first()[0])

    def finish(batches: Iterator[pa.RecordBatch], now: list = current) -> Iterator[pa.RecordBatch]:
        matrix = _matrix(now)
        for row in _rows(batches):
            vectors_of, clusters = _vectors(row, width)
            exact = own_distances(vectors_of, clusters, matrix)
            far = [d if d <= LONGEST else None for d in exact]
            columns = [
                pa.array(row["ids"], pa.int64()),
                pa.array(clusters, pa.int32()),
                pa.array(far, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    needed = state.select("ids", "vectors", "kind", "clusters")
    rows = written(needed.mapInArrow(finish, result), "clustered")
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = rows.groupBy("cluster").agg(
        total.alias("inertia"), F.count_if(F.col("distance").isNull()).alias("unknown")
    )
    inertia: list[int | None] = [0] * count
    for number, value, unknown in sums.collect():
        inertia[number] = None if unknown or value > LONGEST else int(value)
    return Clustering(rows, current, inertia, rescanned)


def _arrow_state() -> pa.Schema:
    digit = pa.struct(
        [("cluster", pa.int32()), ("place", pa.int32()), ("limb", pa.int32()), ("value", pa.int64())]
    )
    return pa.schema(
        [
            ("ids", pa.list_(pa.int64())),
            ("vectors", pa.binary()),
            ("kind", pa.string()),
            ("clusters", pa.binary()),
            ("heap_keys", pa.list_(pa.binary())),
            ("heap_rows", pa.list_(pa.binary())),
            ("counts", pa.list_(pa.int64())),
            ("sums", pa.list_(digit)),
            ("rescanned", pa.int64()),
        ]
    )


def _means(state: DataFrame, before: list[list[int]]) -> list[list[int]]:
    """Means of the clusters, rounded down; an empty one keeps its centroid."""
    big = "decimal(20,0)"
    digits = state.select(F.explode("sums").alias("x")).select("x.*")
    sums = digits.groupBy("cluster", "place", "limb").agg(F.sum(F.col("value").cast(big)))
    totals = [[0] * len(row) for row in before]
    for number, place, limb, value in sums.collect():
        totals[number][place] += int(value) << (LIMB * limb)
    sizes = state.select(F.posexplode("counts").alias("cluster", "n"))
    counts = dict(sizes.groupBy("cluster").agg(F.sum(F.col("n").cast(big))).collect())
    return [
        [x // int(counts[i]) for x in total] if counts.get(i) else before[i]
        for i, total in enumerate(totals)
    ]


def _drifted(
    drift: list[float], before: list[list[int]], after: list[list[int]]
) -> list[float]:
    """Drift of every cluster: how far its own centroid moved, and how far any other one did."""

    def length(a: list[int], b: list[int]) -> float:
        try:
            return math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b, strict=True))) * (1 + MARGIN)
        except OverflowError:
            return math.inf

    moves = [length(a, b) for a, b in zip(before, after, strict=True)]
    others = [max([0.0, *moves[:i], *moves[i + 1 :]]) for i in range(len(moves))]
    return [
        (d + own + other) * (1 + MARGIN)
        for d, own, other in zip(drift, moves, others, strict=True)
    ]


def op11_clustering(embeddings: DataFrame) -> DataFrame:
    """Digest of the clustering of all vectors of 64 components; see ``cluster``."""
    done = cluster(embeddings)
    hashes = [
        hashlib.sha256(",".join(str(x) for x in row).encode()).hexdigest() for row in done.centroids
    ]
    whole = None if None in done.inertia else sum(done.inertia)
    whole = whole if whole is None or whole <= LONGEST else None

    def of_cluster(values: list, kind: str):
        return F.get(F.array(*[F.lit(x) for x in values]).cast(f"array<{kind}>"), F.col("cluster"))

    return done.rows.select(
        "vec_id",
        "cluster",
        "distance",
        of_cluster(done.inertia, "bigint").alias("cluster_inertia"),
        F.lit(whole).cast("bigint").alias("inertia"),
        of_cluster(hashes, "string").alias("centroid_sha256"),
    )
