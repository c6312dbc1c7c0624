"""Near-duplicate join on the Jaccard similarity of word shingles, with Bayesian pruning.

Texts with the same shingle set are one class. Every class has one MinHash signature; classes
that agree in a whole band of it become candidates, and candidates connected that way a
cluster. Within a cluster pairs of classes compare their MinHash values block by block and
are dropped as soon as the posterior probability of reaching the threshold falls below a
tolerance. What is left is verified on the shingle sets themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasonstar.llm.common import lean, sent_by_value, written
from seasonstar.llm.graph import components, roots_of

sent_by_value(__name__)

SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: A pair is dropped when its probability of reaching the threshold is below this.
TOLERANCE = 1e-6
#: Bands and MinHash values in a band: a pair at 0.8 agrees in no band with probability 3e-6.
BANDS, ROWS = 42, 6
VALUES = BANDS * ROWS
#: MinHash values compared between two looks at the posterior.
STEP = 42
#: Texts of a cluster are compared in blocks of this many bytes; a short text counts as
#: 1 / BLOCK_ROWS of a block.
BLOCK_BYTES, BLOCK_ROWS = 8 << 20, 512
#: Bytes hashed, shingles hashed, and shingle columns multiplied at a time.
BYTES_AT_A_TIME, SHINGLES_AT_A_TIME, COLUMNS_AT_A_TIME = 1 << 16, 1 << 11, 1 << 12

_random = np.random.default_rng(20240501)
_BYTE = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _random.integers(0, 1 << 63, SHINGLE_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SCALE = _random.integers(0, 1 << 31, VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFT = _random.integers(0, 1 << 32, VALUES, dtype=np.uint32)
_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, count: int) -> np.ndarray:
    out = np.empty(count, dtype=np.uint64)
    out[0] = 1
    filled = 1
    while filled < count:
        more = min(filled, count - filled)
        step = np.uint64(pow(base, filled, 1 << 64))
        out[filled : filled + more] = out[:more] * step
        filled += more
    return out


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of a text, read in pieces of fixed size.

    A word's hash is a polynomial of its bytes, the difference of two running sums; a word that
    goes on in the next piece takes its sum and length there.
    """
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    found: list[np.ndarray] = []
    open_sum, open_size = 0, 0
    for at in range(0, len(data), BYTES_AT_A_TIME):
        piece = data[at : at + BYTES_AT_A_TIME]
        inside = ~_IS_SPACE[piece]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[piece] * _POWERS[: len(piece)], out=sums[1:])
        words = (sums[ends] - sums[starts]) * _INVERSE[starts]
        sizes = (ends - starts).astype(np.uint64)
        if open_size and len(starts) and starts[0] == 0:
            whole = open_sum + int(words[0]) * pow(_BASE, open_size, 1 << 64)
            words[0] = whole & _MASK
            sizes[0] += np.uint64(open_size)
            open_size = 0
        if open_size:
            found.append(_mixed(np.array([open_sum + open_size & _MASK], dtype=np.uint64)))
            open_size = 0
        if len(ends) and ends[-1] == len(piece):
            open_sum, open_size = int(words[-1]), int(sizes[-1])
            words, sizes = words[:-1], sizes[:-1]
        found.append(_mixed(words + sizes))
    if open_size:
        found.append(_mixed(np.array([open_sum + open_size & _MASK], dtype=np.uint64)))
    return np.concatenate(found) if found else np.empty(0, dtype=np.uint64)


#: Powers of the base, and of its inverse, for the places of a piece.
_POWERS = _powers(_BASE, BYTES_AT_A_TIME + 1)
_INVERSE = _powers(pow(_BASE, -1, 1 << 64), BYTES_AT_A_TIME + 1)


def shingles(text: str | None) -> np.ndarray:
    """The set of five-word shingles as sorted 64-bit hashes.

    A text of one to four words has one shingle, all of them; one without words has none.
    """
    words = word_hashes(text or "")
    if not len(words):
        return words
    size = min(SHINGLE_WORDS, len(words))
    count = len(words) - size + 1
    total = np.full(count, size, dtype=np.uint64)
    for i in range(size):
        total += words[i : i + count] * _PLACE[i]
    return np.unique(_mixed(total))


def signature(values: np.ndarray) -> np.ndarray:
    """MinHash values of a set, the low 16 bits of each."""
    short = (values & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    least = np.full(VALUES, 0xFFFFFFFF, dtype=np.uint32)
    for start in range(0, len(short), SHINGLES_AT_A_TIME):
        part = short[start : start + SHINGLES_AT_A_TIME, None]
        np.minimum(least, (part * _SCALE + _SHIFT).min(axis=0), out=least)
    return least.astype(np.uint16)


def fewest_matches(threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """After how many values, how many must agree for a pair to stay.

    With a uniform prior on the similarity, m matches of n give a posterior probability of
    reaching the threshold t that equals the chance of at most m successes in n + 1 trials of t.
    """
    looks = []
    for n in range(STEP, VALUES + 1, STEP):
        chance, m = 0.0, -1
        while chance < tolerance:
            m += 1
            chance += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        looks.append((n, m))
    return looks


def _signed(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, bytes, the digest of the shingle set (NULL: no word) and its signature."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, signatures = [], []
            for text in batch.column("text"):
                own = shingles(text.as_py())
                filled = len(own) > 0
                keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if filled else None)
                signatures.append(signature(own).tobytes() if filled else None)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(name) for name in ("doc_id", "text_hash", "bytes")),
                    pa.array(keys, pa.binary()),
                    pa.array(signatures, pa.binary()),
                ],
                ["doc_id", "text_hash", "bytes", "key", "signature"],
            )

    rows = documents.select(
        "doc_id",
        text_hash().alias("text_hash"),
        F.octet_length("text").cast("long").alias("bytes"),
        "text",
    )
    return rows.mapInArrow(
        lean(sign), "doc_id long, text_hash long, bytes long, key binary, signature binary"
    )


def text_hash() -> Column:
    """Tells rows with one doc_id and different texts apart."""
    return F.xxhash64("text")


def _row_name() -> list[Column]:
    """What a row is found by: doc_ids may be NULL, or have several texts."""
    own = F.coalesce("doc_id", F.lit(0)).alias("id")
    return [F.col("doc_id").isNull().alias("no_id"), own, F.col("text_hash")]


def _banded(classes: DataFrame) -> DataFrame:
    """A row per class and band: a hash of the band and its values, and the class's key."""

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = _random_odd(BANDS)
        for batch in batches:
            if not batch.num_rows:
                continue
            packed = b"".join(batch.column("signature").to_pylist())
            values = np.frombuffer(packed, np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
            mixed = np.broadcast_to(place, values.shape[:2]).copy()
            for i in range(ROWS):
                mixed = _mixed(mixed ^ values[:, :, i]) + np.uint64(i)
            keys = np.repeat(np.arange(batch.num_rows), BANDS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(mixed.ravel().view(np.int64)), batch.column("key").take(pa.array(keys))],
                ["band", "key"],
            )

    return classes.select("key", "signature").mapInArrow(lean(bands), "band long, key binary")


def _random_odd(count: int) -> np.ndarray:
    return _mixed(np.arange(1, count + 1, dtype=np.uint64))


def _surviving(one: np.ndarray, two: np.ndarray, looks: list[tuple[int, int]]) -> np.ndarray:
    """Pairs (row of ``one``, row of ``two``) that no look at the posterior drops."""
    n_first, needed = looks[0]
    matches = np.zeros((len(one), len(two)), dtype=np.int16)
    for i in range(n_first):
        matches += one[:, i][:, None] == two[:, i][None, :]
    left, right = np.nonzero(matches >= needed)
    found = matches[left, right].astype(np.int32)
    for (begin, _), (n, needed) in zip(looks, looks[1:], strict=False):
        found += (one[left, begin:n] == two[right, begin:n]).sum(axis=1)
        stay = found >= needed
        left, right, found = left[stay], right[stay], found[stay]
    return np.stack([left, right], axis=1)


def _common(one: list[np.ndarray], two: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets of each pair.

    Few pairs are intersected one by one. Many share most of their elements, so the elements
    that two sets have at all are numbered, and 0/1 matrices multiplied, some columns at a time.
    """
    if len(pairs) < 4 * (len(one) + len(two)):
        return np.array(
            [len(np.intersect1d(one[i], two[j], assume_unique=True)) for i, j in pairs], dtype=np.int64
        )

    def flat(sets: list[np.ndarray], known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values = np.concatenate(sets)
        rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        column = np.minimum(np.searchsorted(known, values), len(known) - 1)
        shared = known[column] == values
        order = np.argsort(column[shared], kind="stable")
        return rows[shared][order], column[shared][order]

    known = np.intersect1d(np.concatenate(one), np.concatenate(two))
    total = np.zeros((len(one), len(two)), dtype=np.float64)
    if not len(known):
        return np.zeros(len(pairs), dtype=np.int64)
    (rows_one, column_one), (rows_two, column_two) = flat(one, known), flat(two, known)
    for start in range(0, len(known), COLUMNS_AT_A_TIME):
        parts = []
        for rows, column, count in ((rows_one, column_one, len(one)), (rows_two, column_two, len(two))):
            begin, end = np.searchsorted(column, [start, start + COLUMNS_AT_A_TIME])
            part = np.zeros((count, min(COLUMNS_AT_A_TIME, len(known) - start)), dtype=np.float32)
            part[rows[begin:end], column[begin:end] - start] = 1.0
            parts.append(part)
        total += parts[0] @ parts[1].T
    return total[pairs[:, 0], pairs[:, 1]].astype(np.int64)


def _verified(blocks: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """Links within each pair of blocks of a cluster.

    Per class that has one: the documents linked to it there, and the first class, in the
    order of keys, of its connected part there. Nothing is returned for each pair.
    """
    looks = fewest_matches(threshold, tolerance)

    def verify(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        keys = table.column("key").to_pylist()
        block = table.column("block").to_numpy()
        copies = table.column("copies").to_numpy()
        packed = b"".join(table.column("signature").to_pylist())
        signatures = np.frombuffer(packed, np.uint16).reshape(-1, VALUES)
        low = np.flatnonzero(block == table.column("low")[0].as_py())
        high = np.flatnonzero(block == table.column("high")[0].as_py())
        pairs = _surviving(signatures[low], signatures[high], looks)
        pairs = np.stack([low[pairs[:, 0]], high[pairs[:, 1]]], axis=1)
        if len(low) == len(high) and (low == high).all():
            pairs = pairs[pairs[:, 0] < pairs[:, 1]]
        else:
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        needed, place = np.unique(pairs, return_inverse=True)
        place = place.reshape(pairs.shape)
        texts = table.column("text")
        sets = [shingles(texts[int(i)].as_py()) for i in needed]
        size = np.array([len(s) for s in sets], dtype=np.int64)
        if len(pairs):
            common = _common(sets, sets, place)
            union = size[place[:, 0]] + size[place[:, 1]] - common
            pairs = pairs[common >= threshold * union - 1e-9]
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
        verify, "key binary, linked long, first binary"
    )


def jaccard_links(
    documents: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE
) -> DataFrame:
    """Per row of ``documents``: doc_id, text_hash, class_key, class_id, n_links and n_copies.

    Two rows are linked when the Jaccard similarity of their sets of five-word shingles is at
    least ``threshold``. ``n_links`` counts the other rows linked to the row, copies included;
    ``class_id`` is the smallest doc_id reachable by links; ``n_copies`` counts rows with the
    same shingle set. ``class_key`` tells classes apart even where a doc_id is repeated; it is
    NULL for a NULL text or one without words, which is linked to nothing and is its own class. Rows may repeat and are then copies of one another. Other columns are ignored; an
    empty table gives an empty result.

    Copies never meet: everything after the first aggregation handles a class once. A large
    cluster of different texts is compared in pairs of blocks by as many tasks.
    """
    rows = documents.select("doc_id", "text")
    signed = written(_signed(rows), "jaccard-signed")
    classes = written(
        signed.filter(F.col("key").isNotNull())
        .groupBy("key")
        .agg(
            F.min("doc_id").alias("doc_id"),
            F.min(F.struct(*_row_name())).alias("row"),
            F.count(F.lit(1)).alias("copies"),
            F.max("bytes").alias("bytes"),
            F.first("signature").alias("signature"),
        ),
        "jaccard-classes",
    )
    banded = _banded(classes)
    buckets = (
        banded.groupBy("band")
        .agg(F.min("key").alias("v"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
    )
    meets = banded.join(buckets, "band").select(F.col("key").alias("u"), "v").distinct()
    clusters = components(meets)
    links = written(_cluster_links(rows, classes, clusters, threshold, tolerance), "jaccard-links")
    found = links.groupBy("key").agg(F.sum("linked").alias("linked"))
    joined = components(links.select(F.col("key").alias("u"), F.col("first").alias("v")))
    rooted = (
        classes.select("key", "doc_id", "copies")
        .join(found, "key", "left")
        .join(joined.withColumnRenamed("node", "key"), "key", "left")
        .withColumn("root", F.coalesce("root", "key"))
    )
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    named = rooted.join(least, "root").select(
        "key",
        F.col("root").alias("class_key"),
        "class_id",
        "copies",
        F.coalesce("linked", F.lit(0)).alias("linked"),
    )
    known = signed.join(named, "key").select(
        "doc_id",
        "text_hash",
        "class_key",
        "class_id",
        (F.col("linked") + F.col("copies") - 1).alias("n_links"),
        F.col("copies").alias("n_copies"),
    )
    alone = signed.filter(F.col("key").isNull()).select(
        "doc_id",
        "text_hash",
        F.lit(None).cast("binary").alias("class_key"),
        F.col("doc_id").alias("class_id"),
        F.lit(0).cast("long").alias("n_links"),
        F.lit(1).cast("long").alias("n_copies"),
    )
    return known.unionAll(alone)


def _cluster_links(
    rows: DataFrame, classes: DataFrame, clusters: DataFrame, threshold: float, tolerance: float
) -> DataFrame:
    weight = F.greatest("bytes", F.lit(BLOCK_BYTES // BLOCK_ROWS))
    upto = Window.partitionBy("cluster").orderBy("key")
    before = F.sum(weight).over(upto.rowsBetween(Window.unboundedPreceding, -1))
    placed = (
        clusters.select(F.col("node").alias("key"), F.col("root").alias("cluster"))
        .unionAll(clusters.select(F.col("root").alias("key"), F.col("root").alias("cluster")))
        .distinct()
        .join(classes, "key")
        .withColumn("block", F.floor(F.coalesce(before, F.lit(0)) / BLOCK_BYTES).cast("int"))
        .withColumn("last", F.max("block").over(Window.partitionBy("cluster")))
    )
    named = rows.withColumn("text_hash", text_hash())
    texts = named.select(*_row_name(), "text").dropDuplicates(["no_id", "id", "text_hash"])
    blocks = (
        placed.select("cluster", "block", "last", "key", "copies", "signature", "row.*")
        .join(texts, ["no_id", "id", "text_hash"])
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
        .withColumn("low", F.least("block", "other"))
        .withColumn("high", F.greatest("block", "other"))
    )
    return _verified(
        blocks.select("cluster", "low", "high", "block", "key", "copies", "signature", "text"),
        threshold,
        tolerance,
    )


def drop_near_duplicates(
    documents: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE
) -> DataFrame:
    """``documents`` with one row of each class, that of the smallest doc_id; columns unchanged.

    Rows without a word are classes of their own and stay.
    """
    links = written(jaccard_links(documents, threshold, tolerance), "jaccard-classes")
    chosen = links.filter(F.col("class_key").isNotNull()).groupBy("class_key").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("__row")
    )
    alone = links.filter(F.col("class_key").isNull()).select(
        F.struct("doc_id", "text_hash").alias("__row"), F.lit(True).alias("__alone")
    )
    keep = chosen.select("__row", F.lit(False).alias("__alone")).unionAll(alone).distinct()
    keep = keep.select(
        F.col("__row.doc_id").alias("__id"), F.col("__row.text_hash").alias("__hash"), "__alone"
    )
    marked = documents.withColumn("__own", text_hash())
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__hash"))
    joined = marked.join(keep, same).drop("__id", "__hash")
    once = joined.filter(~F.col("__alone")).dropDuplicates(["doc_id", "__own"])
    return once.unionAll(joined.filter("__alone")).select(*documents.columns)


def op5_jaccard(documents: DataFrame) -> DataFrame:
    return jaccard_links(documents).select("doc_id", "class_id", "n_links", "n_copies")
