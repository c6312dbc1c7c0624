"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts become hashed counts of the 1- to 3-grams of their lower-case characters, damped and
weighted by inverse document frequencies over all training texts. The weights are learned by
follow-the-regularised-leader with an elastic-net penalty on a bounded sample, and the
probabilities are calibrated by one temperature, fitted on sampled documents left out of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasonstar.llm.common import lean, sent_by_value

sent_by_value(__name__)

UNKNOWN = "und"
#: Hash slots of n-grams, the longest n-gram, and characters handled at a time.
SLOTS = 1 << 14
LONGEST = 3
BLOCK_CHARS = 1 << 20
#: Training documents in all, shared evenly between the languages (in expectation).
MAX_SAMPLES = 3_200
#: Every so many-th sampled document fits the temperature instead of the weights.
CALIBRATE_EVERY = 5
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1
HAS_LETTER = r"\p{L}"


def gram_counts(text: str, slots: int = SLOTS) -> np.ndarray:
    """Occurrences of the hashed n-grams of a whole text, read in blocks of fixed size."""
    counts = np.zeros(slots, dtype=np.int64)
    shift = np.uint32(32 - (slots.bit_length() - 1))
    for start in range(0, len(text), BLOCK_CHARS):
        # a block ends with the first characters of the next, so no n-gram is lost or doubled
        chars = text[start : start + BLOCK_CHARS + LONGEST - 1].lower()
        codes = np.frombuffer(chars.encode("utf-32-le", "replace"), dtype="<u4")
        last = start + BLOCK_CHARS >= len(text)
        grams = codes
        for n in range(1, LONGEST + 1):
            if n > 1:
                if len(grams) < 2:
                    break
                grams = grams[:-1] * np.uint32(0x01000193) + codes[n - 1 :]
            own = grams if last else grams[:BLOCK_CHARS]
            mixed = (own + np.uint32(n)) * np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(15)
            counts += np.bincount((mixed * np.uint32(0x85EBCA6B)) >> shift, minlength=slots)
    return counts


@dataclass(frozen=True)
class Model:
    """Learned languages, their weights per slot, slot weights and the temperature."""

    languages: tuple[str, ...]
    weights: np.ndarray
    idf: np.ndarray
    temperature: float

    def logits(self, text: str) -> np.ndarray:
        return self.weights @ vector(gram_counts(text, len(self.idf)), self.idf)

    def predict(self, text: str) -> tuple[str, float]:
        shares = softmax(self.logits(text) / self.temperature)
        best = int(np.argmax(shares))
        return self.languages[best], float(shares[best])


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weighted = np.log1p(counts) * idf
    return weighted / (np.sqrt(weighted @ weighted) or 1.0)


def softmax(logits: np.ndarray) -> np.ndarray:
    powers = np.exp(logits - logits.max())
    return powers / powers.sum()


def document_frequencies(texts: DataFrame, slots: int = SLOTS) -> np.ndarray:
    """Of all rows of ``texts`` (column ``text``), how many have a gram in each slot.

    Each task adds up its own documents, so ``slots`` rows per task are shuffled, and ``slots``
    rows come to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, dtype=np.int64)
        for batch in batches:
            for text in batch.column("text"):
                total += gram_counts(text.as_py(), slots) > 0
        used = np.flatnonzero(total)
        arrays = [pa.array(used, pa.int32()), pa.array(total[used], pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, ["slot", "n"])

    rows = texts.select("text").mapInArrow(lean(count), "slot int, n long")
    found = np.zeros(slots, dtype=np.int64)
    for slot, n in rows.groupBy("slot").agg(F.sum("n")).collect():
        found[slot] = n
    return found


def _sampled(labelled: DataFrame, counts: dict[str, int], most: int) -> list[tuple[str, bytes]]:
    """About ``most`` documents by the smallest hashes: language and packed n-gram counts."""
    scale = 1 << 30
    each = max(1, most // len(counts))
    limits = F.create_map(
        *[F.lit(x) for lang, n in counts.items() for x in (lang, min(scale, each * scale // n))]
    )
    place = F.pmod(F.xxhash64("text"), F.lit(scale))
    chosen = labelled.withColumn("place", place).filter(F.col("place") < limits[F.col("lang")])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for text in batch.column("text"):
                counts = gram_counts(text.as_py())
                used = np.flatnonzero(counts).astype(np.int32)
                packed.append(used.tobytes() + counts[used].astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("place"), pa.array(packed, pa.binary())],
                ["lang", "place", "packed"],
            )

    # a text counts once for each language it is given, however many copies there are
    rows = chosen.select("lang", "place", "text").distinct().mapInArrow(
        lean(pack), "lang string, place long, packed binary"
    )
    found = sorted((r["place"], r["lang"], bytes(r["packed"])) for r in rows.collect())
    return [(lang, packed) for _, lang, packed in found]


def _learn(samples: list[tuple[str, bytes]], languages: list[str], idf: np.ndarray) -> Model:
    """Per-coordinate follow-the-regularised-leader over the samples in a fixed order."""
    sparse = []
    for lang, packed in samples:
        n = len(packed) // 8
        slots = np.frombuffer(packed, np.int32, n)
        value = np.log1p(np.frombuffer(packed, np.int32, n, 4 * n)) * idf[slots]
        sparse.append((languages.index(lang), slots, value / (np.sqrt(value @ value) or 1.0)))
    held = [s for i, s in enumerate(sparse) if i % CALIBRATE_EVERY == 0]
    rest = [s for i, s in enumerate(sparse) if i % CALIBRATE_EVERY] or sparse
    z = np.zeros((len(languages), len(idf)))
    n = np.zeros_like(z)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0.0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    order = np.random.default_rng(1)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rest)):
            label, slots, value = rest[i]
            own_z, own_n = z[:, slots], n[:, slots]
            own_w = weights(own_z, own_n)
            error = softmax(own_w @ value)
            error[label] -= 1.0
            gradient = np.outer(error, value)
            more = own_n + gradient**2
            z[:, slots] = own_z + gradient - (np.sqrt(more) - np.sqrt(own_n)) / ALPHA * own_w
            n[:, slots] = more
    learned = weights(z, n)
    logits = np.array([learned[:, slots] @ value for _, slots, value in held])
    labels = np.array([label for label, _, _ in held])
    return Model(tuple(languages), learned, idf, _temperature(logits, labels))


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least cross-entropy, by golden-section search of its logarithm."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        scaled = logits / np.exp(log_t)
        top = scaled.max(axis=1)
        total = top + np.log(np.exp(scaled - top[:, None]).sum(axis=1))
        return float((total - scaled[np.arange(len(labels)), labels]).mean())

    low, high, golden = -3.0, 3.0, (5**0.5 - 1) / 2
    while high - low > 1e-3:
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(labelled: DataFrame, max_samples: int = MAX_SAMPLES) -> Model | None:
    """Learn from the rows of ``labelled`` whose ``text`` and ``lang`` are not NULL.

    Language counts and document frequencies cover all those rows; the weights are fitted on
    a sample of about ``max_samples`` documents. None if there is no row to learn from.
    """
    rows = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    languages = sorted(counts)
    found = document_frequencies(rows)
    idf = np.log((1.0 + sum(counts.values())) / (1.0 + found)) + 1.0
    return _learn(_sampled(rows, counts, max_samples), languages, idf)


def predicted(model: Model | None) -> Column:
    """Struct of ``lang_pred`` and ``score`` for the column ``text``; NULL text gives NULL."""
    if model is None:
        return F.lit(None).cast("struct<lang_pred:string,score:double>")

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            found = [(None, None) if not t.is_valid else model.predict(t.as_py()) for t in batch]
            columns = zip(*found, strict=True) if found else ((), ())
            arrays = [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.float64()), strict=True)]
            yield pa.StructArray.from_arrays(arrays, ["lang_pred", "score"])

    return predict(F.col("text"))


def identify(
    documents: DataFrame, model: Model | None, names: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """``documents`` with a language and its score under ``names``, from the whole of each text alone.

    A NULL text, one without a letter, and any text when nothing was learned, is ``und`` with
    score 0. Columns of these names are replaced, all others stay as they are; repeated rows stay, and
    an empty table gives an empty result. Equal scores go to the language that sorts first.
    """
    lang, score = names
    found = documents.withColumn("__found", predicted(model))
    sure = F.coalesce(F.col("text").rlike(HAS_LETTER), F.lit(False)) & F.col(
        "__found.lang_pred"
    ).isNotNull()
    return (
        found.withColumn(lang, F.when(sure, F.col("__found.lang_pred")).otherwise(UNKNOWN))
        .withColumn(score, F.when(sure, F.col("__found.score")).otherwise(0.0))
        .drop("__found")
    )


def fold() -> Column:
    """Held-out rows: crc32 of doc_id as text leaves 2 when divided by 4."""
    text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(F.encode(text, "utf-8")) % 4 == 2


def op3_language_id(documents: DataFrame) -> DataFrame:
    """Languages of all documents, learned from the folds not held out; see ``train``, ``identify``."""
    model = train(documents.filter(~fold()))
    rows = documents.select("doc_id", "text", fold().alias("held_out"))
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", "score")
