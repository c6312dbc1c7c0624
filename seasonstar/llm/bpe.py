"""Byte-level BPE through a table of distinct words.

Texts are split into words by the tokenizer's own pattern in Spark. Runs of documents, of
bounded size, number their distinct words and ask for them; every distinct word of the corpus is
encoded once, and the ids go back to the runs that asked, where they are joined to the numbered
words by position. What is sent are compressed runs of numbers, words and ids, not a row per word. Decoding joins ids with the id-to-piece table, whose size is that of the
vocabulary, and puts the pieces of a document together.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seasonstar.llm.common import give_back, lean, sent_by_value

sent_by_value(__name__)

#: Bytes of text in a run at most, but for a longer document, which is a run of its own; runs end
#: with their task. Bytes of text for each part of the word table, which then holds some 200,000
#: distinct words.
RUN_BYTES = 16 << 20
PART_BYTES = 32 << 20
#: Words whose ids are looked up at a time.
WORDS_AT_A_TIME = 1 << 19
#: Words at least so frequent in a run are numbered first, by frequency; the others by spelling.
FREQUENT = 8
#: The word pattern of the byte-level pre-tokenizer, white space as Unicode has it.
SPACE = r"\p{IsWhite_Space}"
WORDS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + SPACE + r"\p{L}\p{N}]+|"
    + SPACE + r"+(?!\P{IsWhite_Space})|" + SPACE + "+"
)


class Vocabulary:
    """A byte-level BPE file: its text, special strings and the id-to-piece table."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            self.text = file.read()
        read = json.loads(self.text)
        pre, model = read["pre_tokenizer"], read["model"]
        plain = pre and pre["type"] == "ByteLevel" and pre["use_regex"]
        if not plain or pre["add_prefix_space"] or read["normalizer"] or model["type"] != "BPE":
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        added = read["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that match by their surroundings are not handled")
        self.special = sorted((t["content"] for t in added), key=lambda t: (-len(t), t))
        byte = _byte_alphabet()
        self.pieces = [b""] * (1 + max([*model["vocab"].values(), *(t["id"] for t in added)]))
        for piece, number in model["vocab"].items():
            self.pieces[number] = bytes(byte[c] for c in piece)
        for token in added:
            self.pieces[token["id"]] = token["content"].encode()

    def tokenizer(self) -> Tokenizer:
        return _tokenizer(self.text)

    def words(self, text: Column) -> Column:
        """The words of a text in order; special strings are words of their own."""

        def plain(part: Column) -> Column:
            return F.regexp_extract_all(part, F.lit(WORDS), F.lit(0))

        if not self.special:
            return plain(text)
        pattern = "|".join(r"\Q" + t + r"\E" for t in self.special)

        def apart(parts: Column) -> Column:
            found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
            return F.flatten(
                F.transform(
                    parts,
                    lambda part, i: F.when(i == 0, plain(part)).otherwise(
                        F.concat(F.array(F.get(found, i - 1)), plain(part))
                    ),
                )
            )

        parts = F.split(text, F.lit(pattern), F.lit(-1))
        return F.when(text.rlike(pattern), apart(parts)).otherwise(plain(text))


def _byte_alphabet() -> dict[str, int]:
    """Bytes by the visible character that stands for them: the printable ones of Latin-1 stand
    for themselves, the others follow from code point 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _tokenizer(text: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has given this task its cores
    made = Tokenizer.from_str(text)
    made.no_truncation()
    made.no_padding()
    return made


def _blob(table: pa.Table) -> bytes:
    """A table as compressed bytes: words and ids take a fraction of what rows of them take."""
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    with pa.ipc.new_stream(sink, table.schema, options=options) as stream:
        stream.write_table(table)
    return sink.getvalue().to_pybytes()


def _table(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


class _Run:
    """Documents of a run: their ids and word counts, the distinct words, and word numbers."""

    def __init__(self):
        self.doc_ids, self.sizes, self.numbers, self.bytes = [], [], [], 0
        self.place: dict[str, int] = {}

    def add(self, rows: pa.RecordBatch, size: int) -> None:
        lists = rows.column("words")
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        own = np.fromiter((self.place.setdefault(w, len(self.place)) for w in words), np.int32, len(words))
        self.numbers.append(own[coded.indices.to_numpy()])
        self.sizes.append(np.diff(lists.offsets.to_numpy()))
        self.doc_ids.append(rows.column("doc_id"))
        self.bytes += size

    def blobs(self) -> tuple[bytes, bytes, bytes]:
        """Documents, numbers of their words, and words by number: the frequent ones first, by
        frequency, and the others by spelling, since both pack well in that order."""
        numbers = np.concatenate(self.numbers)
        count = np.bincount(numbers, minlength=len(self.place))
        words = pa.array(list(self.place), pa.string())
        spelling = pc.array_sort_indices(words).to_numpy()
        rare = count[spelling] < FREQUENT
        often = spelling[~rare]
        order = np.concatenate([often[np.argsort(-count[often], kind="stable")], spelling[rare]])
        place = np.empty(len(words), dtype=np.int32)
        place[order] = np.arange(len(words), dtype=np.int32)
        numbers = place[numbers]
        sizes = pa.array(np.concatenate(self.sizes), pa.int32())
        return (
            _blob(pa.table({"doc_id": pa.chunked_array(self.doc_ids, pa.int64()), "size": sizes})),
            _blob(
                pa.table({"low": (numbers & 255).astype(np.uint8), "high": (numbers >> 8).astype(np.int32)})
            ),
            _blob(pa.table({"word": words.take(pa.array(order))})),
        )


def _runs(split: DataFrame) -> DataFrame:
    """``split`` (doc_id, words) as a row per run: its digest, the documents with the numbers of
    their words, and the words by number. Runs are cut from the rows as they are stored, so a
    task that runs again cuts the same ones; if it ever did not, the digest would not be found."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed() -> pa.RecordBatch:
            documents, numbers, words = run.blobs()
            digest = hashlib.blake2b(documents + numbers + words, digest_size=16).digest()
            return pa.RecordBatch.from_arrays(
                [pa.array([x], pa.binary()) for x in (digest, documents, numbers, words)],
                ["run", "documents", "numbers", "words"],
            )

        run = _Run()
        for batch in batches:
            lists = batch.column("words")
            length = pc.binary_length(lists.flatten()).to_numpy(zero_copy_only=False)
            upto = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
            upto = upto[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
            begin = 0
            while begin < batch.num_rows:
                end = int(np.searchsorted(upto, upto[begin] + RUN_BYTES - run.bytes, side="right")) - 1
                if end <= begin and run.doc_ids:
                    yield packed()
                    run = _Run()
                    continue
                end = max(end, begin + 1)
                run.add(batch.slice(begin, end - begin), int(upto[end] - upto[begin]))
                begin = end
            pa.default_memory_pool().release_unused()
        if run.doc_ids:
            yield packed()

    return split.select("doc_id", "words").mapInArrow(
        lean(pack), "run binary, documents binary, numbers binary, words binary"
    )


def _dealt(words: list[str], parts: int) -> list[tuple[int, np.ndarray]]:
    """The places of the words that go to each part, by a hash of the word."""
    part = np.fromiter((zlib.crc32(w.encode()) % parts for w in words), np.int64, len(words))
    order = np.argsort(part, kind="stable")
    starts = np.flatnonzero(np.diff(part[order], prepend=-1))
    return [(int(part[own[0]]), own) for own in np.split(order, starts)[1:]]


def _asked(runs: DataFrame, parts: int) -> DataFrame:
    """The words of each run, dealt to the parts."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run, blob in zip(batch.column("run"), batch.column("words"), strict=True):
                words = _table(blob.as_py()).column("word").combine_chunks()
                dealt = _dealt(words.to_pylist(), parts)
                blobs = [_blob(pa.table({"word": words.take(pa.array(own))})) for _, own in dealt]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part for part, _ in dealt], pa.int64()),
                        pa.array([run.as_py()] * len(blobs), pa.binary()),
                        pa.array(blobs, pa.binary()),
                    ],
                    ["part", "run", "blob"],
                )

    return runs.mapInArrow(lean(ask), "part long, run binary, blob binary")


def _answered(asked: DataFrame, text: str) -> DataFrame:
    """Every request with the ids of its words, in its order. The requests of a part come together,
    and each distinct word of a part is encoded at its first occurrence only."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(text)
        last = None
        for batch in batches:
            blobs = []
            for part, blob in zip(batch.column("part"), batch.column("blob"), strict=True):
                if part != last:
                    last, known, size, ids = part, {}, array("i"), array("i")
                words = _table(blob.as_py()).column("word").to_pylist()
                new = [word for word in words if word not in known]
                for word, one in zip(new, tokenizer.encode_batch(new, add_special_tokens=False), strict=True):
                    known[word] = len(known)
                    size.append(len(one.ids))
                    ids.extend(one.ids)
                sizes = np.array(size, dtype=np.int32)
                at = np.fromiter((known[word] for word in words), np.int64, len(words))
                starts = np.cumsum(sizes, dtype=np.int64) - sizes
                flat, _ = _ragged(np.array(ids, dtype=np.int32), starts[at], sizes[at])
                blobs.append(
                    _blob(pa.table({"size": sizes[at]})) + _blob(pa.table({"id": flat}))
                )
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), batch.column("run"), pa.array(blobs, pa.binary())],
                ["part", "run", "blob"],
            )

    together = asked.repartition("part").sortWithinPartitions("part")
    return together.mapInArrow(lean(answer), "part long, run binary, blob binary")


def _array(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def _dictionary(words: list[str], answered: dict[int, bytes], parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a run's words by number: all ids one after the other, and where a word's begin."""
    at, size, ids = [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.int32)]
    for part, own in _dealt(words, parts):
        if part not in answered:
            raise ValueError("a run of documents was cut differently when it was read again")
        reader = pa.BufferReader(answered[part])
        at.append(own)
        size.append(_array(pa.ipc.open_stream(reader).read_all(), "size"))
        ids.append(_array(pa.ipc.open_stream(reader).read_all(), "id"))
    place = np.argsort(np.concatenate(at), kind="stable")
    sizes, flat = np.concatenate(size), np.concatenate(ids)
    starts = np.cumsum(sizes, dtype=np.int64) - sizes
    return _ragged(flat, starts[place], sizes[place])


def _ragged(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of ``flat`` one after the other, and where each begins in the result."""
    begins = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    within = np.arange(begins[-1]) - np.repeat(begins[:-1], sizes)
    return flat[np.repeat(starts, sizes) + within], begins


def decode_ids(ids: list[int], pieces: list[bytes]) -> str:
    """The text of ``ids``: each joined to its piece, and the pieces read as UTF-8."""
    return b"".join(map(pieces.__getitem__, ids)).decode("utf-8", "replace")


def encode(
    documents: DataFrame, vocabulary: Vocabulary, digest: bool = False, text_too: bool = False
) -> DataFrame:
    """Per row of ``documents``: doc_id, n_tokens and ``ids``, with ``text_too`` also the ``text``
    decoded from them; with ``digest`` the hashes of the ids and of that text instead.

    The numbered words of the texts cross the network once, compressed, to their ids; the exchange
    is shared by both sides of the join. A NULL text is empty and has no ids. Rows may repeat.
    Other columns are ignored; an empty table gives an empty result. ``documents`` has to be a
    stored table, or anything else that gives its rows in the same order when read again.
    """
    text = F.coalesce("text", F.lit(""))
    total = documents.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    runs = _runs(documents.select("doc_id", vocabulary.words(text).alias("words")))
    placed = runs.repartition("run")
    parts = max(1, -(-total // PART_BYTES))
    answers = _answered(_asked(placed, parts), vocabulary.text)
    pieces = vocabulary.pieces
    names = [str(i) for i in range(len(pieces))]

    def join(rows: pa.Table, answered: pa.Table) -> pa.Table:
        out = []

        def finish(doc_ids: pa.ChunkedArray, ids: np.ndarray, bounds: np.ndarray) -> None:
            made = {"doc_id": doc_ids, "n_tokens": pa.array(np.diff(bounds), pa.int64())}
            if digest:
                hashes: list[tuple[str, str]] = []
                for begin, end in zip(bounds, bounds[1:], strict=False):
                    own = ids[begin:end].tolist()
                    text_ids = ",".join(map(names.__getitem__, own)).encode()
                    decoded = decode_ids(own, pieces).encode()
                    hashes.append(tuple(hashlib.sha256(x).hexdigest() for x in (text_ids, decoded)))
                made["ids_sha256"] = pa.array([h[0] for h in hashes], pa.string())
                made["decoded_sha256"] = pa.array([h[1] for h in hashes], pa.string())
            else:
                made["ids"] = pa.ListArray.from_arrays(
                    pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())
                )
                if text_too:
                    made["text"] = pa.array(
                        [
                            decode_ids(ids[begin:end].tolist(), pieces)
                            for begin, end in zip(bounds, bounds[1:], strict=False)
                        ],
                        pa.string(),
                    )
            out.append(pa.table(made).cast(pa.schema(list(columns.items()))))

        # rows are runs that are equal, so one dictionary does for all of them
        found = dict(zip(answered.column("part").to_pylist(), answered.column("blob").to_pylist(), strict=True))
        words = _table(rows.column("words")[0].as_py()).column("word").to_pylist()
        flat, begins = _dictionary(words, found, parts)
        width = np.diff(begins)
        for row in range(rows.num_rows):
            table = _table(rows.column("numbers")[row].as_py())
            numbers = _array(table, "low") + (_array(table, "high") << 8)
            own = _table(rows.column("documents")[row].as_py())
            ends = np.concatenate([[0], np.cumsum(_array(own, "size"), dtype=np.int64)])
            first = 0
            while first < own.num_rows:  # some documents at a time
                last = int(np.searchsorted(ends, ends[first] + WORDS_AT_A_TIME, side="right")) - 1
                last = max(last, first + 1)
                some = numbers[ends[first] : ends[last]]
                ids, starts = _ragged(flat, begins[some], width[some])
                bounds = starts[ends[first : last + 1] - ends[first]]
                finish(own.column("doc_id").slice(first, last - first), ids, bounds)
                first = last
        del found, flat, begins, width
        give_back()
        return pa.concat_tables(out)

    columns = {"doc_id": pa.int64(), "n_tokens": pa.int64()}
    schema = "doc_id long, n_tokens long"
    if digest:
        columns |= {"ids_sha256": pa.string(), "decoded_sha256": pa.string()}
        schema += ", ids_sha256 string, decoded_sha256 string"
    else:
        columns |= {"ids": pa.list_(pa.int32())} | ({"text": pa.string()} if text_too else {})
        schema += ", ids array<int>" + (", text string" if text_too else "")
    return placed.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(join, schema)


def decode(tokens: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``tokens`` (column ``ids``) with ``text``, joined from the id-to-piece table, which has the
    bounded size of the vocabulary and goes to every task. NULL ids are an empty text."""
    pieces = vocabulary.pieces

    @F.pandas_udf("string")
    def decoded(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: "" if x is None else decode_ids(x.tolist(), pieces))

    return tokens.withColumn("text", decoded("ids"))


def public_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_bpe(documents: DataFrame, path: str | None = None) -> DataFrame:
    return encode(documents, Vocabulary(path or public_path()), digest=True)
