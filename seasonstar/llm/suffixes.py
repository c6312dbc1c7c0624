"""Repeated passages by sorting suffixes: which 100-byte strings also start earlier.

Two equal strings of ``LENGTH`` bytes hold the same anchor at the same place: the least hash of
the ``GRAM``-byte strings inside. So only suffixes at anchors whose hash occurs twice
have to be sorted, a few in a hundred of all. They are sorted deep-shallow: multikey quicksort to a
shallow depth, and blind tries for the groups that share more. The order of what follows the
anchors, the order of what precedes them, read backwards, and the common prefixes of neighbours
in both tell which of the strings around an anchor are equal, and so which of them start earlier.

Documents are dealt to blocks of bounded size. Blocks ask, parts answer; what is sent are
compressed tables of hashes, of the distinct surroundings of anchors, and of results, never
the occurrences of a string one by one. A string that is everywhere is sent once by each block.

An anchor may be frequent and stand in other surroundings each time, as a short line in very many
documents does. The surroundings of anchors with more than ``MANY_FORMS`` of them are not sent:
their strings are, dealt by their own hash and only if that hash occurs twice, and sorted alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonstar.llm.common import lean_cogroup, lean_group, sent_by_value

sent_by_value(__name__)

LENGTH = 100
#: Bytes of an anchor. LENGTH - GRAM + 1 of them lie in a string; one in about 35 is chosen.
GRAM = 32
OFFSETS = LENGTH - GRAM + 1
#: Depth from which groups of equal prefixes go to blind tries, and bytes of a quicksort key.
SHALLOW, KEY = 32, 8
#: Bytes of text in a block. Hashes and surroundings are dealt to one part for so many blocks, as
#: a block sends a message to each part, and sorted in as many slices of a part, one at a time.
BLOCK_BYTES, SLICES = 8 << 20, 8
#: Surroundings of one anchor hash, counted by block, from which strings are dealt one by one.
MANY_FORMS = 1 << 16
#: Bytes whose hashes are computed at a time.
BYTES_AT_A_TIME = 1 << 16
_PLACE_BITS = 17
#: Stands for a NULL doc_id, which is earlier than any other.
NO_ID = -(1 << 63)
#: Bits of an anchor's hash that are sent. A collision only makes for a needless comparison.
HASH_BITS = 48

_random = np.random.default_rng(20240502)
_BYTE = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_TABLE = BYTES_AT_A_TIME + 4 * LENGTH


def _powers(base: int) -> np.ndarray:
    out = np.ones(_TABLE, dtype=np.uint64)
    np.multiply.accumulate(np.full(_TABLE - 1, base, dtype=np.uint64), out=out[1:])
    return out


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of texts: which text, place in it, hash, and hash of the surroundings.

    The surroundings are the up to OFFSETS - 1 bytes before an anchor and the up to LENGTH bytes
    from it on, within the text. Short texts are read many at a time, a long one in pieces that
    overlap.
    """
    found: list[tuple] = []
    run, size = [], 0
    for index, data in enumerate(texts):
        if len(data) < LENGTH:
            continue
        if len(data) > BYTES_AT_A_TIME:
            for first in range(0, len(data) - LENGTH + 1, BYTES_AT_A_TIME):
                start = max(0, first - OFFSETS + 1)
                stop = min(len(data), first + BYTES_AT_A_TIME + 2 * LENGTH)
                begin, end = first - start, min(len(data) - LENGTH + 1, first + BYTES_AT_A_TIME) - start
                at = _anchors(
                    np.frombuffer(data, np.uint8, stop - start, start),
                    np.array([0]),
                    np.array([stop - start]),
                    np.arange(begin, end),
                )
                found.append((np.full(len(at[0]), index), at[0] + start, at[1], at[2]))
            continue
        if size + len(data) > BYTES_AT_A_TIME:
            found.append(_together(run, texts))
            run, size = [], 0
        run.append(index)
        size += len(data)
    if run:
        found.append(_together(run, texts))
    if not found:
        nothing = np.empty(0, dtype=np.int64)
        return nothing, nothing, nothing.astype(np.uint64), nothing.astype(np.uint64)
    index, place, hashes, around = (np.concatenate(column) for column in zip(*found, strict=True))
    order = np.lexsort((place, index))
    index, place = index[order], place[order]
    # pieces of a long text share the anchors where they meet
    new = np.concatenate([[True], (np.diff(index) != 0) | (np.diff(place) != 0)])
    return index[new], place[new], hashes[order][new], around[order][new]


def _together(run: list[int], texts: list[bytes]) -> tuple:
    data = np.frombuffer(b"".join(texts[i] for i in run), np.uint8)
    size = np.array([len(texts[i]) for i in run], dtype=np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    strings = np.ones(len(data), dtype=bool)  # places where a string of LENGTH bytes starts
    for step in range(1, LENGTH):
        strings[ends - step] = False
    at, hashes, around, row = _anchors(data, starts, ends, np.flatnonzero(strings))
    return np.array(run)[row], at - starts[row], hashes, around


def _anchors(piece: np.ndarray, starts: np.ndarray, ends: np.ndarray, strings: np.ndarray) -> tuple:
    """Anchors of the strings that start at ``strings`` in a piece holding the texts that run
    from ``starts`` to ``ends``: places, hashes, hashes of surroundings, and texts."""
    sums = np.zeros(len(piece) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[piece] * _UP[: len(piece)], out=sums[1:])
    grams = len(piece) - GRAM + 1
    gram = _mixed((sums[GRAM:] - sums[:grams]) * _DOWN[:grams])
    low = np.uint64((1 << _PLACE_BITS) - 1)
    ranked = (gram & ~low) | np.arange(grams, dtype=np.uint64)
    width = 1
    while 2 * width <= OFFSETS:
        ranked = np.minimum(ranked[:-width], ranked[width:])
        width *= 2
    if width < OFFSETS:
        ranked = np.minimum(ranked[: width - OFFSETS], ranked[OFFSETS - width :])
    # the least of a window never moves back as the window moves on
    at = (ranked[strings] & low).astype(np.int64)
    at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    row = np.searchsorted(ends, at, side="right")
    left = np.maximum(at - OFFSETS + 1, starts[row])
    right = np.minimum(at + LENGTH, ends[row])
    size = ((at - left) * 512 + right - at).astype(np.uint64)
    around = _mixed((sums[right] - sums[left]) * _DOWN[left] + _mixed(size))
    return at, gram[at], around, row


def strings_around(
    texts: list[bytes], index: np.ndarray, place: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The strings of LENGTH bytes that hold the anchors at ``place`` of texts ``index``, each
    start once: which text, start, and hash."""
    found: list[tuple] = []
    edges = np.flatnonzero(np.diff(index, prepend=-1, append=-1))
    for a, b in zip(edges, edges[1:], strict=False):
        data = texts[index[a]]
        starts = (place[a:b, None] - np.arange(OFFSETS)).ravel()
        starts = np.unique(starts[(starts >= 0) & (starts <= len(data) - LENGTH)])
        pieces = np.flatnonzero(np.diff(starts // BYTES_AT_A_TIME, prepend=-1))
        for own in np.split(starts, pieces)[1:]:
            size = int(own[-1] - own[0]) + LENGTH
            piece = np.frombuffer(data, np.uint8, size, int(own[0]))
            sums = np.zeros(size + 1, dtype=np.uint64)
            np.cumsum(_BYTE[piece] * _UP[:size], out=sums[1:])
            at = own - own[0]
            hashes = _mixed((sums[at + LENGTH] - sums[at]) * _DOWN[at])
            found.append((np.full(len(own), index[a]), own, hashes))
    if not found:
        nothing = np.empty(0, dtype=np.int64)
        return nothing, nothing, nothing.astype(np.uint64)
    return tuple(np.concatenate(column) for column in zip(*found, strict=True))


# ---------------------------------------------------------------- deep-shallow sorting


def common_prefix(one: bytes, two: bytes) -> int:
    size = min(len(one), len(two))
    apart = int.from_bytes(one[:size], "big") ^ int.from_bytes(two[:size], "big")
    return size - (apart.bit_length() + 7) // 8


class _Branch:
    """Inner node of a blind trie: only how deep its strings agree, and by next byte its children."""

    __slots__ = ("children", "depth")

    def __init__(self, depth: int, children: dict):
        self.depth, self.children = depth, children


def blind_trie_order(strings: list[bytes], rows: list[int]) -> list[int]:
    """``rows`` in the order of their strings, by a blind trie: the way down looks at branching
    bytes alone, and one comparison at the leaf shows where a new string leaves the way."""

    def byte(string: bytes, depth: int) -> int:
        return string[depth] if depth < len(string) else -1

    root: _Branch | list[int] = [rows[0]]
    for row in rows[1:]:
        string, node = strings[row], root
        while isinstance(node, _Branch):
            found = node.children.get(byte(string, node.depth))
            node = found if found is not None else next(iter(node.children.values()))
        other = strings[node[0]]
        depth = common_prefix(string, other)
        if depth == len(string) == len(other):
            node.append(row)
            continue
        above, node = None, root
        while isinstance(node, _Branch) and node.depth < depth:
            above, node = node, node.children[byte(string, node.depth)]
        if isinstance(node, _Branch) and node.depth == depth:
            node.children[byte(string, depth)] = [row]
            continue
        fork = _Branch(depth, {byte(other, depth): node, byte(string, depth): [row]})
        if above is None:
            root = fork
        else:
            above.children[byte(string, above.depth)] = fork
    order: list[int] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, _Branch):
            stack += [node.children[b] for b in sorted(node.children, reverse=True)]
        else:
            order += node
    return order


def deep_shallow_order(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """Places of ``strings`` in sorted order: multikey quicksort on keys of a few bytes down to
    ``shallow``, then a blind trie for each group that is still together."""
    order: list[int] = []
    stack: list[tuple[list[int], int]] = [(list(range(len(strings))), 0)]
    while stack:
        rows, depth = stack.pop()
        if len(rows) < 2 or depth < 0:
            order += rows
            continue
        if depth >= shallow:
            order += blind_trie_order(strings, rows)
            continue
        keys = [strings[i][depth : depth + KEY] for i in rows]
        pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
        less = [i for i, k in zip(rows, keys, strict=True) if k < pivot]
        same = [i for i, k in zip(rows, keys, strict=True) if k == pivot]
        more = [i for i, k in zip(rows, keys, strict=True) if k > pivot]
        ended = len(pivot) < KEY  # all of them end here and are equal
        stack += [(more, depth), (same, -1 if ended else depth + KEY), (less, depth)]
    return order


def _ranked(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted order, common prefixes of neighbours in it, and lengths, of ``strings``."""
    order = np.array(deep_shallow_order(strings), dtype=np.int64)
    size = np.array([len(s) for s in strings], dtype=np.int64)
    padded = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8)
    padded = padded.reshape(len(strings), width)[order]
    differ = padded[1:] != padded[:-1]
    prefix = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    prefix = np.minimum(prefix, np.minimum(size[order][1:], size[order][:-1]))
    return order, np.concatenate([[0], prefix]), size


def earlier_strings(before: list[bytes], after: list[bytes], rank: np.ndarray) -> np.ndarray:
    """Whether the string that starts o bytes before anchor i also occurs at an anchor of lower
    ``rank``: a matrix of (anchor, o). ``before`` and ``after`` are what surrounds the anchors."""
    order_after, prefix_after, size_after = _ranked(after, LENGTH)
    order_before, prefix_before, size_before = _ranked([b[::-1] for b in before], OFFSETS - 1)
    out = np.zeros((len(rank), OFFSETS), dtype=bool)
    class_after, class_before = np.empty_like(rank), np.empty_like(rank)
    for o in range(OFFSETS):
        class_after[order_after] = np.cumsum(prefix_after < LENGTH - o)
        class_before[order_before] = np.cumsum(prefix_before < o)
        whole = np.flatnonzero((size_after >= LENGTH - o) & (size_before >= o))
        if len(whole) < 2:
            continue
        string = class_after[whole] * (len(rank) + 1) + class_before[whole]
        by_string = np.lexsort((rank[whole], string))
        string, own = string[by_string], rank[whole][by_string]
        begins = np.concatenate([[True], string[1:] != string[:-1]])
        least = own[np.flatnonzero(begins)][np.cumsum(begins) - 1]
        out[whole[by_string], o] = least < own
    return out


# ---------------------------------------------------------------- blocks and parts


def _blob(**columns) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.table(columns)
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    with pa.ipc.new_stream(sink, table.schema, options=options) as stream:
        stream.write_table(table)
    return sink.getvalue().to_pybytes()


def _table(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def _array(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def _packed(rows: DataFrame) -> DataFrame:
    """(block, doc_id, text) as a compressed run of documents for each block and batch."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column("block").to_numpy()
            order = np.argsort(block, kind="stable")
            starts = np.flatnonzero(np.diff(block[order], prepend=-1))
            blobs = []
            for own in np.split(order, starts)[1:]:
                part = batch.select(["doc_id", "text"]).take(pa.array(own))
                blobs.append(_blob(doc_id=part.column("doc_id"), text=part.column("text")))
            yield pa.RecordBatch.from_arrays(
                [pa.array(block[order][starts], pa.int64()), pa.array(blobs, pa.binary())],
                ["block", "blob"],
            )

    return rows.select("block", "doc_id", "text").mapInArrow(pack, "block long, blob binary")


def _documents(rows: pa.Table, copies: pa.Table | None = None) -> Iterator[tuple]:
    """doc_id (NULL: below all others), text as bytes and whether it is a copy, of the documents
    of a block. Copies are told by doc_id and hash, as a doc_id may have several texts."""
    later: dict[int, set[bytes]] = {}
    if copies is not None:
        told = zip(copies.column("doc_id").to_pylist(), copies.column("blob").to_pylist(), strict=True)
        for doc_id, mark in told:
            later.setdefault(doc_id, set()).add(mark)
    for blob in rows.column("blob"):
        table = _table(blob.as_py())
        for doc_id, text in zip(table.column("doc_id"), table.column("text"), strict=True):
            doc_id = NO_ID if doc_id.as_py() is None else doc_id.as_py()
            data = text.as_py().encode("utf-8", "replace")
            marks = later.get(doc_id)
            yield doc_id, data, marks is not None and hashlib.sha256(data).digest() in marks


def _of_kind(told: pa.Table, kind: int) -> pa.Table:
    return told.filter(pa.array(_array(told, "kind") == kind))


def _dealt(block: int, part: np.ndarray, make: Callable[[np.ndarray], bytes]) -> pa.Table:
    """A row for each part: the blob that ``make`` makes of the rows dealt to it."""
    order = np.argsort(part, kind="stable")
    starts = np.flatnonzero(np.diff(part[order], prepend=-1))
    groups = np.split(order, starts)[1:]
    return pa.table(
        {
            "part": pa.array(part[order][starts], pa.int64()),
            "block": pa.array([block] * len(groups), pa.int64()),
            "blob": pa.array([make(g) for g in groups], pa.binary()),
        }
    )


def _part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (_mixed(hashes) % np.uint64(parts)).astype(np.int64)


def _slice_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The slice of its part that each hash belongs to."""
    return (_mixed(hashes) // np.uint64(parts) % np.uint64(SLICES)).astype(np.uint8)


_ASKED = "part long, block long, blob binary"
_TOLD = "block long, kind int, doc_id long, blob binary"


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``known``."""
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _short(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - HASH_BITS)


def _dealt_hashes(block: int, hashes: np.ndarray, forms: np.ndarray, parts: int) -> pa.Table:
    """Distinct ``hashes`` of a block, whether each occurs twice in it, and in how many forms."""
    order = np.lexsort((forms, hashes))
    hashes, forms = hashes[order], forms[order]
    new_hash = np.diff(hashes, prepend=hashes[:1] ^ np.uint64(1)) != 0
    new_form = new_hash | (np.diff(forms, prepend=forms[:1]) != 0)
    starts = np.flatnonzero(new_hash)
    count = np.diff(starts, append=len(hashes))
    different = np.add.reduceat(new_form.astype(np.int64), starts) if len(starts) else starts
    hashes = hashes[starts]

    def make(own: np.ndarray) -> bytes:
        return _blob(
            step=pa.array(np.diff(hashes[own], prepend=np.uint64(0))),
            twice=pa.array(count[own] > 1),
            forms=pa.array(different[own]),
        )

    return _dealt(block, _part_of(hashes, parts), make)


def _ask_hashes(placed: DataFrame, copies: DataFrame, parts: int) -> DataFrame:
    """The distinct anchor hashes of each block."""

    def ask(rows: pa.Table, told: pa.Table) -> pa.Table:
        texts = [data for _, data, copy in _documents(rows, told) if not copy]
        _, _, hashes, around = anchors(texts)
        block = rows.column("block")[0].as_py() if rows.num_rows else 0
        return _dealt_hashes(block, _short(hashes), around, parts)

    blocks = placed.groupBy("block").cogroup(copies.groupBy("block"))
    return blocks.applyInArrow(lean_cogroup(ask), _ASKED)


def _tell_hashes(asked: DataFrame, kind: int, many_forms: int) -> DataFrame:
    """For each block, those of its hashes that occur twice anywhere, and which of them have
    more than ``many_forms`` forms."""

    def tell(table: pa.Table) -> pa.Table:
        blobs = [_table(b.as_py()) for b in table.column("blob")]
        hashes = [np.cumsum(_array(b, "step"), dtype=np.uint64) for b in blobs]
        twice = np.concatenate([_array(b, "twice") for b in blobs])
        forms = np.concatenate([_array(b, "forms") for b in blobs])
        known, which, count = np.unique(
            np.concatenate(hashes), return_inverse=True, return_counts=True
        )
        again = count > 1
        again[which[twice]] = True
        many = np.bincount(which, weights=forms, minlength=len(known)) > many_forms
        answers, at = [], 0
        for own in hashes:
            mine = which[at : at + len(own)]
            at += len(own)
            mine = np.sort(mine[again[mine]])
            steps = np.diff(known[mine], prepend=np.uint64(0))
            answers.append(_blob(step=pa.array(steps), many=pa.array(many[mine])))
        return pa.table(
            {
                "block": table.column("block"),
                "kind": pa.array([kind] * len(blobs), pa.int32()),
                "doc_id": pa.nulls(len(blobs), pa.int64()),
                "blob": pa.array(answers, pa.binary()),
            }
        )

    return asked.groupBy("part").applyInArrow(lean_group(tell), _TOLD)


def _known(told: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted hashes that a block was told of, and which of them have many forms."""
    answers = [_table(b.as_py()) for b in _of_kind(told, kind).column("blob")]
    if not answers:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=bool)
    known = np.concatenate([np.cumsum(_array(a, "step"), dtype=np.uint64) for a in answers])
    many = np.concatenate([_array(a, "many") for a in answers])
    order = np.argsort(known)
    return known[order], many[order]


def _ask_strings(placed: DataFrame, told: DataFrame, parts: int) -> DataFrame:
    """The distinct hashes of the strings around anchors that have many forms."""

    def ask(rows: pa.Table, told: pa.Table) -> pa.Table:
        known, many = _known(told, 1)
        if not many.any():
            return _dealt(0, np.empty(0, dtype=np.int64), lambda own: b"")
        texts = [data for _, data, copy in _documents(rows, _of_kind(told, 0)) if not copy]
        index, place, hashes, _ = anchors(texts)
        mine = _among(_short(hashes), known[many])
        _, _, strings = strings_around(texts, index[mine], place[mine])
        block = rows.column("block")[0].as_py()
        return _dealt_hashes(block, strings, np.zeros(len(strings), dtype=np.uint64), parts)

    blocks = placed.groupBy("block").cogroup(told.groupBy("block"))
    return blocks.applyInArrow(lean_cogroup(ask), _ASKED)


def _ask_surroundings(placed: DataFrame, told: DataFrame, parts: int) -> DataFrame:
    """The distinct surroundings of anchors whose hash occurs twice, with their first place in
    the block. Of anchors with many forms, the distinct strings whose hash occurs twice."""

    def ask(rows: pa.Table, told: pa.Table) -> pa.Table:
        known, many = _known(told, 1)
        own = [x for x in _documents(rows, _of_kind(told, 0)) if not x[2]]
        texts, ids = [x[1] for x in own], np.array([x[0] for x in own], dtype=np.int64)
        index, place, hashes, around = anchors(texts)
        hashes = _short(hashes)
        each = np.flatnonzero(_among(hashes, known[many]))
        text_s, start, string = strings_around(texts, index[each], place[each])
        asked = np.flatnonzero(_among(string, _known(told, 3)[0]))
        text_s, start, string = text_s[asked], start[asked], string[asked]
        mine = np.flatnonzero(_among(hashes, known[~many]))
        index, place, hashes, around = index[mine], place[mine], hashes[mine], around[mine]

        def firsts(text: np.ndarray, at: np.ndarray, form: np.ndarray) -> np.ndarray:
            order = np.lexsort((at, ids[text], form))
            return order[np.diff(form[order], prepend=form[order][:1] ^ np.uint64(1)) != 0]

        first, first_s = firsts(index, place, around), firsts(text_s, start, string)
        if not len(first) + len(first_s):
            return _dealt(0, np.empty(0, dtype=np.int64), lambda own: b"")
        dealt_by = np.concatenate([hashes[first], string[first_s]])
        part, slices = _part_of(dealt_by, parts), _slice_of(dealt_by, parts)
        alone = np.arange(len(part)) >= len(first)
        text = np.concatenate([index[first], text_s[first_s]])
        at = np.concatenate([place[first], start[first_s]])
        form = np.concatenate([around[first], string[first_s]])

        def make(own: np.ndarray) -> bytes:
            cut = list(zip(text[own].tolist(), at[own].tolist(), alone[own].tolist(), strict=True))
            before = [b"" if a else texts[t][max(0, p - OFFSETS + 1) : p] for t, p, a in cut]
            after = [texts[t][p : p + LENGTH] for t, p, _ in cut]
            return _blob(
                around=pa.array(form[own]),
                slice=pa.array(slices[own]),
                alone=pa.array(alone[own]),
                doc_id=pa.array(ids[text[own]], pa.int64()),
                place=pa.array(at[own], pa.int64()),
                before=pa.array(before, pa.binary()),
                after=pa.array(after, pa.binary()),
            )

        return _dealt(rows.column("block")[0].as_py(), part, make)

    blocks = placed.groupBy("block").cogroup(told.groupBy("block"))
    return blocks.applyInArrow(lean_cogroup(ask), _ASKED)


def _tell_strings(asked: DataFrame) -> DataFrame:
    """For each block and surroundings, at which offsets the string around the first place of the
    block also starts earlier. This is where suffixes are sorted. A string sent alone has nothing
    before it, and is told at offset 0."""

    def tell(table: pa.Table) -> pa.Table:
        blobs = [_table(b.as_py()) for b in table.column("blob")]
        both = pa.concat_tables(blobs)
        doc_id, place = _array(both, "doc_id"), _array(both, "place")
        order = np.lexsort((place, doc_id))
        new = np.concatenate(
            [[True], (np.diff(doc_id[order]) != 0) | (np.diff(place[order]) != 0)]
        )
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.cumsum(new)
        slices = _array(both, "slice")
        packed = np.empty((len(order), -(-OFFSETS // 8)), dtype=np.uint8)
        for one in np.unique(slices):
            own = np.flatnonzero(slices == one)
            sides = both.select(["before", "after"]).take(pa.array(own))
            before, after = (sides.column(side).to_pylist() for side in ("before", "after"))
            packed[own] = np.packbits(earlier_strings(before, after, rank[own]), axis=1)
        out, at = [], 0
        for blob in blobs:
            own = packed[at : at + blob.num_rows]
            at += blob.num_rows
            strings = pa.array([row.tobytes() for row in own], pa.binary())
            out.append(
                _blob(
                    around=blob.column("around"),
                    alone=blob.column("alone"),
                    doc_id=blob.column("doc_id"),
                    place=blob.column("place"),
                    offsets=strings,
                )
            )
        return pa.table(
            {
                "block": table.column("block"),
                "kind": pa.array([2] * len(out), pa.int32()),
                "doc_id": pa.nulls(len(out), pa.int64()),
                "blob": pa.array(out, pa.binary()),
            }
        )

    return asked.groupBy("part").applyInArrow(lean_group(tell), _TOLD)


def covered(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of intervals."""
    if not len(begins):
        return begins, ends
    order = np.argsort(begins, kind="stable")
    begins, ends = begins[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], begins[1:] > ends[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(ends) - 1]])
    return begins[new], ends[last]


def _answers(answer: pa.Table, alone: bool) -> tuple:
    """What was told of surroundings, or of strings ``alone``, in the order of their hashes: hash,
    doc_id and place of the block's first, and by offset whether its string starts earlier."""
    answer = answer.filter(pa.array(_array(answer, "alone") == alone))
    answer = answer.take(pa.array(np.argsort(_array(answer, "around"), kind="stable")))
    packed = np.frombuffer(b"".join(answer.column("offsets").to_pylist()), np.uint8)
    bits = np.unpackbits(packed.reshape(answer.num_rows, -(-OFFSETS // 8)), axis=1)
    told = (_array(answer, name) for name in ("around", "doc_id", "place"))
    return *told, bits[:, :OFFSETS].astype(bool)


def _found_around(answer: pa.Table, index, place, around, ids, sizes) -> tuple:
    """Text, begin and end of the bytes around anchors that strings starting earlier cover."""
    known, first_doc, first_place, bits = _answers(answer, False)
    mine = np.flatnonzero(_among(around, known))
    index, place = index[mine], place[mine]
    at = np.searchsorted(known, around[mine])
    size = np.array(sizes, dtype=np.int64)
    first = (first_doc[at] == ids[index]) & (first_place[at] == place)
    # a later place with the same surroundings: every string around it starts earlier
    later = ~first
    low = np.maximum(place[later] - OFFSETS + 1, 0)
    high = np.minimum(place[later], size[index[later]] - LENGTH)
    row, offset = np.nonzero(bits[at[first]])
    start = place[first][row] - offset
    return (
        np.concatenate([index[later][low <= high], index[first][row]]),
        np.concatenate([low[low <= high], start]),
        np.concatenate([high[low <= high] + LENGTH, start + LENGTH]),
    )


def _found_alone(answer: pa.Table, index, start, strings, ids) -> tuple:
    """The same of the strings around anchors that have many forms."""
    known, first_doc, first_start, bits = _answers(answer, True)
    mine = np.flatnonzero(_among(strings, known))
    index, start = index[mine], start[mine]
    at = np.searchsorted(known, strings[mine])
    later = bits[at, 0] | (first_doc[at] != ids[index]) | (first_start[at] != start)
    return index[later], start[later], start[later] + LENGTH


def _cut(placed: DataFrame, told: DataFrame, schema: str, finish: Callable) -> DataFrame:
    """Each document with the runs of its bytes that strings starting earlier cover."""

    def cut(rows: pa.Table, told: pa.Table) -> pa.Table:
        out: list[tuple] = []
        own = list(_documents(rows, _of_kind(told, 0)))
        nothing = np.empty(0, dtype=np.int64)
        spans: dict[int, tuple] = {}
        answers = [_table(b.as_py()) for b in _of_kind(told, 2).column("blob")]
        if answers:
            answer = pa.concat_tables(answers)
            texts = [b"" if copy else data for _, data, copy in own]
            ids = np.array([x[0] for x in own], dtype=np.int64)
            index, place, hashes, around = anchors(texts)
            known, many = _known(told, 1)
            each = np.flatnonzero(_among(_short(hashes), known[many]))
            found = [
                _found_around(answer, index, place, around, ids, [len(x) for x in texts]),
                _found_alone(answer, *strings_around(texts, index[each], place[each]), ids),
            ]
            whose, begins, ends = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.argsort(whose, kind="stable")
            whose, begins, ends = whose[order], begins[order], ends[order]
            edges = np.flatnonzero(np.diff(whose, prepend=-1, append=-1))
            for a, b in zip(edges, edges[1:], strict=False):
                spans[int(whose[a])] = covered(begins[a:b], ends[a:b])
        for i, (doc_id, data, copy) in enumerate(own):
            begins, ends = spans.get(i, (nothing, nothing))
            if copy and len(data) >= LENGTH:
                begins, ends = np.array([0]), np.array([len(data)])
            named = None if doc_id == NO_ID else doc_id
            out.append((named, *finish(data, begins, ends)))
        names = [part.split()[0] for part in schema.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        types = [kinds[part.split()[1]] for part in schema.split(", ")]
        columns = list(zip(*out, strict=True)) if out else [()] * len(names)
        return pa.table(
            {n: pa.array(c, t) for n, c, t in zip(names, columns, types, strict=True)}
        )

    blocks = placed.groupBy("block").cogroup(told.groupBy("block"))
    return blocks.applyInArrow(lean_cogroup(cut), schema)


def _kept(data: bytes, begins: np.ndarray, ends: np.ndarray) -> bytes:
    edges = [0, *np.stack([begins, ends], axis=1).ravel().tolist(), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _digest(data: bytes, begins: np.ndarray, ends: np.ndarray) -> tuple:
    kept = hashlib.sha256(_kept(data, begins, ends)).hexdigest()
    return len(data), int((ends - begins).sum()), len(begins), kept


def _whole(data: bytes, begins: np.ndarray, ends: np.ndarray) -> tuple:
    return len(data), int((ends - begins).sum()), len(begins), _kept(data, begins, ends)


def remove_repeats(
    documents: DataFrame,
    digest: bool = False,
    block_bytes: int = BLOCK_BYTES,
    many_forms: int = MANY_FORMS,
) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans and ``kept`` bytes (``digest``: their hash).

    Removed is every byte covered by a LENGTH-byte string that also starts earlier: in a document
    with a smaller doc_id, or further ahead in the same one. Strings never cross documents and
    are judged on the input. Whole copies of a text with a smaller doc_id are told by an
    aggregation of text hashes and removed without looking at their anchors. Rows with the same
    doc_id are not earlier than one another. A NULL text is empty, and a text shorter than
    LENGTH loses nothing. Other columns are ignored; an empty table gives an empty result.
    ``many_forms`` tells how anchors are compared, never what is found.
    """
    text = F.coalesce("text", F.lit(""))
    total = documents.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    parts = -(-blocks // SLICES)
    mark = F.sha2(F.encode(text, "utf-8"), 256)
    block = F.pmod(F.xxhash64("doc_id", mark), F.lit(blocks)).cast("long")
    rows = documents.select("doc_id", text.alias("text"), block.alias("block"))
    placed = _packed(rows).repartition(blocks, "block")
    marked = documents.select("doc_id", mark.alias("mark"), block.alias("block"))
    firsts = marked.groupBy("mark").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last")
    )
    copies = (
        marked.join(firsts.filter(F.col("last") > F.col("first")), "mark")
        .filter(F.col("doc_id") > F.col("first"))
        .select(
            "block",
            F.lit(0).alias("kind"),
            "doc_id",
            F.unhex("mark").alias("blob"),
        )
    )
    hashes = _tell_hashes(_ask_hashes(placed, copies, parts), 1, many_forms)
    told = copies.unionAll(hashes)
    alone = _tell_hashes(_ask_strings(placed, told, parts), 3, many_forms)
    strings = _tell_strings(_ask_surroundings(placed, told.unionAll(alone), parts))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, " + (
        "kept_sha256 string" if digest else "kept binary"
    )
    return _cut(placed, told.unionAll(strings), schema, _digest if digest else _whole)


def op7_suffix_dedup(documents: DataFrame) -> DataFrame:
    """Per document the bytes that strings starting earlier cover; see ``remove_repeats``."""
    return remove_repeats(documents, digest=True)
