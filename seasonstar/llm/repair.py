"""Conversation structure repair by an auction shortest-path algorithm.

The rows of a conversation and the states of the wanted grammar ``(s?(ua)+)?`` of role initials span a
lattice: a node says how many rows are done and which state the roles so far lead to, an arc is an
edit with its cost. Every node has a price. From an origin a path grows along arcs whose cost
equals the difference of their ends' prices; where there is none, the price of the last node rises
to what its best arc asks for and the path gives that node up. Once the path meets a node whose price
is final, the prices along it are exact distances to the end. Origins are taken from the last rows to
the first, so all prices converge to distances. An arc is then tight exactly if it lies on a cheapest
way from its start, and following the least initial of the tight arcs gives the least audit.

Spark finds faults and orders rows without their texts: a row is its turn, a digest of role and text, and a
byte that says what matters of it. A conversation's bytes are its lattice. The texts are shuffled once, to
be read in order by the digest of the repaired conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasonstar.llm.common import sent_by_value

sent_by_value(__name__)

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NOT_SPACE = r"[^\x20\x09-\x0D]"
#: The last character that is no white space, if it ends no sentence.
OPEN_END = r"[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z"
#: A row's byte: its initial's place in INITIALS, and flags.
INITIALS = "sua"
OTHER = len(INITIALS)
BLANK, DUPLICATE, OPEN = 4, 8, 16
#: States: nothing said yet, system said, user said, assistant said; and where initials lead.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {
    START: {"s": SYSTEM, "u": USER},
    SYSTEM: {"u": USER},
    USER: {"a": ASSISTANT},
    ASSISTANT: {"u": USER},
}
ENDS = (START, ASSISTANT)
#: The role that may be said next in each state, other than the first system row.
SAID = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
STATES = len(NEXT)
LEGAL = ("su", "ua", "au")
#: Conversations of up to so many rows take their edits from others of the same bytes in a task.
SHORT = 64
EMPTY = hashlib.sha256(b"").hexdigest()


def _arcs(codes: bytes, node: int) -> list[tuple[str, int, int]]:
    """Arcs of a node: initial of the edit, cost, and where it leads."""
    row, state = divmod(node, STATES)
    following = NEXT[state][SAID[state][0]]
    out = []
    if row < len(codes):
        code, after = codes[row], (row + 1) * STATES
        out.append(("D", DELETE, after + state))
        if not code & (BLANK | DUPLICATE):
            more = TRUNCATED if code & OPEN else 0
            own = NEXT[state].get((INITIALS + "-")[code & 3])
            if own is not None:
                out.append(("K", more, after + own))
            out.append(("R", REROLE + more, after + following))
    elif state in ENDS:
        out.append(("", 0, STATES * (len(codes) + 1)))
    out.append(("I", INSERT, row * STATES + following))
    return out


def prices(codes: bytes) -> list[int]:
    """Distance of every node of the lattice to its end, by auctions from the last rows to the first."""
    end = STATES * (len(codes) + 1)
    price = [0] * (end + 1)
    final = bytearray(end + 1)
    final[end] = 1
    for row in range(len(codes), -1, -1):
        first = row * STATES
        if row < len(codes):
            # what all nodes of the next row cost at least, these cost at least
            price[first : first + STATES] = [min(price[first + STATES : first + 2 * STATES])] * STATES
        for origin in range(first, first + STATES):
            path = [origin]
            while not final[path[-1]]:
                node = path[-1]
                best, to = min((cost + price[to], to) for _, cost, to in _arcs(codes, node))
                if price[node] < best:
                    price[node] = best
                    if len(path) > 1:
                        path.pop()
                else:
                    path.append(to)
            for node in path:
                final[node] = 1
    return price


def repaired(codes: bytes) -> tuple[int, str]:
    """Least cost, and of the cheapest edits' initials the ASCII-least."""
    price = prices(codes)
    node, end, audit = START, len(price) - 1, []
    while node != end:
        edit, _, node = min(
            (edit, cost, to)
            for edit, cost, to in _arcs(codes, node)
            if price[node] == cost + price[to]
        )
        audit.append(edit)
    return price[START], "".join(audit)


def inserted_role(initials: str) -> str:
    """The role that an edit other than Keep or Delete gives, after a last role initial or none."""
    return "assistant" if initials == "u" else "user"


def _text(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(" "))


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults put in, by the CRC-32 of ``conv_id:turn``.

    Of 20 remainders 0 drops the row, 1 empties its text, 2 removes its sentence ends, 3 repeats it
    and 4 makes the user say it. A NULL is one space, in roles and texts as in the key.
    """
    number = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    key = F.concat(number("conv_id"), F.lit(":"), number("turn"))
    kind = F.crc32(F.encode(key, "utf-8")) % 20
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        _text("role").alias("role"),
        _text("text").alias("text"),
        kind.alias("__kind"),
    ).filter(F.col("__kind") != 0)
    text = (
        F.when(F.col("__kind") == 1, "")
        .when(F.col("__kind") == 2, F.regexp_replace("text", r"[.!?]", ""))
        .otherwise(F.col("text"))
    )
    role = F.when(F.col("__kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("__kind") == 3, 2).otherwise(1)
    copies = F.explode(F.array_repeat(F.lit(1), times))
    return rows.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("__copy")
    ).drop("__copy")


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with ``digest``, of role and text: equal for equal rows, and the order of tied turns."""
    whole = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    clean = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        _text("role").alias("role"),
        _text("text").alias("text"),
    )
    return clean.withColumn("digest", F.unhex(F.sha2(F.encode(whole, "utf-8"), 256)))


def _coded(keyed: DataFrame) -> DataFrame:
    """A row per conversation, turn and digest: how often it occurs and its byte, without the text."""
    at = F.instr(F.lit(INITIALS), F.substring("role", 1, 1))
    initial = F.when((at == 0) | (F.col("role") == ""), OTHER).otherwise(at - 1)
    fault = F.when(~F.col("text").rlike(NOT_SPACE), BLANK).when(
        F.col("text").rlike(OPEN_END), OPEN
    )
    code = initial + F.coalesce(fault, F.lit(0))
    rows = keyed.groupBy("conv_id", "turn", "digest").agg(
        F.count(F.lit(1)).alias("n"), F.first(code).alias("code")
    )
    # rows of one digest are rows of one conversation, which is one row of the result anyway
    same = Window.partitionBy("conv_id", "digest").orderBy(F.asc_nulls_first("turn"))
    return rows.withColumn("seen", F.row_number().over(same) > 1)


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
_COUNTED = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
EDITS = f"conv_id bigint, turn bigint, digest binary, edits string, state string, last boolean, {_COUNTED}"
REPAIRED = f"conv_id bigint, {_COUNTED}, repaired_sha256 string"
ARROW = {"bigint": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [part.split() for part in schema.split(", ")]
    columns = zip(*rows, strict=True)
    arrays = [pa.array(c, ARROW[kind]) for c, (_, kind) in zip(columns, fields, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in fields])


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of sorted rows, a conversation at a time; counts, cost and audit in its last row."""
    known = lru_cache(maxsize=1 << 14)(repaired)
    rows: list[tuple] = []
    codes = bytearray()
    out: list[tuple] = []

    def flush() -> None:
        turns = [turn for _, turn, _, _ in rows if turn is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults = [c & (BLANK | DUPLICATE | OPEN) for c in codes]
        spoken = (INITIALS + "-").__getitem__
        illegal = sum(
            spoken(a & 3) + spoken(b & 3) not in LEGAL for a, b in zip(codes, codes[1:])
        )
        cost, audit = (known if len(codes) <= SHORT else repaired)(bytes(codes))
        at, state, done = 0, "", 0
        for place, (conv, turn, digest, n) in enumerate(rows):
            last = place == len(rows) - 1
            before, start = state, at
            left = n
            while left or (last and at < len(audit)):
                edit = audit[at]
                if edit != "D":
                    code = codes[done] if edit == "K" else 0
                    state = spoken(code & 3) if edit == "K" else inserted_role(state)[0]
                if edit != "I":
                    left -= 1
                    done += 1
                at += 1
            counts = (None,) * 7
            if last:
                gaps = gaps if gaps < 1 << 63 else None
                counts = (
                    gaps,
                    sum(f & BLANK > 0 for f in faults),
                    sum(f & DUPLICATE > 0 for f in faults),
                    sum(f & OPEN > 0 for f in faults),
                    illegal,
                    cost,
                    audit,
                )
            out.append((conv, turn, digest, audit[start:at], before, last, *counts))
        rows.clear()
        codes.clear()

    for batch in batches:
        for conv, turn, digest, n, code, seen in zip(
            *(batch.column(c).to_pylist() for c in ("conv_id", "turn", "digest", "n", "code", "seen"))
        ):
            if rows and rows[-1][0] != conv:
                flush()
                if len(out) >= 1000:
                    yield _rows(out, EDITS)
                    out.clear()
            again = code if code & BLANK else (code & 3) | DUPLICATE
            rows.append((conv, turn, digest, n))
            codes.append(again if seen else code)
            codes.extend([again] * (n - 1))
    if rows:
        flush()
    if out:
        yield _rows(out, EDITS)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of every conversation, of edits and the texts that follow them in sorted rows."""
    names = ["edits", "state", "last", "role", "text"]
    counted = ["conv_id", *COUNTS]
    found: list[tuple] = []
    pending, state, copies, counts = "", "", 0, ()
    last, sha, some = False, hashlib.sha256(), False

    def say(role: str, text: str) -> None:
        nonlocal some, state
        sha.update((("\n" if some else "") + role + ":" + text).encode("utf-8", "replace"))
        some, state = True, role[:1]

    def insert() -> None:
        nonlocal pending
        while pending[:1] == "I":
            say(inserted_role(state), "")
            pending = pending[1:]

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in names + counted]
        for edits, before, is_last, role, text, *more in zip(*columns, strict=True):
            if edits is not None:
                pending, state, last, counts = edits, before, is_last, tuple(more)
                copies = len(pending) - pending.count("I")
                insert()
                continue
            edit, pending = pending[0], pending[1:]
            if edit != "D":
                say(role if edit == "K" else inserted_role(state), text)
            insert()
            copies -= 1
            if last and not copies:
                found.append((*counts, sha.hexdigest()))
                sha, some = hashlib.sha256(), False
        if found:
            yield _rows(found, REPAIRED)
            found = []


def edits(rows: DataFrame) -> DataFrame:
    """The cheapest edits of every conversation, a row per conversation, turn and digest (see EDITS).

    ``rows`` has ``conv_id, turn, role, text``; other columns are ignored, a NULL role or text is one
    space, and rows of a NULL conv_id are a conversation. Rows are taken by turn, NULL first, and
    tied turns by a digest of role and text, so copies stand together. ``edits`` are the initials of
    this row's edits with the insertions around them, ``state`` the last role initial before. The last
    row of a conversation has its counts, cost and audit; ``gaps`` from 2 ** 63 up are NULL.
    """
    return _edits(_coded(_keyed(rows)))


def _edits(coded: DataFrame) -> DataFrame:
    order = ["conv_id", F.asc_nulls_first("turn"), "digest"]
    dealt = coded.repartition("conv_id").sortWithinPartitions(*order)
    return dealt.select("conv_id", "turn", "digest", "n", "code", "seen").mapInArrow(_solved, EDITS)


def repair(rows: DataFrame) -> DataFrame:
    """The repaired conversations' digest with counts, a row per conversation of ``rows``.

    The result has ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` and
    ``repaired_sha256``; see ``edits`` for NULLs, ties and repeated rows. An empty table gives an empty
    result. The digest and the audit are values of one row, so the rows of a conversation are read one
    after the other by one task; it keeps a byte of a row, its turn and digest, and no texts.
    """
    keyed = _keyed(rows)
    counted = ["conv_id", *COUNTS]
    plan = _edits(_coded(keyed)).select(
        *counted, "turn", "digest", F.lit(0).alias("kind"), "edits", "state", "last",
        _nothing("role"), _nothing("text"),
    )
    texts = keyed.select(
        "conv_id", *[_nothing(name, "bigint") for name in COUNTS[:-1]], _nothing("audit"),
        "turn", "digest", F.lit(1).alias("kind"),
        _nothing("edits"), _nothing("state"), _nothing("last", "boolean"), "role", "text",
    )
    order = ["conv_id", F.asc_nulls_first("turn"), "digest", "kind"]
    merged = plan.unionAll(texts).repartition("conv_id").sortWithinPartitions(*order)
    return merged.mapInArrow(_hashed, REPAIRED)


def _nothing(name: str, kind: str = "string") -> Column:
    return F.lit(None).cast(kind).alias(name)


def op13_repair(conversations: DataFrame) -> DataFrame:
    """Digest of the repaired conversations, after damage; see ``damage`` and ``repair``.

    Every conv_id has a row, one whose rows were all dropped zeros and the digest of nothing.
    """
    done = repair(damage(conversations))
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    joined = ids.alias("i").join(done.alias("d"), F.col("i.conv_id").eqNullSafe(F.col("d.conv_id")), "left")
    gone = F.col("audit").isNull()
    zeros = "blank duplicate truncated illegal cost".split()
    return joined.select(
        F.col("i.conv_id").alias("conv_id"),
        F.when(gone, F.lit(0)).otherwise(F.col("gaps")).cast("long").alias("gaps"),
        *[F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name) for name in zeros],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(EMPTY)).alias("repaired_sha256"),
    )
