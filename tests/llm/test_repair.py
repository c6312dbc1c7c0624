"""Repairs against plain dynamic programming over whole rows; awkward conversations."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from seasonstar.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"
#: Where a role initial leads, by state.
GRAMMAR = {"": "su", "s": "u", "u": "a", "a": "u"}
ROLE = {"u": "user", "a": "assistant"}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip(SPACE)
        if not bare:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """Cost, audit and repaired rows, by the best completion of every place and state."""
    best = {q: (0, "", ()) if q in ("", "a") else (10**9, "", ()) for q in GRAMMAR}
    for i in range(len(rows), -1, -1):
        here = dict(best) if i == len(rows) else {}
        if i < len(rows):
            role, text = rows[i][2:]
            more = 3 if found[i] == "truncated" else 0
            for q, nexts in GRAMMAR.items():
                cost, audit, said = best[q]
                options = [(cost + 4, "D" + audit, said)]
                if found[i] not in ("blank", "duplicate"):
                    if role[:1] and role[:1] in nexts:
                        cost, audit, said = best[role[:1]]
                        options.append((cost + more, "K" + audit, ((role, text), *said)))
                    to = nexts[-1]
                    cost, audit, said = best[to]
                    options.append((cost + 3 + more, "R" + audit, ((ROLE[to], text), *said)))
                here[q] = min(options, key=lambda o: o[:2])
        for _ in range(4):
            for q, nexts in GRAMMAR.items():
                to = nexts[-1]
                cost, audit, said = here[to]
                here[q] = min(here[q], (cost + 3, "I" + audit, ((ROLE[to], ""), *said)), key=lambda o: o[:2])
        best = here
    return best[""]


def brute(source, rows=None):
    rows = damaged(source) if rows is None else rows
    out = []
    for conv in {r[0] for r in source}:
        own = [r for r in rows if r[0] == conv]
        digest = lambda r: hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, digest(r)))
        turns = [r[1] for r in own if r[1] is not None]
        found = faults(own)
        roles = [r[2][:1] for r in own]
        cost, audit, said = cheapest(own, found)
        assert re.fullmatch("(s?(ua)+)?", "".join(role[:1] for role, _ in said))
        out.append(
            (
                conv,
                max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                *(found.count(k) for k in ("blank", "duplicate", "truncated")),
                sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False)),
                cost,
                audit,
                hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest(),
            )
        )
    return sorted(out, key=repr)


def result(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def conversations(count, seed, longest=12, first=0):
    rnd = random.Random(seed)
    texts = ["Yes.", "No!", "why", "", "  \n", "It is so. \t", "ends open ", "Really? ", "déjà vu…"]
    rows = []
    for conv in range(first, first + count):
        for turn in range(rnd.randrange(1, longest)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "User"])
            rows.append((conv, turn, role, rnd.choice(texts)))
    return rows


@pytest.mark.parametrize("seed", range(40))
def test_prices_and_audits_equal_dynamic_programming(seed):
    rnd = random.Random(seed)
    for _ in range(60):
        n = rnd.randrange(0, 14)
        rows = [(1, i, rnd.choice("suax") + "x", f"{i}{rnd.choice(['.', ''])}") for i in range(n)]
        found = [rnd.choice(["", "", "blank", "duplicate"]) or f for f in faults(rows)]
        flag = {"": 0, "blank": 4, "duplicate": 8, "truncated": 16}
        codes = bytes("suax".index(r[2][0]) + flag[f] for r, f in zip(rows, found, strict=True))
        assert repair.repaired(codes) == cheapest(rows, found)[:2]


def test_equals_brute_force(spark):
    rows = conversations(400, 1)
    assert result(repair.op13_repair(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute(rows)


def test_given_conversations(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert result(repair.op13_repair(rows)) == brute([tuple(r) for r in rows.collect()])


def test_awkward_rows(spark):
    rows = conversations(30, 2)
    rows += [(None, 1, "user", "Hi."), (None, 2, None, None), (None, None, "assistant", "Ho.")]
    rows += [(100, None, "user", "Hi."), (100, None, "user", "Hi."), (100, None, "assistant", "a.")]
    rows += [(101, 5, "user", "same."), (101, 5, "assistant", "turn."), (101, 5, "user", "other.")] * 2
    rows += [(102, -(2**63), "user", "a."), (103, 2**63 - 1, None, "b.")]
    rows += [(104, 1, "user", "long. " * 200_000), (104, 2, "assistant", "x" * 500_000)]
    rows += [(105, i, "user" if i % 2 == 0 else "assistant", f"{i}.") for i in range(3000)]
    rows += [(106, 1, "user", " \t" * 300_000 + "z")]
    plain = spark.createDataFrame(rows, SCHEMA)
    expected = brute(rows)
    assert result(repair.op13_repair(plain)) == expected
    names = "digest n code seen kind edits state last gaps audit __kind".split()
    more = plain.select("*", *[F.lit("extra").alias(n) for n in names])
    assert result(repair.op13_repair(more)) == expected


def test_conversations_without_rows_after_damage(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hi."), (gone, 0, "assistant", "Ho.")]
    empty = hashlib.sha256(b"").hexdigest()
    frame = spark.createDataFrame(rows, SCHEMA)
    assert result(repair.op13_repair(frame)) == [(gone, 0, 0, 0, 0, 0, 0, "", empty)]
    assert repair.op13_repair(frame.limit(0)).collect() == []


def test_repair_alone_takes_gaps_beyond_a_long(spark):
    rows = [(1, -(2**63), "user", "a."), (1, 2**63 - 1, "assistant", "b.")]
    (row,) = repair.repair(spark.createDataFrame(rows, SCHEMA)).collect()
    assert row["gaps"] is None and row["audit"] == "KK"
    assert row["repaired_sha256"] == hashlib.sha256(b"user:a.\nassistant:b.").hexdigest()


def test_work_grows_with_the_rows():
    visits = []
    for n in (500, 5000):
        codes = bytes(random.Random(n).choices(range(4), k=n))
        calls = 0
        arcs = repair._arcs

        def counted(*args):
            nonlocal calls
            calls += 1
            return arcs(*args)

        repair._arcs = counted
        try:
            repair.prices(codes)
        finally:
            repair._arcs = arcs
        visits.append(calls)
    assert visits[1] < 12 * visits[0]
