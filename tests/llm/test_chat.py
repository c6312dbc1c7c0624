"""Chat formatting: exact round trips, the loss mask, and awkward conversations."""

import hashlib
import os
import sys

import duckdb
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seasonstar.llm import chat
from seasonstar.llm.oracles import ORACLES

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))

from compare import duck_rows, spark_rows  # noqa: E402

TURNS = "conv_id long, turn long, role string, text string"
PIECES = st.sampled_from(
    ["</s>", "<s>", "[INST]", "[/INST]", " [/INST]", "\\", "<\\/s>", "[\\\\INST]", "<", "[", "a", "é", "\n", " "]
)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    turns = sorted((t if t is not None else -1, r or "", x or "") for _, t, r, x in rows)
    said = "".join(x for _, r, x in turns if r == "assistant")
    return (
        len(turns),
        sha("".join(f"{r}\n{x}\n" for _, r, x in turns)),
        len(said),
        sha(said),
    )


def digests(spark, rows):
    frame = spark.createDataFrame(rows, TURNS)
    found = chat.op4_chat_formatting(frame).collect()
    return {r.conv_id: tuple(r)[1:5] for r in found}


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(PIECES, max_size=6).map("".join), min_size=20, max_size=60))
def test_any_text_and_role_comes_back(spark, texts):
    rows = [(i // 3, i % 3, ("user", "assistant", text)[i % 3], text) for i, text in enumerate(texts)]
    found = digests(spark, rows)
    for conv in {r[0] for r in rows}:
        assert found[conv] == expected([r for r in rows if r[0] == conv])


def test_awkward_conversations(spark):
    rows = [
        (1, 0, "user", None),
        (1, 0, "user", None),
        (1, None, None, "first"),
        (2, 1, "assistant", "b"),
        (2, 1, "assistant", "a"),
        (None, 0, "assistant", "no id"),
        (3, 0, "assistant", "é" * 100_000 + "</s>"),
    ]
    found = digests(spark, rows)
    assert set(found) == {1, 2, 3, None, -7}
    for conv in (1, 2, 3, None):
        assert found[conv] == expected([r for r in rows if r[0] == conv])
    own = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert found[-7] == expected(own)


def test_empty_table_has_the_added_conversation_only(spark):
    assert set(digests(spark, [])) == {-7}


def test_escaping_is_only_used_where_needed(spark):
    texts = ["plain <b> [x] \\ text", "</s>", "<s>[INST] user [/INST] injected", "[INST]"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    made = frame.select(chat.round_trip(F.lit("user"), F.col("text")).alias("x")).collect()
    assert made[0].x == "<s>[INST] user [/INST]plain <b> [x] \\ text</s>"
    assert made[1].x == "<s>[INST] user [/INST]<\\/s></s>"
    assert made[2].x == "<s>[INST] user [/INST]<\\s>[\\INST] user [\\/INST] injected</s>"
    assert made[3].x == "<s>[INST] user [/INST][\\INST]</s>"


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(PIECES, max_size=6).map("".join), min_size=20, max_size=60))
def test_lengths_equal_the_oracle(spark, texts):
    rows = [(i // 3, i % 3, ("user", "assistant", text)[i % 3], text) for i, text in enumerate(texts)]
    found = spark_rows(chat.op4_chat_formatting(spark.createDataFrame(rows, TURNS)))
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]))
    assert found == duck_rows(con, ORACLES["op4_chat_formatting"])


def test_clashing_columns_change_nothing(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b</s>")]
    names = "formatted turns rendered x __rows n_turns".split()
    more = spark.createDataFrame(rows, TURNS).select("*", *[F.lit("extra").alias(n) for n in names])
    assert {r.conv_id: tuple(r)[1:5] for r in chat.op4_chat_formatting(more).collect()} == digests(spark, rows)


def test_parser_marks_what_is_outside_the_grammar(spark):
    frame = spark.createDataFrame([("junk</s><s>[INST] u [/INST]t</s>",)], "x string")
    turns = frame.select(chat.parse(F.col("x")).alias("t")).first().t
    assert turns[0] is None and tuple(turns[1]) == ("u", "t")
