"""Chat formatting with a grammar round trip.

Grammar of the formatted text::

    conversation = turn*
    turn         = "<s>[INST] " role " [/INST]" text "</s>"

Roles and texts may hold the control strings ``<s> </s> [INST] [/INST]``. A turn is
first rendered as it is and parsed back; the parser reads every control string as a mark, so a turn
with one in its role or text is outside the grammar. If the parser does not return the same role
and text, the content is escaped: every control string, with however many backslashes
after its first character, gets one backslash more. The parser takes one backslash out
of every control string that has one, so escaping any text and parsing it gives the
text back. Rendering goes on through these forms until the turn comes back identical.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasonstar.llm.common import hex_sha256, let

OPEN = "<s>[INST] "
MIDDLE = " [/INST]"
CLOSE = "</s>"
#: A control string split after its first character, with the escapes that may stand there.
CONTROL = r"([<\[])(\\*)(/?s>|/?INST\])"
BARE = r"</?s>|\[/?INST\]"
ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(CONTROL), F.lit(r"$1\\$2$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(ESCAPED), F.lit("$1$2$3"))


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MIDDLE), text, F.lit(CLOSE))


def _parsed_turn(piece: Column) -> Column:
    """Role and text of a turn without its closing mark; NULL where the grammar is broken."""
    at = F.instr(piece, MIDDLE)
    fits = piece.startswith(OPEN) & (at > len(OPEN))
    role = F.substr(piece, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)
    text = F.substr(piece, at + len(MIDDLE))
    inside = role.rlike(BARE) | text.rlike(BARE)
    return F.when(
        fits & ~inside, F.struct(unescape(role).alias("role"), unescape(text).alias("text"))
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of role and text.

    Deterministic: closing marks end turns, the first middle mark of a turn ends its role, and
    no other mark may stand in a turn. A text outside the grammar gives NULL in the place of
    the broken turn.
    """
    pieces = F.split(formatted, F.lit(CLOSE), F.lit(-1))
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), _parsed_turn)


def round_trip(role: Column, text: Column) -> Column:
    """The turn as it has to be rendered to be parsed back identically."""

    def same(rendered: Column) -> Column:
        source = F.array(F.struct(role.alias("role"), text.alias("text")))
        return F.coalesce(parse(rendered) == source, F.lit(False))

    plain = render_turn(role, text)
    safe = render_turn(escape(role), escape(text))
    return F.when(same(plain), plain).otherwise(
        let(
            safe,
            lambda x: F.when(same(x), x).otherwise(
                F.raise_error(F.lit("a turn does not come back from its formatted text"))
            ),
        )
    )


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per ``conv_id``: ``formatted`` and the ``turns`` parsed from it.

    Rows are ordered by ``turn``, rows with the same turn by role and text, a NULL turn
    first; repeated rows stay. NULL roles and texts are empty. Escaping and its round trip are
    work of single rows, before the shuffle; a conversation, which is one output text, is
    then put together in one row and parsed once more as a whole, and a result that differs
    from its source raises. An empty table gives an empty result; other columns are ignored.
    """
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("rendered", round_trip(F.col("role"), F.col("text")))
    whole = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text", "rendered"))).alias("__rows")
    )
    formatted = F.array_join(F.transform("__rows", lambda x: x["rendered"]), "")
    source = F.transform(
        "__rows", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))
    )
    parsed = whole.select("conv_id", formatted.alias("formatted"), source.alias("__source")).select(
        "conv_id", "formatted", "__source", parse(F.col("formatted")).alias("__turns")
    )
    broken = F.raise_error(F.lit("a conversation does not come back from its formatted text"))
    return parsed.select(
        "conv_id",
        "formatted",
        F.when(F.col("__turns") == F.col("__source"), F.col("__turns"))
        .otherwise(broken)
        .alias("turns"),
    )


def masked_text(turns: Column) -> Column:
    """All text under the loss mask: what assistants say, in order."""
    said = F.filter(turns, lambda t: t["role"] == "assistant")
    return F.array_join(F.transform(said, lambda t: t["text"]), "")


def op4_chat_formatting(conversations: DataFrame) -> DataFrame:
    """Digest of the formatted conversations, with conversation -7 added."""
    spark = conversations.sparkSession
    extra = spark.range(2, numPartitions=1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    rows = conversations.select("conv_id", F.col("turn").cast("long"), "role", "text")
    done = format_conversations(rows.unionByName(extra))
    spoken = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    masked = masked_text(F.col("turns"))
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        hex_sha256(spoken).alias("turns_sha256"),
        F.length(masked).cast("long").alias("loss_chars"),
        hex_sha256(masked).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
