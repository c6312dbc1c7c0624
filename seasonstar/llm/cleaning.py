"""Line-first cleaning: rules per line, then a verdict on what is left of the document.

Each line is judged on its own by punctuation, navigation and boilerplate rules; lines
that fail go. A document that loses more than ``max_lost`` percent of its word characters
is rejected, and so is one that fails the base statistics. Everything is work of one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasonstar.llm.common import WORD, let

SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
#: Fixed rules. A line is too symbolic when more than this percent of its word characters
#: are neither letters, marks nor digits.
MARKS = r"[^\p{L}\p{M}\p{N}\x20\x09-\x0D]"
MAX_MARKS = 25
HAS_LETTER = r"\p{L}"
#: A line that ends like a sentence, perhaps within quotes or brackets.
SENTENCE_END = r"""[.!?:;,\x{2026}\x{3002}]["'\x{2019}\x{201D}\x{00BB})\]]*[\x20\x09-\x0D]*$"""
#: Menus: at least so many cells between separators, none of them longer than this; or a link
#: text in a line of few words.
SEPARATOR = r"[|\x{203A}\x{00BB}\x{2022}>]"
MENU_CELLS = 3
CELL_CHARS = 40
LINK = (
    r"(?i)(?:^|[^\p{L}\p{N}])(?:home|menu|sitemap|site map|log ?in|sign ?(?:in|up|out)|read more|"
    r"click here|next page|previous page|back to top|skip to (?:main )?content|share (?:this|on)|"
    r"follow us|contact us|about us|subscribe)(?:$|[^\p{L}\p{N}])"
)
LINK_WORDS = 12
#: Notices that come with a page, not with its text.
NOTICE = (
    r"(?i)all rights reserved|\x{00A9}|copyright (?:\(c\)|[12][0-9]{3})|cookies? policy|"
    r"uses? cookies|privacy policy|terms (?:of|and) (?:use|service|conditions)|"
    r"licensed under|powered by|lorem ipsum|enable javascript"
)
NOTICE_WORDS = 40
MIN_WORDS = 50
MAX_REPEAT = 50
MAX_LOST = 50


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, F.lit(SPACE), F.lit("")))


def n_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur at least twice, each word once.

    The windows of a row are sorted with their positions; a window equal to a neighbour is a
    repeated one. The positions, sorted again, add up to three words each, less the overlap
    with the window before. Time grows as n log n with the words of the row.
    """

    def same(a: Column, b: Column) -> Column:
        return (a["1"] == b["1"]) & (a["0"] == b["0"]) & (a["2"] == b["2"])

    def repeated(windows: Column) -> Column:
        marked = F.transform(
            windows,
            lambda x, k: F.when(
                same(x, F.get(windows, k + 1)) | same(x, F.get(windows, k - 1)), x["3"]
            ),
        )
        return F.sort_array(F.array_compact(marked))

    def covered(starts: Column) -> Column:
        return F.aggregate(
            starts,
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda a, at: F.struct(
                (a["n"] + at + 3 - F.greatest(a["end"], at)).alias("n"), (at + 3).alias("end")
            ),
            lambda a: a["n"],
        )

    n = F.size(words)
    windows = F.slice(
        F.arrays_zip(
            F.slice(words, 1, n),
            F.slice(words, 2, n),
            F.slice(words, 3, n),
            F.sequence(F.lit(0), n - 1),
        ),
        1,
        n - 2,
    )
    return F.when(
        n < 4, 0
    ).otherwise(let(F.sort_array(windows), lambda w: covered(repeated(w))))


def line_fails(line: Column) -> Column:
    """Whether a line breaks a punctuation, navigation or boilerplate rule."""

    def judged(words: Column) -> Column:
        marks = n_matches(line, MARKS) * 100 > word_chars(line) * MAX_MARKS
        fragment = (words < 4) & ~line.rlike(SENTENCE_END)
        cells = F.split(line, F.lit(SEPARATOR), F.lit(-1))
        short = F.forall(cells, lambda c: F.length(c) <= CELL_CHARS)
        menu = (line.rlike(SEPARATOR) & (F.size(cells) >= MENU_CELLS) & short) | (
            (words <= LINK_WORDS) & line.rlike(LINK)
        )
        notice = (words <= NOTICE_WORDS) & line.rlike(NOTICE)
        return ~line.rlike(HAS_LETTER) | marks | fragment | menu | notice

    return let(n_matches(line, WORD), judged)


def clean_lines(
    documents: DataFrame,
    text: str = "text",
    min_words: int = MIN_WORDS,
    max_repeat: int = MAX_REPEAT,
    max_lost: int = MAX_LOST,
) -> DataFrame:
    """``documents`` with its statistics, verdict and ``clean_text``, without any shuffle.

    Lines are what lies between line feeds; blank lines are neither judged nor lost. Added are
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_chars,
    n_failed_lines, kept and clean_text (columns of these names are replaced). A NULL text has
    no words, so it fails the base rule; its clean_text is NULL.
    """
    source = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_extract_all(source, F.lit(WORD), F.lit(0))
    lines = F.split(source, F.lit("\n"), F.lit(-1))
    worded = F.filter(lines, lambda x: x.rlike(WORD))
    failed = F.transform(lines, lambda x: x.rlike(WORD) & line_fails(x))

    def split_up(flags: Column) -> Column:
        good = F.filter(lines, lambda _, i: ~F.get(flags, i))
        bad = F.filter(lines, lambda _, i: F.get(flags, i))
        return F.struct(
            F.array_join(good, "\n").alias("clean"),
            F.size(bad).cast("long").alias("n_failed"),
            word_chars(F.array_join(bad, "\n")).cast("long").alias("lost"),
        )

    stats = documents.withColumns(
        {
            "__words": let(
                words, lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("repeat"))
            ),
            "__dup": let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))),
            "__split": let(failed, split_up),
            "word_chars": word_chars(source).cast("long"),
            "n_symbols": n_matches(source, SYMBOL).cast("long"),
        }
    )
    n_words, repeat = F.col("__words.n").cast("long"), F.col("__words.repeat").cast("long")
    base = (n_words < min_words) | (repeat * 100 > n_words * max_repeat)
    lost = F.col("__split.lost")
    return stats.withColumns(
        {
            "n_words": n_words,
            "n_dup_lines": F.col("__dup").cast("long"),
            "n_repeat_words": repeat,
            "base_failed": base,
            "n_failed_lines": F.col("__split.n_failed"),
            "lost_chars": lost,
            "kept": ~base & (lost * 100 <= F.col("word_chars") * max_lost),
            "clean_text": F.when(F.col(text).isNotNull(), F.col("__split.clean")),
        }
    ).drop("__words", "__dup", "__split")


def op2_cleaning(documents: DataFrame) -> DataFrame:
    return clean_lines(documents.select("doc_id", "text")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "n_failed_lines",
        "lost_chars",
    )
