"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

Two first-order models over characters, one of random strings and one of ordinary
identifiers, are trained from labelled samples: values that the patterns find, and words
outside of them. The first also learns the usual alphabets of random strings in fixed shares, as
the values found may all be of one kind. Long tokens whose likelihood under the first exceeds that under the second by
enough per character are reported as kind ``markov``. All of it is expressions of one row; the
model is a table of fixed size.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasonstar.llm.common import hex_sha256, let

#: Fixed patterns, in the order in which kinds are listed. A failing short value still uses up
#: its text, so the least length of ``assign`` is tested afterwards; a short run of the other
#: two hides no longer one, so theirs stands in the pattern.
ASSIGN = (
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
MIN_ASSIGN = 8
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")
#: Tokens that the models judge.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
#: Whole tokens with letters and digits: what the models judge, and neither learns as ordinary.
MIXED = (
    r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}"
)
#: Ordinary identifiers that the second model is trained on.
IDENTIFIER = r"(?<![A-Za-z0-9])[A-Za-z][A-Za-z0-9_-]{5,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
#: Characters that have a number: 0 stands for any other one and for the start.
WIDTH = len(ALPHABET) + 1
#: Labelled strings of each kind that a model is trained on at most, and the documents that
#: ordinary identifiers are taken from (in expectation).
MAX_SAMPLES = 20_000
SAMPLE_DOCUMENTS = 2_000
#: Alphabets that random strings are written in, by kind. The random model counts every kind with
#: KIND_PAIRS pairs of characters, dealt evenly to its alphabets and in them to all pairs, as
#: strings of KIND_LENGTH characters have them on average; and the values found with as many
#: pairs at most. So what the patterns find cannot crowd out the kinds they do not find. The
#: signs - _ / are left to what is found: they join words and paths, which would look random.
RANDOM_KINDS = {
    "hex": ("0123456789abcdef", "0123456789ABCDEF"),
    "base32": (ALPHABET[:26] + "234567",),
    "base62": (ALPHABET[:62],),
    "base64": (ALPHABET[:62] + "+",),
}
KIND_PAIRS, KIND_LENGTH = 100_000, 32
#: Log-likelihood ratio, in nats per character, from which a token counts as random.
MIN_RATIO = 0.5
#: Imagined observations: of every character, and of what follows a character, in the shares that
#: characters have anyway. So no probability is zero, and what never follows an unseen character
#: is judged by how rare it is.
PRIOR, FOLLOWERS = 0.5, 20.0

#: Values whose running results are made at a time.
CHUNK = 256
_NONE = "array<struct<start:int,kind:int,end:int>>"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def running(values: Column, combine, start: int = 0) -> Column:
    """``combine`` of all values up to each one, in arrays of any length.

    Spark appends to an array by copying it, so prefixes are made in chunks of CHUNK values and the
    chunks' own totals are put before them: work per value stays the same in long arrays.
    """
    numbers = "array<int>"

    def prefixes(items: Column, inclusive: bool) -> Column:
        first = F.struct(F.lit(start).alias("total"), F.array().cast(numbers).alias("out"))

        def step(state: Column, x: Column) -> Column:
            total = combine(state["total"], x)
            shown = total if inclusive else state["total"]
            return F.struct(
                total.alias("total"), F.concat(state["out"], F.array(shown)).alias("out")
            )

        return F.aggregate(items, first, step, lambda s: s["out"])

    def joined(chunks: Column) -> Column:
        before = prefixes(F.transform(chunks, lambda c: F.element_at(c, -1)), inclusive=False)
        return let(
            before,
            lambda b: F.flatten(
                F.transform(chunks, lambda c, k: F.transform(c, lambda x: combine(F.get(b, k), x)))
            ),
        )

    last = ((F.size(values) - 1) / CHUNK).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(values, k * CHUNK + 1, CHUNK))
    chunks = F.transform(cut, lambda c: prefixes(c, inclusive=True))
    return F.when(F.size(values) == 0, F.array().cast(numbers)).otherwise(let(chunks, joined))


def _spans(text: Column, pattern: str, kind: int, good) -> Column:
    """Matches of ``pattern`` as an array of (start, kind, end), if ``good(match, i, values)`` holds.

    The pieces between the matches and the matches themselves, added up in turn, give the
    places in code points. Texts without a match are not split at all.
    """
    nothing = F.array().cast(_NONE)

    def placed(parts: Column) -> Column:
        sizes = F.transform(parts["match"], lambda m: F.length(m))
        lengths = F.transform(sizes, lambda n, i: n + F.length(F.get(parts["piece"], i)))

        def spans(ends: Column) -> Column:
            every = F.transform(
                parts["match"],
                lambda m, i: F.when(
                    good(m, i, parts["value"]),
                    F.struct(
                        (F.get(ends, i) - F.length(m)).alias("start"),
                        F.lit(kind).alias("kind"),
                        F.get(ends, i).alias("end"),
                    ),
                ),
            )
            return F.filter(every, lambda x: x.isNotNull())

        return let(let(lengths, lambda n: running(n, lambda a, b: a + b)), spans)

    value = _all(text, pattern, 2) if kind == 0 else F.array().cast("array<string>")
    parts = F.struct(
        F.split(text, F.lit(pattern), F.lit(-1)).alias("piece"),
        _all(text, pattern).alias("match"),
        value.alias("value"),
    )
    return F.when(text.rlike(pattern), let(parts, placed)).otherwise(nothing)


def base_spans(text: Column) -> Column:
    """Spans of the three fixed kinds, by start and kind."""
    every = lambda m, i, v: F.lit(True)
    enough = lambda m, i, v: F.length(F.get(v, i)) >= MIN_ASSIGN
    return F.sort_array(
        F.concat(
            _spans(text, ASSIGN, 0, enough),
            _spans(text, ACCESS, 1, every),
            _spans(text, HEX, 2, every),
        )
    )


def _numbers(token: Column) -> Column:
    """A token's characters by number, after the number of the start."""
    chars = F.filter(F.split(token, F.lit(""), F.lit(-1)), lambda c: c != "")
    codes = F.transform(chars, lambda c: F.instr(F.lit(ALPHABET), c))
    return F.concat(F.array(F.lit(0)), codes)


def _pairs(numbers: Column) -> Column:
    """Each character with the one before it, as one number."""
    return F.transform(
        F.slice(numbers, 2, F.size(numbers) - 1),
        lambda c, i: F.get(numbers, i) * WIDTH + c,
    )


def labelled_samples(
    documents: DataFrame, max_samples: int = MAX_SAMPLES, sample_documents: int = SAMPLE_DOCUMENTS
) -> DataFrame:
    """At most ``max_samples`` distinct strings of each ``label``: 1 random, 0 ordinary.

    Values of pattern matches anywhere are label 1. Identifiers of documents without any match,
    from about ``sample_documents`` documents chosen by a hash of their text, are label 0; tokens
    like those to be judged are cut out before, as a random one that no pattern finds may be among
    them. Prose hardly has digits or joined words, so every identifier also gives a form with them,
    see ``_formed``. Of each label those with the smallest hashes are kept, so reruns agree. A
    string counts once, however many copies there are.
    """
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(text.alias("text"))
    matched = rows.filter(
        F.col("text").rlike(ASSIGN) | F.col("text").rlike(ACCESS) | F.col("text").rlike(HEX)
    ).select(
        F.explode(
            F.concat(
                F.filter(_all(F.col("text"), ASSIGN, 2), lambda v: F.length(v) >= MIN_ASSIGN),
                _all(F.col("text"), ACCESS),
                _all(F.col("text"), HEX),
            )
        ).alias("value")
    )
    count = max(rows.count(), 1)
    scale = 1 << 30
    share = min(scale, sample_documents * scale // count)
    plain = (
        rows.filter(F.pmod(F.xxhash64("text"), F.lit(scale)) < share)
        .filter(
            ~(F.col("text").rlike(ASSIGN) | F.col("text").rlike(ACCESS) | F.col("text").rlike(HEX))
        )
        .select(
            F.explode(
                _all(F.regexp_replace("text", F.lit(MIXED), F.lit(" ")), IDENTIFIER)
            ).alias("value")
        )
    )

    def some(values: DataFrame, label: int, most: int) -> DataFrame:
        kept = values.distinct().orderBy(F.xxhash64("value"), "value").limit(most)
        return kept.select(F.lit(label).alias("label"), "value")

    names = some(plain, 0, max_samples // 2)
    forms = names.select("label", _formed(F.col("value")).alias("value"))
    return some(matched, 1, max_samples).unionAll(names).unionAll(forms)


def _formed(word: Column) -> Column:
    """An ordinary form with digits, signs or joined words; the word's hash says which one."""
    pick = lambda seed, most: F.pmod(F.xxhash64(word, F.lit(seed)), F.lit(most))
    two = lambda seed, most: F.lpad(pick(seed, most).cast("string"), 2, "0")
    year = F.concat((pick(2, 60) + 1970).cast("string"))
    number, small = pick(3, 4096).cast("string"), pick(4, 20).cast("string")
    day = F.concat_ws("-", year, two(5, 13), two(6, 32))
    time = F.concat_ws("-", two(7, 24), two(8, 60), two(9, 60))
    title = F.initcap(F.regexp_replace(word, "[_-]", ""))
    half = F.lower(F.substring(word, 1, 4))
    forms = [
        F.concat(word, small),
        F.concat_ws("_", half, F.lower(word), year),
        F.concat_ws("_", word, F.concat(number, F.lit("x"), pick(10, 4096).cast("string")), half),
        F.concat(half, title, small, title),
        F.concat(half, title, F.initcap(half)),
        F.concat_ws("-", F.upper(word), small, F.upper(half)),
        F.concat_ws("-", F.upper(half), number, small, word),
        F.concat(day, F.lit("T"), time, F.lit("Z")),
        F.concat_ws("_", half, day, time),
        F.concat_ws("-", word, F.concat(F.lit("v"), small), small, number),
    ]
    return F.get(F.array(*forms), pick(1, len(forms)).cast("int"))


def random_pairs() -> list[float]:
    """Pairs of characters, by number, of random strings of every kind."""
    out = [0.0] * (WIDTH * WIDTH)
    for alphabets in RANDOM_KINDS.values():
        for letters in alphabets:
            numbers = [ALPHABET.index(c) + 1 for c in letters]
            strings = KIND_PAIRS / KIND_LENGTH / len(alphabets)
            for first in numbers:
                out[first] += strings / len(numbers)
                for second in numbers:
                    pairs = strings * (KIND_LENGTH - 1) / len(numbers) ** 2
                    out[first * WIDTH + second] += pairs
    return out


def train(
    samples: DataFrame, prior: float = PRIOR, followers: float = FOLLOWERS
) -> list[float]:
    """Log-likelihood ratio of every pair of characters, random over ordinary.

    ``samples`` has ``label`` and ``value``. What comes to the driver is a count for each label
    and pair, at most 2 * WIDTH ** 2. The random model knows the pairs of RANDOM_KINDS besides its
    samples, which weigh as much as one kind at most. Without samples of label 0, its model is
    uniform.
    """
    counted = (
        samples.select("label", F.explode(let(_numbers(F.col("value")), _pairs)).alias("pair"))
        .groupBy("label", "pair")
        .count()
        .collect()
    )
    tables = {label: [0.0] * (WIDTH * WIDTH) for label in (0, 1)}
    for label, pair, count in counted:
        tables[label][pair] += count
    weight = min(1.0, KIND_PAIRS / max(sum(tables[1]), 1))
    tables[1] = [weight * n + m for n, m in zip(tables[1], random_pairs(), strict=True)]
    logs = {}
    for label, pairs in tables.items():
        seen = [prior + sum(pairs[c::WIDTH]) for c in range(WIDTH)]
        share = [n / sum(seen) for n in seen]
        after = [sum(pairs[i * WIDTH : (i + 1) * WIDTH]) + followers for i in range(WIDTH)]
        logs[label] = [
            log((n + followers * share[i % WIDTH]) / after[i // WIDTH]) for i, n in enumerate(pairs)
        ]
    return [a - b for a, b in zip(logs[1], logs[0], strict=True)]


def markov_spans(text: Column, ratios: list[float], min_ratio: float = MIN_RATIO) -> Column:
    model = F.lit(ratios)

    def random(token: Column) -> Column:
        score = let(
            _numbers(token),
            lambda n: F.aggregate(_pairs(n), F.lit(0.0), lambda s, pair: s + F.get(model, pair)),
        )
        mixed = token.rlike("[0-9]") & token.rlike("[A-Za-z]")
        return mixed & (score >= F.length(token) * min_ratio)

    return _spans(text, TOKEN, 3, lambda m, i, v: random(m))


def all_spans(text: Column, ratios: list[float], min_ratio: float = MIN_RATIO) -> Column:
    """Base spans and the Markov spans that meet none of them, by start and kind.

    A NULL text is empty and has no spans; repeated matches are spans of their own.
    """

    def joined(found: Column) -> Column:
        return F.when(F.size(found["more"]) == 0, found["base"]).otherwise(
            let(F.sort_array(F.concat(found["base"], found["more"])), apart)
        )

    def apart(spans: Column) -> Column:
        """Of sorted spans those that are base ones or meet none: no base span before ends after
        their start, and the next one, which is a base one if it starts before their end, does not."""
        ends = F.transform(spans, lambda x: F.when(x["kind"] < 3, x["end"]).otherwise(0))
        return let(
            running(ends, lambda a, b: F.greatest(a, b)),
            lambda upto: F.filter(
                spans,
                lambda x, i: (x["kind"] < 3)
                | (
                    (F.get(upto, i) <= x["start"])
                    & F.coalesce(F.get(spans, i + 1)["start"] >= x["end"], F.lit(True))
                ),
            ),
        )

    text = F.coalesce(text, F.lit(""))
    return let(
        F.struct(
            base_spans(text).alias("base"), markov_spans(text, ratios, min_ratio).alias("more")
        ),
        joined,
    )


def scan(
    documents: DataFrame, ratios: list[float] | None = None, min_ratio: float = MIN_RATIO
) -> DataFrame:
    """``documents`` with ``spans``: an array of (start, kind, end), kind being a place in KINDS.

    Places are code points, ends exclusive. Without ``ratios`` the models are trained on the
    documents themselves. No shuffle but for the bounded samples; a column named ``spans`` is
    replaced. An empty table gives an empty result.
    """
    if ratios is None:
        ratios = train(labelled_samples(documents))
    return documents.withColumn("spans", all_spans(F.col("text"), ratios, min_ratio))


def redact(documents: DataFrame, ratios: list[float] | None = None) -> DataFrame:
    """``documents`` with every span of their texts replaced by ``[secret]``.

    Overlapping spans become one. A NULL text stays NULL, other columns stay as they are.
    """

    def cut(spans: Column) -> Column:
        done = F.aggregate(
            spans,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts")),
            lambda s, x: F.when(
                x["start"] < s["at"],
                F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["parts"].alias("parts")),
            ).otherwise(
                F.struct(
                    x["end"].alias("at"),
                    F.concat(
                        s["parts"],
                        F.array(
                            F.substr("text", s["at"] + 1, x["start"] - s["at"]), F.lit("[secret]")
                        ),
                    ).alias("parts"),
                )
            ),
            lambda s: F.concat(F.array_join(s["parts"], ""), F.substr("text", s["at"] + 1)),
        )
        return F.when(F.size(spans) == 0, F.col("text")).otherwise(done)

    if ratios is None:
        ratios = train(labelled_samples(documents))
    return documents.withColumn("text", let(all_spans(F.col("text"), ratios), cut))


def written_spans(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    parts = F.transform(
        spans,
        lambda x: F.concat_ws(
            ":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string")
        ),
    )
    return F.array_join(parts, ",")


def op10_secret_scan(documents: DataFrame) -> DataFrame:
    """Counts and digests of the spans of all documents; see ``scan`` and ``all_spans``."""

    def digest(spans: Column) -> Column:
        of = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
        base = F.filter(spans, lambda x: x["kind"] < 3)
        return F.struct(
            of(0).alias("n_assign"),
            of(1).alias("n_access"),
            of(2).alias("n_hex"),
            hex_sha256(written_spans(base)).alias("base_sha256"),
            written_spans(spans).alias("spans"),
        )

    found = scan(documents.select("doc_id", "text"))
    return found.select("doc_id", let(F.col("spans"), digest).alias("d")).select("doc_id", "d.*")
