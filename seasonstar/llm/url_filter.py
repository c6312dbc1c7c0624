"""URL filters: rules, and naive Bayes over the words that hosts and paths are made of.

Hosts run words together, so every run of letters of a host is split by the most probable sequence of
words (Viterbi over a unigram model, which counts the words of all pages). The tokens of an URL are
these words and the runs of letters or digits of its path. Multinomial naive Bayes over the tokens,
trained on all distinct URLs, labelled by whether one of a few seed words is among their tokens,
gives the verdict wherever no rule does: words that keep company with the seeds block as well.

Distinct names and URLs are handled once. What a run of letters could be is looked up by joining its
pieces to the word counts, so no vocabulary is broadcast; token weights are joined in the same way, with
hot tokens dealt to several tasks. Costs and weights are whole micro-nats: sums are exact.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasonstar.llm.common import sent_by_value, written

sent_by_value(__name__)


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host with its subdomains and all paths that begin with ``path``."""

    host: str
    path: str
    verdict: str


RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)
#: Words that label an URL as unwanted where naive Bayes is trained.
SEEDS = (
    "adult",
    "ads",
    "bets",
    "betting",
    "casino",
    "gambling",
    "jackpot",
    "malware",
    "phishing",
    "pills",
    "poker",
    "porn",
    "sex",
    "spam",
    "torrent",
    "viagra",
    "warez",
    "xxx",
)
#: A name of a host has 63 characters at most, by the rules of the domain name system; longer runs
#: of letters are no names and stay whole. Words to look up are no longer than LONGEST_WORD.
LONGEST_NAME = 63
LONGEST_WORD = 24
#: Imagined occurrences of every token in each class.
PRIOR = 0.1
MICRO = 1_000_000
#: Tasks that one token's rows are dealt to.
SALTS = 16
ABSOLUTE = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
LETTERS = r"\p{L}+"
#: Tokens of a path: runs of letters, and runs of digits, which count by their length alone.
PATH_TOKEN = r"\p{L}+|\p{Nd}+"
#: Ends at the next tag's start as well, so a text of unclosed tags is read once.
TAG = r"<[^<>]*>"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _absolute(url: Column) -> Column:
    return F.coalesce(F.instr(url, "://") > 0, F.lit(False))


def host_of(url: Column) -> Column:
    """What stands between ``://`` and the next ``/ ? #``; empty without ``://``."""
    return F.when(_absolute(url), lower_ascii(F.regexp_extract(url, ABSOLUTE, 1))).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host up to the next ``? #``."""
    return F.when(_absolute(url), F.regexp_extract(url, ABSOLUTE, 2)).otherwise("")


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> Column:
    """Struct of ``rule`` and ``verdict`` of the longest rule that fits, of equals that with the longer
    host; NULL if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.host + r.path), len(r.host))):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        value = F.struct(F.lit(rule.host + rule.path).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(fits, value).otherwise(found)
    return found


# --- words of names ---------------------------------------------------------------


def word_counts(pages: DataFrame) -> DataFrame:
    """``word`` and ``n`` over the text of all pages, tags left out; NULL pages have none."""
    text = F.regexp_replace(F.coalesce(F.col("html"), F.lit("")), TAG, " ")
    words = F.regexp_extract_all(F.lower(text), F.lit(LETTERS), F.lit(0))
    rows = pages.select(F.explode(words).alias("word"))
    return rows.filter(F.length("word") <= LONGEST_WORD).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def with_seeds(counts: DataFrame, seeds: Sequence[str] = SEEDS) -> DataFrame:
    """Word counts, every seed word seen once more."""
    more = counts.sparkSession.range(1, numPartitions=1).select(
        F.explode(F.array(*[F.lit(s) for s in seeds])).alias("word"), F.lit(1).cast("long").alias("n")
    )
    return counts.unionAll(more).groupBy("word").agg(F.sum("n").alias("n"))


def unknown_cost(length: int, total_cost: int) -> int:
    """Cost of an unknown word: it grows tenfold in odds with each letter, from ten in all words up."""
    return total_cost + (length - 1) * 2_302_585


def cheapest_words(name: str, costs: dict[str, int], total_cost: int) -> list[str]:
    """The words with the least total cost; of equals the fewest, and then the longest from the end."""
    best: list[tuple[int, int, int]] = [(0, 0, 0)]
    for end in range(1, len(name) + 1):
        options = []
        for start in range(end):
            word = name[start:end]
            cost = costs.get(word)
            if cost is None:
                cost = unknown_cost(len(word), total_cost)
            before = best[start]
            options.append((before[0] + cost, before[1] + 1, start))
        best.append(min(options))
    words, end = [], len(name)
    while end:
        start = best[end][2]
        words.append(name[start:end])
        end = start
    return words[::-1]


def segmented(names: DataFrame, counts: DataFrame) -> DataFrame:
    """``name`` and its ``words``, a row per distinct ``name`` of ``names``.

    ``counts`` has ``word`` and ``n``. All distinct pieces of names are joined to it, the words found
    come back in one row per name, of some 1,200 pieces at most, and a Viterbi search per name takes
    the cheapest. A name longer than LONGEST_NAME is one word.
    """
    total = counts.agg(F.sum("n")).first()[0] or 1
    whole = F.round(F.ln(F.lit(float(total))) * MICRO).cast("long")
    cost = F.round((F.ln(F.lit(float(total))) - F.ln(F.col("n").cast("double"))) * MICRO)
    known = counts.select(F.col("word").alias("piece"), cost.cast("long").alias("cost"))
    short = names.select("name").distinct()
    fits = F.length("name") <= LONGEST_NAME
    starts = short.filter(fits).select("name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("at"))
    most = F.least(F.lit(LONGEST_WORD), F.length("name") - F.col("at") + 1)
    pieces = starts.select("name", "at", F.explode(F.sequence(F.lit(1), most)).alias("size")).select(
        "name", F.expr("substr(name, at, size)").alias("piece")
    )
    pieces = written(pieces.distinct(), "url-pieces")
    # words are many: only those that are a piece of some name are dealt to several tasks
    found = salted_join(pieces, known.join(pieces.select("piece").distinct(), "piece"), "piece")
    lists = found.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("piece", "cost"))).alias("costs"))
    rows = short.join(lists, "name", "left").select("name", "costs", whole.alias("whole"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names_of, words = batch.column("name").to_pylist(), []
            for name, costs, top in zip(
                names_of, batch.column("costs").to_pylist(), batch.column("whole").to_pylist(), strict=True
            ):
                words.append([name] if len(name) > LONGEST_NAME else cheapest_words(name, dict(costs or []), top))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names_of, pa.string()), pa.array(words, pa.list_(pa.string()))], ["name", "words"]
            )

    return rows.mapInArrow(split, "name string, words array<string>")


def salted_join(many: DataFrame, few: DataFrame, key: str, salts: int = SALTS, how: str = "inner") -> DataFrame:
    """``many`` joined to ``few``, whose ``key`` is unique: a hot key's rows go to ``salts`` tasks."""
    others = [name for name in many.columns if name != key]
    left = many.withColumn("__salt", F.pmod(F.xxhash64(*others), F.lit(salts)) if others else F.lit(0))
    right = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    right = right.withColumn("__salt", F.col("__salt").cast("long"))
    left = left.withColumn("__salt", F.col("__salt").cast("long"))
    return left.join(right, [key, "__salt"], how).drop("__salt")


# --- naive Bayes ------------------------------------------------------------------


def site_tokens(sites: DataFrame, counts: DataFrame) -> DataFrame:
    """Distinct ``host, path`` with their ``tokens``: words of the host, runs of the path.

    The host's names are split in a table of distinct names, and put together per distinct host.
    """
    names = F.regexp_extract_all("host", F.lit(LETTERS), F.lit(0))
    hosts = sites.select("host").distinct()
    placed = hosts.select("host", F.posexplode(names).alias("place", "name"))
    split = segmented(placed.select("name"), counts)
    parts = salted_join(placed, split, "name").groupBy("host").agg(
        F.sort_array(F.collect_list(F.struct("place", "words"))).alias("parts")
    )
    words = parts.select("host", F.flatten(F.transform("parts", lambda p: p["words"])).alias("words"))
    runs = F.transform(
        F.regexp_extract_all(lower_ascii(F.col("path")), F.lit(PATH_TOKEN), F.lit(0)),
        lambda run: F.when(run.rlike(r"\A\p{Nd}"), F.concat(F.lit("#"), F.length(run).cast("string"))).otherwise(run),
    )
    nothing = F.array().cast("array<string>")
    return salted_join(sites.select("host", "path"), words, "host", how="left").select(
        "host", "path", F.concat(F.coalesce("words", nothing), runs).alias("tokens")
    )


def token_weights(sites: DataFrame, seeds: Sequence[str] = SEEDS, prior: float = PRIOR) -> tuple[DataFrame, int]:
    """Weight of every token, log odds of block over allow in micro-nats, and that of the classes.

    ``sites`` has ``tokens``. A site with a seed word among them is of the class to block. Counts are of
    all sites; the driver gets two numbers per class.
    """
    bad = F.arrays_overlap("tokens", F.array(*[F.lit(s) for s in seeds])).cast("int")
    rows = sites.select(bad.alias("bad"), "tokens")
    classes = {
        r["bad"]: (r["n"], r["tokens"] or 0)
        for r in rows.groupBy("bad").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("tokens")).alias("tokens")).collect()
    }
    counted = rows.select("bad", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.sum("bad").alias("block"), F.sum(1 - F.col("bad")).alias("allow")
    )
    counted = written(counted, "url-tokens")
    kinds = counted.count()
    (n0, t0), (n1, t1) = (classes.get(k, (0, 0)) for k in (0, 1))

    def share(column: str, tokens: int) -> Column:
        return F.ln((F.col(column) + prior) / (tokens + prior * (kinds + 1)))

    weight = F.round((share("block", t1) - share("allow", t0)) * MICRO).cast("long")
    base = counted.sparkSession.range(1).select(F.round(F.ln(F.lit((n1 + prior) / (n0 + prior))) * MICRO).cast("long"))
    return counted.select("token", weight.alias("weight")), base.first()[0]


def scored(sites: DataFrame, weights: DataFrame, base: int) -> DataFrame:
    """``host, path`` and ``score``: log odds of block over allow in micro-nats."""
    tokens = sites.select("host", "path", F.posexplode("tokens").alias("place", "token"))
    sums = salted_join(tokens, weights, "token").groupBy("host", "path").agg(F.sum("weight").alias("weight"))
    return sums.select("host", "path", (F.col("weight") + base).alias("score"))


def judge(
    pages: DataFrame,
    rules: Sequence[Rule] = RULES,
    seeds: Sequence[str] = SEEDS,
    prior: float = PRIOR,
) -> DataFrame:
    """``pages`` (``page_id, url, html``) with ``host, path, rule, verdict`` and ``score``.

    A rule's verdict counts, without one that of naive Bayes: ``block`` if its log odds are above 0. A
    NULL url, or one without ``://``, has an empty host and path, fits no rule, and is judged by the
    share of the classes alone, as is one without any token. Repeated rows stay and are judged alike, as
    are all URLs with the same host and path. Other columns are ignored; an empty table gives an
    empty result.
    """
    url = F.col("url")
    parsed = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    distinct = parsed.select("host", "path").distinct()
    counts = written(with_seeds(word_counts(pages), seeds), "url-words")
    sites = written(site_tokens(distinct, counts), "url-sites")
    weights, base = token_weights(sites, seeds, prior)
    scores = scored(sites, weights, base)
    fit = fitting_rule(F.col("host"), F.col("path"), rules)
    score = F.coalesce("score", F.lit(base))
    return (
        parsed.join(scores, ["host", "path"], "left")
        .select("page_id", "host", "path", fit.alias("fit"), score.alias("score"))
        .select(
            "page_id",
            "host",
            "path",
            F.col("fit.rule").alias("rule"),
            F.coalesce("fit.verdict", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"),
            (F.col("score") / float(MICRO)).alias("score"),
        )
    )


def op12_url_filter(pages: DataFrame) -> DataFrame:
    """Verdicts on all pages with the given rules; see ``judge``."""
    return judge(pages)
