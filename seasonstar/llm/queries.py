"""Registered queries of this package and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seasonstar.llm import bpe, chat, cleaning, clustering, embeddings, jaccard, language, mixing, repair, secret_scan, sharding, suffixes, url_filter
from seasonstar.llm.common import table
from seasonstar.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def _over(name: str, operator: Callable[[DataFrame], DataFrame]):
    return lambda spark, sf_dir: operator(table(spark, sf_dir, name))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": _over("documents", sharding.op1_sharding),
    "op2_cleaning": _over("documents", cleaning.op2_cleaning),
    "op3_language_id": _over("documents", language.op3_language_id),
    "op4_chat_formatting": _over("conversations", chat.op4_chat_formatting),
    "op5_jaccard": _over("documents", jaccard.op5_jaccard),
    "op6_bpe": _over("documents", bpe.op6_bpe),
    "op7_suffix_dedup": _over("documents", suffixes.op7_suffix_dedup),
    "op8_mixing": _over("documents", mixing.op8_mixing),
    "op9_embeddings": _over("embeddings", embeddings.op9_embeddings),
    "op10_secret_scan": _over("documents", secret_scan.op10_secret_scan),
    "op11_clustering": _over("embeddings", clustering.op11_clustering),
    "op12_url_filter": _over("pages", url_filter.op12_url_filter),
    "op13_repair": _over("conversations", repair.op13_repair),
}
