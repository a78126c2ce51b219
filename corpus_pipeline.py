"""Corpus preparation: quality rules, near-duplicates, secrets, mixing, tokens.

Every stage takes the documents its predecessor kept and returns the columns of
``documents`` (the last one: token counts and digests per document).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weir.llm import bpe, mixing, quality_rules, secrets, simhash
from weir.llm.common import table
from weir.llm.queries import RANKS
from weir.shipping import ship
from weir.storage import written


#: Shares of the tokens after the rules and the deduplication.
TARGETS = {"clean": 0.86, "low": 0.01, "toxic": 0.13}


def passing_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    ship(spark)
    return simhash.one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rate says, so that domains get their shares of the tokens."""
    return mixing.drawn(docs, table(spark, sf_dir, "labels"), TARGETS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the bytes decoded from them."""
    import public_tokenizers

    ship(spark)
    return bpe.digests(bpe.encode_documents(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN))


STAGES = [("quality_rules", passing_rules), ("near_duplicates", near_duplicates), ("secrets", without_secrets), ("mixing", mixed), ("tokens", tokens)]

#: The stages learn sketches and models; they are tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage kept is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
