"""The documents' way through five operators.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and returns the rows that the next
one gets. ``run`` applies them all to the table ``documents``, writing each stage's rows to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.decontaminate import clean_only
from tessera.llm.jaccard_join import one_of_each_class
from tessera.llm.language_id import keep_identified
from tessera.llm.mixture import apply_mix, mix
from tessera.llm.registry import tokenizer_path
from tessera.llm.token_table import read_token_table, write_token_table
from tessera.plans.scratch import materialize
from tessera.sources.tables import table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a text in a known language go; the languages are learned from the labelled rows of ``docs``."""
    return keep_identified(docs, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of similar texts, the row with the least id stays; rows without words all stay, and so do unlike texts that share an id."""
    return one_of_each_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return clean_only(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of scarce languages are repeated towards flattened shares of tokens, which the written tokens meet; every document stays at least once."""
    return apply_mix(docs, mix(docs, label_col="lang", min_copies=1))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sorted-string-table shards, read back: one row for each written document."""
    return read_token_table(write_token_table(docs, tokenizer_path()), with_ids=False)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("token_output", token_output),
]

#: Trained models and token ids have no SQL form; tests compare every stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
