"""A training-corpus pipeline: five stages, each written as Parquet and read by the next.

quality classifier -> quality rules -> one document of each group of near copies -> masked
personal data -> packed sequences. ``run`` applies them to ``documents``.

Every stage takes any rows of the columns of ``documents``: null and empty texts count as empty, null
ids stay with their rows, repeated rows are judged each (the join keeps one of equal ids with
words), an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import jaccard, packing, pii, quality, rules
from tallyspark.llm.common import materialise, table
from tallyspark.llm.queries import tokenizer_file
from tallyspark.session import ship_package


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    ship_package(spark)
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the n-gram likelihood ratio."""
    return rules.accepted(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 4-word shingles at 0.85."""
    ship_package(spark)
    return jaccard.representatives(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data masked and ``n_chars`` counted anew."""
    ship_package(spark)
    out = pii.masked(docs)
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed documents."""
    ship_package(spark)
    return packing.pack(docs, packing.Settings(tokenizer_file("word_bpe_49k.json")))


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies),
    ("PII", personal_data),
    ("packing", packed),
]

#: SQL can express neither the network, the field nor the tokenizer; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
