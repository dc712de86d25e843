"""A corpus pipeline: five stages over the table of documents, each on all that the one before kept.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents, whatever further columns there are and how they are named. SQL can't express the
first and third stage's methods, so there is no SQL for the whole; the stages are tested against brute force.

Defined results, for all stages: a null doc_id is a value like others; an empty table gives an empty result with the same columns;
texts are taken whole, however long. Nulls, ties and repeated rows: see each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewalk.llm import decontaminate, language_id, line_dedup, mixing, near_dedup
from tidewalk.llm.columns import fresh
from tidewalk.llm.scratch import cut

#: Least posterior chance of the predicted language.
LEAST_LANGUAGE_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose text is of a learned language; those without a letter or without a clear language go.

    Null and empty texts have no letter and go. A tie of two languages has a score of at most 0.5 each and stays at 0.5.
    Repeated rows get equal results. Without any labelled document nothing is of a learned language, and all go.
    """
    (own,) = fresh(docs, "own")
    model = language_id.fit(docs, public_tokenizers.path("piece_bpe_32k.model"))
    inner = docs.select(*[F.col(f"`{c}`").alias(f"{own}{k}") for k, c in enumerate(docs.columns)], F.col("text"))
    found = language_id.predict(inner, model, [c for c in inner.columns if c != "text"])
    found = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return found.select(*[F.col(f"{own}{k}").alias(c) for k, c in enumerate(docs.columns)])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove the lines that later occurrences of three-line windows cover; n_chars follows the text.

    A document that loses lines and keeps nothing but white space goes: all it held stands in an earlier one. Null and empty
    texts stay as they are. Rows equal in doc_id and text count as one document, and get equal results.
    """
    out = line_dedup.dedup_lines(docs, counts=False, drop_emptied=True)
    return out.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each component of near-duplicates: of the document of least doc_id (null last, then by the text's hash).

    Texts without words are linked with nothing and stay. Of rows equal in doc_id and text one stays.
    """
    return near_dedup.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which the benchmark's passages make at least a twentieth. Null and empty texts have no words and stay; repeated rows get equal results."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes, by source weights: doc_id, size, source_size, target, taken, source.

    A null source is a source of its own; null and empty texts are taken 0 times; repeated rows are documents of their own.
    """
    return mixing.mix(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontaminate", drop_contaminated),
    ("mix_sources", mix_sources),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
