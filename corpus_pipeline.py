"""From raw documents to token ids: the stages of a training-data pipeline.

Every stage takes the documents that the one before it left, as Parquet, and all but the last
return the columns of ``documents``. ``n_chars`` follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import digest, encode
from tidemark.llm.line_dedup import remove_boilerplate
from tidemark.llm.mixing import mix_sources
from tidemark.llm.near_dup import one_of_each
from tidemark.llm.quality_rules import clean_documents
from tidemark.llm.queries import VOCABULARY
from tidemark.session import settle


def _counted(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go; documents that lose too much, or fail the base rules, go."""
    return _counted(clean_documents(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten sites share go, but for their first document; near copies keep their bodies for the stage that takes them out."""
    return _counted(remove_boilerplate(docs, max_loss=0.5))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8) stays: the smallest id."""
    return one_of_each(docs, pct=80, width=5)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that every source holds the same amount of text, in shuffled order."""
    return mix_sources(docs, seed=8)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of ids and decoded text."""
    return digest(encode(docs, VOCABULARY, decoded_col="decoded", keep=["doc_id", "lang", "source"]), keep=["doc_id", "lang", "source", "ids"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_dup", near_copies),
    ("mixing", mixture),
    ("bpe", tokens),
]
#: Sketches, likelihoods and encoding are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs, name)
    return docs
