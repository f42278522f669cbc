"""The operators as queries over the driver's tables, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every text and their decoding, as digests."""
    from tidemark.llm.bpe import digest, encode

    docs = table(spark, folder, "documents")
    return digest(encode(docs, VOCABULARY, decoded_col="decoded", keep=["doc_id"]), keep=["doc_id"])


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and verdict of the quality rules for every document."""
    from tidemark.llm.quality_rules import quality_rules

    return quality_rules(table(spark, folder, "documents"), keep=["doc_id"])


def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without word runs of smaller documents."""
    from tidemark.llm.substring_dedup import remove_repeats

    done = remove_repeats(table(spark, folder, "documents"), width=13)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_near_dup(spark: SparkSession, folder: str) -> DataFrame:
    """Group of near copies of every document, at a similarity of 0.85."""
    from tidemark.llm.near_dup import near_duplicates

    return near_duplicates(table(spark, folder, "documents"), pct=85)


#: The rules that the URL query applies (host, path, verdict).
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Rule and verdict of every page's URL."""
    from tidemark.llm.url_filter import filter_urls

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, folder, "pages"), rules)


def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Shard and place of every document under a map of virtual slots balanced by bytes."""
    from tidemark.llm.sharding import shard_documents

    placed = shard_documents(table(spark, folder, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without the lines that ten sites share."""
    from tidemark.llm.line_dedup import remove_boilerplate

    done = remove_boilerplate(table(spark, folder, "documents"), count_cols=("n_lines", "n_removed"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Copies of documents so that every source gets the same share, in shuffled order."""
    from tidemark.llm.mixing import mix_sources

    mixed = mix_sources(table(spark, folder, "documents"), seed=8, result_cols=("copy", "order_key"))
    return mixed.select("doc_id", "source", "copy", "order_key")


def op9_quality_model(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document, learnt from the labels that are not held out; a null id is held out."""
    from tidemark.llm.quality_model import score, train

    docs = table(spark, folder, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    model = train(docs, table(spark, folder, "labels").where(~held_out))
    scored = score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links and group of every vector among those of its label, at a cosine of 0.93."""
    from tidemark.llm.embedding_dedup import near_vectors

    return near_vectors(table(spark, folder, "embeddings"), cosine=0.93)


def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Code and error of every vector under codebooks of eight parts after six rounds."""
    from tidemark.llm.vector_codes import vector_codes

    return vector_codes(table(spark, folder, "embeddings"), positions=8, entries=16, rounds=6, scale=4096)


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The strongest phrases of two to five words of every language."""
    from tidemark.llm.collocations import collocations

    return collocations(table(spark, folder, "documents"), threshold=100, longest=5, top=2000)


def op13_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    """Log-probability of every document under a suffix tree learnt from the documents that are not held out; a null id is held out."""
    from tidemark.llm.suffix_tree import learn, score

    docs = table(spark, folder, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(True))
    scored = score(docs, learn(docs.where(~held_out)), keep=["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_quality_rules": op2_quality_rules,
    "op3_near_dup": op3_near_dup,
    "op4_url_filter": op4_url_filter,
    "op5_sharding": op5_sharding,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_mixing": op8_mixing,
    "op9_quality_model": op9_quality_model,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_vector_codes": op11_vector_codes,
    "op12_collocations": op12_collocations,
    "op13_lm_score": op13_lm_score,
}
