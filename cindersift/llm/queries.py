"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from cindersift.llm import bpe, chat, decontaminate, divergence, licences, lines, near, neighbours, oracles, prefixes, private, quality, secrets, urls
from cindersift.llm.batches import bounded


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 rows of largest inner product for every vec_id divisible by 20, against all rows."""
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op2_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and positions of personal data in every document."""
    return private.digests(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line occurrence that goes, and the occurrence that stays for it."""
    return lines.duplicate_lines(table(spark, sf_dir, "documents"), lines.FIVE).select(F.col("id").alias("doc_id"), "line", F.col("first_id").alias("kept_doc_id"), F.col("first_line").alias("kept_line"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of documents at 85 of 100 shingles in common."""
    return near.near_duplicates(table(spark, sf_dir, "documents"), 85)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, learnt from the labels outside fold 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.trained(docs, table(spark, sf_dir, "labels"))
    out = quality.scored(docs, model).select("doc_id", F.coalesce(quality.fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: source/thousands/hundreds/id.txt, where some ids are their directory's licence file."""
    k = F.floor(F.col("doc_id") / 20)
    parent = F.concat_ws("/", F.col("source"), F.floor(k / 50).cast("string"))
    inner = F.concat_ws("/", parent, F.floor(k / 5).cast("string"))
    path = F.when(k % 50 == 0, F.concat(parent, F.lit("/LICENSE"))).when(k % 5 == 0, F.concat(inner, F.lit("/LICENSE"))).otherwise(F.concat(inner, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select("doc_id", path.alias("path"), "text")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The own and the inherited licence of every document, as a file of a tree made from source and id."""
    return licences.scanned(document_files(table(spark, sf_dir, "documents")), key_col="doc_id")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.digests(turns.unionByName(own))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return urls.judged(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document and benchmark item that it holds."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text encoded and decoded again."""
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language, and the ten terms that mark each source most."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and positions of secrets in every document."""
    return secrets.digests(table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations, with its subtree's counts."""
    return prefixes.trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_nearest_neighbours, op2_private_data, op3_line_dedup, op4_minhash_near_dedup, op5_quality_classifier, op6_license_scan, op7_chat_formatting, op8_url_filters, op9_decontamination, op10_byte_bpe, op11_source_divergence, op12_secret_scan, op13_conversation_trie)}
ORACLES = oracles.ORACLES
