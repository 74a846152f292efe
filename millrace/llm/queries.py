"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import find_contamination
from .embedding_dedup import near_duplicates
from .filter_audit import filter_audit
from .html_extract import extract_main_text
from .jaccard_join import jaccard_groups
from .langid import fit, identify
from .line_dedup import dedup_lines
from .mixing import mix_to_targets
from .oracle import SQL
from .sharding import shard_by_bytes
from .spelling import spelling_variants
from .substring_dedup import remove_repeats
from .top_k import top_k
from .warc import round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, by a model of the two thirds that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    found = identify(docs, fit(docs.filter(~held_out)), keep=("doc_id",))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "mixture")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10, k=5)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the group that their near copies, by four-word shingles, connect them to."""
    return jaccard_groups(table(spark, sf_dir, "documents"), n=4, num=85).select("doc_id", "n_shingles", "component_id")


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the twenty-word windows that also start earlier."""
    return remove_repeats(table(spark, sf_dir, "documents"), window=20)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, each with the words that the mix takes of it."""
    return mix_to_targets(table(spark, sf_dir, "documents"), cap=3)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract_main_text(table(spark, sf_dir, "pages"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near-equal bytes."""
    return shard_by_bytes(table(spark, sf_dir, "documents"), n_shards=40)


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that near-equal earlier ones."""
    return dedup_lines(table(spark, sf_dir, "documents"), min_similarity=0.8, zeros=True, min_chars=9)


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors with their links of cosine 0.95 and more."""
    return near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95).select("vec_id", "n_links", "component_id", "kept")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back."""
    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all vectors for every fiftieth."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with their more frequent forms."""
    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove of all documents, in every order."""
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_langid, op2_decontamination, op3_jaccard, op4_substring, op5_mixing, op6_html, op7_sharding, op8_lines, op9_embeddings, op10_warc,
                                  op11_topk, op12_spelling, op13_filters)}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express; the others are held against brute force in the tests."""
    return dict(SQL)
