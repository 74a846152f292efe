"""The corpus pipeline: language ID, near-duplicate removal, decontamination, mixing, sharding.

Each stage works on all that the one before kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import Table
from millrace.llm.decontaminate import find_contamination
from millrace.llm.jaccard_join import jaccard_groups
from millrace.llm.langid import fit, identify
from millrace.llm.mixing import mix_to_targets
from millrace.llm.sharding import shard_by_bytes

#: A document stays if one language has at least this share of it.
MIN_SCORE = 0.5
#: Removed documents are listed to all tasks up to this many; beyond, the list is joined.
MAX_SENT = 1_000_000


def packed(docs: DataFrame, *columns: str) -> DataFrame:
    """``docs`` as one column ``row`` and copies of the columns that a stage reads, so that no other name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[F.col(f"`{c}`") for c in columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those without letters go, null and empty texts among them, and those in which no language
    has half of the text. The model is fitted on the labelled rows of ``docs``; without any, all documents are
    undetermined and go. Whole texts count, however long; repeated rows stay repeated; an empty table gives no rows; other
    columns pass, whatever their names."""
    rows = packed(docs, "text", "lang")
    found = identify(rows, fit(rows), keep=("row",))
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the smallest id, then the first in the table; a null id is the
    largest. Shingles of five words, similarity 0.8. Repeated rows, and equal ids or null ids with other texts, are rows of their own, so
    exactly one of a group stays. Null and empty texts are near nothing and stay. Very long texts are compared whole;
    an empty table gives no rows; other columns pass, whatever their names."""
    # Written once: numbers of a scan depend on how it is cut, which changes with the executors that are there. Ids and texts
    # are read from the rows, not written beside them.
    rows = Table(packed(docs).withColumn("place", F.monotonically_increasing_id()), "numbered").df
    rows = rows.select("row", "place", "row.doc_id", "row.text")
    rows = rows.withColumn("id", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place"))
    groups = jaccard_groups(rows, n=5, num=80, id_col="id")
    gone = Table(groups.filter("doc_id <> component_id").select(F.col("doc_id.place").alias("_place")), "near-copies").df
    gone = F.broadcast(gone) if gone.limit(MAX_SENT + 1).count() <= MAX_SENT else gone
    return rows.join(gone, F.col("place") == F.col("_place"), "left_anti").select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten words in a row (or a whole shorter item) of the benchmark. Null and empty texts have none and
    stay; repeated rows are judged one by one; an empty table or benchmark removes nothing; whole texts are searched;
    other columns pass, whatever their names."""
    rows = packed(docs, "doc_id", "text")
    found = find_contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10, k=5, carry=("row",))
    return found.filter("not contaminated").select("row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, up to three times. A null source is a source; null and empty texts have no
    words and stay once; rows equal in id, source and size are told apart by number; an empty table gives no rows; other
    columns pass, whatever their names."""
    mixed = mix_to_targets(packed(docs, "doc_id", "text", "source"), cap=3, carry=("row",)).filter("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each copy, as ``doc_id, size, text_crc32, law, shard, slot, grown_shard``. Null ids and texts and
    repeated rows are ordinary records, very long texts weigh what they have; an empty table gives no rows; other columns are not read."""
    return shard_by_bytes(packed(docs, "doc_id", "text"), n_shards=40)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: The stages are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if i == len(STAGES) - 1 else Table(out, f"pipeline-{name}").df
    return docs
