"""The corpus pipeline: toxicity, quality, near-duplicates, packing. Each stage works on all its predecessor kept.

In every stage: a null or empty text is a text without words, a very long one is taken whole, extra columns
stay whatever their names, and an empty table gives an empty one. Where a label contradicts itself both count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import ngram_join, packing, quality, toxicity
from lexloom.llm.common import BROADCAST_IDS, batches_by_bytes, stored


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression distance doesn't call toxic; labels of all rows may be learnt.

    Rows with a null doc_id and repeated rows are judged each by their own text.
    """
    batches_by_bytes(spark)
    return toxicity.accept(docs, toxicity.train(docs, _labels(spark, sf_dir), F.lit(True)))


def poor_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; all labels may be learnt.

    Rows with a null doc_id and repeated rows are judged each by their own text. Without labels all stay.
    """
    batches_by_bytes(spark)
    statistics = stored(quality.described(docs), "statistics")  # a few numbers a document meet the labels, not texts
    model = quality.train(statistics, _labels(spark, sf_dir), F.lit(True))
    return quality.accept(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id; of repeated rows of it, one.

    Texts without words are linked with nothing and stay. Rows with a null doc_id stay all. An id that stands
    on different texts stays with all of them if it leads the group of one.

    Texts stay where they are: the ids to drop are broadcast up to BROADCAST_IDS, and only rows of ids that
    repeat are compared.
    """
    batches_by_bytes(spark)
    ids = ngram_join.join(docs).filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.col("doc_id") == F.col("component_id")).alias("leads"))
    ids = stored(ids.filter("n > 1 or not leads"), "ids")
    few = lambda d: F.broadcast(d) if d.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else d
    kept = docs.join(few(ids.filter("not leads").select("doc_id")), "doc_id", "left_anti")
    repeated = few(ids.filter("leads and n > 1").select("doc_id"))
    once, again = kept.join(repeated, "doc_id", "left_anti"), kept.join(repeated, "doc_id", "left_semi")
    return once.unionByName(again.dropDuplicates(["doc_id", "text"])).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents packed into sequences of at most 4096 ids; every row is packed, repeated or without id."""
    import public_tokenizers

    batches_by_bytes(spark)
    placed = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", toxic_out), ("quality", poor_out), ("ngram_join", one_of_each), ("packing", packed)]

#: Models learnt by Newton steps and compression can't be written in SQL; tests compare with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
