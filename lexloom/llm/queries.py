"""The registered queries of the operators: thin wrappers that read the given tables."""

from __future__ import annotations

import sys
from importlib.util import module_from_spec, spec_from_file_location
from pathlib import Path
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import batches_by_bytes, stored
from lexloom.llm.toxicity import held_out
from lexloom.llm import conversation_trie, html_text, lm, near_dup, ngram_join, oracles, packing, quality, secrets, sp_codec, spelling, topk, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    batches_by_bytes(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    texts = sp_codec.encode_texts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return texts.select("doc_id", "n_parts", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), F.col("whole").alias("round_trip"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 4, 2)
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), ~out)
    return toxicity.score(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write(_table(spark, sf_dir, "pages"), min_bytes=0)
    return warc.read(manifest, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "verified")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = held_out(F.col("doc_id"), 3, 1)
    stats = stored(quality.described(_table(spark, sf_dir, "documents")), "statistics")
    model = quality.train(stats, _table(spark, sf_dir, "labels"), ~out)
    return quality.score(stats, model).select("doc_id", out.alias("held_out"), "score", "predicted")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack(_table(spark, sf_dir, "documents"), _word_bpe(), keep_ids=False)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.perplexity(_table(spark, sf_dir, "documents"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def _pipeline_module() -> ModuleType:
    """corpus_pipeline, which stands at the top of the repository, from wherever this is run."""
    if "corpus_pipeline" not in sys.modules:
        spec = spec_from_file_location("corpus_pipeline", Path(__file__).parents[2] / "corpus_pipeline.py")
        sys.modules["corpus_pipeline"] = module = module_from_spec(spec)
        spec.loader.exec_module(module)
    return sys.modules["corpus_pipeline"]


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pipeline_module().run(spark, sf_dir)


def queries() -> dict:
    return {"op1_ngram_join": op1_ngram_join, "op2_topk": op2_topk, "op3_near_dup": op3_near_dup, "op4_sentencepiece": op4_sentencepiece, "op5_toxicity": op5_toxicity, "op6_warc": op6_warc, "op7_html_text": op7_html_text, "op8_quality": op8_quality, "op9_packing": op9_packing, "op10_lm": op10_lm, "op11_secrets": op11_secrets, "op12_spelling": op12_spelling, "op13_conversation_trie": op13_conversation_trie, "pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLES)
