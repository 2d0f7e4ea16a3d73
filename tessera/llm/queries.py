"""The queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.staging import ship_code


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per row of documents: the base measures, base_failed, the host's shrunk failure rate and kept."""
    from tessera.llm.quality_rules import quality_rules

    out = quality_rules(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.round("host_rate", 6).alias("host_rate"), "kept")


def crc_mod(n: int) -> Column:
    """crc32 of the doc_id as text, modulo n."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per row of documents: held_out, score, predicted. A null doc_id is not held out."""
    from tessera.llm.quality_model import scored
    from tessera.llm.toxicity import THRESHOLD, train

    docs = _table(spark, sf_dir, "documents")
    model = train(docs, _table(spark, sf_dir, "labels"), crc_mod(3) != 1)
    out = scored(docs, model, F.col("doc_id"))
    return out.select("doc_id", F.coalesce(crc_mod(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per row of documents: held_out, score, predicted. A null doc_id is not held out."""
    from tessera.llm.quality_model import THRESHOLD, scored, train

    docs = _table(spark, sf_dir, "documents")
    model = train(docs, _table(spark, sf_dir, "labels"), crc_mod(5) != 0)
    out = scored(docs, model, F.col("doc_id"))
    return out.select("doc_id", F.coalesce(crc_mod(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per row of documents: its class (the smallest doc_id in it) and the rows of the class."""
    from tessera.llm.near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_docs")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per row of documents: size, source_size, target, taken."""
    from tessera.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents"))[0].select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per row of documents: spans by the rules counted by kind, their digest, all spans and their number."""
    from tessera.llm.pii import RULE_KINDS, find_pii, train_on

    docs = _table(spark, sf_dir, "documents")
    by_rule = F.filter("spans", lambda s: s["by_rule"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["by_rule"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    counts = [count(k) for k in RULE_KINDS]
    return find_pii(docs, train_on(docs)).select("doc_id", *counts, F.sha2(listed(by_rule), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per row of documents: n_lines, n_removed and the md5 of what stays. Lines of fewer than three words (line_dedup.MIN_WORDS) are never boilerplate."""
    from tessera.llm.line_dedup import drop_boilerplate

    out = drop_boilerplate(_table(spark, sf_dir, "documents"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


def op8_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per piece, its checksum taken from the ids read back."""
    from tessera.llm.packing import assign_sequences, write_pieces

    pieces = write_pieces(_table(spark, sf_dir, "documents"), tokenizer_path())
    return assign_sequences(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per row of documents, from the shards read back."""
    from tessera.llm.token_files import read_shards, write_shards

    return read_shards(spark, write_shards(_table(spark, sf_dir, "documents"), tokenizer_path()))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 20 best of each vector whose id is divisible by 20."""
    from tessera.llm.topk import top_k

    out = top_k(_table(spark, sf_dir, "embeddings"), F.pmod(F.col("id"), F.lit(20)) == 0)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages of corpus_pipeline.py over documents."""
    import corpus_pipeline

    ship_code(spark)
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_toxicity": op2_toxicity,
    "op3_near_dedup": op3_near_dedup,
    "op4_mix_sources": op4_mix_sources,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_pii": op6_pii,
    "op7_line_dedup": op7_line_dedup,
    "op8_harmonic_packing": op8_harmonic_packing,
    "op9_token_files": op9_token_files,
    "op10_exact_top_k": op10_exact_top_k,
    "pipeline": pipeline,
}
