"""The corpus pipeline: each stage reads what its predecessor kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import line_dedup, mixing, near_dedup, packing, quality_model
from tessera.llm.common import stage_path
from tessera.llm.queries import crc_mod, tokenizer_path

#: What a stage adds to rows bears this prefix, so no column of documents is hidden.
OWN = "__stage_"


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("*", F.xxhash64("text").alias(f"{OWN}node"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (operator 5) predicts to be good; it is fitted to this stage's rows of labels that operator 5 may learn from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_model.train(docs, labels, crc_mod(5) != 0)
    out = quality_model.scored(docs, model, *(F.col(f"`{c}`") for c in docs.columns), name=f"{OWN}score")
    return out.filter(F.col(f"{OWN}score") >= quality_model.THRESHOLD).drop(f"{OWN}score")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that operator 7 takes out; n_chars follows the text."""
    out = line_dedup.drop_boilerplate(docs)
    kept = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*(kept[c].alias(c) if c in kept else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates (operator 3) the document with the smallest doc_id (null: the last); of rows alike in doc_id and text, the one whose columns have the smallest hash."""
    classes = near_dedup.near_duplicates(docs)
    first = classes.groupBy("class_node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "g")).alias("row"))
    keep = first.select(*[F.col(f"row.{c}").alias(f"{OWN}{c}") for c in ("doc_id", "h", "g")])
    h, g = near_dedup.text_keys(F.col("text"))
    same = F.col("doc_id").eqNullSafe(F.col(f"{OWN}doc_id")) & (F.col(f"{OWN}of_h") == F.col(f"{OWN}h")) & (F.col(f"{OWN}of_g") == F.col(f"{OWN}g"))
    joined = docs.select("*", h.alias(f"{OWN}of_h"), g.alias(f"{OWN}of_g")).join(keep, same)
    whole = [F.col(f"`{c}`") for c in docs.columns]
    one = joined.groupBy(f"{OWN}doc_id", f"{OWN}h", f"{OWN}g").agg(F.min_by(F.struct(*whole), F.xxhash64(*whole)).alias(f"{OWN}row"))
    return one.select(*[F.col(f"{OWN}row.`{c}`") for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as operator 4 takes them: once for each time its words are taken whole, and once more if half or more of them are taken again."""
    taken, _, _ = mixing.mix(docs)
    # Rows alike in doc_id and text share what they were taken
    times = F.floor(F.avg("taken") / F.greatest(F.max("size"), F.lit(1)) + 0.5).cast("int")
    each = taken.groupBy(F.col("doc_id").alias(f"{OWN}doc"), F.col("text_key").alias(f"{OWN}text")).agg(times.alias(f"{OWN}times")).filter(F.col(f"{OWN}times") > 0)
    joined = _keyed(docs).join(each, F.col("doc_id").eqNullSafe(F.col(f"{OWN}doc")) & (F.col(f"{OWN}node") == F.col(f"{OWN}text")))
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(F.array_repeat(F.lit(0), F.col(f"{OWN}times"))).alias(f"{OWN}n")).drop(f"{OWN}n")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of operator 8 with their places in sequences; their ids lie in the folder that this stage writes."""
    pieces = packing.write_pieces(docs, tokenizer_path(), stage_path(spark, "pipeline-pieces"))
    digest = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.assign_sequences(digest).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("quality classifier", quality), ("line dedup", lines), ("near dedup", near), ("mixing", mixture), ("packing", packed)]

#: Tokenizers, sampling and the classifier are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = stage_path(spark, f"pipeline-{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
