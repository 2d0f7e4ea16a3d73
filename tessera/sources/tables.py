"""Readers and writers of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SYMBOL = T.StructType([T.StructField(n, k) for n, k in (
    ("canonical_fqn", T.StringType()), ("flags", T.LongType()), ("simple_name", T.StringType()), ("namespace", T.StringType()), ("namespace_depth", T.IntegerType()), ("name_length", T.IntegerType()),
    ("fqn_length", T.IntegerType()), ("first_char", T.StringType()), ("document_id", T.StringType()), ("file_path", T.StringType()), ("line_number", T.IntegerType()), ("symbol_id", T.StringType()),
)])
EMBEDDING = T.StructType([T.StructField(n, k) for n, k in (
    ("id", T.StringType()), ("content", T.StringType()), ("vector", T.ArrayType(T.FloatType())), ("dimension", T.IntegerType()), ("metadata", T.StringType()), ("created_at", T.LongType()), ("provider", T.StringType()),
)])


def read(spark: SparkSession, path: str, format: str = "parquet", schema=None, **options) -> DataFrame:
    """A table in any format that Spark reads; a schema spares the pass that would infer it."""
    reader = spark.read.format(format).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write(df: DataFrame, path: str, format: str = "parquet", partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    writer = df.write.format(format).mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def symbol_rows(names: DataFrame) -> DataFrame:
    """Symbol rows from (canonical_fqn, flags, document_id, file_path, line_number): what follows from the name is added."""
    from tessera.functions.text import symbol_id

    simple = F.substring_index(F.split("canonical_fqn", r"\(", 2)[0], ".", -1)
    space = F.when(F.contains("canonical_fqn", F.lit(".")), F.regexp_extract("canonical_fqn", r"^(.*)\.[^.]*$", 1)).otherwise("")
    out = names.withColumn("simple_name", simple).withColumn("namespace", space)
    return out.select(
        "canonical_fqn", "flags", "simple_name", "namespace", (F.size(F.split("namespace", r"\.")) - F.when(F.col("namespace") == "", 1).otherwise(0)).alias("namespace_depth"),
        F.length("simple_name").alias("name_length"), F.length("canonical_fqn").alias("fqn_length"), F.lower(F.substring("simple_name", 1, 1)).alias("first_char"),
        "document_id", "file_path", "line_number", symbol_id(F.col("document_id"), F.col("line_number"), F.col("simple_name"), F.hash("simple_name")).alias("symbol_id"),
    )


def same_source(spark: SparkSession, manifest: str, source_hash: str) -> bool:
    """Whether the manifest (a one-row table of source_hash) says that this source is loaded."""
    try:
        return spark.read.parquet(manifest).filter(F.col("source_hash") == source_hash).limit(1).count() == 1
    except Exception as e:  # no table there
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise


def load_once(df: DataFrame, path: str, manifest: str, source_hash: str) -> bool:
    """Writes df to path unless the manifest has source_hash; returns whether it wrote."""
    spark = df.sparkSession
    if same_source(spark, manifest, source_hash):
        return False
    df.write.mode("overwrite").parquet(path)
    spark.createDataFrame([(source_hash,)], "source_hash string").write.mode("overwrite").parquet(manifest)
    return True


def files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """path, modified, length, content of files as text; obj and bin folders are left out."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return rows.filter(~F.col("path").rlike(r"/(obj|bin)/")).select("path", F.col("modificationTime").alias("modified"), "length", F.decode("content", "UTF-8").alias("content"))
