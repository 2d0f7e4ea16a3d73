"""Bloom filters as tables of the bits that are set, so building, merging and asking are joins and aggregates that scale with the keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import bloom_positions


def built(keys: DataFrame, key: Column, bits: int, hashes: int) -> DataFrame:
    """bit: the bits that some key sets. Null keys set none."""
    return keys.filter(key.isNotNull()).select(F.explode(bloom_positions(key, bits, hashes)).alias("bit")).distinct()


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """The filter of all keys of two filters of the same bits and hashes."""
    return a.unionByName(b).distinct()


def asked(rows: DataFrame, key: Column, filter_: DataFrame, bits: int, hashes: int) -> DataFrame:
    """rows with might_contain: False only for keys that were never added."""
    keyed = rows.withColumn("__key", key)
    positions = keyed.select("__key").filter(F.col("__key").isNotNull()).distinct().select("__key", F.explode(F.array_distinct(bloom_positions(F.col("__key"), bits, hashes))).alias("bit"))
    there = positions.join(filter_.withColumn("__set", F.lit(1)), "bit", "left").groupBy("__key").agg(F.bool_and(F.col("__set").isNotNull()).alias("might_contain"))
    return keyed.join(there, "__key", "left").withColumn("might_contain", F.coalesce("might_contain", F.lit(False))).drop("__key")


def stats(filter_: DataFrame, bits: int, hashes: int) -> DataFrame:
    """set_bits, fill, rate (estimated share of false positives): one row."""
    n = filter_.agg(F.count("*").alias("set_bits"))
    return n.withColumn("fill", F.col("set_bits") / F.lit(bits)).withColumn("rate", F.pow("fill", F.lit(hashes)))
