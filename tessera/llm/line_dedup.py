"""Lines that many sites share are taken out of all documents but the first that holds them.

A HyperLogLog sketch of the sites of each line hash is built in each task and
merged by aggregation. Lines whose estimate lies near the threshold are counted
exactly; the others are decided by the estimate, which is further from the
threshold than the sketch can err.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WORD_GAP, checkpointed, column_of, let, source_key, staged

#: A line at so many distinct sites is boilerplate.
MIN_SITES = 10
#: Shorter lines, such as a lone word, are alike by chance and stay.
MIN_WORDS = 3
#: log2 of the sketch's registers: a standard error of 1.04 / sqrt(4096) = 1.6 %.
LG_K = 12
#: Estimates from MIN_SITES / NEAR to MIN_SITES * NEAR are checked by exact counts: over 12 standard errors on either side.
NEAR = 1.25


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _long_enough(line: Column, words: int) -> Column:
    return line.rlike(rf"^[\x20\x09-\x0D]*([^\x20\x09-\x0D]+{WORD_GAP}){{{words - 1}}}[^\x20\x09-\x0D]")


def _occurrences(rows: DataFrame, words: int) -> DataFrame:
    """doc_id, text_key, site, at (from 0), h, g of each line that is long enough."""
    split = rows.select("doc_id", "text_key", "site", F.posexplode(_lines(F.col("text"))).alias("at", "line")).filter(_long_enough(F.col("line"), words))
    return split.select("doc_id", "text_key", "site", "at", F.xxhash64("line").alias("h"), F.hash("line").alias("g"))


def boilerplate(lines: DataFrame, sites: int = MIN_SITES) -> DataFrame:
    """h, g, first_doc (smallest doc_id): of the line hashes at so many distinct sites at least."""
    sketched = lines.groupBy("h", "g").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.min("doc_id").alias("first_doc"))
    estimated = checkpointed(sketched.select("h", "g", "first_doc", F.hll_sketch_estimate("sketch").alias("n")).filter(F.col("n") >= sites / NEAR))
    near = estimated.filter(F.col("n") <= sites * NEAR).drop("n")
    # Distinct (line, site) rows first: a line on every page of a site is one row a task before the shuffle
    exact = lines.select("h", "g", "site").join(near.select("h", "g"), ["h", "g"], "left_semi").distinct().groupBy("h", "g").agg(F.count("*").alias("n_sites")).filter(F.col("n_sites") >= sites)
    return estimated.filter(F.col("n") > sites * NEAR).drop("n").unionByName(near.join(exact.select("h", "g"), ["h", "g"], "left_semi"))


def drop_boilerplate(docs: DataFrame, sites: int = MIN_SITES, words: int = MIN_WORDS) -> DataFrame:
    """row (the row of docs as a struct), text (what stays), n_lines, n_removed: one row for each row of docs.

    Lines are what stands between line feeds, compared as they are. A line is boilerplate at `sites` distinct sources or more (null counts as one source) and stays in the document
    with the smallest doc_id that holds it, so a text copied to many sites is not lost. Rows that share a doc_id are cut by their own texts. Null text: stays null, no lines. An empty text has one empty line.
    Rows that repeat are cut alike; a very long text is cut in linear time. The row's own columns stay in the struct, so no name clashes. Empty table: empty result.
    """
    text = column_of(docs, "text", "string")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"), source_key(column_of(docs, "source", "string")).alias("site"))
    lines = staged(_occurrences(keyed, words), "lines")
    found = checkpointed(boilerplate(lines, sites))
    hits = lines.join(found, ["h", "g"]).filter(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    cut = hits.groupBy(F.col("doc_id").alias("of_doc"), F.col("text_key").alias("of_text")).agg(F.collect_set("at").alias("gone"))
    joined = keyed.drop("site").join(cut, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_key") == F.col("of_text")), "left")
    places = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("gone"))
    kept = let(_lines(F.col("text")), lambda x: F.array_join(F.transform(places(x), lambda i: F.get(x, i)), "\n"))
    return joined.select("row", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"), F.when(F.col("text").isNull(), 0).otherwise(F.size(_lines(F.col("text")))).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
