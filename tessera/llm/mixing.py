"""Sources mixed to target weights by a low-discrepancy schedule of equal-token blocks.

A source's documents are shuffled and laid end to end; the stream is cut into
blocks of equal size. The schedule visits the cumulative weights at the points
of a golden-ratio lattice, so each stretch of it holds the sources in
proportion; ranked within its source, a slot names a block. A source that is
due more than it has starts over.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD_GAP, checkpointed, column_of, source_key
from tessera.operators.order import running

#: Tokens (words) of a block, and the blocks that a small source is cut into at least.
BLOCK_TOKENS, LEAST_BLOCKS = 256, 64
#: Of the sources by code point, null last, in turn.
WEIGHTS = (5, 2, 1)
#: Of all sizes; of a source's size.
SHARE, MOST = 1.5, 2.0


def word_count(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, WORD_GAP))).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target: the weights share out share * all sizes, no source gets over most * its size, the excess is reshared.

    Sources sorted by limit / weight fill up in that order, so running sums give the level at which the others stop. Sources may be as many as hosts, so no sum runs in one task.
    """
    by_name = F.col("source").asc_nulls_last()
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("nth"), F.lit(len(weights))) + 1).cast("int")).cast("double")
    x = running(sources.select("source", "source_size"), [by_name], nth=F.lit(1)).withColumn("w", w).withColumn("limit", F.col("source_size") * most).drop("nth")
    x = running(x, [(F.col("limit") / F.col("w")).asc(), by_name], nth=F.lit(1), full=F.col("limit"), passed=F.col("w"))
    totals = x.agg(F.sum("source_size").alias("all_sizes"), F.sum("w").alias("all_w"))
    x = x.join(F.broadcast(totals)).withColumn("level", (F.col("all_sizes") * share - F.col("full")) / (F.col("all_w") - F.col("passed")))
    x = checkpointed(x.withColumn("open", F.when(F.col("limit") > F.col("level") * F.col("w"), F.col("nth"))))
    stop = x.agg(F.min("open").alias("first"), F.min_by("level", "open").alias("stop"))
    target = F.when(F.col("first").isNull() | (F.col("nth") < F.col("first")), F.col("limit")).otherwise(F.least(F.col("stop") * F.col("w"), F.col("limit")))
    return x.join(F.broadcast(stop)).select("source", "source_size", target.alias("target"))


def quotas(sources: DataFrame, block: int = BLOCK_TOKENS, least: int = LEAST_BLOCKS) -> DataFrame:
    """source, source_size, target, step (tokens of a block), blocks, quota (slots): to within half a block of the target."""
    size = F.col("source_size")
    x = sources.withColumn("step", F.greatest(F.lit(1), F.least(F.lit(block), F.floor(size / least))).cast("long"))
    x = x.withColumn("blocks", F.ceil(size / F.col("step")).cast("long"))
    passes = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0)
    x = x.withColumn("quota", F.least(2 * F.col("blocks"), passes * F.col("blocks") + F.floor((F.col("target") - passes * size) / F.col("step") + 0.5)).cast("long"))
    return x.withColumn("quota", F.when(size > 0, F.col("quota")).otherwise(0))


def golden_step(n: int) -> int:
    """The number next to n / golden ratio that shares no factor with n: its multiples modulo n visit each of n cells once."""
    g = max(1, round(n * (math.sqrt(5) - 1) / 2))
    return next(x for d in range(n + 1) for x in (g + d, g - d) if x > 0 and math.gcd(x, n) == 1)


def _numbered(rows: DataFrame, cell: Column, order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds to rows the sum of value over earlier rows of the same source. Cells are consecutive ranges of the order: sums of cells are added up first, so that no source is one task's."""
    rows = rows.withColumn("cell", cell).withColumn("key", source_key(F.col("source"))).withColumn("value", value)
    sums = rows.groupBy("key", "cell").agg(F.sum("value").alias("total"))
    by = Window.partitionBy("key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("key", "cell", F.coalesce(F.sum("total").over(by), F.lit(0)).alias("base"))
    within = Window.partitionBy("key", "cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("inside", F.coalesce(F.sum("value").over(within), F.lit(0))).join(base.hint("merge"), ["key", "cell"]).withColumn(name, (F.col("base") + F.col("inside")).cast("long")).drop("cell", "key", "value", "base", "inside")


def schedule(plan: DataFrame, slots: int) -> DataFrame:
    """slot (0 to slots - 1, the order of training), source, nth (the slot's rank in its source), block."""
    if not slots:
        return plan.select(F.lit(0).cast("long").alias("slot"), "source", F.lit(0).cast("long").alias("nth"), F.lit(0).cast("long").alias("block")).limit(0)
    back, chunk = pow(golden_step(slots), -1, slots) if slots > 1 else 0, max(64, math.isqrt(slots))
    cells = running(plan.select("source", "blocks", "quota"), [F.col("source").asc_nulls_last()], **{"from": F.col("quota")}).filter("quota > 0")
    parts = cells.select("source", "blocks", "quota", "from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("quota") - 1, F.lit(chunk).cast("long"))).alias("part"))
    parts = parts.repartition(F.col("source"), F.col("part"))
    each = parts.select("source", "blocks", F.explode(F.sequence(F.col("from") + F.col("part"), F.col("from") + F.least(F.col("part") + chunk, F.col("quota")) - 1)).alias("point"))
    # Cell `point` of the cumulative weights is met at the slot whose multiple of the golden step it is
    met = F.pmod(F.col("point") * F.lit(back), F.lit(slots)) if slots < 2**31 else F.pmod(F.col("point").cast("decimal(19,0)") * F.lit(back).cast("decimal(19,0)"), F.lit(slots).cast("decimal(19,0)")).cast("long")
    placed = _numbered(each.select(met.cast("long").alias("slot"), "source", "blocks"), F.floor(F.col("slot") / chunk), [F.col("slot")], F.lit(1), "nth")
    return placed.select("slot", "source", "nth", F.pmod(F.col("nth"), F.col("blocks")).alias("block"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, schedule, pieces). documents: row (a number of the row), doc_id, text_key (hash of its text), size, source_size, target, taken (words, repeats counted). schedule: see there. pieces: source, block, row, from, to (words of the row in the block).

    The shuffle is by md5 of the doc_id and the text's md5, so reruns agree: only rows alike in both could change places, and they are alike in all that is taken of them. Null text: size 0, taken 0;
    null source: one more source, the last. Rows that share a doc_id are taken each by itself. Very long texts are cut into as many blocks as they fill. Empty table: empty results.
    """
    text = column_of(docs, "text", "string")
    mixed = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))
    sized = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", column_of(docs, "source", "string").alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("text_key"), mixed.alias("mixed"))
    sized = checkpointed(sized)
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    plan = checkpointed(quotas(targets(sums, weights, share, most), block))
    slots = plan.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    digits = max(1, math.ceil(math.log(max(2, sized.count()), 16) / 2))
    # md5 has no hot values, so its first digits cut a source into even cells
    laid = _numbered(sized.drop("text_key").filter("size > 0"), F.substring("mixed", 1, digits), [F.col("mixed"), F.col("row")], F.col("size"), "at")
    key = source_key(F.col("source"))
    by_source = plan.select(key.alias("key"), "source_size", "target", "step")
    laid = laid.withColumn("key", key).join(by_source, "key")
    start, end, step = F.col("at"), F.col("at") + F.col("size"), F.col("step")
    spread = laid.select("row", "source", "at", "size", "step", F.explode(F.sequence(F.floor(start / step), F.floor((end - 1) / step))).alias("block"))
    pieces = spread.select("source", "block", "row", (F.greatest(start, F.col("block") * step) - start).alias("from"), (F.least(end, (F.col("block") + 1) * step) - start).alias("to"))
    timeline = schedule(plan, slots)
    # Sizes are estimated from the few sources that the slots are made of, so joins with them name their kind
    used = pieces.withColumn("key", key).join(timeline.select(key.alias("key"), "block").hint("merge"), ["key", "block"]).groupBy("row").agg(F.sum(F.col("to") - F.col("from")).alias("taken"))
    out = sized.withColumn("key", key).join(by_source.drop("step"), "key").join(used, "row", "left")
    return out.select("row", "doc_id", "text_key", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")), timeline, pieces
