"""Change streams on Structured Streaming, and what they come to in a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.layers import applied, last_change
from tessera.operators.order import numbered

# Items of a batch and milliseconds that it waits.
BATCH_ITEMS, BATCH_MS, DEBOUNCE_MS = 50, 300, 500


def micro_batches(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, id_col: str = "id", order: str = "ts", once: bool = False) -> StreamingQuery:
    """Runs apply(rows, batch) on each micro-batch, of which only the last change of an id is left. The checkpoint makes batches repeatable, so apply must overwrite by batch number."""

    def each(rows: DataFrame, batch: int) -> None:
        apply(last_change(rows, id_col, order), batch)

    writer = changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{BATCH_MS} milliseconds")).start()


def batches(changes: DataFrame, id_col: str = "id", order: str = "ts", size: int = BATCH_ITEMS, partition: str | None = None) -> DataFrame:
    """The same in a batch: changes in order (within a partition, if one is named), cut into runs of `size`, the last change of an id in each."""
    if partition:
        w = Window.partitionBy(partition).orderBy(order, id_col)
        placed = changes.withColumn("__at", F.row_number().over(w) - 1)
    else:
        placed = numbered(changes, [F.col(order), F.col(id_col)], "__at")
    cut = placed.withColumn("batch", F.floor(F.col("__at") / size))
    last = F.row_number().over(Window.partitionBy(*([partition] if partition else []), "batch", id_col).orderBy(F.desc(order)))
    return cut.withColumn("__n", last).filter("__n = 1").drop("__n", "__at")


def debounced(events: DataFrame, key: str, ts: str, quiet: str = "30 minutes", watermark: str | None = None) -> DataFrame:
    """key, started, ended, n of runs of events with gaps below `quiet`: a session window, in batch and in stream (with a watermark)."""
    rows = events.withWatermark(ts, watermark) if watermark else events
    return rows.groupBy(key, F.session_window(ts, quiet).alias("w")).agg(F.count("*").alias("n"), F.max(ts).alias("last")).select(key, F.col("w.start").alias("started"), "last", "n")


def windowed(events: DataFrame, ts: str, size: str, keys: list[str], slide: str | None = None, watermark: str | None = None, value: str | None = None) -> DataFrame:
    """keys, started, n and total of tumbling or sliding windows of event time."""
    rows = events.withWatermark(ts, watermark) if watermark else events
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    aggs = [F.count("*").alias("n")] + ([F.sum(value).alias("total")] if value else [])
    return rows.groupBy(w.alias("w"), *keys).agg(*aggs).select(F.col("w.start").alias("started"), *keys, *[F.col(c) for c in ("n", *(["total"] if value else []))])


def interval_join(left: DataFrame, right: DataFrame, key: str, ts: str, within: str, watermark: str | None = None) -> DataFrame:
    """Pairs of a key whose right event follows the left one within an interval; with watermarks, a stream-stream join of bounded state."""
    a = left.select(key, F.col(ts).alias("left_ts"), F.struct(*left.columns).alias("left"))
    b = right.select(F.col(key).alias("__key"), F.col(ts).alias("right_ts"), F.struct(*right.columns).alias("right"))
    if watermark:
        a, b = a.withWatermark("left_ts", watermark), b.withWatermark("right_ts", watermark)
    return a.join(b, (F.col(key) == F.col("__key")) & (F.col("right_ts") > F.col("left_ts")) & (F.col("right_ts") <= F.col("left_ts") + F.expr(f"INTERVAL {within}"))).drop("__key")


def value_changes(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Rows whose value differs from the one before of their key; the first counts as a change."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    nth = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("before", before).withColumn("__n", nth).filter((F.col("__n") == 1) | ~F.col("before").eqNullSafe(F.col(value))).drop("__n")


def ingest(changes: DataFrame, out_path: str, checkpoint: str, columns: list[str], id_col: str = "id") -> StreamingQuery:
    """Writes a stream of changes (id, op, ts, payload) to out_path, the last change of an id of each micro-batch n in batch=n; a batch that is repeated overwrites its own. See ingested()."""

    def each(rows: DataFrame, batch: int) -> None:
        last_change(rows, id_col).select(id_col, "op", *columns).write.mode("overwrite").parquet(f"{out_path}/batch={batch}")

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested(base: DataFrame, out_path: str, id_col: str = "id") -> DataFrame:
    """base with all batches at out_path in it: of each id the last change, which counts as added where an earlier batch added the row. Batches stay as small as their changes until a compaction."""
    every = base.sparkSession.read.option("basePath", out_path).parquet(out_path)
    cols = [c for c in every.columns if c not in (id_col, "op", "batch")]
    last = every.groupBy(id_col).agg(F.max_by(F.struct("op", *cols), "batch").alias("__last"), F.bool_or(F.col("op") == "A").alias("__new"))
    op = F.when(F.col("__last.op") == "D", "D").when(F.col("__new"), "A").otherwise("M")
    return applied(base, last.select(id_col, op.alias("op"), *[F.col(f"__last.`{c}`") for c in cols]), id_col)
