"""What the operators of this subpackage share: staging, text columns, word codes."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.staging import checkpointed, shared_folder

#: White space that separates words: space and U+0009 to U+000D.
WORD_GAP = r"[\x20\x09-\x0D]+"
#: Text bytes that a Python worker turns into words at a time.
SLICE_BYTES = 3_000_000
#: Rows that Spark hands to Python at a time; texts may be long.
BATCH_ROWS, BATCH_BYTES = 1000, 16_000_000
#: Parts in which tables of sums are sent and added up.
TABLE_PARTS = 16


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, in a folder of this application that goes when its driver ends."""
    sc = spark.sparkContext
    top = f"{shared_folder(spark)}/tessera/{sc.applicationId}"
    folder = sc._jvm.org.apache.hadoop.fs.Path(top)
    files = folder.getFileSystem(sc._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    return f"{top}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, within: str | None = None) -> DataFrame:
    """df, written as Parquet below the shared folder (or in `within`, a folder there) and read again: for wide rows of which later steps read a few columns."""
    path = f"{within}/{name}-{uuid.uuid4().hex}" if within else stage_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes what was staged at path."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows and bytes of the session's Arrow batches by BATCH_ROWS and BATCH_BYTES; a row of more bytes is a batch of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table_sum(rows: DataFrame, size: int, tally: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None]) -> np.ndarray:
    """The sum of the tables of `size` whole numbers (a multiple of TABLE_PARTS) that tally makes of each task's batches (none: no rows). Tables are sent in parts, which are added up as they arrive."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tally(batches)
        if table is not None:
            yield pa.RecordBatch.from_pydict({"part": list(range(TABLE_PARTS)), "sums": [x.astype("<i8").tobytes() for x in np.split(table, TABLE_PARTS)]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(data, "<i8")
        if sums:
            yield pa.RecordBatch.from_pydict({"part": list(sums), "sums": [x.tobytes() for x in sums.values()]})

    small_batches(rows.sparkSession)
    kind = "part long, sums binary"
    out = np.zeros((TABLE_PARTS, size // TABLE_PARTS), np.int64)
    for part, data in rows.mapInArrow(tidy(gather), kind).repartition(TABLE_PARTS, "part").mapInArrow(tidy(add), kind).collect():
        out[part] = np.frombuffer(data, "<i8")
    return out.ravel()


def trim() -> None:
    """Returns what allocators have kept of freed memory to the system."""
    pa.default_memory_pool().release_unused()
    if trimmed := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trimmed(0)


def give_back() -> None:
    """Returns what this process has freed to the system: after a fit, the allocator would keep it."""
    gc.collect()
    trim()


def tidy(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """task, whose worker returns what it freed when the batches end. Workers outlive their tasks, so what one's arrays took would else be held beside the JVM's heap through all later stages, those without Python too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            trim()

    return run


def let(value: Column, body) -> Column:
    """body(value), with value computed once; Catalyst would copy the expression to each place that reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of batch with at most so many text bytes each, or one row."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to
    pa.default_memory_pool().release_unused()


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(first word of each text and an end, code of each word, the distinct words) of an Arrow string array; null: no words. Words are the runs without ASCII white space."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(texts)
    starts = lists.offsets.to_numpy().astype(np.int64)
    flat = pc.dictionary_encode(lists.values)
    codes, words = flat.indices.to_numpy().astype(np.int64), flat.dictionary
    codes, starts = codes[starts[0] : starts[-1]], starts - starts[0]
    if (empty := pc.index(words, "").as_py()) >= 0:  # white space at either end of a text
        keep = codes != empty
        starts = np.concatenate([[0], np.cumsum(keep)])[starts]
        codes = codes[keep]
    return starts, codes, words


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """word_codes with the words as strings: each distinct one is dealt with in Python once for a slice."""
    starts, codes, words = word_codes(texts)
    return starts, codes, words.to_pylist()


def mix64(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def source_key(source: Column) -> Column:
    """A string for each source that is null for none: the null one has a key that no other source can have."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def column_of(df: DataFrame, name: str, kind: str) -> Column:
    """df's column, or nulls where there is none."""
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
