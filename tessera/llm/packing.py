"""Harmonic packing of tokenized documents into sequences of one capacity.

A piece of length n is of class k where capacity / (k + 1) < n <= capacity / k;
a sequence of class k holds k pieces. As the count is fixed, a piece's number
within its class tells its sequence, so workers fill sequences without hearing
of each other once the counts of their ranges are summed up. Documents are cut
so that pieces nearly reach the upper end of their class. Each k up to the capacity
is a class, so small documents fill their sequences as well as large ones. What
is left over in each class, fewer than k pieces, is packed best-fit by falling
length.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed, column_of, slices, small_batches, stage_path, tidy
from tessera.llm.tokens import TEXT_BYTES, closed, encoder

CAPACITY, END_ID = 4096, 2
#: Shares of a class's space that a piece may leave empty.
LOOSE = 0.02
#: Consecutive pieces of which counts are summed before the shuffle.
RANGE = 4096


def class_of(length: int, capacity: int = CAPACITY) -> int:
    """Pieces of this length that a sequence holds."""
    return capacity // length


def cuts(length: int, capacity: int = CAPACITY, loose: float = LOOSE) -> list[int]:
    """Lengths of a document's pieces, in order."""
    out = [capacity] * (length // capacity)
    left = length % capacity
    while left:
        k = capacity // left
        if left * k >= (1 - loose) * capacity:
            out.append(left)
            break
        out.append(capacity // (k + 1))
        left -= out[-1]
    return out


PIECES = "uid long, doc_id long, start long, length long, doc_tokens long, class int, ids binary"


def write_pieces(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents, with their ids (little-endian, 4 bytes each), written as Parquet to path and read back.

    uid numbers the pieces. Null or empty text: the end id alone. Rows that share a doc_id, or repeat, are pieces of their own. A very long text is cut into as many pieces as it fills. Further columns
    are left out, whatever their names. Empty table: no pieces.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, uid = encoder(tokenizer), TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, most=TEXT_BYTES):
                ids, ends = closed(*enc.encode(part.column("text")), end_id)
                sizes = np.diff(ends)
                lengths = [cuts(n, capacity) for n in sizes.tolist()]
                n_pieces = np.fromiter(map(len, lengths), np.int64, len(lengths))
                length = np.fromiter((x for c in lengths for x in c), np.int64, int(n_pieces.sum()))
                to = np.concatenate([[0], np.cumsum(length)])
                yield pa.RecordBatch.from_pydict(
                    {
                        "uid": uid + np.arange(len(length)),
                        "doc_id": part.column("doc_id").take(pa.array(np.repeat(np.arange(len(sizes)), n_pieces))),
                        "start": to[:-1] - np.repeat(ends[:-1], n_pieces),
                        "length": length,
                        "doc_tokens": np.repeat(sizes, n_pieces),
                        "class": np.fromiter((class_of(x, capacity) for x in length.tolist()), np.int32, len(length)),
                        "ids": pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer((to * 4).astype(np.int32)), pa.py_buffer(ids)]),
                    }
                )
                uid += len(length)

    spark = docs.sparkSession
    small_batches(spark)
    path = path or stage_path(spark, "pieces")
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), column_of(docs, "text", "string").alias("text")).mapInArrow(tidy(cut), PIECES).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(PIECES).parquet(path)


def best_fit(lengths: list[tuple[int, int]], capacity: int = CAPACITY) -> list[tuple[int, int, int]]:
    """(uid, sequence from 0, offset) of (length, uid) pieces: the longest first, each into a sequence with the least room that it fits."""
    sizes: list[int] = []  # rooms that some sequence has, ascending
    having: dict[int, list[int]] = {}
    used: list[int] = []
    out = []
    for n, uid in sorted(lengths, key=lambda x: (-x[0], x[1])):
        place = bisect.bisect_left(sizes, n)
        if place == len(sizes):
            at, room = len(used), capacity
            used.append(0)
        else:
            room = sizes[place]
            at = heapq.heappop(having[room])
            if not having[room]:
                sizes.pop(place)
        out.append((uid, at, used[at]))
        used[at] += n
        if room > n:
            if not having.setdefault(room - n, []):
                bisect.insort(sizes, room - n)
            heapq.heappush(having[room - n], at)
    return out


def assign_sequences(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (with uid, length, class and any further columns but the ids) with sequence_id and offset instead of uid and class.

    A piece's number in its class is the number of those in earlier ranges of uids plus its own in the range; the sequence is that number by the class's count. The rest of each class has
    fewer pieces than a sequence holds: capacity * ln(capacity) / 2 and some more over all classes (21,000 for 4096) whatever the input, so they are packed on the driver.
    """
    spark: SparkSession = pieces.sparkSession
    cell, k = F.floor(F.col("uid") / RANGE).alias("cell"), F.col("class")
    counted = pieces.groupBy("class", cell).agg(F.count("*").alias("n"))
    order = Window.partitionBy("class").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.select(F.col("class").alias("of_class"), F.col("cell").alias("of_cell"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"), F.sum("n").over(Window.partitionBy("class")).alias("in_class"))
    local = F.row_number().over(Window.partitionBy("class", "cell").orderBy("uid")) - 1
    ranked = pieces.withColumn("cell", cell).withColumn("local", local).join(base, (k == F.col("of_class")) & (F.col("cell") == F.col("of_cell")))
    number = F.col("base") + F.col("local")
    placed = ranked.withColumn("bin", F.floor(number / k)).withColumn("place", F.pmod(number, k)).withColumn("whole", F.floor(number / k) < F.floor(F.col("in_class") / k))
    ranked = checkpointed(placed.drop("cell", "local", "of_class", "of_cell", "base", "in_class"))
    numbered = ranked.filter("whole").withColumn("sequence_id", k.cast("long") * F.lit(1 << 40) + F.col("bin"))
    # Pieces of the higher classes (of 64 and more, for 4096) are all of one length, so their places tell their offsets; sequences of the others hold few pieces
    one_length = F.floor(F.lit(capacity) / k) - F.floor(F.lit(capacity) / (k + 1)) == 1
    before = Window.partitionBy("class", "bin").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)
    even = numbered.filter(one_length).withColumn("offset", (F.col("place") * F.col("length")).cast("long"))
    mixed = numbered.filter(~one_length).withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
    full = even.unionByName(mixed).drop("place")
    rest = best_fit([tuple(r) for r in ranked.filter("not whole").select("length", "uid").collect()], capacity)
    placed = spark.createDataFrame(rest, "of_uid long, sequence_id long, offset long")
    left = ranked.filter("not whole").drop("place").join(F.broadcast(placed), F.col("uid") == F.col("of_uid")).drop("of_uid")
    return full.unionByName(left).drop("uid", "class", "bin", "whole")
