"""Token ids in files of Re-Pair grammars.

A shard holds documents in ascending order. Pairs of ids that occur often are
replaced by nonterminals, many pairs a round and round after round; the shard
keeps the rules, the length each nonterminal expands to and where each document
begins, so one document is read without the others.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import column_of, slices, small_batches, stage_path
from tessera.llm.tokens import TEXT_BYTES, closed, encoder, gathered

END_ID = 1
#: Ids of a shard, about; the last document may go beyond.
SHARD_IDS = 2_000_000
#: A pair is worth a rule from so many occurrences on; rules a round; rounds; share of symbols that a round must save to be followed by another.
LEAST_COUNT, ROUND_RULES, ROUNDS, LEAST_GAIN = 12, 4000, 6, 0.02
#: Slots of the table that finds a round's rules.
SLOT_BITS = 20
MAGIC = b"RPG1"
HEAD = struct.Struct("<4sIQQQQ")


class Grammar:
    """rules (left, right) of nonterminals base, base + 1, ... and the symbols."""

    def __init__(self, base: int, rules: np.ndarray, symbols: np.ndarray, bounds: np.ndarray):
        self.base, self.rules, self.symbols, self.bounds = base, rules, symbols, bounds

    def expansion_sizes(self) -> np.ndarray:
        """Ids that each symbol from base on stands for."""
        sizes = [0] * len(self.rules)
        for i, (a, b) in enumerate(self.rules.tolist()):
            sizes[i] = (1 if a < self.base else sizes[a - self.base]) + (1 if b < self.base else sizes[b - self.base])
        return np.asarray(sizes, np.int64)


def chosen_pairs(keys: np.ndarray, counts: np.ndarray, room: int, base_bits: int) -> np.ndarray:
    """Frequent pairs that can be replaced at once: no symbol is the left part of one and the right part of another."""
    often = np.flatnonzero(counts >= LEAST_COUNT)
    most = min(room, ROUND_RULES)
    if len(often) > 3 * most:
        often = often[np.argpartition(-counts[often], 3 * most)[: 3 * most]]
    often = often[np.lexsort((keys[often], -counts[often]))]
    left, right, out = set(), set(), []
    mask = (1 << base_bits) - 1
    for key in keys[often].tolist():
        a, b = key >> base_bits, key & mask
        if a == b:
            if a not in left and a not in right:
                left.add(a)
                right.add(a)
                out.append(key)
        elif a not in right and b not in left:
            left.add(a)
            right.add(b)
            out.append(key)
        if len(out) == most:
            break
    return np.asarray(out, keys.dtype)


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where pairs are looked up."""
    if bits == 16:
        return (keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOT_BITS)
    return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)


def re_pair(ids: np.ndarray, bounds: np.ndarray) -> Grammar:
    """The grammar of ids, of which document i is ids[bounds[i] : bounds[i + 1]]; no pair reaches over a bound."""
    base = int(ids.max()) + 1 if len(ids) else 0
    bits = 16 if base <= 1 << 16 else 32
    kind, limit = (np.uint32, 1 << 16) if bits == 16 else (np.uint64, 1 << 32)
    seq, last = ids.astype(kind), np.zeros(len(ids), bool)
    last[bounds[1:][bounds[1:] > bounds[:-1]] - 1] = True
    rules: list[np.ndarray] = []
    made = base
    for _ in range(ROUNDS):
        if len(seq) < 2:
            break
        keys = (seq[:-1] << kind(bits)) | seq[1:]
        inner = np.sort(keys[~last[:-1]])
        if not len(inner):
            break
        edges = np.flatnonzero(inner[1:] != inner[:-1])
        runs = np.diff(np.concatenate([[-1], edges, [len(inner) - 1]]))
        pairs = chosen_pairs(inner[np.concatenate([edges, [len(inner) - 1]])], runs, limit - made, bits)
        if not len(pairs):
            break
        # Each pair has a slot of a table; of pairs that share one, the most frequent stays
        slot = np.zeros(1 << SLOT_BITS, np.uint16)
        _, one = np.unique(_slots(pairs, bits), return_index=True)
        pairs = np.sort(pairs[one])
        slot[_slots(pairs, bits)] = np.arange(len(pairs))
        lefts, rights = np.zeros(made, bool), np.zeros(made, bool)
        lefts[pairs >> kind(bits)] = True
        rights[pairs & kind((1 << bits) - 1)] = True
        at = np.flatnonzero(lefts[seq[:-1]] & rights[seq[1:]] & ~last[:-1])
        nth = slot[_slots(keys[at], bits)]
        hit = pairs[nth] == keys[at]
        at, nth = at[hit], nth[hit]
        if len(at) > 1:  # runs of one symbol overlap themselves: every other place counts
            new_run = np.concatenate([[True], np.diff(at) != 1])
            first = at[np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))]
            even = (at - first) % 2 == 0
            at, nth = at[even], nth[even]
        seq[at] = made + nth
        last[at] = last[at + 1]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        gain = len(at) / len(seq)
        seq, last = seq[keep], last[keep]
        rules.append(np.stack([pairs >> kind(bits), pairs & kind((1 << bits) - 1)], axis=1).astype(np.uint32))
        made += len(pairs)
        if gain < LEAST_GAIN or made >= limit:
            break
    ends = np.flatnonzero(last) + 1
    to = np.zeros(len(bounds), np.int64)
    to[1:][bounds[1:] > bounds[:-1]] = ends
    return Grammar(base, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), seq, np.maximum.accumulate(to))


def pack_shard(doc_ids: np.ndarray, known: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> bytes:
    """The shard as bytes: head; doc ids and which are not null; first symbol and first id of each document; rules with expansion sizes; symbols."""
    g = re_pair(ids, bounds)
    wide = g.base + len(g.rules) > 1 << 16
    head = HEAD.pack(MAGIC, 4 if wide else 2, len(doc_ids), g.base, len(g.rules), len(g.symbols))
    parts = [doc_ids.astype("<i8"), known.astype("u1"), g.bounds.astype("<u8"), bounds.astype("<u8"), g.rules.astype("<u4"), g.expansion_sizes().astype("<u4"), g.symbols.astype("<u4" if wide else "<u2")]
    return head + b"".join(p.tobytes() for p in parts)


class Shard:
    """A shard read from its bytes."""

    def __init__(self, data: bytes):
        magic, width, n, base, n_rules, n_symbols = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a shard")
        at = HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        self.doc_ids, self.known = take("<i8", n), take("u1", n).astype(bool)
        self.symbol_at, self.id_at = take("<u8", n + 1).astype(np.int64), take("<u8", n + 1).astype(np.int64)
        self.base, self.rules, self.sizes = base, take("<u4", 2 * n_rules).reshape(-1, 2), take("<u4", n_rules).astype(np.int64)
        self.symbols = take("<u4" if width == 4 else "<u2", n_symbols)
        self._flat: tuple[np.ndarray, np.ndarray] | None = None

    def _expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """What the nonterminals stand for, end to end, and where each begins."""
        if self._flat is None:
            at = np.concatenate([[0], np.cumsum(self.sizes)])
            flat = np.empty(at[-1], np.uint32)
            where = at.tolist()
            for i, (a, b) in enumerate(self.rules.tolist()):
                to = where[i]
                for x in (a, b):
                    if x < self.base:
                        flat[to] = x
                        to += 1
                    else:
                        j = x - self.base
                        n = where[j + 1] - where[j]
                        flat[to : to + n] = flat[where[j] : where[j + 1]]
                        to += n
            self._flat = flat, at
        return self._flat

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        flat, at = self._expansions()
        every = np.concatenate([np.arange(self.base, dtype=np.uint32), flat])
        begins = np.concatenate([np.arange(self.base), self.base + at[:-1]])
        sizes = np.concatenate([np.ones(self.base, np.int64), self.sizes])
        return gathered(every, begins, sizes, symbols)[0]

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, decoded alone."""
        return self._expand(self.symbols[self.symbol_at[i] : self.symbol_at[i + 1]])

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, where each document begins, and an end)."""
        return self._expand(self.symbols), self.id_at


SHARDS = "shard long, n_docs long, n_ids long, payload binary"


def write_shards(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> str:
    """Writes the ids of all documents, each with end_id, in ascending doc_id order (null first; ties by the text's hash); returns the path.

    Shards are rows of a Parquet table, so they go wherever Spark writes: shard (ascending with the doc_ids), n_docs, n_ids, payload. Null text: the end id alone. Rows that share a doc_id, or have
    none, are documents each, and so are rows that repeat: ranges of the order are cut within them too. A very long text is one document of one shard.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, held, n = encoder(tokenizer), TaskContext.get().partitionId() << 32, [], 0

        def full() -> pa.RecordBatch:
            sizes = np.concatenate([np.diff(e) for _, _, _, e in held])
            ids, bounds = np.concatenate([x for _, _, x, _ in held]), np.concatenate([[0], np.cumsum(sizes)])
            data = pack_shard(np.concatenate([d for d, _, _, _ in held]), np.concatenate([k for _, k, _, _ in held]), ids, bounds)
            return pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [len(sizes)], "n_ids": [len(ids)], "payload": pa.array([data], pa.binary())})

        for batch in batches:
            for part in slices(batch, most=TEXT_BYTES):
                ids, ends = closed(*enc.encode(part.column("text")), end_id)
                column = part.column("doc_id")
                held.append((column.fill_null(0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False), ids, ends))
                n += len(ids)
                if n >= shard_ids:
                    yield full()
                    shard, held, n = shard + 1, [], 0
        if held:
            yield full()

    small_batches(docs.sparkSession)
    path = path or stage_path(docs.sparkSession, "shards")
    text = column_of(docs, "text", "string")
    # The row's number only cuts runs of rows alike in the rest, whose order does not matter
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"), F.monotonically_increasing_id().alias("row"))
    order = ["doc_id", "h", "row"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(encode, SHARDS).write.option("compression", "zstd").parquet(path)
    return path


def read_shards(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of each document, decoded from the files at path."""
    shards = spark.read.schema(SHARDS).parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column("shard").to_pylist(), batch.column("payload"), strict=True):
                shard = Shard(data.as_buffer())
                ids, at = shard.documents()
                raw, ends = memoryview(ids.astype("<u4")).cast("B"), (at * 4).tolist()
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_pydict({"of_shard": np.full(len(crc), number), "doc_id": pa.array(shard.doc_ids, mask=~shard.known), "inside": at[:-1], "n_tokens": np.diff(at), "ids_crc32": pa.array(crc, pa.int64())})

    # One row for some 2,000,000 ids
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = shards.select("shard", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("base"))
    read = shards.select("shard", "payload").mapInArrow(decode, "of_shard long, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return read.join(base, F.col("of_shard") == F.col("shard")).select("doc_id", (F.col("base") + F.col("inside")).cast("long").alias("start"), "n_tokens", "ids_crc32")
