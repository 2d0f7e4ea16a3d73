"""Near-duplicates by consistent weighted sampling over TF-IDF shingles.

Shingles of five words weigh (1 + ln tf) * (1 + idf). Improved consistent
weighted sampling draws, for each of HASHES seeds, a shingle and a level of its
weight, so that two texts draw alike with a probability of their weighted
Jaccard similarity. Bands of the draws bring texts together. Each band's texts
are compared with its leader first; those that this leaves in different classes
are then compared with each other, pair by pair in bands of few texts and block
by block in bands of many. Each comparison computes the weighted Jaccard
similarity of the whole texts.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest as hash_word

from tessera.llm.common import TABLE_PARTS, checkpointed, coded_words, column_of, give_back, mix64, removed, slices, small_batches, stage_path, staged, table_sum, tidy, trim
from tessera.llm.components import components

SHINGLE, THRESHOLD = 5, 0.8
HASHES, BANDS, ROWS = 64, 32, 5
#: Share of the documents up to which a shingle counts as rare (idf 1); one that all have has idf 0. It is a share, so idf does not change with the size of the corpus.
RARE = 1 / 128
#: Document frequencies are counted in so many hashed buckets, a table of fixed size (2 MB). A bucket's mean load, a 500th of the documents at 500 shingles each, is taken off its count, so what
#: shingles of a bucket add to each other's frequency stays below RARE.
DF_BITS = 18
#: Draws are read from tables of so many entries by seeds of their own; a shingle's full hash decides between equal draws.
TABLE_BITS = 16
#: Four bits of each draw. Texts at the threshold differ in 12 of them with a deviation of 3.1, so they differ in more than this in one of some 10,000,000 cases (bands miss far more, see README);
#: such pairs are not compared.
SKETCH_WORDS, MOST_DIFFERENT = 4, 30
#: What a band's leader leaves apart is listed pair by pair in bands of up to so many texts, so that a text is in so many pairs of a band at most; in larger ones, pairs are never rows but cells of
#: blocks. Both compare the same: all pairs of different classes whose sketches are near enough.
SMALL_BAND = 32
#: Sketches of a block of a large band; text bytes of a block of alike texts; shingles of a block multiplied at a time.
SKETCHES, BLOCK_BYTES, COLUMNS = 256, 250_000, 4096
#: Nodes are hashed to so many places to tell which texts are wanted, so that set has a fixed size (8 MB).
PLACES = 1 << 20
#: Shingles drawn from at a time; text bytes of which shingles are in memory.
CHUNK, TEXT_BYTES = 32_768, 2_000_000


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash, count) of the distinct shingles of each text, sorted. Texts of one to four words have one shingle, texts without words none."""
    starts, codes, words = coded_words(texts)
    hashed = mix64(np.fromiter(map(hash_word, words), np.uint64, len(words)))
    w = hashed[codes]
    n = np.diff(starts)
    per = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), per)
    first = np.repeat(starts[:-1] - np.concatenate([[0], np.cumsum(per)[:-1]]), per) + np.arange(len(doc))
    h = np.zeros(len(doc), np.uint64)
    w = np.concatenate([w, np.zeros(SHINGLE, np.uint64)])
    last = np.repeat(starts[1:], per)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            h = h * np.uint64(0x9E3779B97F4A7C15) + np.where(first + k < last, w[first + k], np.uint64(0))
    h = mix64(h)
    at = 0
    for size in per.tolist():
        h[at : at + size].sort()
        at += size
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.concatenate([at, [len(h)]]))


@functools.lru_cache(maxsize=1)
def _draws() -> tuple[np.ndarray, ...]:
    """Tables of Gamma(2, 1) draws r (and 1 / r), ln c and uniform draws; odd multipliers and shifts of the seeds; the draws of each band."""
    rng = np.random.Generator(np.random.PCG64(20240229))
    n = 1 << TABLE_BITS
    r, c, beta = rng.gamma(2, 1, n), rng.gamma(2, 1, n), rng.random(n)
    multiply = rng.integers(0, 1 << 32, HASHES, np.uint32) | np.uint32(1)
    bands = np.stack([rng.permutation(HASHES)[:ROWS] for _ in range(BANDS)])
    f = np.float32
    return r.astype(f), (1 / r).astype(f), np.log(c).astype(f), beta.astype(f), multiply, bands


def weights(h: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return ((1 + np.log(tf)) * (1 + idf[(h >> np.uint64(64 - DF_BITS)).astype(np.int64)])).astype(np.float32)


def idf_table(df: np.ndarray, n_docs: int) -> np.ndarray:
    """idf by bucket, from 0 (in every document) to 1 (in a share of RARE or less)."""
    share = np.maximum(df - df.mean(), 0) / max(n_docs, 1)
    return np.clip(np.log(np.maximum(share, RARE)) / np.log(RARE), 0, 1).astype(np.float32)


def samples(h: np.ndarray, w: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """HASHES draws (rows) for each stretch of shingles (columns): the draw's value above the shingle's low hash bits, the smallest of its stretch."""
    r, inverse, ln_c, beta, multiply, _ = _draws()
    out = np.empty((HASHES, len(starts)), np.uint64)
    low = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    lw, tie = np.log(w), low.astype(np.uint64)
    mixed = (h >> np.uint64(32)).astype(np.uint32) ^ low
    shift = np.uint32(32 - TABLE_BITS)
    for k in range(HASHES):
        at = ((mixed * multiply[k]) >> shift).astype(np.int64)
        b = beta[at]
        t = np.floor(lw * inverse[at] + b)
        t -= b
        t += 1
        t *= r[at]
        a = ln_c[at] - t
        a += 128  # positive floats sort as their bits do
        key = a.view(np.uint32).astype(np.uint64)
        key <<= np.uint64(32)
        key |= tie
        out[k] = np.minimum.reduceat(key, starts)
    return out


def _signatures(doc: np.ndarray, h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(texts with shingles, their band keys, their sketch bits)."""
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    have, ends = doc[first], np.concatenate([first[1:], [len(doc)]])
    keys, sketch = np.empty((len(have), BANDS), np.int64), np.empty((len(have), SKETCH_WORDS), np.int64)
    bands = _draws()[5]
    i = 0
    with np.errstate(over="ignore"):
        while i < len(have):
            j = max(i + 1, int(np.searchsorted(ends, first[i] + CHUNK, side="right")))
            a, b = first[i], ends[j - 1]
            s = mix64(samples(h[a:b], w[a:b], first[i:j] - a).ravel()).reshape(HASHES, j - i)
            bits = np.zeros((j - i, SKETCH_WORDS), np.uint64)
            for k in range(HASHES):
                bits[:, k // 16] |= (s[k] & np.uint64(15)) << np.uint64(4 * (k % 16))
            sketch[i:j] = bits.view(np.int64)
            for k in range(BANDS):
                x = np.full(j - i, k + 1, np.uint64)
                for row in bands[k]:
                    x = mix64(x * np.uint64(0x9E3779B97F4A7C15) + s[row])
                keys[i:j, k] = x.view(np.int64)
            i = j
    return have, keys, sketch


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """(documents by bucket, documents), counted over every row."""
    size = 1 << DF_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        table = np.zeros(size + TABLE_PARTS, np.int64)
        for batch in batches:
            for part in slices(batch, most=TEXT_BYTES):
                _, h, _ = shingles(part.column("text"))
                table[:size] += np.bincount((h >> np.uint64(64 - DF_BITS)).astype(np.int64), minlength=size)
                table[size] += part.num_rows
        return table if table[size] else None

    table = table_sum(rows.select("text"), size + TABLE_PARTS, count)
    return table[:size], int(table[size])


def differences(a: str, b: str) -> Column:
    """Draws that differ, by the sketches in columns a0 to a3 and b0 to b3."""
    total = F.lit(0)
    for i in range(SKETCH_WORDS):
        x = F.col(f"{a}{i}").bitwiseXOR(F.col(f"{b}{i}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return total


def text_keys(text: Column) -> tuple[Column, Column]:
    """Two independent hashes (h, g) that stand for a text; null as the empty text."""
    whole = F.coalesce(text, F.lit(""))
    return F.xxhash64(whole).alias("h"), F.xxhash64(F.lit(SHINGLE), whole).alias("g")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two texts as (sorted hashes, weights)."""
    at = np.minimum(np.searchsorted(b[0], a[0]), max(len(b[0]) - 1, 0))
    if not len(a[0]) or not len(b[0]):
        return 0.0
    hit = b[0][at] == a[0]
    both = float(np.minimum(a[1][hit], b[1][at[hit]]).sum(dtype=np.float64))
    return both / (float(a[1].sum(dtype=np.float64)) + float(b[1].sum(dtype=np.float64)) - both)


def _texts(ends: DataFrame, nodes: DataFrame, rows: DataFrame, folder: str) -> DataFrame:
    """node, text of the nodes in ends. Most texts are not wanted: those whose place is free are left where they are."""
    wanted = checkpointed(ends.distinct().join(nodes.select("node", "h", "g", "first_doc"), "node"))
    place = F.pmod("h", F.lit(PLACES)).alias("place")
    near = rows.withColumn("place", place).join(F.broadcast(wanted.select(place).distinct()), "place", "left_semi")
    asked = wanted.select("node", F.col("h").alias("of_h"), F.col("g").alias("of_g"), "first_doc")
    found = near.join(asked, near.doc_id.eqNullSafe(F.col("first_doc")) & (near.h == F.col("of_h")) & (near.g == F.col("of_g")))
    # A plain table, so that Spark can split what is joined with it
    return staged(found.select("node", "text").dropDuplicates(["node"]), "texts", folder)


def _verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, idf, threshold: float, folder: str) -> DataFrame:
    """a, b, alike of pairs (a, b) of nodes. b's are the fewer, so they are read last and kept while they repeat."""
    texts = _texts(pairs.select(F.explode(F.array("a", "b")).alias("node")), nodes, rows, folder)
    side = lambda name: texts.select(F.col("node").alias(name), F.col("text").alias(f"text_{name}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for part in slices(batch, "text_a", TEXT_BYTES):
                a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
                new = {x: i for i, x in enumerate(b) if x not in held}
                both = pa.concat_arrays([part.column("text_a"), part.column("text_b").take(pa.array(list(new.values()), pa.int64()))])
                doc, h, tf = shingles(both)
                w = weights(h, tf, idf.value)
                at = np.searchsorted(doc, np.arange(len(both) + 1))
                of = lambda i: (h[at[i] : at[i + 1]], w[at[i] : at[i + 1]])
                fresh = {x: of(len(a) + i) for i, x in enumerate(new)}
                alike = [similarity(of(i), fresh.get(y) or held[y]) >= threshold for i, y in enumerate(b)]
                held = {y: fresh.get(y) or held[y] for y in b[-1:]}
                yield pa.RecordBatch.from_pydict({"a": a, "b": b, "alike": alike})

    return joined.select("a", "b", "text_a", "text_b").mapInArrow(tidy(compare), "a long, b long, alike boolean")


def block_links(texts: pa.Array, other: pa.Array, labels: np.ndarray, other_labels: np.ndarray, idf: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of texts and others of different labels whose similarity reaches the threshold, for each text one of each label.

    min(w, v) of a shingle that the texts have m and n times is the sum over levels up to both m and n of what a level adds, so sums of minima are a product of matrices over levels of shingles.
    """
    n = len(texts)
    doc, h, tf = shingles(pa.concat_arrays([texts.cast(pa.large_string()), other.cast(pa.large_string())]))
    unit = weights(h, np.ones(len(h)), idf).astype(np.float64)
    total = np.bincount(doc, weights=weights(h, tf, idf), minlength=n + len(other))
    level = np.arange(tf.sum()) - np.repeat(np.cumsum(tf) - tf, tf)
    adds = np.repeat(unit, tf) * np.where(level == 0, 1.0, np.log1p(level) - np.log(np.maximum(level, 1)))
    with np.errstate(over="ignore"):
        keys = np.repeat(h, tf) + mix64(level.astype(np.uint64))
    doc = np.repeat(doc, tf)
    _, column = np.unique(keys, return_inverse=True)
    here, there = np.zeros(column.max(initial=-1) + 1, bool), np.zeros(column.max(initial=-1) + 1, bool)
    here[column[doc < n]], there[column[doc >= n]] = True, True
    rank = np.cumsum(here & there) - 1
    keep = (here & there)[column]
    doc, column, value = doc[keep], rank[column[keep]], np.sqrt(adds[keep]).astype(np.float32)
    order = np.argsort(column, kind="stable")
    doc, column, value = doc[order], column[order], value[order]
    both = np.zeros((n, len(other)), np.float32)
    for low in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        dense = np.zeros((n + len(other), COLUMNS), np.float32)
        dense[doc[a:b], column[a:b] - low] = value[a:b]
        both += dense[:n] @ dense[n:].T
    whole = total[:n, None] + total[None, n:] - both
    alike = (both >= (threshold - 1e-5) * whole) & (labels[:, None] != other_labels[None, :])
    i, j = np.nonzero(alike)
    _, one = np.unique(np.stack([i, other_labels[j]]), axis=1, return_index=True) if len(i) else (None, np.zeros(0, np.int64))
    return i[one], j[one]


def _dealt(open_rows: DataFrame, group: str, space: int) -> DataFrame:
    """Rows (group, label, size and others) of groups of more than one class, with the group's largest class (core) and the columns and lines of blocks, each of about `space` sizes, that it takes to hold those outside the core against all."""
    sizes = open_rows.groupBy(group, "label").agg(F.sum("size").alias("n")).groupBy(group).agg(F.max(F.struct("n", "label")).alias("core"), F.sum("n").alias("all"))
    blocks = lambda n: F.ceil(n / F.lit(space)).cast("long")
    plan = sizes.filter("all > core.n").select(group, F.col("core.label").alias("core"), blocks(F.col("all")).alias("columns"), blocks(F.col("all") - F.col("core.n")).alias("lines"))
    return checkpointed(open_rows.join(checkpointed(plan), group))


def _sent(placed: DataFrame, group: str, *others: str) -> DataFrame:
    """group, line, column of each block with its rows: those that ask (outside the core) and those that they are held against."""
    spread = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.col(k) - 1))
    part = lambda k: F.pmod(F.xxhash64("node"), F.col(k))
    rest = placed.filter("label <> core").select(group, part("lines").alias("line"), spread("columns").alias("column"), "node", "label", *others, F.lit(True).alias("asks"))
    every = placed.select(group, spread("lines").alias("line"), part("columns").alias("column"), "node", "label", *others, F.lit(False).alias("asks"))
    return rest.unionByName(every)


def near_labels(a: np.ndarray, b: np.ndarray, labels: np.ndarray, other_labels: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(label, label) that connect all the labels of sketches (rows of a and of b) which differ in at most so many draws."""
    differ = np.zeros((len(a), len(b)), np.uint8)
    for k in range(SKETCH_WORDS):
        x = a[:, k, None] ^ b[None, :, k]
        x |= (x >> np.uint64(2)) & np.uint64(0x3333333333333333)
        x |= (x >> np.uint64(1)) & np.uint64(0x5555555555555555)
        differ += np.bitwise_count(x & np.uint64(0x1111111111111111))
    near = (differ <= most) & (labels[:, None] != other_labels[None, :])
    left, out = near.any(1), []
    while left.any():
        seed = int(np.argmax(left))
        rows, columns = np.zeros(len(a), bool), np.zeros(len(b), bool)
        rows[seed], new = True, np.array([seed])
        while len(new):
            met = near[new].any(0) & ~columns
            columns |= met
            new = np.flatnonzero(near[:, met].any(1) & ~rows)
            rows[new] = True
        left &= ~rows
        ends = np.unique(np.concatenate([labels[rows], other_labels[columns]]))
        out.append(np.stack([np.full(len(ends), labels[seed]), ends]))
    pairs = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
    return pairs[0], pairs[1]


def _near_classes(open_rows: DataFrame) -> DataFrame:
    """a, b: classes that texts of one large band (band, node, label, a0 to a3) connect, as their sketches allow that they are alike. Those outside the band's largest class are held against all of the band."""
    words, most = [f"a{i}" for i in range(SKETCH_WORDS)], MOST_DIFFERENT

    def compare(table: pa.Table) -> pa.Table:
        asks = table["asks"].combine_chunks()
        a, b = table.filter(asks), table.filter(pc.invert(asks))
        bits = lambda t: np.stack([t[c].to_numpy().view(np.uint64) for c in words], axis=1)
        x, y = near_labels(bits(a), bits(b), a["label"].to_numpy(), b["label"].to_numpy(), most)
        return pa.table({"a": x, "b": y}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    sent = _sent(_dealt(open_rows.withColumn("size", F.lit(1).cast("long")), "band", SKETCHES), "band", *words)
    return sent.groupBy("band", "line", "column").applyInArrow(compare, "a long, b long").filter("a <> b").distinct()


def _pool_links(open_rows: DataFrame, nodes: DataFrame, rows: DataFrame, idf, threshold: float, folder: str) -> DataFrame:
    """a, b: links between classes of one pool (classes that texts of large bands connect by their sketches). Those outside the pool's largest class are held against all of the pool, block by block."""
    named = checkpointed(open_rows.select("node", "label").distinct().join(nodes.select("node", "size"), "node"))
    pools = checkpointed(components(_near_classes(open_rows)).select(F.col("node").alias("label"), F.col("label").alias("pool")))
    placed = _dealt(named.join(pools, "label"), "pool", BLOCK_BYTES)
    sent = _sent(placed, "pool").join(_texts(placed.select("node"), nodes, rows, folder), "node")

    def compare(table: pa.Table) -> pa.Table:
        asks = table["asks"].combine_chunks()
        a, b = table.filter(asks), table.filter(pc.invert(asks))
        column = lambda t, c: t[c].combine_chunks()
        i, j = block_links(column(a, "text"), column(b, "text"), a["label"].to_numpy(), b["label"].to_numpy(), idf.value, threshold) if a.num_rows and b.num_rows else (np.zeros(0, np.int64),) * 2
        trim()
        return pa.table({"a": a["node"].to_numpy()[i], "b": b["node"].to_numpy()[j]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return sent.groupBy("pool", "line", "column").applyInArrow(compare, "a long, b long")


def _signed(rows: DataFrame, idf, folder: str) -> DataFrame:
    """A row for each distinct text: node (its number), h, g, size (bytes), first_doc (smallest doc_id that is not null), n (rows), its sketch and the keys of its bands."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=TEXT_BYTES):
                doc, h, tf = shingles(part.column("text"))
                have, keys, sketch = _signatures(doc, h, weights(h, tf, idf.value))
                bands = np.zeros(part.num_rows + 1, np.int32)
                bands[have + 1] = BANDS
                words = np.zeros((part.num_rows, SKETCH_WORDS), np.int64)
                words[have] = sketch
                columns = {c: part.column(c) for c in ("doc_id", "h", "g", "size")} | {f"s{i}": words[:, i] for i in range(SKETCH_WORDS)}
                keyed = pa.ListArray.from_arrays(pa.array(np.cumsum(bands, dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_pydict(columns | {"bands": keyed})

    drawn = [f"s{i}" for i in range(SKETCH_WORDS)]
    signed = rows.mapInArrow(tidy(sign), f"doc_id long, h long, g long, size long, {', '.join(f'{c} long' for c in drawn)}, bands array<long>")
    each = signed.groupBy("h", "g").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("size", *drawn, "bands")])
    return staged(each.withColumn("node", F.monotonically_increasing_id()), "nodes", folder)


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) after further links (a, b); a node without a label is a class of its own."""
    of = lambda name: labels.select(F.col("node").alias(name), F.col("label").alias(f"of_{name}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    new = components(between)
    to = new.select(F.col("node").alias("from"), F.col("label").alias("to"))
    moved = labels.join(to, F.col("label") == F.col("from"), "left").select("node", F.coalesce("to", "label").alias("label"))
    return checkpointed(moved.unionByName(new.join(labels.select("node"), "node", "left_anti")))


def _open(members: DataFrame, labels: DataFrame, folder: str) -> DataFrame:
    """band, node, label, in_band of the bands whose members (band, node) are of more than one class."""
    placed = staged(members.join(labels, "node", "left").select("band", "node", F.coalesce("label", "node").alias("label")), "placed", folder)
    span = placed.groupBy("band").agg(F.min("label").alias("one"), F.max("label").alias("other"), F.count("*").alias("in_band"))
    return staged(placed.join(checkpointed(span.filter("one <> other").select("band", "in_band")), "band"), "open", folder)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, h, g (hashes of its text), class_node (a number of the class), class_id (smallest doc_id of it), class_docs: one row for each row of docs.

    Texts of at least `threshold` weighted Jaccard similarity are linked, links make classes; equal texts (rows that repeat) are of one class, and so are texts that differ in white space. Texts
    without words, null among them, are alike only if equal. Null doc_ids: class_id is the smallest that is not null. A very long text counts as a whole. Empty table: empty result.

    Two texts that share a band are compared unless their sketches differ in too many draws or other links have made them one class. A band's leader, its smallest node, is compared with all of it;
    of what is then still of different classes, each text outside the band's largest class is compared with all others, as any two of different classes have one of those.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    text = column_of(docs, "text", "string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *text_keys(text), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("size"))
    df, n_docs = document_frequencies(rows)
    idf = spark.sparkContext.broadcast(idf_table(df, n_docs))
    give_back()
    folder = stage_path(spark, "near")
    nodes = _signed(rows, idf, folder)
    sketch = lambda name: nodes.select(F.col("node").alias(name), *[F.col(f"s{i}").alias(f"{name}{i}") for i in range(SKETCH_WORDS)])

    def compared(pairs: DataFrame) -> DataFrame:
        near = pairs.join(sketch("a"), "a").join(sketch("b"), "b").filter(differences("a", "b") <= MOST_DIFFERENT).select("a", "b")
        return checkpointed(_verified(checkpointed(near), nodes, rows, idf, threshold, folder))

    banded = nodes.select("node", F.explode("bands").alias("band"))
    shared = checkpointed(banded.groupBy("band").agg(F.min("node").alias("leader"), F.count("*").alias("size")).filter("size > 1"))
    members = staged(banded.join(shared, "band"), "members", folder)
    checked = compared(members.filter("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct())
    labels = components(checked.filter("alike").select("a", "b"))
    drawn = {f"a{i}": f"b{i}" for i in range(SKETCH_WORDS)}
    open_ = _open(members.filter("size > 2 AND node <> leader").select("band", "node"), labels, folder)
    placed = open_.withColumnRenamed("node", "a").join(sketch("a"), "a")
    small = placed.filter(F.col("in_band") <= SMALL_BAND).withColumnRenamed("label", "label_a").drop("in_band")
    other = small.withColumnsRenamed({"a": "b", "label_a": "label_b"} | drawn)
    met = small.join(other, "band").filter((F.col("label_a") < F.col("label_b")) & (differences("a", "b") <= MOST_DIFFERENT))
    pairs = checkpointed(met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().join(checked.select("a", "b"), ["a", "b"], "left_anti"))
    more = _verified(pairs, nodes, rows, idf, threshold, folder).filter("alike").select("a", "b")
    large = staged(placed.filter(F.col("in_band") > SMALL_BAND).withColumnRenamed("a", "node").drop("in_band"), "large", folder)
    more = checkpointed(more.unionByName(_pool_links(large, nodes, rows, idf, threshold, folder)))
    labels = _merged(labels, more)
    classed = staged(nodes.select("node", "h", "g", "first_doc", "n").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "classed", folder)
    named = checkpointed(classed.groupBy("label").agg(F.min("first_doc").alias("class_id"), F.sum("n").alias("class_docs")))
    by_text = staged(classed.join(named, "label").select("h", "g", F.col("label").alias("class_node"), "class_id", "class_docs"), "near-classes")
    idf.destroy()
    removed(spark, folder)
    return rows.select("doc_id", "h", "g").join(by_text, ["h", "g"]).select("doc_id", "h", "g", "class_node", "class_id", "class_docs")
