"""Vector search and hybrid retrieval."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import cosine
from tessera.operators.order import numbered

#: Above this many rows a search may use hashing (see lsh_top_k); results are exact by default.
BACKEND_LIMITS = {"small": 5_000, "default": 10_000, "enterprise": 50_000}
#: Rows of a block of vectors; of a block's rows compared at a time; bytes of blocks that Spark hands to Python at a time.
BLOCK_ROWS, PAIR_ROWS, PAIR_BYTES = 4096, 512, 16_000_000
# Results and floor by kind of request.
ENRICHMENT = {
    "definition": (5, 0.75), "references": (5, 0.7), "modify": (3, 0.8), "members": (5, 0.75), "complexity": (3, 0.7), "all_references": (10, 0.65), "list_types": (8, 0.7),
    "search_symbols": (10, 0.6), "trace": (5, 0.75), "style": (5, 0.7), "hierarchy": (5, 0.75), "project_structure": (3, 0.65), "usages": (8, 0.7), "diagnostics": (5, 0.7), "code_fixes": (5, 0.75),
}


def top_k(rows: DataFrame, query: list[float], k: int, floor: float = 0.0, id_col: str = "vec_id", vector: str = "embedding", where: Column | None = None) -> DataFrame:
    """The k rows most similar to query, best first, with similarity and rank from 1; rows of another length take no part. A filter applies before, not after.

    Each task keeps its own k best, so only those are moved.
    """
    rows = rows if where is None else rows.filter(where)
    near = rows.filter(F.size(vector) == len(query)).withColumn("similarity", cosine(F.col(vector), F.array(*map(F.lit, map(float, query))))).filter(F.col("similarity") >= floor)
    best = near.orderBy(F.desc("similarity"), id_col).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), id_col)))


def _dealt(rows: DataFrame, side: str, id_col: str, vector: str, same: str | None) -> tuple[DataFrame, int]:
    """Rows with an id and a vector, dealt by id into blocks of about BLOCK_ROWS (within `same`): a row for each with ids and vectors as arrays; and the number of blocks."""
    kept = rows.filter(F.col(id_col).isNotNull() & F.col(vector).isNotNull())
    blocks = max(1, -(-kept.count() // BLOCK_ROWS))
    key = F.col(same) if same else F.lit(0)
    each = kept.select(key.alias("same"), F.pmod(F.xxhash64(id_col), F.lit(blocks)).alias(side), F.col(id_col).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    return each.groupBy("same", side).agg(F.collect_list("id").alias(f"{side}_ids"), F.collect_list("v").alias(f"{side}_v")), blocks


def _matrices(row: pa.RecordBatch, side: str) -> dict[int, tuple[pa.Array, np.ndarray]]:
    """length -> (ids, unit vectors; zeros stay) of a block."""
    ids, lists = row.column(f"{side}_ids")[0].values, row.column(f"{side}_v")[0].values
    sizes, flat = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    out = {}
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        m = flat[(ends[at] - d)[:, None] + np.arange(d)]
        length = np.sqrt((m * m).sum(axis=1, keepdims=True))
        out[d] = ids.take(pa.array(at)), m / np.where(length > 0, length, 1.0)
    return out


def _blockwise(
    left: DataFrame, right: DataFrame, left_id: str, right_id: str, vector: str, same: str | None, compared: Callable[[pa.Array, np.ndarray, pa.Array, np.ndarray], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """What `compared` makes of each pair of blocks of the sides, called with ids and unit vectors of one length."""
    a, _ = _dealt(left, "a", left_id, vector, same)
    b, blocks = _dealt(right, "b", right_id, vector, same)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one, other = _matrices(batch.slice(i, 1), "a"), _matrices(batch.slice(i, 1), "b")
                for d in one.keys() & other.keys():
                    yield from compared(*one[d], *other[d])

    # A row of blocks is a few megabytes, so few of them make a batch
    left.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", PAIR_BYTES)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    # Dealt out by blocks of the right side, mostly the larger: few queries are still many tasks
    pairs = a.withColumn("b", every).join(b, ["same", "b"])
    return pairs.select("a_ids", "a_v", "b_ids", "b_v").mapInArrow(compare, schema)


def knn_join(left: DataFrame, right: DataFrame, k: int | None, floor: float, left_id: str = "id", right_id: str = "id", vector: str = "embedding", same: str | None = None) -> DataFrame:
    """left_id, right_id, similarity, rank: for each left row the k most similar right rows at floor or above, best first (ties: smaller id); without k, all of them.

    Rows with the row's own id, and vectors of another length, are not compared; a vector of zeros has similarity 0. With `same`, only rows alike in that column are. Both sides are dealt into blocks
    by their counts; each pair of blocks is a matrix product, from which a left row keeps k rows at most, so neither side is ever whole in one place.
    """
    kind = dict(left.dtypes)[left_id], dict(right.dtypes)[right_id]
    schema = f"left_id {kind[0]}, right_id {kind[1]}, similarity double"
    near = _blockwise(left, right, left_id, right_id, vector, same, lambda a, x, b, y: _nearest(a, x, b, y, k, floor), schema)
    rank = F.row_number().over(Window.partitionBy("left_id").orderBy(F.desc("similarity"), "right_id"))
    ranked = near.withColumn("rank", rank)
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def _nearest(left: pa.Array, x: np.ndarray, right: pa.Array, y: np.ndarray, k: int | None, floor: float, near: Callable[[int, int], np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
    """left_id, right_id, similarity of the pairs of two blocks that a join keeps: no more than k of a left row but for ties with the k-th. Rows of one id are no pair, unless `near` tells which rows are."""
    codes = pc.dictionary_encode(pa.concat_arrays([left.cast(right.type), right])).indices.to_numpy()
    for at in range(0, len(x), PAIR_ROWS):
        scores = x[at : at + PAIR_ROWS] @ y.T
        other = codes[at : at + len(scores), None] != codes[None, len(left) :] if near is None else near(at, at + len(scores))
        keep = (scores >= floor) & other
        if k is not None and scores.shape[1] > k:
            held = np.where(keep, scores, -np.inf)
            keep &= scores >= np.partition(held, -k, axis=1)[:, -k][:, None]
        i, j = np.nonzero(keep)
        if len(i):
            yield pa.RecordBatch.from_pydict({"left_id": left.take(pa.array(at + i)), "right_id": right.take(pa.array(j)), "similarity": scores[i, j]})


def federated_top_k(rows: DataFrame, query: list[float], k: int, projects: list[str] | None = None, floor: float = 0.0, project: str = "project") -> DataFrame:
    """The k best over the stores of all projects named, each project's own k best first: rows are filtered by project at the scan."""
    where = None if projects is None else F.col(project).isin(*projects)
    return top_k(rows, query, k, floor, where=where)


def centroids(rows: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """group, n, centroid: element-wise means, added up in each task before the shuffle."""
    each = rows.select(group, F.posexplode(vector).alias("i", "x"))
    means = each.groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    gathered = means.groupBy(group).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "m"))).alias("pairs"))
    return gathered.select(group, "n", F.transform("pairs", lambda p: p["m"]).alias("centroid"))


def centroid_pairs(centers: DataFrame, group: str, floor: float = 0.85) -> DataFrame:
    """a, b (a < b), similarity of groups whose centroids are alike."""
    near = knn_join(centers, centers, None, floor, group, group, "centroid")
    return near.filter("left_id < right_id").select(F.col("left_id").alias("a"), F.col("right_id").alias("b"), "similarity")


def lsh_top_k(
    queries: DataFrame, rows: DataFrame, k: int, floor: float = 0.0, id_col: str = "vec_id", vector: str = "embedding", tables: int = 8, bits: int = 6, probes: int = 2,
    seed: int = 1
) -> DataFrame:
    """query_id, id_col, similarity, rank: approximate top_k for each row of queries. Rows whose signature of random hyperplanes differs from the
query's in at most `probes` bits, in one table at least, are compared exactly.

    With 2 of 6 bits the mean recall of 10 is 0.99 on the given embeddings; with 1 it is 0.88 to 0.90, with none 0.32 to 0.41. Rows of another length than the first query's take no part.
    Both sides are dealt into blocks by their counts, as in knn_join; signatures and products of two blocks are matrices, from which a query keeps k rows at most.
    """
    first = queries.select(F.size(vector)).first()
    size = max(first[0] if first else 1, 1)
    planes = np.random.Generator(np.random.PCG64(seed)).normal(size=(tables, bits, size))
    fit = lambda d: d.filter(F.size(vector) == size)

    def near(x: np.ndarray, y: np.ndarray) -> Callable[[int, int], np.ndarray]:
        """Which rows of x (from, to) are near which of y."""
        signed = lambda v: [((v @ p.T > 0) @ (1 << np.arange(bits))).astype(np.min_scalar_type(2**bits - 1)) for p in planes]
        a, b = signed(x), signed(y)
        return lambda i, j: np.logical_or.reduce([np.bitwise_count(s[i:j, None] ^ t[None, :]) <= probes for s, t in zip(a, b, strict=True)])

    kind = dict(queries.dtypes)[id_col], dict(rows.dtypes)[id_col]
    met = _blockwise(fit(queries), fit(rows), id_col, id_col, vector, None, lambda a, x, b, y: _nearest(a, x, b, y, k, floor, near(x, y)), f"left_id {kind[0]}, right_id {kind[1]}, similarity double")
    rank = F.row_number().over(Window.partitionBy("left_id").orderBy(F.desc("similarity"), "right_id"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("left_id").alias("query_id"), F.col("right_id").alias(id_col), "similarity", "rank")


def upsert(base: DataFrame, changes: DataFrame, id_col: str, order: str) -> DataFrame:
    """base with the latest change of each id instead of, or beside, its rows."""
    last = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc(order)))
    new = changes.withColumn("__n", last).filter("__n = 1").drop("__n")
    return base.join(new.select(id_col), id_col, "left_anti").unionByName(new.select(*base.columns))


def deleted(rows: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """rows without those whose id is in gone."""
    return rows.join(gone.select(id_col), id_col, "left_anti")


def duplicates_on_ingest(store: DataFrame, incoming: DataFrame, floor: float = 0.85, k: int = 10, shown: int = 3, reuse: float = 0.90) -> DataFrame:
    """For each incoming row (id, project, embedding) its `shown` nearest stored rows at floor or above; reuse_hint where the project differs and the similarity is `reuse` or more."""
    near = knn_join(incoming, store, k, floor)
    own = incoming.select(F.col("id").alias("left_id"), F.col("project").alias("left_project"))
    other = store.select(F.col("id").alias("right_id"), F.col("project").alias("right_project"))
    named = near.filter(F.col("rank") <= shown).join(own, "left_id").join(other, "right_id")
    return named.withColumn("reuse_hint", (F.col("left_project") != F.col("right_project")) & (F.col("similarity") >= reuse))


def backend(n: int, size: str = "default") -> str:
    return "exact" if n <= BACKEND_LIMITS[size] else "hashed"


def backend_of(n: Column, most: int) -> Column:
    """The same for a column of counts."""
    return F.when(n <= most, "exact").otherwise("hashed")


def search_route(mode: Column, local: Column, hub: Column) -> Column:
    """Where a search goes: local, hub, both or none, by what it asks for (local, hub, both or any) and whether each is there. any: the local index if it is there, else the hub; both: what is there of them."""
    one = lambda there, name: F.when(there, name).otherwise("none")
    either = F.when(local & hub, "both").when(local, "local").when(hub, "hub").otherwise("none")
    return F.when(mode == "local", one(local, "local")).when(mode == "hub", one(hub, "hub")).when(mode == "any", F.when(local, "local").when(hub, "hub").otherwise("none")).otherwise(either)


def score_range(rows: DataFrame, score: str) -> DataFrame:
    """rows with `normalised`: the score's place between the smallest and the largest; 1 where those are equal."""
    ends = rows.agg(F.min(score).alias("__low"), F.max(score).alias("__high"))
    width = F.col("__high") - F.col("__low")
    return rows.join(F.broadcast(ends)).withColumn(
        "normalised", F.when(width < 1e-10, 1.0).otherwise((F.col(score) - F.col("__low")) / F.when(width < 1e-10, 1.0).otherwise(width))
    ).drop("__low", "__high")


def rank_fusion(ranked: DataFrame, k: int = 60, weights: dict[int, float] | None = None) -> DataFrame:
    """id, score, final_rank (from 0), appearances, lowest, highest of lists given as rows (list, id, rank0): the sum of weight / (k + rank). Weights are divided by their sum."""
    if k < 0:
        raise ValueError("k must not be negative")
    if weights is not None:
        total = sum(weights.values())
        if total <= 0:
            raise ValueError("weights must add up to more than 0")
        share = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i, w in weights.items() for x in (i, w / total)]), F.col("list")), F.lit(0.0))
    else:
        share = F.lit(1.0)
    part = F.when(F.lit(k) + F.col("rank0") == 0, F.lit(float("inf"))).otherwise(share / F.when(F.lit(k) + F.col("rank0") == 0, 1).otherwise(F.lit(k) + F.col("rank0")))
    fused = ranked.withColumn("part", part).groupBy("id").agg(
        F.sum("part").alias("score"), F.count("*").alias("appearances"), F.min("rank0").alias("lowest"), F.max("rank0").alias("highest"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("list", "rank0")))).alias("ranks")
    )
    best_first = [F.desc(F.round("score", 12)), F.col("id")]
    return numbered(fused, best_first, "final_rank").withColumn("final_rank", F.col("final_rank").cast("int"))


def weighted_fusion(entity: DataFrame, content: DataFrame, semantic: DataFrame, limit: int, weights: tuple[float, float, float] = (0.3, 0.3, 0.4)) -> DataFrame:
    """id, score, sources, n_sources of three lists (id, score): weighted scores of an id are added up; more sources win ties."""
    lists = [
        d.groupBy("id").agg((F.max("score") * w).alias("score")).withColumn("source", F.lit(s)) for d, w,
        s in zip((entity, content, semantic), weights, ("entity", "content", "semantic"), strict=True)
    ]
    every = lists[0].unionByName(lists[1]).unionByName(lists[2])
    fused = every.groupBy("id").agg(F.sum("score").alias("score"), F.array_join(F.array_sort(F.collect_list("source")), "+").alias("sources"), F.count("*").alias("n_sources"))
    return fused.orderBy(F.desc(F.round("score", 9)), F.desc("n_sources"), "id").limit(limit)


def hybrid_rank(vector_hits: DataFrame, feature_hits: DataFrame, mode: str = "hybrid", weights: tuple[float, float] = (0.7, 0.3), k: int = 60) -> DataFrame:
    """Weighted rank fusion of two lists (id, score): vector only, features only, or both, with each list's score beside the fused one."""
    lists = {"vector": vector_hits, "features": feature_hits}
    used = [n for n in lists if mode in ("hybrid", n)]
    ranked = [numbered(lists[n].select("id", "score"), [F.desc("score"), F.col("id")], "rank0").select(F.lit(i).alias("list"), "id", "rank0") for i, n in enumerate(used)]
    every = ranked[0] if len(ranked) == 1 else ranked[0].unionByName(ranked[1])
    w = {i: weights[list(lists).index(n)] for i, n in enumerate(used)}
    out = rank_fusion(every, k, w)
    for n in lists:
        out = out.join(lists[n].groupBy("id").agg(F.max("score").alias(f"{n}_score")), "id", "left")
    return out


def embed(texts: Column, dimensions: int = 384) -> Column:
    """A vector for a text without a model: the bytes of its md5 in turn as v / 128 - 1, to unit length."""
    digest = F.md5(texts)
    values = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.conv(F.substring(digest, F.pmod(i, F.lit(16)) * 2 + 1, F.lit(2)), 16, 10).cast("double") / 128 - 1)
    size = F.sqrt(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(values, lambda x: F.when(size == 0, 0.0).otherwise(x / size))


def embed_once(rows: DataFrame, text: str, embedder, name: str = "embedding") -> DataFrame:
    """rows with embedder(text column): texts alike after trimming, in line ends and case are embedded once and joined back."""
    from tessera.functions.text import unix_lines

    key = F.lower(F.trim(unix_lines(F.col(text))))
    keyed = rows.withColumn("__key", key)
    once = keyed.select("__key").distinct().withColumn(name, embedder(F.col("__key")))
    return keyed.join(once, "__key", "left").drop("__key")


def enriched(requests: DataFrame, rows: DataFrame, kind: str, floor: float | None = None) -> DataFrame:
    """request_id, id, similarity, rank: for each request (id, embedding) the rows that a kind of request shows beside its own result; at another floor where one is given."""
    k, least = ENRICHMENT[kind]
    return knn_join(requests, rows, k, least if floor is None else floor).select(F.col("left_id").alias("request_id"), F.col("right_id").alias("id"), "similarity", "rank")


def search_scope(rows: DataFrame, scope: str) -> DataFrame:
    """rows of a scope: solution, methods, classes or project:name."""
    if scope.startswith("project:"):
        return rows.filter(F.col("project") == scope.partition(":")[2])
    kinds = {"solution": None, "methods": "method", "classes": "class"}
    if scope not in kinds:
        raise ValueError(f"no such scope: {scope}")
    return rows if kinds[scope] is None else rows.filter(F.col("kind") == kinds[scope])
