"""Queries of lookup, vector search and fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions.similarity import capped_levenshtein, fqn_score, fuzzy_contains, name_similarity, segment_match
from tessera.functions.vectors import cosine, dot, euclidean, magnitude, sparse_cosine
from tessera.operators import lookup, similarity, vector
from tessera.plans.base import SYMBOLS, query, symbols, table


def _vector(spark: SparkSession, d: str, vec_id: int) -> list[float]:
    """One row's vector; none: a zero vector, to which nothing is similar."""
    row = table(spark, d, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()
    return list(row[0]) if row else [0.0] * 64


COSINE = "list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[])"


@query(
    f"SELECT e.vec_id, round({COSINE}, 6) AS similarity, row_number() OVER (ORDER BY {COSINE} DESC, e.vec_id)::INT AS rank FROM embeddings e, embeddings "
    f"q WHERE q.vec_id = 0 AND {COSINE} >= 0 ORDER BY {COSINE} DESC, e.vec_id LIMIT 20"
)
def vector_topk(spark, d) -> DataFrame:
    return vector.top_k(table(spark, d, "embeddings"), _vector(spark, d, 0), 20).select("vec_id", F.round("similarity", 6).alias("similarity"), "rank")


@query(f"SELECT e.vec_id, round({COSINE}, 6) AS similarity FROM embeddings e, embeddings q WHERE q.vec_id = 1 AND e.label % 2 = 0 AND {COSINE} >= 0.2 ORDER BY {COSINE} DESC, e.vec_id LIMIT 10")
def vector_topk_filtered(spark, d) -> DataFrame:
    return vector.top_k(table(spark, d, "embeddings"), _vector(spark, d, 1), 10, 0.2, where=F.col("label") % 2 == 0).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH s AS (SELECT q.vec_id AS left_id, e.vec_id AS right_id, {COSINE} AS x FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY x DESC, right_id)::INT AS rank FROM s WHERE x >= 0.3) SELECT left_id, right_id, round(x, 6) AS
similarity, rank FROM r WHERE rank <= 5""")
def knn_join(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    return vector.knn_join(e.filter("vec_id % 20 = 0"), e, 5, 0.3, "vec_id", "vec_id").select("left_id", "right_id", F.round("similarity", 6).alias("similarity"), "rank")


@query(f"""WITH s AS (SELECT q.vec_id AS left_id, e.vec_id AS right_id, {COSINE} AS x FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY x DESC, right_id)::INT AS rank FROM s WHERE x >= 0.2) SELECT left_id, right_id, round(x, 6) AS similarity FROM r WHERE rank = 1""")
def nearest_of_same_label(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    return vector.knn_join(e, e, 1, 0.2, "vec_id", "vec_id", same="label").select("left_id", "right_id", F.round("similarity", 6).alias("similarity"))


@query(
    f"SELECT e.label AS project, e.vec_id, round({COSINE}, 6) AS similarity FROM embeddings e, embeddings q WHERE q.vec_id = 2 AND e.label IN (1, 3, "
    f"5) AND {COSINE} >= 0 ORDER BY {COSINE} DESC, e.vec_id LIMIT 15"
)
def federated_topk(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("project", F.col("label"))
    return vector.federated_top_k(e, _vector(spark, d, 2), 15, [1, 3, 5]).select("project", "vec_id", F.round("similarity", 6).alias("similarity"))


CENTROIDS = """flat AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label, i, avg(x) AS m FROM flat GROUP BY label, i), c AS (SELECT label, list(m ORDER BY i) AS v FROM m GROUP BY label)"""


@query(f"WITH {CENTROIDS} SELECT label, (i - 1)::INT AS i, round(m, 6) AS x FROM m")
def centroid_by_label(spark, d) -> DataFrame:
    return vector.centroids(table(spark, d, "embeddings"), "label").select("label", F.posexplode("centroid").alias("i", "x")).withColumn("x", F.round("x", 6))


@query(
    f"WITH {CENTROIDS} SELECT a.label AS a, b.label AS b, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM c a JOIN c b ON a.label < b.label "
    f"WHERE list_cosine_similarity(a.v, b.v) >= 0.1"
)
def centroid_pairs(spark, d) -> DataFrame:
    return vector.centroid_pairs(vector.centroids(table(spark, d, "embeddings"), "label"), "label", 0.1).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {CENTROIDS} SELECT e.label, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], c.v), 6) AS to_centroid FROM embeddings e JOIN c ON e.label = c.label")
def similarity_to_centroid(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.join(vector.centroids(e, "label").select("label", "centroid"), "label").select("label", "vec_id", F.round(cosine(F.col("embedding"), F.col("centroid")), 6).alias("to_centroid"))


@query("""SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dot, round(sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])), 6) AS magnitude,
round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS euclidean FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def vector_scalars(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    x, y = F.col("embedding"), F.col("next")
    return e.join(n, "vec_id").select("vec_id", F.round(dot(x, y), 6).alias("dot"), F.round(magnitude(x), 6).alias("magnitude"), F.round(euclidean(x, y), 6).alias("euclidean"))


@query(f"""WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id = 7) SELECT e.vec_id, CASE WHEN x >= 0.98 THEN 'identical' WHEN x >= 0.95 THEN
'refactoring' WHEN x >= 0.85 THEN 'minor' WHEN x >= 0.70 THEN 'moderate' WHEN x >= 0.50 THEN 'major' ELSE 'breaking' END AS category,
CASE WHEN x >= 0.9 THEN 'very similar' WHEN x >= 0.7 THEN 'similar' WHEN x >= 0.5 THEN 'somewhat similar' ELSE 'different' END AS likeness FROM (SELECT
e.vec_id, {COSINE} AS x FROM embeddings e, q) e""")
def semantic_diff(spark, d) -> DataFrame:
    from tessera.functions.ratings import change_category, likeness

    q = F.array(*map(F.lit, map(float, _vector(spark, d, 7))))
    s = cosine(F.col("embedding"), q)
    return table(spark, d, "embeddings").select("vec_id", change_category(s).alias("category"), likeness(s).alias("likeness"))


RANKS = f"""ra AS (SELECT e.vec_id AS id, {COSINE} AS score, row_number() OVER (ORDER BY {COSINE} DESC, e.vec_id) - 1 AS rank0 FROM embeddings e, embeddings q WHERE q.vec_id = 0 QUALIFY rank0 < 50),
rb AS (SELECT e.vec_id AS id, {COSINE} AS score, row_number() OVER (ORDER BY {COSINE} DESC, e.vec_id) - 1 AS rank0 FROM embeddings e, embeddings q WHERE q.vec_id = 1 QUALIFY rank0 < 50)"""


def _ranked(spark, d, vec_id: int, n: int) -> DataFrame:
    return vector.top_k(table(spark, d, "embeddings"), _vector(spark, d, vec_id), 50, -1.0).select(
        F.lit(n).alias("list"), F.col("vec_id").alias("id"), F.col("similarity").alias("score"), (F.col("rank") - 1).alias("rank0")
    )


@query(f"""WITH {RANKS}, f AS (SELECT id, sum(1.0::DOUBLE / (60 + rank0)) AS score, count(*) AS appearances, min(rank0) AS lowest, max(rank0) AS highest FROM
(SELECT * FROM ra UNION ALL SELECT * FROM rb) GROUP BY id)
SELECT id, round(score, 6) AS score, appearances, lowest::INT AS lowest, highest::INT AS highest, (row_number() OVER (ORDER BY round(score, 12) DESC, id) - 1)::INT AS final_rank FROM f""")
def rank_fusion(spark, d) -> DataFrame:
    return vector.rank_fusion(_ranked(spark, d, 0, 0).unionByName(_ranked(spark, d, 1, 1))).select("id", F.round("score", 6).alias("score"), "appearances", "lowest", "highest", "final_rank")


@query(f"""WITH {RANKS}, f AS (SELECT id, sum(w / (60 + rank0)) AS score FROM (SELECT *, 0.7::DOUBLE AS w FROM ra UNION ALL SELECT *, 0.3::DOUBLE FROM rb) GROUP BY id)
SELECT id, round(score, 6) AS score, (row_number() OVER (ORDER BY round(score, 12) DESC, id) - 1)::INT AS final_rank FROM f""")
def weighted_rank_fusion(spark, d) -> DataFrame:
    return vector.rank_fusion(_ranked(spark, d, 0, 0).unionByName(_ranked(spark, d, 1, 1)), weights={0: 7.0, 1: 3.0}).select("id", F.round("score", 6).alias("score"), "final_rank")


@query(f"""WITH {RANKS}, f AS (SELECT id, sum(w / (60 + rank0)) AS score FROM (SELECT *, 0.7::DOUBLE AS w FROM ra UNION ALL SELECT *, 0.3::DOUBLE FROM rb) GROUP BY id)
SELECT f.id, round(f.score, 6) AS score, round(ra.score, 6) AS vector_score, round(rb.score, 6) AS features_score FROM f LEFT JOIN ra ON ra.id = f.id LEFT JOIN rb ON rb.id = f.id""")
def hybrid_search(spark, d) -> DataFrame:
    out = vector.hybrid_rank(_ranked(spark, d, 0, 0).select("id", "score"), _ranked(spark, d, 1, 1).select("id", "score"))
    return out.select("id", *[F.round(c, 6).alias(c) for c in ("score", "vector_score", "features_score")])


@query(f"WITH {RANKS} SELECT id, round((score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()), 6) AS normalised FROM ra")
def minmax_scores(spark, d) -> DataFrame:
    return vector.score_range(_ranked(spark, d, 0, 0), "score").select("id", F.round("normalised", 6).alias("normalised"))


@query(f"""WITH e AS (SELECT p_partkey AS id, 0.6::DOUBLE AS score FROM part WHERE p_name LIKE '%ring%'), c AS (SELECT p_partkey AS id, 0.5::DOUBLE AS score
FROM part WHERE p_type = 'ECONOMY'), s AS (SELECT e.vec_id AS id, {COSINE} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0),
u AS (SELECT id, 0.3 * score AS score, 'entity' AS source FROM e UNION ALL SELECT id, 0.3 * score, 'content' FROM c UNION ALL SELECT id, 0.4 * score, 'semantic'
FROM s), f AS (SELECT id, sum(score) AS score, string_agg(source, '+' ORDER BY source) AS sources, count(*) AS n FROM u GROUP BY id)
SELECT id, round(score, 6) AS score, sources FROM f ORDER BY round(score, 9) DESC, n DESC, id LIMIT 40""")
def weighted_fusion(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    e = p.filter("p_name LIKE '%ring%'").select(F.col("p_partkey").alias("id"), F.lit(0.6).alias("score"))
    c = p.filter("p_type = 'ECONOMY'").select(F.col("p_partkey").alias("id"), F.lit(0.5).alias("score"))
    q = F.array(*map(F.lit, map(float, _vector(spark, d, 0))))
    s = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), cosine(F.col("embedding"), q).alias("score"))
    return vector.weighted_fusion(e, c, s, 40).select("id", F.round("score", 6).alias("score"), "sources")


@query(f"""WITH s AS (SELECT a.vec_id AS left_id, b.vec_id AS right_id, a.label AS la, b.label AS lb, list_cosine_similarity(a.embedding::DOUBLE[],
b.embedding::DOUBLE[]) AS x FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY x DESC, right_id) AS n FROM s WHERE x >= 0.3) SELECT left_id, right_id, round(x, 6) AS
similarity, la <> lb AND x >= 0.4 AS reuse_hint FROM r WHERE n <= 3""")
def duplicates_on_ingest(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("project"), "embedding")
    return vector.duplicates_on_ingest(e, e.filter("id % 20 = 0"), 0.3, reuse=0.4).select("left_id", "right_id", F.round("similarity", 6).alias("similarity"), "reuse_hint")


@query("SELECT vec_id, label + CASE WHEN vec_id % 10 = 0 THEN 100 ELSE 0 END AS label FROM embeddings UNION ALL SELECT vec_id + 1000000, label + 100 FROM embeddings WHERE vec_id % 10 = 0")
def vector_upsert(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "label")
    new = e.filter("vec_id % 10 = 0").withColumn("label", F.col("label") + 100).withColumn("ts", F.lit(2))
    return vector.upsert(e, new.unionByName(new.withColumn("label", F.lit(-1)).withColumn("ts", F.lit(1))).unionByName(new.withColumn("vec_id", F.col("vec_id") + 1000000)), "vec_id", "ts")


@query()
def lsh_topk(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    return vector.lsh_top_k(e.filter("vec_id % 20 = 0"), e, 10).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


@query("""WITH b AS (SELECT r_regionkey AS id, md5(lower(trim(r_name))) AS h FROM region), v AS (SELECT id, i, CASE WHEN true THEN ('0x' || substr(h, ((i % 16)
* 2 + 1)::INT, 2))::INT END / 128.0::DOUBLE - 1 AS x FROM b, range(384) t(i)), n AS (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY id)) AS s FROM v)
SELECT id, i::INT AS i, round(x / s, 6) AS x FROM n""")
def text_embedding(spark, d) -> DataFrame:
    rows = table(spark, d, "region").select(F.col("r_regionkey").alias("id"), "r_name")
    return vector.embed_once(rows, "r_name", vector.embed).select("id", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.round("x", 6))


@query(
    f"WITH {SYMBOLS}, h AS (SELECT *, lower(simple_name) = 'red widget' AS exact FROM symbols WHERE contains(lower(simple_name), 'red widget') OR contains(lower(canonical_fqn), "
    f"'red widget')) SELECT id, canonical_fqn FROM h WHERE exact OR NOT (SELECT coalesce(bool_or(exact), false) FROM h)"
)
def find_exact(spark, d) -> DataFrame:
    return lookup.find(symbols(spark, d), "RED Widget").select("id", "canonical_fqn")


@query(f"WITH {SYMBOLS} SELECT id, canonical_fqn FROM symbols WHERE (contains(lower(simple_name), 'widg') OR contains(lower(canonical_fqn), 'widg')) AND flags & 1 = 1 AND flags & 32768 = 0")
def find_contains(spark, d) -> DataFrame:
    return lookup.find(symbols(spark, d), "widg", required=1, excluded=32768).select("id", "canonical_fqn")


@query(f"WITH {SYMBOLS} SELECT id FROM symbols WHERE lower(namespace) = 'cat.economy.brandn2' AND flags & 1 = 1")
def find_by_namespace(spark, d) -> DataFrame:
    return lookup.by_namespace(symbols(spark, d), "cat.ECONOMY.BrandN2", 1).select("id")


@query(f"WITH {SYMBOLS} SELECT id, flags FROM symbols WHERE flags & 1 = 1 AND flags & {(1 << 4) | (1 << 5) | (1 << 15) | (1 << 16)} <> 0")
def public_api(spark, d) -> DataFrame:
    return lookup.public_api(symbols(spark, d)).select("id", "flags")


@query(f"WITH {SYMBOLS} SELECT id, simple_name FROM symbols WHERE canonical_fqn = 'Cat.ECONOMY.BrandN17.red_widget'")
def find_by_fqn(spark, d) -> DataFrame:
    return lookup.by_fqn(symbols(spark, d), "Cat.ECONOMY.BrandN17.red_widget").select("id", "simple_name")


@query(
    f"WITH {SYMBOLS} SELECT canonical_fqn, min(line_number) AS line_number FROM (SELECT canonical_fqn, line_number, document_id, first_value(line_number) "
    f"OVER (PARTITION BY canonical_fqn ORDER BY document_id, line_number) AS f FROM symbols) WHERE line_number = f GROUP BY canonical_fqn"
)
def symbol_scan(spark, d) -> DataFrame:
    s = symbols(spark, d).withColumn("canonical_fqn", F.concat(F.lit("global::"), F.col("canonical_fqn"))).withColumn("is_implicit", F.lit(False)).withColumn("kind", F.lit("Method"))
    return lookup.scanned(s.unionByName(s.limit(5).withColumn("is_implicit", F.lit(True)).withColumn("canonical_fqn", F.lit("x")))).select("canonical_fqn", "line_number")


@query("""SELECT p_partkey AS id, p_name AS name, CASE WHEN lower(p_name) = 'ring' THEN 1.0 WHEN starts_with(lower(p_name), 'ring') THEN 0.8 WHEN
contains(lower(p_name), 'ring') THEN 0.6 ELSE 0.4 END::DOUBLE AS relevance FROM part
WHERE regexp_matches(p_name, '(?i)RING') AND p_type IN ('ECONOMY', 'STANDARD') AND contains(p_brand, 'Brand#1') ORDER BY 3 DESC, p_name, p_partkey LIMIT 20""")
def entity_search(spark, d) -> DataFrame:
    e = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("namespace"))
    return lookup.entity_search(e, "RING", ["ECONOMY", "STANDARD"], "Brand#1").select("id", "name", "relevance")


@query(r"""WITH h AS (SELECT doc_id, text, len(regexp_extract_all(text, '(?i)the\w+ing')) AS n, trim(list_filter(string_split(text, chr(10)), lambda x:
regexp_matches(x, '(?i)the\w+ing'))[1], ' ') AS line FROM documents WHERE regexp_matches(text, '(?i)the\w+ing'))
SELECT doc_id, n AS hits, CASE WHEN length(line) > 100 THEN line[1:100] || '...' ELSE line END AS first_line, round(least(1.0, n / greatest(length(text) // 100, 1)), 6) AS relevance FROM h""")
def content_search(spark, d) -> DataFrame:
    return lookup.content_search(table(spark, d, "documents"), r"the\w+ing").withColumn("relevance", F.round("relevance", 6))


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents), c AS (SELECT doc_id, len(w) AS n,
len(list_filter(w, lambda x: x = 'license')) AS t0, len(list_filter(w, lambda x: starts_with(x, 'publi'))) AS t1 FROM w),
s AS (SELECT count(*) AS docs, avg(n) AS mean, sum((t0 > 0)::INT) AS d0, sum((t1 > 0)::INT) AS d1 FROM c)
SELECT doc_id, round(ln(1 + (docs - d0 + 0.5) / (d0 + 0.5)) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * n / mean)) + ln(1 + (docs - d1 + 0.5) / (d1 + 0.5)) * t1 *
2.2 / (t1 + 1.2 * (0.25 + 0.75 * n / mean)), 6) AS score
FROM c, s WHERE t0 > 0 OR t1 > 0 ORDER BY ln(1 + (docs - d0 + 0.5) / (d0 + 0.5)) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * n / mean)) + ln(1 + (docs - d1 + 0.5) /
(d1 + 0.5)) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * n / mean)) DESC, doc_id LIMIT 20""".replace("\\\\", "\\"))
def bm25_topk(spark, d) -> DataFrame:
    return lookup.bm25(table(spark, d, "documents"), "license publi*", 20).withColumn("score", F.round("score", 6))


@query("SELECT page_id FROM pages WHERE regexp_matches(url, '(?i)^http.*\\.example\\.com/fr/.*$')")
def glob_wildcard(spark, d) -> DataFrame:
    return table(spark, d, "pages").filter(X.glob_matches(F.col("url"), "HTTP*.example.com/fr/*")).select("page_id")


@query("SELECT page_id FROM pages WHERE starts_with(url, 'http:') AND contains(url, '=x') AND ends_with(url, 'x')")
def glob_double_star(spark, d) -> DataFrame:
    return table(spark, d, "pages").filter(X.glob_matches(F.col("url"), "http:/**/*x") & X.glob_matches(F.col("url"), "=X")).select("page_id")


@query("SELECT p_partkey AS id, regexp_replace(p_name, '^(.*?)ring$', 'loop of \\1') AS renamed FROM part WHERE regexp_matches(p_name, '^(.*?)ring$')")
def wildcard_rewrite(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    return p.filter(X.name_matches(F.col("p_name"), "*ring")).select(F.col("p_partkey").alias("id"), X.rewritten(F.col("p_name"), "*ring", "loop of *").alias("renamed"))


@query("SELECT p_partkey AS id, regexp_replace(p_name, '^(\\w+) (\\w+)$', '\\2_\\1') AS renamed FROM part WHERE regexp_matches(p_name, '^(\\w+) (\\w+)$')")
def regex_rewrite(spark, d) -> DataFrame:
    p, rx = table(spark, d, "part"), r"^(\w+) (\w+)$"
    return p.filter(X.name_matches(F.col("p_name"), rx)).select(F.col("p_partkey").alias("id"), X.rewritten(F.col("p_name"), rx, "$2_$1").alias("renamed"))


@query("""WITH p AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), x AS (SELECT l_partkey AS part, l_suppkey AS id, p_name AS name, substr(s_name, 1, 6)
|| ' ring' AS asked FROM p JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey)
SELECT part, id, CASE WHEN abs(length(asked) - length(name)) > greatest(length(asked), length(name)) // 2 THEN greatest(length(asked), length(name)) ELSE levenshtein(asked, name) END::INT AS distance,
round(CASE WHEN lower(asked) = lower(name) THEN 1.0 ELSE 1 - levenshtein(lower(asked), lower(name)) / greatest(length(asked), length(name), 1) END, 6) AS similarity FROM x""")
def edit_distances(spark, d) -> DataFrame:
    """Of the names of each part and supplier that a line has together."""
    pairs = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    names = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.concat(F.substring("s_name", 1, 6), F.lit(" ring")).alias("asked"))
    x = pairs.join(names, "l_partkey").join(s, "l_suppkey")
    asked, name = F.col("asked"), F.col("name")
    return x.select(
        F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("id"), capped_levenshtein(asked, name).cast("int").alias("distance"),
        F.round(name_similarity(asked, name), 6).alias("similarity")
    )


_ASKED = "Cat.economy.BrandN17.Red_Widget"


@query(f"""WITH {SYMBOLS}, s AS (SELECT id, canonical_fqn, CASE WHEN canonical_fqn = '{_ASKED}' THEN 1.0 WHEN lower(canonical_fqn) = lower('{_ASKED}') THEN 0.99
WHEN lower(split_part(canonical_fqn, '(', 1)) = lower('{_ASKED}') THEN 0.9 ELSE 0.0 END::DOUBLE AS score FROM symbols)
SELECT id, score FROM s WHERE score >= 0.7""")
def fuzzy_names(spark, d) -> DataFrame:
    s = symbols(spark, d).withColumn("score", fqn_score(F.lit(_ASKED), F.col("canonical_fqn")))
    return s.filter("score >= 0.7").select("id", "score")


@query("""WITH x AS (SELECT p_partkey AS id, lower('at Cat.Red_Widget(int)') AS h, p_name AS n FROM part) SELECT id, round(CASE WHEN contains(h, lower(n)) OR contains(lower(n), h) THEN 1.0
ELSE greatest(0.0, 1 - CASE WHEN abs(length(h) - length(n)) > greatest(length(h), length(n)) // 2 THEN greatest(length(h), length(n)) ELSE levenshtein(h,
lower(n)) END / greatest(length(h), length(n))) END, 6) AS score FROM x""")
def fuzzy_hint(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(fuzzy_contains(F.lit("at Cat.Red_Widget(int)"), F.col("p_name")), 6).alias("score"))


@query()
def segment_hint(spark, d) -> DataFrame:
    return symbols(spark, d).select("id", F.round(segment_match(F.lit("at Cat.ECONOMY.red_widget(int)"), F.col("canonical_fqn")), 6).alias("score"))


BOUGHT = "t AS (SELECT o_custkey AS id, l_partkey AS k, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL), m AS (SELECT id, sqrt(sum(n * n)) AS m FROM t GROUP BY id)"


def _bought(spark, d) -> DataFrame:
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return lines.groupBy(F.col("o_custkey").alias("id"), F.col("l_partkey").alias("key")).agg(F.count("*").cast("int").alias("n"))


@query(f"""WITH {BOUGHT}, p AS (SELECT x.id AS a, y.id AS b, sum(x.n * y.n) AS dot FROM t x JOIN t y ON x.k = y.k AND x.id < y.id GROUP BY ALL)
SELECT a, b, round(dot / (ma.m * mb.m), 6) AS similarity FROM p JOIN m ma ON ma.id = a JOIN m mb ON mb.id = b WHERE dot / (ma.m * mb.m) >= 0.22""")
def sparse_cosine_pairs(spark, d) -> DataFrame:
    """Customers who buy alike, by the parts of all their orders."""
    return similarity.sparse_pairs(_bought(spark, d), 0.22).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {BOUGHT}, ids AS (SELECT c_custkey AS id FROM customer)
SELECT a.id AS a, b.id AS b, round(CASE WHEN ma.m IS NULL AND mb.m IS NULL THEN 1.0 WHEN ma.m IS NULL OR mb.m IS NULL THEN 0.0 ELSE coalesce(p.dot, 0) / (ma.m * mb.m) END, 6) AS similarity
FROM ids a JOIN ids b ON b.id = a.id + 1 LEFT JOIN m ma ON ma.id = a.id LEFT JOIN m mb ON mb.id = b.id
LEFT JOIN (SELECT x.id, sum(x.n * y.n) AS dot FROM t x JOIN t y ON x.k = y.k AND y.id = x.id + 1 GROUP BY 1) p ON p.id = a.id""")
def sparse_cosine_next(spark, d) -> DataFrame:
    """Of each customer and the next one, those without orders too."""
    maps = _bought(spark, d).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("key").cast("string"), "n"))).alias("m"))
    every = table(spark, d, "customer").select(F.col("c_custkey").alias("id")).join(maps, "id", "left").withColumn("m", F.coalesce("m", F.create_map().cast("map<string,int>")))
    a, b = every.select(F.col("id").alias("a"), F.col("m").alias("x")), every.select((F.col("id") - 1).alias("a"), F.col("id").alias("b"), F.col("m").alias("y"))
    return a.join(b, "a").select("a", "b", F.round(sparse_cosine(F.col("x"), F.col("y")), 6).alias("similarity"))


_GRAMS = "list_distinct(list_transform(range(1, greatest(len(w) - 6, 1)), lambda i: array_to_string(w[i:i + 7], ' ')))"


@query(f"""WITH b AS (SELECT item_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM benchmark), d AS (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS (SELECT item_id, unnest({_GRAMS}) AS g FROM b), y AS (SELECT doc_id, unnest({_GRAMS}) AS g FROM d), n AS (SELECT item_id, count(*) AS windows FROM x GROUP BY 1)
SELECT item_id, doc_id, count(*) AS shared, any_value(windows) AS windows FROM x JOIN y USING (g) JOIN n USING (item_id) GROUP BY ALL""".replace("\\\\", "\\"))
def passage_search(spark, d) -> DataFrame:
    """Documents that share windows of eight words with a benchmark text, and how many of its windows."""
    return lookup.shared_passages(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "doc_id", 8)


@query(
    f"WITH {SYMBOLS} SELECT row_number() OVER (ORDER BY simple_name, id)::INT AS rank, id, (SELECT count(*) FROM symbols) AS total, (SELECT count(*) "
    f"FROM symbols) > 60 AS has_more FROM symbols ORDER BY simple_name, id LIMIT 20 OFFSET 40"
)
def paged(spark, d) -> DataFrame:
    p = lookup.page(symbols(spark, d), ["simple_name", "id"], 40, 20)
    return p.select((F.row_number().over(Window.orderBy("simple_name", "id")) + 40).alias("rank"), "id", "total", "has_more")


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN text[1:200] || '...' ELSE text END AS snippet FROM documents")
def snippets(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.snippet(F.col("text"), 200).alias("snippet"))


@query(
    "SELECT r_regionkey AS id, ceil(-n * ln(0.01) / (ln(2) * ln(2)))::BIGINT AS bits, greatest(1, round(ceil(-n * ln(0.01) / (ln(2) * ln(2))) / n "
    "* ln(2)))::INT AS hashes FROM (SELECT r_regionkey, (r_regionkey + 1) * 1000 AS n FROM region)"
)
def bloom_sizes(spark, d) -> DataFrame:
    n = (F.col("r_regionkey") + 1) * 1000
    return table(spark, d, "region").select(F.col("r_regionkey").alias("id"), X.bloom_size(n, F.lit(0.01)).alias("x")).select("id", F.col("x.bits").cast("long").alias("bits"), "x.hashes")


@query(f"""WITH e AS (SELECT p_partkey AS id, 0.3 * CASE WHEN lower(p_name) = 'ring' THEN 1.0 WHEN starts_with(lower(p_name), 'ring') THEN 0.8 WHEN
contains(lower(p_name), 'ring') THEN 0.6 ELSE 0.4 END AS score, 'entity' AS source FROM part WHERE regexp_matches(p_name, '(?i)ring')),
c AS (SELECT doc_id AS id, 0.3 * least(1.0, len(regexp_extract_all(text, '(?i)ring')) / greatest(length(text) // 100, 1)) AS score, 'content' AS source FROM
documents WHERE regexp_matches(text, '(?i)ring')),
s AS (SELECT e.vec_id AS id, 0.4 * {COSINE} AS score, 'semantic' AS source FROM embeddings e, embeddings q WHERE q.vec_id = 0), f AS (SELECT id, sum(score) AS
score, string_agg(source, '+' ORDER BY source) AS sources, count(*) AS n FROM (SELECT * FROM e UNION ALL SELECT * FROM c UNION ALL SELECT * FROM s) GROUP BY id)
SELECT id, round(score, 6) AS score, sources FROM f ORDER BY round(score, 9) DESC, n DESC, id LIMIT 50""")
def pattern_search(spark, d) -> DataFrame:
    e = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    c = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    s = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), cosine(F.col("embedding"), F.array(*map(F.lit, map(float, _vector(spark, d, 0))))).alias("score"))
    return lookup.pattern_search(e, c, s, "ring", limit=50).select("id", F.round("score", 6).alias("score"), "sources")


@query(f"""WITH s AS (SELECT q.vec_id AS request_id, e.vec_id AS id, {COSINE} AS x FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id %
20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY x DESC, id)::INT AS rank FROM s WHERE x >= 0.3)
SELECT request_id, id, round(x, 6) AS similarity, rank FROM r WHERE rank <= 10""")
def enriched_results(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return vector.enriched(e.filter("id % 20 = 0"), e, "search_symbols", 0.3).withColumn("similarity", F.round("similarity", 6))


@query("""WITH h AS (SELECT doc_id, source, lang, lower(text) AS text, row_number() OVER (PARTITION BY lower(text) ORDER BY source, lang, doc_id) AS n FROM
documents WHERE regexp_matches(text, '(?im)^th'))
SELECT source AS file, lang AS kind, string_agg(md5(text), '|' ORDER BY text) AS texts FROM (SELECT * FROM h WHERE n = 1 ORDER BY source, lang, text LIMIT 20) GROUP BY ALL""")
def definition_search(spark, d) -> DataFrame:
    u = table(spark, d, "documents").select(F.col("source").alias("file"), F.lit("p").alias("parent"), F.col("lang").alias("kind"), F.lower("text").alias("text"))
    return lookup.definition_search(u, "^th").select("file", "kind", F.array_join(F.transform("texts", F.md5), "|").alias("texts"))


@query(
    f"WITH {SYMBOLS} SELECT canonical_fqn AS fqn FROM symbols WHERE regexp_matches(canonical_fqn, '(?i)brandn1.*ring') OR regexp_matches(simple_name, "
    f"'(?i)brandn1.*ring') GROUP BY 1 ORDER BY 1 LIMIT 30"
)
def type_search(spark, d) -> DataFrame:
    return lookup.type_search(symbols(spark, d).select(F.col("canonical_fqn").alias("fqn"), F.col("simple_name").alias("name")), "brandn1.*ring", 30).select("fqn")


@query("SELECT count(*) AS cached, count(*) FILTER (o_orderkey % 7 <> 0) AS resolved, count(*) FILTER (o_orderkey % 7 <> 0) >= 0.8 * count(*) AS usable FROM orders")
def resolved_share(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return lookup.resolved_share(o, o.filter("o_orderkey % 7 <> 0"), "o_orderkey")


@query()
def stack_hints(spark, d) -> DataFrame:
    from tessera.functions.similarity import stack_confidence

    hints = F.array(F.lit("at Cat.ECONOMY.BrandN17.red_widget(int)"), F.lit("in small rng"))
    s = symbols(spark, d)
    kind = F.element_at(F.split("namespace", r"\."), -1)
    return s.select("id", F.round(stack_confidence(hints, F.col("simple_name"), kind, F.col("namespace"), F.col("namespace"), F.col("canonical_fqn")), 6).alias("confidence"))
