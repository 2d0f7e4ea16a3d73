"""Queries of similarity groups, layers, merging and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions.similarity import class_similarity, method_similarity
from tessera.functions.vectors import jaccard
from tessera.operators import graph, layers, merge, similarity
from tessera.plans.base import CALLS, LAYERS, UNITS, calls, order_delta, order_rows, query, table, units
from tessera.sources.staging import checkpointed

STRUCTURE = "regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]+(\\n|$)', '\\1', 'g'), '^\\s+|\\s+$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')".replace("\\\\", "\\")


@query(f"SELECT doc_id, md5({STRUCTURE}) AS fingerprint FROM documents")
def fingerprints(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.fingerprint(F.col("text")).alias("fingerprint"))


@query(f"SELECT md5({STRUCTURE}) AS fingerprint, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def fingerprint_groups(spark, d) -> DataFrame:
    return table(spark, d, "documents").groupBy(X.fingerprint(F.col("text")).alias("fingerprint")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


@query(r"SELECT doc_id, regexp_replace(regexp_replace(replace(text, chr(13), ''), '[ \t]+(\n|$)', '\1', 'g'), '\n+$', '', 'g') || chr(10) AS text FROM documents")
def normalised_text(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.normalised(F.col("text")).alias("text"))


_WORDS = r"list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}'))"


def _word_classes(spark, d) -> DataFrame:
    s = table(spark, d, "documents").select("doc_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"), 1)).alias("w"))
    return checkpointed(similarity.set_classes(s, "doc_id", "w"))


@query(f"""WITH s AS (SELECT min(doc_id) AS id, list_sort({_WORDS}) AS w FROM documents GROUP BY 2 HAVING len(list_sort({_WORDS})) > 0),
f AS (SELECT id, len(w) AS n, unnest(w) AS x FROM s),
p AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS m FROM f a JOIN f b ON a.x = b.x AND a.id < b.id GROUP BY ALL)
SELECT a, b, round(m / (na + nb - m), 6) AS similarity FROM p WHERE m / (na + nb - m) >= 0.8""")
def word_set_pairs(spark, d) -> DataFrame:
    """Pairs of documents whose sets of words are alike but not equal; word_set_members tells which documents each stands for."""
    return similarity.set_pairs(_word_classes(spark, d), 0.8).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH s AS (SELECT doc_id AS id, list_sort({_WORDS}) AS w FROM documents) SELECT id, min(id) OVER (PARTITION BY w) AS rep FROM s WHERE len(w) > 0""")
def word_set_members(spark, d) -> DataFrame:
    return _word_classes(spark, d).select("id", "rep")


def _clone_groups(spark, d) -> DataFrame:
    classes = _word_classes(spark, d)
    return similarity.with_copies(similarity.set_groups(classes, 0.8), classes)


@query()
def clone_groups(spark, d) -> DataFrame:
    return _clone_groups(spark, d).withColumn("similarity", F.round("similarity", 6))


@query()
def clone_summary(spark, d) -> DataFrame:
    return similarity.group_summary(_clone_groups(spark, d)).withColumn("similarity", F.round("similarity", 6))


def _methods(spark, d) -> DataFrame:
    """Suppliers as methods: parts they ship as calls, return flags as operations."""
    x = table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.sort_array(F.collect_set((F.col("l_partkey") % 30).cast("string"))).alias("invoked"), F.count("*").cast("int").alias("n"), F.sum("l_quantity").alias("q")
    )
    ops = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").cast("int").alias("c")).groupBy(F.col("l_suppkey").alias("k")).agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "c"))).alias("operations"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), "s_nationkey")
    return x.withColumnRenamed("l_suppkey", "k").join(ops, "k").join(s, "k").select(
        "k", "invoked", "operations", F.array(
            (F.col("k") % 5).cast("string"), (F.col("k") % 3).cast("string")
        ).alias("accessed_types"), F.array((F.col("k") % 2).cast("string"), (F.col("k") % 4).cast("string")).alias("param_types"),
        (F.col("k") % 3).cast("string").alias("return_type"), (F.col("n") % 60).alias("blocks"), (F.col("n") % 25).alias("branches"), (F.col("k") % 8).alias("loops"), (F.col("n") % 30).alias("cyclomatic"), F.floor(F.col("k") / 20).alias("block_key"),
    )


@query("""WITH l AS (SELECT * FROM lineitem), m AS (SELECT l_suppkey AS k, list_distinct(list((l_partkey % 30)::VARCHAR)) AS inv, count(*)::INT AS n FROM l
GROUP BY 1), o AS (SELECT l_suppkey AS k, l_returnflag AS f, count(*) AS c FROM l GROUP BY ALL), nm AS (SELECT k, sqrt(sum(c * c)) AS m FROM o GROUP BY k),
x AS (SELECT m.*, m.k // 20 AS bk, nm.m FROM m JOIN supplier ON s_suppkey = m.k JOIN nm ON nm.k = m.k), p AS (SELECT a.k AS a, b.k AS b, a.inv AS ia, b.inv AS
ib, a.n AS na, b.n AS nb, (SELECT coalesce(sum(q.c * r.c), 0) FROM o q JOIN o r ON q.f = r.f WHERE q.k = a.k AND r.k = b.k) / (a.m * b.m) AS ops FROM x a JOIN x
b ON a.bk = b.bk AND a.k < b.k),
s AS (SELECT a, b, 0.25 * len(list_intersect(ia, ib)) / (len(ia) + len(ib) - len(list_intersect(ia, ib))) + 0.20 * ops
 + 0.15 * len(list_intersect([(a % 5)::VARCHAR, (a % 3)::VARCHAR], [(b % 5)::VARCHAR, (b % 3)::VARCHAR])) / (len(list_distinct([a % 5, a % 3])) +
len(list_distinct([b % 5, b % 3])) - len(list_intersect([a % 5, a % 3], [b % 5, b % 3])))
 + 0.10 * ((a % 2 = b % 2)::INT + (a % 4 = b % 4)::INT) / 2 + 0.05 * (a % 3 = b % 3)::INT + 0.025 + 0.05 * (1 - abs(na % 60 - nb % 60) / 60) + 0.05 * (1 -
abs(na % 25 - nb % 25) / 25) + 0.05 * (1 - abs(a % 8 - b % 8) / 8) + 0.075 * (1 - abs(na % 30 - nb % 30) / 30) AS v FROM p)
SELECT a, b, round(v, 6) AS similarity FROM s WHERE v >= 0.5""")
def similar_methods(spark, d) -> DataFrame:
    m = _methods(spark, d)
    return similarity.similar_pairs(m, "k", [c for c in m.columns if c not in ("k", "block_key")], method_similarity, 0.5, ["block_key"]).withColumn("similarity", F.round("similarity", 6))


@query()
def similar_classes(spark, d) -> DataFrame:
    """Every eight suppliers are a class and every 40 a block of classes that are compared: methods are matched one to one within each pair of classes."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.floor(F.col("s_suppkey") / 8).alias("c"))
    m = _methods(spark, d).withColumn("block_key", F.floor(F.col("k") / 40))
    features = [c for c in m.columns if c not in ("k", "block_key")]
    pairs = similarity.similar_pairs(m, "k", features, method_similarity, 0.0, ["block_key"])
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    named = both.join(s.select(F.col("k").alias("a"), F.col("c").alias("ca")), "a").join(s.select(F.col("k").alias("b"), F.col("c").alias("cb")), "b").filter("ca < cb")
    matched = similarity.assigned(named, ["ca", "cb"], "a", "b", "similarity").select("ca", "cb", F.col("similarity").alias("methods"))
    from tessera.functions.similarity import CLASS_COUNTS

    c = s.groupBy("c").agg(F.count("*").cast("int").alias("n"), F.sort_array(F.collect_set((F.col("k") % 7).cast("string"))).alias("set")).select(
        "c",
        F.struct(
            (F.col("c") % 3).cast("string").alias("base"), F.col("set").alias("interfaces"), F.col("set").alias("referenced_types"), F.col("set").alias("namespaces"),
            *[F.col("n").alias(x) for x in CLASS_COUNTS]
        ).alias("f")
    )
    out = matched.join(c.select(F.col("c").alias("ca"), F.col("f").alias("fa")), "ca").join(c.select(F.col("c").alias("cb"), F.col("f").alias("fb")), "cb")
    return out.select("ca", "cb", F.round(class_similarity(F.col("fa"), F.col("fb"), F.col("methods")), 6).alias("similarity"))


@query("""WITH s AS (SELECT o_custkey AS id, list_distinct(list(l_partkey % 20)) AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))), 6) AS similarity FROM s a JOIN s b ON
a.id // 10 = b.id // 10 AND a.id < b.id""")
def blocked_jaccard(spark, d) -> DataFrame:
    x = table(spark, d, "orders").join(
        table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")
    ).groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set(F.col("l_partkey") % 20).alias("s")).withColumn("block", F.floor(F.col("id") / 10))
    return similarity.similar_pairs(x, "id", ["s"], lambda a, b: jaccard(a["s"], b["s"]), 0.0, ["block"]).withColumn("similarity", F.round("similarity", 6))


_ON_BRANCH = "SELECT id, o_orderstatus, o_totalprice FROM base WHERE id NOT IN (SELECT id FROM branch) UNION ALL SELECT id, o_orderstatus, o_totalprice FROM branch WHERE op <> 'D'"


@query(f"WITH {LAYERS} {_ON_BRANCH}")
def layer_branch(spark, d) -> DataFrame:
    return layers.resolved(order_rows(spark, d), order_delta(spark, d, "branch"), None, "feature")


@query("SELECT o_orderkey AS id, o_orderstatus, o_totalprice FROM orders")
def layer_main(spark, d) -> DataFrame:
    return layers.resolved(order_rows(spark, d), order_delta(spark, d, "branch"), None, "Master")


@query(
    f"WITH {LAYERS}, v AS ({_ON_BRANCH}) SELECT * FROM v WHERE id NOT IN (SELECT id FROM working WHERE op <> 'A') UNION ALL SELECT id, o_orderstatus, "
    f"o_totalprice FROM working WHERE op = 'A' OR op = 'M' AND id IN (SELECT id FROM v)"
)
def layer_working(spark, d) -> DataFrame:
    return layers.resolved(order_rows(spark, d), order_delta(spark, d, "branch"), order_delta(spark, d, "working"), "feature")


@query(f"""WITH {LAYERS} SELECT coalesce(b.id, w.id) AS id, CASE WHEN w.op IS NULL THEN b.op WHEN b.op IS NULL THEN w.op WHEN b.op = 'A' AND w.op = 'M' THEN 'A'
WHEN b.op = 'D' AND w.op = 'A' THEN 'M' ELSE w.op END AS op,
CASE WHEN w.op IS NULL THEN b.o_totalprice ELSE w.o_totalprice END AS o_totalprice FROM branch b FULL JOIN working w ON b.id = w.id""")
def layer_promote(spark, d) -> DataFrame:
    return layers.merged(order_delta(spark, d, "branch"), order_delta(spark, d, "working")).select("id", "op", "o_totalprice")


@query(f"WITH {LAYERS} SELECT w.id, CASE WHEN b.id IS NULL THEN 'A' ELSE 'M' END AS op FROM working w LEFT JOIN base b ON b.id = w.id WHERE w.op <> 'D'")
def layer_upsert(spark, d) -> DataFrame:
    return layers.as_change(order_rows(spark, d), order_delta(spark, d, "working").filter("op <> 'D'").drop("op")).select("id", "op")


@query(
    f"WITH {LAYERS}, n AS ({_ON_BRANCH}) SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'Added' WHEN n.id IS NULL THEN 'Deleted' ELSE "
    f"'Modified' END AS change FROM base o FULL JOIN n ON o.id = n.id WHERE o.id IS NULL OR n.id IS NULL OR o.o_totalprice <> n.o_totalprice"
)
def snapshot_diff(spark, d) -> DataFrame:
    old = order_rows(spark, d)
    return layers.snapshot_diff(old, layers.applied(old, order_delta(spark, d, "branch")), "id", ["o_totalprice"])


_CHANGES = "c AS (SELECT event_id AS id, 'b' || (user_id % 12) AS branch FROM events)"


def _changes(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("b"), (F.col("user_id") % 12).cast("string")).alias("branch"))


@query(f"WITH {_CHANGES} SELECT branch, count(*) AS n, count(*) > 800 AS due FROM c GROUP BY branch")
def compaction_due(spark, d) -> DataFrame:
    return layers.compaction(_changes(spark, d), threshold=800)


@query(f"WITH {_CHANGES} SELECT id, branch FROM c WHERE branch NOT IN (SELECT 'b' || r_regionkey FROM region)")
def orphaned_changes(spark, d) -> DataFrame:
    return layers.orphans(_changes(spark, d), table(spark, d, "region").select(F.concat(F.lit("b"), F.col("r_regionkey").cast("string")).alias("branch"))).select("id", "branch")


@query("WITH b AS (SELECT 'b' || (user_id % 30) AS branch, max(ts) AS last_modified FROM events GROUP BY 1) SELECT branch FROM b ORDER BY last_modified DESC, branch LIMIT 10")
def recent_branches(spark, d) -> DataFrame:
    b = table(spark, d, "events").groupBy(F.concat(F.lit("b"), (F.col("user_id") % 30).cast("string")).alias("branch")).agg(F.max("ts").alias("last_modified"))
    return layers.recent_branches(b).select("branch")


@query("SELECT event_id AS id FROM events WHERE event_id + value * 10 >= 2000")
def unexpired_entries(spark, d) -> DataFrame:
    return layers.unexpired(table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_id").alias("created_at"), (F.col("value") * 10).alias("ttl")), 2000).select("id")


@query(
    "WITH s AS (SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'error') AS changed FROM events GROUP BY 1) SELECT user_id, CASE "
    "WHEN changed = 0 THEN 'NoChanges' WHEN changed / total > 0.3 THEN 'FullRescan' ELSE 'Incremental' END AS strategy FROM s"
)
def update_strategy(spark, d) -> DataFrame:
    s = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "error").alias("changed"))
    return s.select("user_id", layers.update_strategy(F.col("changed"), F.col("total")).alias("strategy"))


MATCHES = f"""{UNITS}, kc AS (SELECT content_hash AS k, min(id) AS t FROM a WHERE content_hash IS NOT NULL GROUP BY 1), ks AS (SELECT structural_hash AS k,
min(id) AS t FROM a GROUP BY 1), kg AS (SELECT signature AS k, min(id) AS t FROM a WHERE signature IS NOT NULL GROUP BY 1), ki AS (SELECT id AS k, id AS t FROM
a),
matches AS (SELECT base.id AS base_id, coalesce(kc.t, ks.t, kg.t, ki.t) AS target_id, CASE WHEN kc.t IS NOT NULL THEN 'content_hash' WHEN ks.t IS NOT NULL THEN
'structural_hash' WHEN kg.t IS NOT NULL THEN 'signature' WHEN ki.t IS NOT NULL THEN 'id' END AS match_type,
CASE WHEN kc.t IS NOT NULL THEN 1.0 WHEN ks.t IS NOT NULL THEN 0.95 WHEN kg.t IS NOT NULL THEN 0.85 WHEN ki.t IS NOT NULL THEN 0.7 END::DOUBLE AS confidence
FROM base LEFT JOIN kc ON base.content_hash = kc.k LEFT JOIN ks ON base.structural_hash = ks.k LEFT JOIN kg ON base.signature = kg.k LEFT JOIN ki ON base.id = ki.k)"""


def _matches(spark, d) -> DataFrame:
    return merge.fast_match(units(spark, d, "base"), units(spark, d, "a"))


@query(f"WITH {MATCHES} SELECT * FROM matches")
def fast_match(spark, d) -> DataFrame:
    return _matches(spark, d)


@query(f"WITH {MATCHES} SELECT id FROM base WHERE id NOT IN (SELECT base_id FROM matches WHERE target_id IS NOT NULL)")
def unmatched_units(spark, d) -> DataFrame:
    return merge.unmatched(units(spark, d, "base"), _matches(spark, d)).select("id")


@query(f"""WITH {MATCHES} SELECT count(*) AS total, count(target_id) AS matched, count(*) - count(target_id) AS unmatched, round(count(target_id) / count(*), 6)
AS rate, count(*) FILTER (match_type = 'content_hash') AS by_content_hash, count(*) FILTER (match_type = 'structural_hash') AS by_structural_hash,
count(*) FILTER (match_type = 'signature') AS by_signature, count(*) FILTER (match_type = 'id') AS by_id FROM matches""")
def match_stats(spark, d) -> DataFrame:
    return merge.match_stats(_matches(spark, d)).withColumn("rate", F.round("rate", 6))


THREE = f"""{UNITS}, x AS (SELECT coalesce(o.id, a.id, b.id) AS id, o.content_hash AS o, a.content_hash AS a, b.content_hash AS b FROM base o FULL JOIN a ON
o.id = a.id FULL JOIN b ON coalesce(o.id, a.id) = b.id),
y AS (SELECT id, o, a, b, CASE WHEN o IS NOT NULL AND a IS NULL AND b IS NULL THEN 'Delete/both' WHEN o IS NOT NULL AND a IS NULL THEN 'Delete/A' WHEN o IS NOT
NULL AND b IS NULL THEN 'Delete/B' WHEN o IS NULL AND a IS NOT NULL AND b IS NOT NULL THEN CASE WHEN a = b THEN 'Create/both' ELSE 'Conflict/both' END
WHEN o IS NULL AND a IS NOT NULL THEN 'Create/A' WHEN o IS NULL THEN 'Create/B' WHEN a = o AND b = o THEN NULL WHEN b = o THEN 'Update/A' WHEN a = o THEN
'Update/B' WHEN a = b THEN 'Update/both' ELSE 'Conflict/both' END AS act FROM x)"""


def _merged(spark, d) -> DataFrame:
    return merge.three_way(units(spark, d, "base"), units(spark, d, "a"), units(spark, d, "b"))


@query(f"""WITH {THREE} SELECT id, split_part(act, '/', 1) AS action, split_part(act, '/', 2) AS source, CASE WHEN act = 'Delete/both' THEN 1.0 WHEN
starts_with(act, 'Delete') THEN 0.8 WHEN starts_with(act, 'Create') THEN 0.95 WHEN starts_with(act, 'Update') THEN 1.0 ELSE 0.0 END::DOUBLE AS confidence,
CASE WHEN act = 'Delete/A' THEN b <> o WHEN act = 'Delete/B' THEN a <> o ELSE false END AS delete_modify FROM y WHERE act IS NOT NULL""")
def three_way_merge(spark, d) -> DataFrame:
    return _merged(spark, d)


@query(f"WITH {THREE} SELECT split_part(act, '/', 1) AS action, count(*) AS n FROM y WHERE act IS NOT NULL GROUP BY 1")
def merge_stats(spark, d) -> DataFrame:
    return _merged(spark, d).groupBy("action").agg(F.count("*").alias("n"))


@query()
def resolved_conflicts(spark, d) -> DataFrame:
    text = lambda v, n: units(spark, d, v).select("id", F.col("content").alias(n))
    conflicts = _merged(spark, d).filter("action = 'Conflict'").select("id")
    rows = conflicts.join(text("base", "base"), "id", "left").join(text("a", "a"), "id", "left").join(text("b", "b"), "id", "left")
    return merge.resolved_conflicts(rows).select("id", F.md5(F.coalesce("merged", F.lit(""))).alias("merged_md5"), "resolution")


def _version_pairs(spark, d) -> DataFrame:
    side = lambda v, p: units(spark, d, v).select(
        "id",
        *[F.col(c).alias(f"{p}_{n}") for c, n in (("structural_hash", "structural"), ("signature", "signature"), ("parent", "parent"), ("type", "type"), ("content_hash", "fqn"))]
    )
    return side("base", "base").join(side("a", "target"), "id").withColumn("base_file", F.col("id") % 4).withColumn("target_file", F.when(F.col("id") % 50 == 0, 9).otherwise(F.col("id") % 4))


@query(
    f"WITH {UNITS} SELECT base.id, CASE WHEN base.structural_hash = a.structural_hash THEN 'CodeCleanup' WHEN base.signature <> a.signature THEN 'APIChange' "
    f"ELSE 'Modification' END AS intent, CASE WHEN base.structural_hash = a.structural_hash THEN 0.95 WHEN base.signature <> a.signature THEN 0.9 ELSE "
    f"0.7 END::DOUBLE AS confidence FROM base JOIN a ON base.id = a.id"
)
def change_intents(spark, d) -> DataFrame:
    return merge.change_intents(_version_pairs(spark, d)).select("id", "intent", "confidence")


@query(
    f"WITH {UNITS} SELECT base.id, CASE WHEN base.id % 50 = 0 THEN 'FileChange' WHEN base.parent <> a.parent THEN 'ParentChange' WHEN base.content_hash "
    f"<> a.content_hash THEN 'Rename' ELSE 'None' END AS movement FROM base JOIN a ON base.id = a.id"
)
def movements(spark, d) -> DataFrame:
    return merge.movements(_version_pairs(spark, d)).select("id", "movement")


@query()
def renames(spark, d) -> DataFrame:
    c = table(spark, d, "supplier")
    a = c.select(
        F.col("s_suppkey").alias("id"), F.lit("Method").alias("type"), F.col("s_nationkey").alias("signature_shape"), F.col("s_name").alias("name"),
        F.concat(F.lit("src/f"), (F.col("s_suppkey") % 5).cast("string"), F.lit(".cs")).alias("file"), F.col("s_suppkey").alias("start_line"),
        F.concat(F.lit("call "), F.col("s_name"), F.lit(" with "), F.col("s_acctbal").cast("string")).alias("content")
    )
    b = a.withColumn(
        "content", F.replace("content", F.col("name"), F.concat(F.lit("New"), F.col("name")))
    ).withColumn("name", F.concat(F.lit("New"), F.col("name"))).withColumn("start_line", F.col("start_line") + 3)
    return merge.renames(a, b).withColumn("score", F.round("score", 6))


@query()
def semantic_match(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings").join(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text"), "vec_id").select(
        F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("type"), F.substring("text", 1, 12).alias("name"), F.col("text").alias("content")
    )
    return merge.semantic_match(e.filter("id % 20 = 0"), e, 0.3).select("base_id", "target_id", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"))


@query("SELECT user_id % 9 AS file, event_type AS container, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def replacement_conflicts(spark, d) -> DataFrame:
    return merge.replacement_conflicts(table(spark, d, "events").select((F.col("user_id") % 9).alias("file"), F.col("event_type").alias("container")))


@query("SELECT event_type AS symbol, count(*) AS locations, count(DISTINCT user_id) AS affected_files, bool_or(value > 150) AS breaking FROM events GROUP BY 1")
def preview_impact(spark, d) -> DataFrame:
    return merge.preview_impact(table(spark, d, "events").select(F.col("event_type").alias("symbol"), F.col("user_id").alias("file"), (F.col("value") > 150).alias("is_public")))


@query("""WITH o AS (SELECT o_custkey AS parent, o_orderkey AS child, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) - 1 AS y FROM orders) SELECT parent, child, x::INT AS old_at, y::INT AS new_at FROM o WHERE x <> y""")
def position_changes(spark, d) -> DataFrame:
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("parent")).agg(
        F.array_sort(F.collect_list("o_orderkey")).alias("x"),
        F.transform(F.array_sort(F.collect_list(F.struct("o_totalprice", "o_orderkey"))), lambda s: s["o_orderkey"]).alias("y")
    )
    return merge.position_changes(o.select("parent", F.col("x").alias("children")), o.select("parent", F.col("y").alias("children")))


@query(f"WITH {CALLS} SELECT caller FROM calls WHERE callee = 'm20'")
def callers(spark, d) -> DataFrame:
    return graph.callers(calls(spark, d), "m20")


@query(f"WITH {CALLS} SELECT callee FROM calls WHERE caller = 'm5'")
def callees(spark, d) -> DataFrame:
    return graph.callees(calls(spark, d), "m5")


@query(f"""WITH RECURSIVE {CALLS}, p(path, depth) AS (SELECT ['m20'], 0 UNION ALL SELECT list_prepend(k.caller, p.path), depth + 1 FROM p JOIN calls k ON k.callee = p.path[1] WHERE depth < 5),
e AS (SELECT path, depth, depth < 5 AS reached FROM p WHERE depth = 5 OR NOT EXISTS (SELECT 1 FROM calls k WHERE k.callee = p.path[1])), c AS (SELECT *, 1 / (1
+ depth * 0.1::DOUBLE) * CASE WHEN reached THEN 1.0 ELSE 0.7 END AS c FROM e)
SELECT array_to_string(path, '>') AS path, depth::INT AS depth, reached, round(c, 6) AS confidence FROM c ORDER BY c DESC, array_to_string(path, '>') LIMIT 12""")
def backtrace(spark, d) -> DataFrame:
    found = graph.backtrace(calls(spark, d), "m20", most_depth=5, most_paths=12)
    return found.select(F.array_join("path", ">").alias("path"), "depth", "reached", F.round("confidence", 6).alias("confidence"))


@query(f"WITH RECURSIVE {CALLS}, r(node) AS (SELECT 'm20' UNION SELECT k.caller FROM r JOIN calls k ON k.callee = r.node) SELECT node FROM r")
def dependents_closure(spark, d) -> DataFrame:
    start = spark.createDataFrame([("m20",)], "node string")
    return graph.dependents(calls(spark, d).select(F.col("caller").alias("file"), F.col("callee").alias("depends_on")), start).select("node")


@query(
    f"WITH RECURSIVE {CALLS}, k AS (SELECT DISTINCT * FROM calls), n AS (SELECT caller AS node FROM k UNION SELECT callee FROM k), l(node, level) AS "
    f"(SELECT node, 0 FROM n UNION SELECT k.caller, l.level + 1 FROM l JOIN k ON k.callee = l.node) SELECT node, max(level)::INT AS level FROM l GROUP "
    f"BY node"
)
def topological_levels(spark, d) -> DataFrame:
    k = calls(spark, d)
    nodes = k.select(F.col("caller").alias("node")).union(k.select("callee"))
    return graph.levels(nodes, k.select(F.col("caller").alias("node"), F.col("callee").alias("needs")))


HIERARCHY = "h AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region)"


def _hierarchy(spark, d) -> DataFrame:
    pair = lambda t, c, a, p, b: table(spark, d, t).select(
        F.concat(F.lit(a), F.col(c).cast("string")).alias("child"), F.concat(F.lit(b), F.col(p).cast("string")).alias("parent") if p else F.lit(b).alias("parent")
    )
    return pair("nation", "n_nationkey", "n", "n_regionkey", "r").union(pair("supplier", "s_suppkey", "s", "s_nationkey", "n")).union(pair("region", "r_regionkey", "r", None, "world"))


@query(f"WITH RECURSIVE {HIERARCHY}, t(node, depth) AS (SELECT 'r1', 0 UNION ALL SELECT h.child, depth + 1 FROM t JOIN h ON h.parent = t.node) SELECT node, depth::INT AS depth FROM t")
def descendants(spark, d) -> DataFrame:
    return graph.descendants(_hierarchy(spark, d), "r1")


@query(f"WITH RECURSIVE {HIERARCHY}, t(node, depth) AS (SELECT 's3', 0 UNION ALL SELECT h.parent, depth + 1 FROM t JOIN h ON h.child = t.node) SELECT node, depth::INT AS depth FROM t")
def ancestors(spark, d) -> DataFrame:
    return graph.ancestors(_hierarchy(spark, d), "s3")


@query(
    "SELECT p_brand AS parent, CASE p_size % 4 WHEN 0 THEN 'method' WHEN 1 THEN 'field' WHEN 2 THEN 'property' ELSE 'type' END AS kind, string_agg(p_name, "
    "',' ORDER BY p_name, p_partkey) AS members FROM part GROUP BY ALL"
)
def member_tree(spark, d) -> DataFrame:
    p = table(spark, d, "part").select(
        F.col("p_brand").alias("parent"), F.expr("CASE p_size % 4 WHEN 0 THEN 'method' WHEN 1 THEN 'field' WHEN 2 THEN 'property' ELSE 'type' END").alias("kind"),
        F.col("p_name").alias("signature"), F.col("p_partkey").alias("line")
    )
    return graph.member_tree(p).select("parent", "kind", F.array_join("members", ",").alias("members"))


@query("""WITH l AS (SELECT conv_id AS file, turn AS line, text FROM conversations), f AS (SELECT file, line FROM l WHERE contains(text, 'the') ORDER BY file, line LIMIT 20)
SELECT f.file, f.line, string_agg(trim(l.text, ' '), chr(10) ORDER BY l.line) AS context, (SELECT count(*) FROM l WHERE contains(text, 'the')) AS total FROM f
JOIN l ON l.file = f.file AND abs(l.line - f.line) <= 2 GROUP BY f.file, f.line""")
def references_context(spark, d) -> DataFrame:
    lines = table(spark, d, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("line"), "text")
    return graph.references_with_context(lines.filter("contains(text, 'the')").select("file", "line"), lines).select("file", "line", "context", "total")


@query(f"""WITH RECURSIVE {CALLS}, p(path) AS (SELECT ['m5'] UNION ALL SELECT list_append(p.path, k.callee) FROM p JOIN calls k ON k.caller = p.path[-1])
SELECT array_to_string(path, '>') AS path, 'exit' AS ended FROM p WHERE NOT EXISTS (SELECT 1 FROM calls k WHERE k.caller = p.path[-1]) ORDER BY 1 LIMIT 100""")
def forward_paths(spark, d) -> DataFrame:
    k = calls(spark, d).select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    return graph.forward_paths(k, "m5").select(F.array_join("path", ">").alias("path"), "ended")


_EXPORTED = f"""WITH RECURSIVE {CALLS}, p(path, depth) AS (SELECT ['m20'], 0 UNION ALL SELECT list_prepend(k.caller, p.path), depth + 1 FROM p JOIN calls k ON k.callee = p.path[1] WHERE depth < 5),
e AS (SELECT path, depth, 1 / (1 + depth * 0.1::DOUBLE) * CASE WHEN depth < 5 THEN 1.0 ELSE 0.7 END AS c FROM p WHERE depth = 5 OR NOT EXISTS (SELECT 1 FROM calls k WHERE k.callee = p.path[1])),
b AS (SELECT * FROM e ORDER BY c DESC, array_to_string(path, '>') LIMIT 5), g AS (SELECT unnest(path[:-2]) AS a, unnest(path[2:]) AS b, c FROM b), s AS (SELECT
a, b, max(c) AS c FROM g GROUP BY ALL),"""


@query(f"""{_EXPORTED} l AS (SELECT '  "' || a || '" -> "' || b || '" [color=' || CASE WHEN c > 0.8 THEN 'green' WHEN c > 0.5 THEN 'orange' ELSE 'red' END || '];' AS line FROM s)
SELECT 'digraph calls {{' || chr(10) || coalesce(string_agg(line, chr(10) ORDER BY line), '') || chr(10) || '}}' AS text FROM l""")
def graph_export(spark, d) -> DataFrame:
    return graph.exported(graph.backtrace(calls(spark, d), "m20", most_depth=5), "dot")


@query(f"""{_EXPORTED} l AS (SELECT '  ' || md5(a) || '["' || a || '"] --> ' || md5(b) || '["' || b || '"]' AS line FROM s)
SELECT 'graph TD' || chr(10) || coalesce(string_agg(line, chr(10) ORDER BY line), '') || chr(10) AS text FROM l""")
def graph_export_mermaid(spark, d) -> DataFrame:
    return graph.exported(graph.backtrace(calls(spark, d), "m20", most_depth=5), "mermaid")


@query(
    "WITH RECURSIVE h AS (SELECT 'n' || n_nationkey AS id, 'r' || n_regionkey AS parent_id FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey "
    "FROM supplier UNION ALL SELECT 'r' || r_regionkey, NULL FROM region), t(depth, id, p) AS (SELECT 0, id, parent_id FROM h WHERE id = 's7' UNION "
    "ALL SELECT depth + 1, h.id, h.parent_id FROM t JOIN h ON h.id = t.p) SELECT depth::INT AS depth, id FROM t"
)
def enclosing_scopes(spark, d) -> DataFrame:
    from tessera.operators.lookup import enclosing_scopes as scopes

    h = _hierarchy(spark, d).select(F.col("child").alias("id"), F.when(F.col("parent") != "world", F.col("parent")).alias("parent_id"))
    return scopes(h, "s7", 4)




@query("""WITH s AS (SELECT o_orderkey AS k, 'src/f' || o_orderkey || CASE o_orderkey % 3 WHEN 0 THEN '.cs' WHEN 1 THEN '.PNG' ELSE '.txt' END AS path,
o_orderstatus AS status FROM orders), t AS (SELECT k, CASE WHEN k % 5 = 0 THEN 'D' ELSE 'M' END AS status FROM s WHERE k % 8 = 0)
SELECT path, CASE k % 3 WHEN 0 THEN 'semantic' WHEN 1 THEN 'binary' ELSE 'text' END AS way, s.status <> 'P' AS in_base, s.status <> 'F' AS in_source, CASE WHEN
t.status IS NULL THEN s.status <> 'P' ELSE t.status <> 'D' END AS in_target FROM s LEFT JOIN t USING (k)""")
def merge_file_plan(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    s = table(spark, d, "orders").select(
        k, F.concat(F.lit("src/f"), k.cast("string"), F.expr("CASE o_orderkey % 3 WHEN 0 THEN '.cs' WHEN 1 THEN '.PNG' ELSE '.txt' END")).alias("path"),
        F.expr("CASE o_orderstatus WHEN 'P' THEN 'A' WHEN 'F' THEN 'D' ELSE 'M' END").alias("status"), F.lit(None).cast("string").alias("renamed_from")
    )
    t = s.filter("o_orderkey % 8 = 0").select("path", F.when(k % 5 == 0, "D").otherwise("M").alias("status"))
    return merge.file_plan(s, t, "src/*")
