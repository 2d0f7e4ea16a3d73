"""Queries of versions, layers of vectors, filters, fingerprints by format, snippets, routes and replacements."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import bloom, graph, layers, lookup, merge, metrics, vector
from tessera.plans.base import LAYERS, order_delta, order_rows, query, table
from tessera.plans.retrieval import COSINE, _vector
from tessera.plans.versions import _ON_BRANCH
from tessera.sources import versions
from tessera.sources.staging import shared_folder


def _scratch(spark) -> str:
    return f"{shared_folder(spark)}/tessera-versions/{uuid.uuid4().hex}"


_VECTORS = """base AS (SELECT vec_id AS id, embedding FROM embeddings), branch AS (SELECT vec_id AS id, 'D' AS op FROM embeddings WHERE vec_id % 7 = 3 UNION ALL
SELECT vec_id + 1000000, 'A' FROM embeddings WHERE vec_id % 9 = 4),
layered AS (SELECT id, embedding FROM base WHERE id % 7 <> 3 UNION ALL SELECT id + 1000000, embedding FROM base WHERE id % 9 = 4),
working AS (SELECT id FROM layered WHERE id % 11 = 5), seen AS (SELECT id, CASE WHEN id % 11 = 5 THEN list_transform(embedding, lambda x: -x) ELSE embedding END AS embedding FROM layered)"""


@query(f"WITH {_VECTORS} SELECT e.id, round({COSINE}, 6) AS similarity FROM seen e, embeddings q WHERE q.vec_id = 0 AND {COSINE} >= 0 ORDER BY {COSINE} DESC, e.id LIMIT 20")
def layered_topk(spark, d) -> DataFrame:
    """The best vectors as a client on a branch sees them: layers are resolved before the search, so deleted and changed ones don't take places."""
    base = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    branch = base.filter("id % 7 = 3").withColumn("op", F.lit("D")).unionByName(base.filter("id % 9 = 4").withColumn("id", F.col("id") + 1000000).withColumn("op", F.lit("A")))
    on_branch = layers.resolved(base, branch, None, "feature")
    working = on_branch.filter("id % 11 = 5").withColumn("op", F.lit("M")).withColumn("embedding", F.transform("embedding", lambda x: -x))
    seen = layers.resolved(base, branch, working, "feature")
    return vector.top_k(seen, _vector(spark, d, 0), 20, id_col="id").select("id", F.round("similarity", 6).alias("similarity"))


@query("SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM embeddings WHERE label % 3 = 1)")
def vector_delete(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    return vector.deleted(e, e.filter("label % 3 = 1"), "vec_id").select("vec_id")


@query("SELECT CASE WHEN label % 2 = 0 THEN 'method' ELSE 'class' END AS kind, count(*) AS n, count(DISTINCT label) AS projects FROM embeddings GROUP BY 1")
def vector_counts(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").groupBy(F.when(F.col("label") % 2 == 0, "method").otherwise("class").alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("label").alias("projects"))


@query(f"SELECT e.vec_id, round({COSINE}, 6) AS similarity FROM embeddings e, embeddings q WHERE q.vec_id = 5 AND e.label % 2 = 0 AND {COSINE} >= 0 ORDER BY {COSINE} DESC, e.vec_id LIMIT 10")
def scoped_search(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("kind", F.when(F.col("label") % 2 == 0, "method").otherwise("class"))
    return vector.top_k(vector.search_scope(e, "methods"), _vector(spark, d, 5), 10).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("SELECT event_type, count(*) AS n, CASE WHEN count(*) <= 2000 THEN 'exact' ELSE 'hashed' END AS backend FROM events GROUP BY 1")
def backend_choice(spark, d) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).withColumn("backend", vector.backend_of(F.col("n"), 2000))


_BLOOM_BITS, _BLOOM_HASHES = 60_000, 5
_POSITIONS = f"list_transform(range({_BLOOM_HASHES}), lambda i: (('0x' || substr(md5(k), 1, 8))::BIGINT + i * ('0x' || substr(md5(k), 9, 8))::BIGINT) % {_BLOOM_BITS})"
_FILTER = f"f AS (SELECT DISTINCT unnest({_POSITIONS}) AS bit FROM (SELECT p_name || p_partkey AS k FROM part UNION ALL SELECT s_name FROM supplier))"


def _bloom(spark, d) -> DataFrame:
    parts = bloom.built(table(spark, d, "part"), F.concat("p_name", F.col("p_partkey").cast("string")), _BLOOM_BITS, _BLOOM_HASHES)
    return bloom.merged(parts, bloom.built(table(spark, d, "supplier"), F.col("s_name"), _BLOOM_BITS, _BLOOM_HASHES))


@query(f"""WITH {_FILTER}, q AS (SELECT DISTINCT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE (SELECT any_value(p_name || p_partkey) FROM part
WHERE p_partkey = c_custkey) END AS k FROM customer),
p AS (SELECT id, unnest(list_distinct({_POSITIONS})) AS bit FROM q WHERE k IS NOT NULL), h AS (SELECT id, bool_and(f.bit IS NOT NULL) AS hit FROM p LEFT JOIN f ON f.bit = p.bit GROUP BY id)
SELECT q.id, coalesce(hit, false) AS might_contain FROM q LEFT JOIN h ON h.id = q.id""")
def bloom_membership(spark, d) -> DataFrame:
    """Names that were added, and others, asked of a filter that is merged from two."""
    added = table(spark, d, "part").select(F.col("p_partkey").alias("c_custkey"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("of_part"))
    asked = table(spark, d, "customer").join(added, "c_custkey", "left").select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.col("of_part")).alias("k")
    )
    return bloom.asked(asked, F.col("k"), _bloom(spark, d), _BLOOM_BITS, _BLOOM_HASHES).select("id", "might_contain")


@query(f"WITH {_FILTER} SELECT count(*) AS set_bits, round(count(*) / {_BLOOM_BITS}, 9) AS fill, round((count(*) / {_BLOOM_BITS}) ** {_BLOOM_HASHES}, 9) AS rate FROM f")
def bloom_stats(spark, d) -> DataFrame:
    return bloom.stats(_bloom(spark, d), _BLOOM_BITS, _BLOOM_HASHES).select("set_bits", F.round("fill", 9).alias("fill"), F.round("rate", 9).alias("rate"))


@query(f"""WITH {LAYERS}, v AS ({_ON_BRANCH}) SELECT 0::BIGINT AS version, count(*) AS n_rows, true AS current FROM base UNION ALL SELECT 2, count(*), false FROM v""")
def snapshot_lifecycle(spark, d) -> DataFrame:
    """Three versions are made, the first is rolled back to, and all but it and the newest are removed."""
    root, base = _scratch(spark), order_rows(spark, d)
    versions.create(base, root)
    versions.create(base.filter("id % 2 = 0"), root)
    versions.create(layers.applied(base, order_delta(spark, d, "branch")), root)
    versions.rollback(spark, root, 0)
    versions.cleanup(spark, root, 1)
    return versions.listed(spark, root)


@query(f"WITH {LAYERS} {_ON_BRANCH}")
def compaction_run(spark, d) -> DataFrame:
    """The table after a compaction, read from the version that it wrote; a delta below the threshold writes none."""
    root, delta = _scratch(spark), order_delta(spark, d, "branch")
    versions.create(order_rows(spark, d), root)
    versions.compact(spark, root, delta.limit(5), threshold=10)
    versions.compact(spark, root, delta, threshold=10)
    return versions.current(spark, root)


@query("""WITH c AS (SELECT event_id AS id, 'b' || (user_id % 30) AS branch, ts FROM events), b AS (SELECT branch FROM c GROUP BY 1 ORDER BY max(ts) DESC, branch LIMIT 10)
SELECT id, branch, branch IN (SELECT branch FROM b) AS kept FROM c WHERE branch IN (SELECT branch FROM b) OR branch = (SELECT max(branch) FROM c WHERE branch NOT IN (SELECT branch FROM b))""")
def evicted_branches(spark, d) -> DataFrame:
    """Changes of the branches that stay in memory, and those of one that was evicted, read back."""
    root = _scratch(spark)
    c = table(spark, d, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("b"), (F.col("user_id") % 30).cast("string")).alias("branch"), F.col("ts").alias("last_modified"))
    kept = versions.evict(c, root)
    gone = c.select("branch").distinct().join(kept.select("branch").distinct(), "branch", "left_anti").agg(F.max("branch")).first()[0]
    back = versions.restored(spark, root, gone or "")
    return kept.select("id", "branch", F.lit(True).alias("kept")).unionByName(back.select("id", "branch", F.lit(False).alias("kept")))


@query(
    f"WITH {LAYERS} SELECT coalesce(b.id, o.id) AS id, CASE WHEN o.id IS NULL THEN 'A' WHEN b.id IS NULL THEN 'D' ELSE 'M' END AS op, b.o_totalprice "
    f"FROM base o FULL JOIN ({_ON_BRANCH}) b ON o.id = b.id WHERE o.id IS NULL OR b.id IS NULL OR o.o_totalprice <> b.o_totalprice"
)
def pulled_changes(spark, d) -> DataFrame:
    old = order_rows(spark, d)
    return versions.pulled(old, layers.applied(old, order_delta(spark, d, "branch")), ["o_totalprice"]).select("id", "op", "o_totalprice")


_GAPS = r"""'("(?:[^"\\]|\\.)*")|\s+'"""
_COMMENTS = r"""'("(?:[^"\\\n]|\\.)*")|//[^\n]*|/\*(?:[^*]|\*+[^*/])*\*+/'"""


@query(f"SELECT event_id, md5(regexp_replace(props, {_GAPS}, '\\1', 'g')) AS compact, md5(regexp_replace(replace(props, ':', ' : '), {_GAPS}, '\\1', 'g')) AS spaced FROM events")
def json_fingerprints(spark, d) -> DataFrame:
    """JSON alike but for its white space has one fingerprint."""
    e = table(spark, d, "events")
    of = lambda c: F.md5(X.structural_of(c, F.lit(".json")))
    return e.select("event_id", of(F.col("props")).alias("compact"), of(F.replace("props", F.lit(":"), F.lit(" : "))).alias("spaced"))


@query(r"SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(html, '^\s+|\s+$', '', 'g'), '^<\?xml[^>]*\?>\s*', ''), '>\s+<', '><', 'g')) AS fingerprint FROM pages")
def xml_fingerprints(spark, d) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(X.structural_of(F.regexp_replace("html", r"^\s+|\s+\z", ""), F.lit("xml"))).alias("fingerprint"))


_CODE = """'int f' || p_partkey || '(int a, string b) {' || chr(10) || '  // ' || p_name || chr(10) || '  if (a > ' || p_size || ' && b != "x // y") { return g' || (p_size % 5) || '(new Box(a)); } /* ' || p_brand || ' */' || chr(10) || '  for (;;) h(a);' || chr(10) || '}'"""


def _code(spark, d) -> DataFrame:
    """Parts as snippets of code."""
    c = F.concat(
        F.lit("int f"), F.col("p_partkey").cast("string"), F.lit("(int a, string b) {\n  // "), F.col("p_name"), F.lit("\n  if (a > "), F.col("p_size").cast("string"), F.lit(' && b != "x // y") { return g'),
        (F.col("p_size") % 5).cast("string"), F.lit("(new Box(a)); } /* "), F.col("p_brand"), F.lit(" */\n  for (;;) h(a);\n}"),
    )
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size", c.alias("code"))


@query(rf"""WITH c AS (SELECT p_partkey AS id, {_CODE} AS code FROM part), m AS (SELECT id, replace(regexp_replace(code, {_COMMENTS}, '\1' || chr(1), 'g'), '"' || chr(1), '"') AS code FROM c)
SELECT id, md5(trim(regexp_replace(code, '[\x01\s]+', ' ', 'g'), ' ')) AS fingerprint FROM m""")
def code_fingerprints(spark, d) -> DataFrame:
    return _code(spark, d).select("id", F.md5(X.structural_of(F.col("code"), F.lit(".cs"))).alias("fingerprint"))


@query(
    "SELECT p_partkey AS id, 5 AS lines, 1 AS branches, 1 AS loops, 4 AS cyclomatic, 2 AS parameters, array_to_string(list_sort(['Box', 'f' || p_partkey, "
    "'g' || (p_size % 5), 'h']), ',') AS calls, 'Box' AS types FROM part"
)
def snippet_features(spark, d) -> DataFrame:
    x = _code(spark, d).select("id", X.snippet_features(F.col("code")).alias("x"))
    return x.select("id", "x.lines", "x.branches", "x.loops", "x.cyclomatic", "x.parameters", F.array_join("x.calls", ",").alias("calls"), F.array_join("x.types", ",").alias("types"))


@query("SELECT p_partkey AS id, 'Where:' || CASE p_size % 3 WHEN 0 THEN 'true,ToList:false' WHEN 1 THEN 'true,Select:true' ELSE 'true,Count:false' END AS called FROM part")
def sequence_calls(spark, d) -> DataFrame:
    code = F.concat(F.lit("rows.Where(x => x.N > 1).Other()"), F.expr("CASE p_size % 3 WHEN 0 THEN '.ToList()' WHEN 1 THEN '.Select<int>(x => x.N)' ELSE '.Count ()' END"))
    called = F.transform(X.sequence_calls(code), lambda c: F.concat(c["name"], F.lit(":"), c["deferred"].cast("string")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(called, ",").alias("called"))


@query("SELECT lang AS type, count(*) AS units, count(DISTINCT source) AS files, count(e.vec_id) AS embedded FROM documents LEFT JOIN embeddings e ON vec_id = doc_id GROUP BY 1")
def unit_stats(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    units = table(spark, d, "documents").join(e, "doc_id", "left").select(F.col("lang").alias("type"), F.col("source").alias("file"), "embedding")
    return metrics.unit_stats(units)


@query("SELECT user_id % 7 AS project, count(DISTINCT event_type) AS branches, count(*) AS vectors, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1")
def project_listing(spark, d) -> DataFrame:
    rows = table(spark, d, "events").select((F.col("user_id") % 7).alias("project"), F.col("event_type").alias("branch"), "ts")
    return metrics.project_listing(rows)


@query("""WITH i AS (SELECT DISTINCT event_type || (event_id % 3) AS name, user_id % 20 AS file FROM events WHERE event_type <> 'error' OR user_id % 20 < 5), n
AS (SELECT count(DISTINCT file) AS n FROM i), c AS (SELECT name FROM i, n GROUP BY name HAVING count(*) = any_value(n.n))
SELECT file, name FROM i WHERE name NOT IN (SELECT name FROM c)""")
def unique_imports(spark, d) -> DataFrame:
    """Names that a file imports and that not all files do."""
    i = table(spark, d, "events").filter("event_type <> 'error' OR user_id % 20 < 5").select(
        F.concat("event_type", (F.col("event_id") % 3).cast("string")).alias("name"), (F.col("user_id") % 20).alias("file")
    )
    return metrics.unique_imports(i)


@query("""WITH o AS (SELECT o_custkey AS parent, list(o_orderkey ORDER BY o_orderkey) AS x, list(o_orderkey ORDER BY o_totalprice, o_orderkey) AS y FROM orders GROUP BY 1)
SELECT parent, x = CASE WHEN parent % 3 = 0 THEN x ELSE y END AS same, parent % 3 <> 0 AND x <> y AS reordered FROM o""")
def reordered_children(spark, d) -> DataFrame:
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("parent")).agg(
        F.array_sort(F.collect_list("o_orderkey")).alias("x"),
        F.transform(F.array_sort(F.collect_list(F.struct("o_totalprice", "o_orderkey"))), lambda s: s["o_orderkey"]).alias("y")
    )
    new = o.select("parent", F.when(F.col("parent") % 3 == 0, F.col("x")).otherwise(F.col("y")).alias("children"))
    return merge.reordered_only(o.select("parent", F.col("x").alias("children")), new)


@query("""WITH v AS (SELECT a.vec_id AS id, o.embedding::DOUBLE[] AS o, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b FROM embeddings a JOIN embeddings
b ON b.vec_id = CASE WHEN a.vec_id % 4 = 0 THEN a.vec_id ELSE a.vec_id + 1 END JOIN embeddings o ON o.vec_id = a.vec_id + 2),
s AS (SELECT id, list_cosine_similarity(a, b) AS ab, list_cosine_similarity(a, o) AS ao, list_cosine_similarity(b, o) AS bo, 1 -
abs(list_cosine_similarity(list_transform(list_zip(a, o), lambda z: z[1] - z[2]), list_transform(list_zip(b, o), lambda z: z[1] - z[2]))) AS turn FROM v)
SELECT id, CASE WHEN ab >= 0.95 THEN CASE WHEN ao <= bo THEN 'A' ELSE 'B' END WHEN turn >= 0.3 THEN 'both' ELSE 'conflict' END AS decision FROM s""")
def conflict_sides(spark, d) -> DataFrame:
    """What embeddings say of a conflict between versions a and b of base."""
    e = table(spark, d, "embeddings")
    side = lambda key, name: e.select(key.alias("id"), F.col("embedding").alias(name))
    a, o = side(F.col("vec_id"), "a_vector"), side(F.col("vec_id") - 2, "base_vector")
    b = e.select(F.col("vec_id").alias("of"), F.col("embedding").alias("b_vector"))
    rows = a.withColumn("of", F.when(F.col("id") % 4 == 0, F.col("id")).otherwise(F.col("id") + 1)).join(b, "of").join(o, "id")
    return merge.closer_side(rows).select("id", "decision")


@query("""SELECT path, CASE WHEN contains(lower(path), 'f1') THEN 'B' ELSE source END AS source FROM (SELECT 'src/f' || o_orderkey || CASE WHEN o_orderkey % 3 =
0 THEN '.cs' ELSE '.txt' END AS path, 'A' AS source FROM orders)
WHERE path LIKE 'src/%.cs' AND NOT contains(path, '7')""")
def merge_instructions(spark, d) -> DataFrame:
    """A plan of files after instructions in words."""
    said = merge.instructions("Include src/*.cs files\nSkip *7*.cs")
    plan = table(spark, d, "orders").select(
        F.concat(F.lit("src/f"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 3 == 0, ".cs").otherwise(".txt")).alias("path"),
        F.lit("A").alias("source")
    )
    return merge.instructed(plan, said["include"], said["exclude"], {"f1": "B"})


@query("""WITH m AS (SELECT 's' || s_suppkey AS type, 'call' || (s_suppkey % 3) AS signature FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'call' ||
(n_nationkey % 3) FROM nation), h AS (SELECT 's' || s_suppkey AS child, 'n' || s_nationkey AS parent FROM supplier)
SELECT DISTINCT m.type, m.signature, h.parent AS base FROM m JOIN h ON h.child = m.type JOIN m b ON b.type = h.parent AND b.signature = m.signature""")
def overrides(spark, d) -> DataFrame:
    member = lambda t, k, a: table(spark, d, t).select(
        F.concat(F.lit(a), F.col(k).cast("string")).alias("type"), F.concat(F.lit("call"), (F.col(k) % 3).cast("string")).alias("signature")
    )
    members = member("supplier", "s_suppkey", "s").unionByName(member("nation", "n_nationkey", "n"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("child"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("parent"))
    return graph.overrides(members, s)


@query("SELECT p_partkey AS id, p_size < p_partkey % 60 AS feasible, 1::BIGINT AS unknown FROM part")
def path_feasibility(spark, d) -> DataFrame:
    """Paths under the conditions that n is above the part's size, below another number, and something that isn't understood."""
    n = lambda c: c.cast("string")
    conditions = F.array(F.concat(F.lit("n > "), n(F.col("p_size"))), F.concat(F.lit("n < "), n(F.col("p_partkey") % 60)), F.lit("ready()"), F.lit("m == 3"), F.lit("m != 4"))
    return graph.feasible(table(spark, d, "part").select(F.col("p_partkey").alias("id"), conditions.alias("conditions")))


@query(
    "SELECT event_id, n.user_id AS subscriber FROM events e JOIN (SELECT DISTINCT user_id, event_type FROM events WHERE value > 100) n ON n.event_type "
    "= e.event_type AND n.user_id <> e.user_id WHERE e.event_type = 'signup'"
)
def notified(spark, d) -> DataFrame:
    """Who is told of which change: subscribers to its project but the one who made it."""
    e = table(spark, d, "events")
    subscriptions = e.filter("value > 100").select(F.col("event_type").alias("project"), F.col("user_id").alias("subscriber")).distinct()
    changes = e.filter("event_type = 'signup'").select("event_id", F.col("event_type").alias("project"), F.col("user_id").alias("author"))
    return layers.notifications(changes, subscriptions).select("event_id", "subscriber")


@query(
    "SELECT event_id, CASE WHEN event_type = 'error' AND user_id % 2 = 0 THEN 'local' WHEN event_type = 'error' THEN 'none' WHEN event_type = 'view' "
    "THEN CASE WHEN user_id % 2 = 0 THEN 'local' ELSE 'hub' END ELSE 'both' END AS route FROM events"
)
def search_routes(spark, d) -> DataFrame:
    """Where a search goes, by what it asks for and what is there."""
    mode = F.when(F.col("event_type") == "error", "local").when(F.col("event_type") == "view", "any").otherwise("both")
    local, hub = F.when(F.col("event_type").isin("error", "view"), F.col("user_id") % 2 == 0).otherwise(F.lit(True)), F.lit(True)
    return table(spark, d, "events").select("event_id", vector.search_route(mode, local, hub).alias("route"))


_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), n AS (SELECT *, len(regexp_extract_all(line, 'the')) AS n FROM l)"


@query(f"WITH {_LINES} SELECT doc_id, i::INT AS container, n, n > 1 AS conflict FROM n WHERE n > 0")
def replace_preview(spark, d) -> DataFrame:
    return lookup.replace_preview(table(spark, d, "documents"), "the")


@query(
    f"WITH {_LINES}, r AS (SELECT doc_id, string_agg(CASE WHEN n = 1 THEN regexp_replace(line, 'the', 'this') ELSE line END, chr(10) ORDER BY i) AS "
    f"text, count(*) FILTER (n = 1) AS applied, sum(n) AS hits FROM n GROUP BY doc_id) SELECT doc_id, md5(text) AS text_md5, applied FROM r WHERE hits "
    f"> 0"
)
def replaced_best_effort(spark, d) -> DataFrame:
    return lookup.replaced(table(spark, d, "documents"), "the", "this").select("doc_id", F.md5("text").alias("text_md5"), "applied")


@query(
    f"WITH {_LINES}, s AS (SELECT bool_or(n > 1) AS stop FROM n), r AS (SELECT doc_id, string_agg(CASE WHEN n = 1 AND NOT stop THEN regexp_replace(line, "
    f"'the', 'this') ELSE line END, chr(10) ORDER BY i) AS text, count(*) FILTER (n = 1 AND NOT stop) AS applied, sum(n) AS hits FROM n, s GROUP BY "
    f"doc_id) SELECT doc_id, md5(text) AS text_md5, applied FROM r WHERE hits > 0"
)
def replaced_all_or_nothing(spark, d) -> DataFrame:
    return lookup.replaced(table(spark, d, "documents"), "the", "this", "AllOrNothing").select("doc_id", F.md5("text").alias("text_md5"), "applied")
