"""The registry of queries, and the derived tables they share, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.staging import ship_code

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbols(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    space = F.concat(F.lit("Cat."), F.col("p_type"), F.lit("."), F.replace("p_brand", F.lit("#"), F.lit("N")))
    flags = F.expr("shiftleft(1L, CAST(p_partkey % 4 AS INT)) | shiftleft(16L, CAST(p_size % 5 AS INT)) | CASE WHEN p_size % 3 = 0 THEN 32768L ELSE 65536L END")
    args = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("("), F.col("p_size").cast("string"), F.lit(")"))).otherwise("")
    return p.select(
        F.col("p_partkey").alias("id"), F.concat(
            space, F.lit("."), F.replace("p_name", F.lit(" "), F.lit("_")), args
        ).alias("canonical_fqn"), F.col("p_name").alias("simple_name"), space.alias("namespace"),
        flags.alias("flags"), F.concat(F.lit("doc"), (F.col("p_partkey") % 50).cast("string")).alias("document_id"), F.col("p_partkey").alias("line_number"), (F.col("p_size") % 7 == 0).alias("is_constructor"),
    )


SYMBOLS = """symbols AS (
    SELECT p_partkey AS id, 'Cat.' || p_type || '.' || replace(p_brand, '#', 'N') || '.' || replace(p_name, ' ', '_') || CASE WHEN p_size % 5 = 0 THEN '(' ||
p_size || ')' ELSE '' END AS canonical_fqn,
        p_name AS simple_name, 'Cat.' || p_type || '.' || replace(p_brand, '#', 'N') AS namespace,
        ((1::BIGINT << (p_partkey % 4)::INT) | (16::BIGINT << (p_size % 5)::INT) | CASE WHEN p_size % 3 = 0 THEN 32768 ELSE 65536 END)::BIGINT AS flags,
        'doc' || (p_partkey % 50) AS document_id, p_partkey AS line_number, p_size % 7 = 0 AS is_constructor
    FROM part
)"""


def diagnostics(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    rule = F.expr("CASE event_type WHEN 'view' THEN 'CA1873' WHEN 'click' THEN 'CA1822' WHEN 'purchase' THEN 'CA1829' WHEN 'error' THEN 'CA2000' ELSE 'IDE0005' END")
    file = F.expr("concat('src/', CASE WHEN user_id % 7 = 0 THEN 'Log' WHEN user_id % 11 = 0 THEN 'Benchmark' ELSE 'Mod' END, user_id, '.cs')")
    severity = F.expr("CASE WHEN value < 5 THEN 'Hidden' WHEN value < 20 THEN 'Info' WHEN value < 60 THEN 'Warning' ELSE 'Error' END")
    message = F.expr("concat(CASE WHEN event_id % 100 = 0 AND event_type = 'click' THEN 'performance of ' ELSE 'use of ' END, event_type)")
    return e.select(
        F.col("event_id").alias("nth"), rule.alias("diag_id"), file.alias("file_path"),
        F.concat(F.lit("P"), (F.col("user_id") % 3).cast("string")).alias("project_name"), severity.alias("severity"), message.alias("message"),
        (F.col("event_id") % 17 == 0).alias("is_suppressed"), F.col("user_id")
    )


DIAGNOSTICS = """diagnostics AS (
    SELECT event_id AS nth, CASE event_type WHEN 'view' THEN 'CA1873' WHEN 'click' THEN 'CA1822' WHEN 'purchase' THEN 'CA1829' WHEN 'error' THEN 'CA2000' ELSE 'IDE0005' END AS diag_id,
        'src/' || CASE WHEN user_id % 7 = 0 THEN 'Log' WHEN user_id % 11 = 0 THEN 'Benchmark' ELSE 'Mod' END || user_id || '.cs' AS file_path, 'P' || (user_id % 3) AS project_name,
        CASE WHEN value < 5 THEN 'Hidden' WHEN value < 20 THEN 'Info' WHEN value < 60 THEN 'Warning' ELSE 'Error' END AS severity,
        CASE WHEN event_id % 100 = 0 AND event_type = 'click' THEN 'performance of ' ELSE 'use of ' END || event_type AS message, event_id % 17 = 0 AS is_suppressed, user_id
    FROM events
)"""


def units(spark: SparkSession, d: str, version: str) -> DataFrame:
    """A version of the documents as units: base, a or b; branches respace, drop and add some."""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")
    if version == "a":
        t = t.filter("id % 10 <> 3").withColumn(
            "text",
            F.when(F.col("id") % 10 == 1, F.replace("text", F.lit(" "), F.lit("  "))).when(F.col("id") % 10 == 4, F.concat("text", F.lit("  "))).otherwise(F.col("text"))
        )
        t = t.unionByName(t.filter("id % 10 = 2").withColumn("id", F.col("id") + 1000000).withColumn("text", F.concat(F.lit("new "), F.col("text"))))
    if version == "b":
        t = t.filter("id % 10 <> 5 AND id % 20 <> 3").withColumn(
            "text",
            F.when(F.col("id") % 20 == 1, F.replace("text", F.lit(" "), F.lit("  "))).when(
                F.col("id") % 20 == 11, F.replace("text", F.lit(" "), F.lit("\n"))
            ).when(F.col("id") % 10 == 6, F.concat(F.lit("x "), F.col("text"))).otherwise(F.col("text"))
        )
    shape = F.regexp_replace("text", "[^a-z]+", " ")
    return t.select(
        "id", F.col("text").alias("content"), F.md5("text").alias("content_hash"), F.md5(F.trim(shape)).alias("structural_hash"),
        F.concat_ws("/", "lang", "source", (F.length("text") % 1000).cast("string")).alias("signature"), F.col("source").alias("parent"), F.col("lang").alias("type")
    )


def _units_sql(name: str, rows: str) -> str:
    return f"""{name} AS (
    SELECT id, text AS content, md5(text) AS content_hash, md5(trim(regexp_replace(text, '[^a-z]+', ' ', 'g'))) AS structural_hash,
        lang || '/' || source || '/' || (length(text) % 1000) AS signature, source AS parent, lang AS type FROM ({rows})
)"""


_A = """SELECT id, CASE WHEN id % 10 = 1 THEN replace(text, ' ', '  ') WHEN id % 10 = 4 THEN text || '  ' ELSE text END AS text, lang, source FROM (SELECT doc_id AS id, text, lang, source FROM documents) WHERE id % 10 <> 3"""
UNITS = ",\n".join([
    _units_sql("base", "SELECT doc_id AS id, text, lang, source FROM documents"),
    _units_sql("a", f"{_A} UNION ALL SELECT id + 1000000, 'new ' || text, lang, source FROM ({_A}) WHERE id % 10 = 2"),
    _units_sql(
        "b",
        "SELECT doc_id AS id, CASE WHEN doc_id % 20 = 1 THEN replace(text, ' ', '  ') WHEN doc_id % 20 = 11 THEN replace(text, ' ', chr(10)) WHEN doc_id % 10 = 6 THEN 'x ' || text ELSE text END AS text, lang, source FROM documents WHERE doc_id % 10 <> 5 AND doc_id % 20 <> 3"
    ),
])


def order_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus", "o_totalprice")


def order_delta(spark: SparkSession, d: str, layer: str) -> DataFrame:
    """Changes to orders: every tenth deleted, the next repriced, copies of another tenth added."""
    o, n = order_rows(spark, d), 10 if layer == "branch" else 15
    gone = o.filter(f"id % {n} = 0").withColumn("op", F.lit("D"))
    new = o.filter(f"id % {n} = 1").withColumn("op", F.lit("M")).withColumn("o_totalprice", F.col("o_totalprice") * 2)
    more = o.filter(f"id % {n} = 2").withColumn("op", F.lit("A")).withColumn("id", F.col("id") + (1000000 if layer == "branch" else 2000000))
    return gone.unionByName(new).unionByName(more)


def _delta_sql(name: str, n: int, shift: int) -> str:
    return f"""{name} AS (
    SELECT o_orderkey AS id, o_orderstatus, o_totalprice, 'D' AS op FROM orders WHERE o_orderkey % {n} = 0
    UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice * 2, 'M' FROM orders WHERE o_orderkey % {n} = 1
    UNION ALL SELECT o_orderkey + {shift}, o_orderstatus, o_totalprice, 'A' FROM orders WHERE o_orderkey % {n} = 2
)"""


LAYERS = f"""base AS (SELECT o_orderkey AS id, o_orderstatus, o_totalprice FROM orders),
{_delta_sql("branch", 10, 1000000)},
{_delta_sql("working", 15, 2000000)}"""


def calls(spark: SparkSession, d: str) -> DataFrame:
    """Call edges from all events: user u calls 2u, 2u + 1 or 2u + 2, by the event's number. A caller's number is below its callee's, so there are no cycles."""
    e = table(spark, d, "events")
    name = lambda c: F.concat(F.lit("m"), c.cast("string"))
    return e.select(
        F.col("user_id").alias("a"), (2 * F.col("user_id") + F.col("event_id") % 3).alias("b")
    ).filter("a <> b").select(name(F.col("a")).alias("caller"), name(F.col("b")).alias("callee")).distinct()


CALLS = """calls AS (
    SELECT DISTINCT 'm' || user_id AS caller, 'm' || (2 * user_id + event_id % 3) AS callee FROM events WHERE user_id <> 2 * user_id + event_id % 3
)"""
