"""Queries of logs, diagnostics, rollups, streams in batch form, and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import ratings
from tessera.functions import text as X
from tessera.operators import logs, lookup, metrics
from tessera.plans.base import DIAGNOSTICS, SYMBOLS, diagnostics, query, symbols, table
from tessera.sources import tables, units
from tessera.streaming import streams


def _log_lines(spark, d, form: str) -> DataFrame:
    """events as log lines of a format, numbered by event; every eleventh line does not have the format."""
    e = table(spark, d, "events").withColumn("t", F.date_trunc("second", "ts"))
    level = F.expr("CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'warn' WHEN 'signup' THEN 'I' ELSE 'debug' END")
    status = F.expr("CASE event_type WHEN 'error' THEN 503 WHEN 'purchase' THEN 404 ELSE 200 END")
    n = F.col("event_id").cast("string")
    line = {
        "plain": F.concat(F.date_format("t", "yyyy-MM-dd HH:mm:ss"), F.lit(" ["), level, F.lit("] "), F.col("event_type"), F.lit(" by "), F.col("user_id").cast("string")),
        "logcat": F.concat(
            F.date_format("t", "MM-dd HH:mm:ss"), F.lit(".123  "), n, F.lit(" 7 "), F.upper(F.substring(level, 1, 1)), F.lit(" Tag"),
            (F.col("user_id") % 3).cast("string"), F.lit(" : "), F.col("event_type")
        ),
        "web": F.concat(
            F.lit("10.0.0."), (F.col("user_id") % 256).cast("string"), F.lit(" - - ["), F.date_format("t", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET /'),
            F.col("event_type"), F.lit(' HTTP/1.1" '), status.cast("string"), F.lit(" 12")
        ),
        "ecs": F.concat(
            F.lit('{"@timestamp":"'), F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('","log.level":"'), level, F.lit('","message":"'), F.col("event_type"),
            F.lit('","user":"u'), F.col("user_id").cast("string"), F.lit('"}')
        ),
    }[form]
    return e.select((F.col("event_id") + 1).alias("line_number"), F.when(F.col("event_id") % 11 == 5, F.lit("??")).otherwise(line).alias("line"), "user_id")


_LEVEL = "CASE event_type WHEN 'error' THEN 'Error' WHEN 'purchase' THEN 'Warning' WHEN 'signup' THEN 'Info' ELSE 'Debug' END"
_SECOND = "date_trunc('second', ts)::TIMESTAMP"
_FORMAT = "event_id % 11 <> 5"


@query(
    f"SELECT (event_id + 1)::INT AS line_number, {_SECOND} AS ts, {_LEVEL} AS level, event_type || ' by ' || user_id AS message, CASE WHEN event_type "
    f"= 'error' THEN event_type || ' by ' || user_id END AS stack_trace FROM events WHERE {_FORMAT}"
)
def log_plain(spark, d) -> DataFrame:
    return logs.parsed_plain(_log_lines(spark, d, "plain")).select("line_number", "ts", "level", "message", "stack_trace")


@query(f"SELECT (event_id + 1)::INT AS line_number, {_SECOND} + INTERVAL 123 MILLISECOND AS ts, {_LEVEL} AS level, 'Tag' || (user_id % 3) AS source, event_type AS message FROM events WHERE {_FORMAT}".replace("'Warning'", "'Warning'"))
def log_logcat(spark, d) -> DataFrame:
    return logs.parsed_logcat(_log_lines(spark, d, "logcat"), 2024).select("line_number", "ts", "level", "source", "message")


@query(
    f"SELECT (event_id + 1)::INT AS line_number, {_SECOND} AS ts, CASE event_type WHEN 'error' THEN 'Error' WHEN 'purchase' THEN 'Warning' ELSE 'Info' "
    f"END AS level, 'GET /' || event_type AS message, '/' || event_type AS path, CASE event_type WHEN 'error' THEN 503 WHEN 'purchase' THEN 404 ELSE "
    f"200 END::INT AS status_code FROM events WHERE {_FORMAT}"
)
def log_web(spark, d) -> DataFrame:
    return logs.parsed_web(_log_lines(spark, d, "web")).select("line_number", "ts", "level", "message", "path", "status_code")


@query(f"SELECT (event_id + 1)::INT AS line_number, {_SECOND} AS ts, {_LEVEL} AS level, event_type AS message, 'u' || user_id AS user_field FROM events WHERE {_FORMAT}")
def log_ecs(spark, d) -> DataFrame:
    return logs.parsed_ecs(_log_lines(spark, d, "ecs")).select("line_number", "ts", "level", "message", F.element_at("additional_fields", "user").alias("user_field"))


@query("SELECT unnest(['plain', 'logcat', 'web', 'ecs']) AS written, unnest(['PlainText', 'Logcat', 'WebServer', 'ECS']) AS format")
def log_formats(spark, d) -> DataFrame:
    out = [logs.sniffed(_log_lines(spark, d, f)).withColumn("written", F.lit(f)) for f in ("plain", "logcat", "web", "ecs")]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query(
    f"SELECT (event_id + 1)::INT AS line_number FROM events WHERE {_FORMAT} AND event_type IN ('error', 'purchase') AND contains(event_type || ' by "
    f"' || user_id, 'by 1') AND {_SECOND} >= TIMESTAMP '2024-01-01 06:00:00' AND {_SECOND} <= TIMESTAMP '2024-01-20 00:00:00'"
)
def log_filter(spark, d) -> DataFrame:
    entries = logs.parsed_plain(_log_lines(spark, d, "plain"))
    return logs.filtered(entries, ["BY 1"], ["Error", "Warning"], [500], "2024-01-01 06:00:00", "2024-01-20 00:00:00").select("line_number")


@query("""WITH l AS (SELECT conv_id, turn, text, list(CASE WHEN trim(text) <> '' THEN md5(text) END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2
PRECEDING AND 1 PRECEDING) AS b, list(CASE WHEN trim(text) <> '' THEN md5(text) END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 1
FOLLOWING) AS a FROM conversations)
SELECT conv_id, turn, coalesce(array_to_string(b, ','), '') AS before, coalesce(array_to_string(a, ','), '') AS after FROM l WHERE contains(text, 'the')""")
def log_context(spark, d) -> DataFrame:
    rows = logs.with_context(
        table(spark, d, "conversations").withColumn("text_md5", F.when(F.trim("text") != "", F.md5("text")).otherwise("")), F.contains("text", F.lit("the")), 2, 1,
        "conv_id", "turn", "text_md5"
    )
    return rows.select("conv_id", "turn", F.array_join("context_before", ",").alias("before"), F.array_join("context_after", ",").alias("after"))


@query(
    f"WITH {DIAGNOSTICS} SELECT diag_id, count(*) AS n, count(DISTINCT file_path) AS files, count(DISTINCT project_name) AS projects, arg_min(severity, "
    f"nth) AS severity FROM diagnostics GROUP BY 1"
)
def diagnostic_stats(spark, d) -> DataFrame:
    return metrics.diagnostic_stats(diagnostics(spark, d))


CLUSTERS = f"""{DIAGNOSTICS}, g AS (SELECT diag_id, count(*) AS n, bool_or(contains(lower(file_path), 'log')) AS has_log, bool_or(contains(lower(file_path),
'benchmark')) AS has_bench, arg_min(severity, nth) AS severity, bool_or(contains(message, 'performance')) AS perf FROM diagnostics GROUP BY 1),
clusters AS (SELECT diag_id, n, severity, perf, CASE WHEN diag_id = 'CA1873' AND has_log AND n > 10 THEN 'FalsePositive' WHEN diag_id = 'CA1822' AND has_bench
THEN 'Infrastructure' WHEN diag_id = 'CA1829' THEN 'PerformanceCritical' WHEN starts_with(diag_id, 'CA2') THEN 'Security' WHEN starts_with(diag_id, 'IDE') THEN
'Style' ELSE 'NeedsManualReview' END AS category FROM g),
rated AS (SELECT *, CASE category WHEN 'FalsePositive' THEN 0.9 WHEN 'Infrastructure' THEN 0.85 WHEN 'PerformanceCritical' THEN 0.8 WHEN 'Security' THEN 0.75
WHEN 'Style' THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence, CASE category WHEN 'FalsePositive' THEN 'None' WHEN 'Infrastructure' THEN 'None' WHEN
'PerformanceCritical' THEN 'Warning' WHEN 'Security' THEN 'Error' WHEN 'Style' THEN 'Silent' ELSE CASE WHEN severity IN ('Warning', 'Error') THEN 'Warning' ELSE
'Suggestion' END END AS recommended FROM clusters)"""
_WEIGHT = "CASE category WHEN 'Security' THEN 10.0 WHEN 'PerformanceCritical' THEN 8.0 WHEN 'Infrastructure' THEN 5.0 WHEN 'Style' THEN 3.0 WHEN 'FalsePositive' THEN 1.0 ELSE 5.0 END * CASE severity WHEN 'Error' THEN 1.0 WHEN 'Warning' THEN 0.7 WHEN 'Info' THEN 0.4 ELSE 0.2 END * confidence"


@query(
    f"WITH {CLUSTERS} SELECT diag_id, n, category, recommended, confidence, CASE WHEN perf THEN 'Performance optimization' ELSE category END AS pattern, "
    f"round_even({_WEIGHT}, 2) AS relevance, (SELECT string_agg(message, '|' ORDER BY nth) FROM (SELECT message, nth FROM diagnostics x WHERE x.diag_id "
    f"= rated.diag_id ORDER BY nth LIMIT 5)) AS examples FROM rated"
)
def diagnostic_clusters(spark, d) -> DataFrame:
    c = metrics.diagnostic_clusters(diagnostics(spark, d))
    return c.select("diag_id", "n", "category", "recommended", "confidence", "pattern", "relevance", F.array_join("examples", "|").alias("examples"))


@query(f"WITH {CLUSTERS} SELECT category, count(*) AS clusters, sum(n)::BIGINT AS occurrences FROM rated GROUP BY 1")
def category_histogram(spark, d) -> DataFrame:
    return metrics.category_histogram(metrics.diagnostic_clusters(diagnostics(spark, d)))


@query(
    f"WITH {CLUSTERS} SELECT diag_id, CASE WHEN confidence >= 0.8 THEN 'rule' ELSE 'review' END AS kind, CASE WHEN confidence >= 0.8 THEN 'dotnet_diagnostic.' "
    f"|| diag_id || '.severity = ' || lower(recommended) ELSE '# review: ' || diag_id END AS line FROM rated"
)
def recommendations(spark, d) -> DataFrame:
    return metrics.recommendations(metrics.diagnostic_clusters(diagnostics(spark, d))).select("diag_id", "kind", "line")


@query(
    f"WITH {CLUSTERS} SELECT string_agg(CASE WHEN confidence >= 0.8 THEN 'dotnet_diagnostic.' || diag_id || '.severity = ' || lower(recommended) ELSE "
    f"'# review: ' || diag_id END, chr(10) ORDER BY category, diag_id) AS text FROM rated"
)
def config_text(spark, d) -> DataFrame:
    return metrics.config_text(metrics.diagnostic_clusters(diagnostics(spark, d)))


@query(f"""WITH {CLUSTERS}, flat AS (SELECT ['CA1873', 'CA1822', 'CA1829', 'CA2000', 'IDE0005'][label % 5 + 1] AS rule, unnest(embedding)::DOUBLE AS x,
generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT rule, i, avg(x) AS m FROM flat GROUP BY ALL), c AS (SELECT rule, list(m ORDER BY i) AS v FROM m GROUP BY rule),
p AS (SELECT a.rule AS a, b.rule AS b FROM c a JOIN c b ON a.rule <> b.rule AND list_cosine_similarity(a.v, b.v) >= 0),
n AS (SELECT a, count(*) AS near FROM p JOIN rated x ON x.diag_id = a JOIN rated y ON y.diag_id = b AND y.category = x.category GROUP BY a)
SELECT diag_id, round(least(1.0, confidence + 0.05 * coalesce(near, 0)), 6) AS confidence FROM rated LEFT JOIN n ON n.a = diag_id""")
def cluster_neighbours(spark, d) -> DataFrame:
    rules = F.element_at(F.array(*map(F.lit, ("CA1873", "CA1822", "CA1829", "CA2000", "IDE0005"))), (F.pmod("label", F.lit(5)) + 1).cast("int"))
    messages = table(spark, d, "embeddings").select(rules.alias("diag_id"), "embedding")
    return metrics.cluster_neighbours(messages, metrics.diagnostic_clusters(diagnostics(spark, d)), 0.0).withColumn("confidence", F.round("confidence", 6))


@query(
    f"WITH {DIAGNOSTICS} SELECT nth FROM diagnostics WHERE NOT is_suppressed AND severity IN ('Warning', 'Error') AND diag_id IN ('CA2000', 'CA1829') "
    f"AND lower(project_name) IN ('p1', 'p2') AND (regexp_matches(file_path, '(?i)^src/mod.*\\.cs$') OR contains(lower(file_path), 'log7.cs'))"
)
def diagnostics_filtered(spark, d) -> DataFrame:
    return lookup.diagnostics_filtered(diagnostics(spark, d), "Warning", ["CA2000", "CA1829"], ["p1", "P2"], ["SRC/mod*.cs", "log7.cs"]).select("nth")


@query(
    f"WITH {DIAGNOSTICS} SELECT nth, (SELECT count(*) FROM diagnostics) AS total, (SELECT count(*) > 35 FROM diagnostics) AS has_more FROM diagnostics "
    f"ORDER BY CASE severity WHEN 'Error' THEN 3 WHEN 'Warning' THEN 2 WHEN 'Info' THEN 1 ELSE 0 END DESC, file_path, diag_id, nth LIMIT 25 OFFSET "
    f"10"
)
def diagnostics_page(spark, d) -> DataFrame:
    return lookup.page(diagnostics(spark, d), [ratings.severity_order(F.col("severity")).desc(), "file_path", "diag_id", "nth"], 10, 25).select("nth", "total", "has_more")


@query(f"WITH {DIAGNOSTICS} SELECT nth FROM diagnostics WHERE diag_id IN ('CA1873', 'CA2000')")
def preset_filter(spark, d) -> DataFrame:
    return diagnostics(spark, d).filter(F.col("diag_id").isin(*sorted(metrics.preset("logging") | metrics.preset("High")))).select("nth")


@query(
    f"WITH {DIAGNOSTICS} SELECT file_path, count(*) FILTER (severity = 'Error') AS errors, count(*) FILTER (severity = 'Warning') AS warnings, count(*) "
    f"FILTER (severity = 'Info') AS infos FROM diagnostics GROUP BY 1 HAVING count(*) FILTER (severity IN ('Error', 'Warning')) > 0 ORDER BY count(*) "
    f"FILTER (severity IN ('Error', 'Warning')) DESC, file_path LIMIT 20"
)
def validation_summary(spark, d) -> DataFrame:
    return metrics.validation_summary(diagnostics(spark, d))


@query(f"""WITH {DIAGNOSTICS}, b AS (SELECT severity, count(*) AS n FROM diagnostics WHERE nth % 2 = 0 GROUP BY 1), a AS (SELECT severity, count(*) AS n FROM diagnostics WHERE nth % 2 = 1 GROUP BY 1)
SELECT severity, coalesce(b.n, 0) AS before, coalesce(a.n, 0) AS after, CASE WHEN coalesce(a.n, 0) < coalesce(b.n, 0) THEN 'improved' WHEN coalesce(a.n, 0) >
coalesce(b.n, 0) THEN 'degraded' ELSE 'unchanged' END AS change FROM b FULL JOIN a USING (severity)""")
def validation_change(spark, d) -> DataFrame:
    x = diagnostics(spark, d)
    return metrics.validation_change(x.filter("nth % 2 = 0"), x.filter("nth % 2 = 1"))


@query(
    f"WITH {SYMBOLS} SELECT count(*) AS total, count(DISTINCT simple_name) AS names, count(DISTINCT namespace) AS namespaces, bit_or(flags) AS all_flags, "
    f"count(*) FILTER (flags & 1 <> 0) AS n_public, count(*) FILTER (flags & 32768 <> 0) AS n_method FROM symbols"
)
def symbol_stats(spark, d) -> DataFrame:
    return metrics.symbol_stats(symbols(spark, d)).select("total", "names", "namespaces", "all_flags", "n_public", "n_method")


@query(
    "SELECT count(*) AS n, sum(length(props))::BIGINT AS bytes, count(DISTINCT event_type) AS operations, count(DISTINCT user_id) AS solutions, min(event_id) "
    "AS oldest, max(event_id) AS newest FROM events"
)
def cache_stats(spark, d) -> DataFrame:
    return metrics.cache_stats(table(spark, d, "events").select(
        F.col("props").alias("result"), F.col("event_type").alias("operation"), F.col("user_id").alias("solution"), F.col("event_id").alias("created_at")
    ))


@query("""WITH m AS (SELECT o_custkey % 7 AS project, o_custkey % 100 AS type_, l_quantity::INT % 20 AS cc, l_linenumber AS cog, l_quantity::BIGINT AS lines
FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT project, type_, grouping(project, type_)::BIGINT AS level, count(*) AS methods, sum(cc)::BIGINT AS sum_cc, max(cc) AS max_cc, round(avg(cc), 6) AS
avg_cc, sum(cog)::BIGINT AS sum_cognitive, count(*) FILTER (cc > 10) AS complex_methods, sum(lines)::BIGINT AS lines FROM m GROUP BY GROUPING SETS ((project,
type_), (project))""")
def complexity_rollup(spark, d) -> DataFrame:
    m = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(
        (F.col("o_custkey") % 7).alias("project"), (F.col("o_custkey") % 100).alias("type_"), (F.col("l_quantity").cast("int") % 20).alias("cyclomatic"),
        F.col("l_linenumber").alias("cognitive"), F.col("l_quantity").cast("long").alias("lines")
    )
    return metrics.complexity_rollup(m, "project", "type_").withColumn("avg_cc", F.round("avg_cc", 6)).withColumn("level", F.col("level").cast("long"))


@query("""SELECT p_brand AS type_, count(*) FILTER (p_size % 4 = 0) AS n_method, count(*) FILTER (p_size % 4 = 1) AS n_property, count(*) FILTER (p_size % 4 = 2) AS n_field, count(*) FILTER (p_size % 4 = 3) AS n_event, round(avg(CASE WHEN p_size % 4 = 0 THEN p_size END), 6) AS avg_cc, count(DISTINCT p_type) AS dependencies FROM part GROUP BY 1""")
def type_metrics(spark, d) -> DataFrame:
    m = table(spark, d, "part").select(
        F.col("p_brand").alias("type_"), F.expr("CASE p_size % 4 WHEN 0 THEN 'method' WHEN 1 THEN 'property' WHEN 2 THEN 'field' ELSE 'event' END").alias("kind"),
        F.col("p_size").alias("cyclomatic"), F.col("p_type").alias("depends_on")
    )
    return metrics.type_metrics(m, "type_").withColumn("avg_cc", F.round("avg_cc", 6))


@query(r"""WITH w AS (SELECT list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[a-zA-Z]{2,}')) AS w FROM documents),
c AS (SELECT sum(len(list_filter(w, lambda w: lower(w) NOT IN ('if', 'else', 'for', 'while', 'return', 'new', 'var', 'int', 'string', 'bool', 'void', 'public',
'private', 'static', 'class', 'null', 'true', 'false', 'this', 'using'))))::BIGINT AS latin FROM w)
SELECT latin, 0::BIGINT AS other, 0.0::DOUBLE AS share, 'english' AS language FROM c""")
def language_mix(spark, d) -> DataFrame:
    return metrics.language_mix(table(spark, d, "documents"))


@query(
    "SELECT count(*) AS files, sum(len(string_split(text, chr(10))))::BIGINT AS lines, sum(length(text))::BIGINT AS bytes, CASE WHEN sum(len(string_split(text, "
    "chr(10)))) < 10000 THEN 'small' WHEN sum(len(string_split(text, chr(10)))) < 100000 THEN 'medium' ELSE 'large' END AS size FROM documents"
)
def size_class(spark, d) -> DataFrame:
    return metrics.size_class(table(spark, d, "documents"))


@query("SELECT p_type AS category, p_name AS package, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS versions, count(DISTINCT p_size % 5) AS projects FROM part GROUP BY ALL")
def technologies(spark, d) -> DataFrame:
    refs = table(spark, d, "part").select(F.col("p_type").alias("category"), F.col("p_name").alias("package"), F.col("p_brand").alias("version"), (F.col("p_size") % 5).alias("project"))
    return metrics.technologies(refs).select("category", "package", F.array_join("versions", ",").alias("versions"), "projects")


@query("SELECT event_type AS name, count(DISTINCT user_id % 20) AS files, count(DISTINCT user_id % 20) = (SELECT count(DISTINCT user_id % 20) FROM events) AS common FROM events GROUP BY 1")
def import_usage(spark, d) -> DataFrame:
    return metrics.import_usage(table(spark, d, "events").select(F.col("event_type").alias("name"), (F.col("user_id") % 20).alias("file")))


@query(
    "SELECT CASE WHEN l_discount * 10 >= 1 THEN 'perfect' WHEN l_discount * 10 >= 0.9 THEN 'high' WHEN l_discount * 10 >= 0.8 THEN 'good' WHEN l_discount "
    "* 10 >= 0.7 THEN 'fair' ELSE 'low' END AS bucket, count(*) AS n FROM lineitem GROUP BY 1"
)
def score_histogram(spark, d) -> DataFrame:
    return metrics.score_histogram(table(spark, d, "lineitem").select((F.col("l_discount") * 10).alias("s")), "s")


@query("SELECT user_id, round(count(*) FILTER (event_type = 'click') / count(*), 6) AS hit_rate FROM events GROUP BY 1")
def hit_rates(spark, d) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.round(metrics.ratio(F.count_if(F.col("event_type") == "click"), F.count("*")), 6).alias("hit_rate"))


@query("""WITH n AS (SELECT event_id, user_id, value, (row_number() OVER (ORDER BY ts, event_id) - 1) // 50 AS batch, ts FROM events) SELECT batch, user_id AS id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY batch, user_id ORDER BY ts DESC, event_id DESC) AS r FROM n) WHERE r = 1""")
def dedupe_last_batch(spark, d) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("id"), "event_id", "value", F.struct("ts", "event_id").alias("order"))
    return streams.batches(e, "id", "order").select("batch", "id", "event_id", "value")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
SELECT user_id, min(ts) AS started, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, session""")
def debounce_sessions(spark, d) -> DataFrame:
    return streams.debounced(table(spark, d, "events"), "user_id", "ts", "6 hours")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS started, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark, d) -> DataFrame:
    return streams.windowed(table(spark, d, "events"), "ts", "1 hour", ["event_type"], value="value").withColumn("total", F.round("total", 4))


@query("WITH k AS (SELECT unnest([0, 1]) AS k) SELECT time_bucket(INTERVAL 1 HOUR, ts) - k * INTERVAL 1 HOUR AS started, count(*) AS n FROM events, k GROUP BY ALL")
def sliding_windows(spark, d) -> DataFrame:
    return streams.windowed(table(spark, d, "events"), "ts", "2 hours", [], slide="1 hour")


@query(
    "SELECT v.user_id, v.event_id AS left_id, p.event_id AS right_id FROM events v JOIN events p ON v.user_id = p.user_id AND v.event_type = 'view' "
    "AND p.event_type = 'purchase' AND p.ts > v.ts AND p.ts <= v.ts + INTERVAL 6 HOUR"
)
def interval_join(spark, d) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return streams.interval_join(
        e.filter("event_type = 'view'"), e.filter("event_type = 'purchase'"), "user_id", "ts", "6 HOURS"
    ).select("user_id", F.col("left.event_id").alias("left_id"), F.col("right.event_id").alias("right_id"))


@query(
    "WITH p AS (SELECT user_id, event_id, event_type, lag(event_type) OVER w AS before, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION "
    "BY user_id ORDER BY ts, event_id)) SELECT user_id, event_id, before FROM p WHERE n = 1 OR before IS DISTINCT FROM event_type"
)
def value_changes(spark, d) -> DataFrame:
    e = table(spark, d, "events").withColumn("o", F.struct("ts", "event_id"))
    return streams.value_changes(e, "user_id", "event_type", "o").select("user_id", "event_id", "before")


@query("SELECT event_id, (props->>'$.k')::INT AS k FROM events")
def json_fields(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("""SELECT event_id::VARCHAR AS source_id, '$' AS id, 'JsonObject' AS type, props AS content FROM (SELECT event_id, '{"k":' || (props->>'$.k') || '}' AS props FROM events) UNION ALL SELECT event_id::VARCHAR, 'k', 'JsonProperty', props->>'$.k' FROM events""")
def json_units(spark, d) -> DataFrame:
    return units.extracted(table(spark, d, "events"), "event_id", "props", "json").select("source_id", "id", "type", "content")


@query()
def html_units(spark, d) -> DataFrame:
    return units.with_children(units.extracted(table(spark, d, "pages"), "page_id", "html", "html")).select(
        "source_id", "id", "parent_id", "name", F.size("child_ids").alias("n_children"), F.md5("content").alias("content_md5")
    )


@query("SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '<a [^>]*href=')) AS links FROM pages")
def html_titles(spark, d) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<a [^>]*href=")).cast("long").alias("links"))


@query(
    f"WITH {SYMBOLS}, s AS (SELECT id, canonical_fqn, split_part(canonical_fqn, '(', 1) AS bare FROM symbols) SELECT canonical_fqn, list_last(string_split(bare, "
    f"'.')) AS simple_name, len(string_split(bare, '.')) - 1 AS namespace_depth, length(canonical_fqn) AS fqn_length, count(*) AS n FROM s GROUP BY "
    f"ALL"
)
def symbol_rows(spark, d) -> DataFrame:
    rows = symbols(spark, d).select("canonical_fqn", "flags", "document_id", F.col("document_id").alias("file_path"), F.col("line_number").cast("int").alias("line_number"))
    return tables.symbol_rows(rows).groupBy(
        "canonical_fqn", "simple_name", F.col("namespace_depth").cast("long").alias("namespace_depth"), F.col("fqn_length").cast("long").alias("fqn_length")
    ).agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE text[1:297] || '...' END AS piece FROM (SELECT doc_id, replace(text, chr(10), ' ') AS text FROM documents)")
def embedding_texts(spark, d) -> DataFrame:
    t = table(spark, d, "documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit(" ")))
    none = F.lit(None).cast("string")
    return t.select("doc_id", X.embedding_text(F.lit("Block"), none, none, F.col("text"), F.array().cast("array<string>"), 300).alias("piece"))


@query(
    "SELECT doc_id, len(list_filter(list_distinct(string_split(lower(text), chr(10))), lambda x: NOT list_contains(string_split(text, chr(10)), x))) "
    "AS inserted, len(list_filter(list_distinct(string_split(text, chr(10))), lambda x: NOT list_contains(string_split(lower(text), chr(10)), x))) "
    "AS deleted FROM documents"
)
def line_changes(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.line_changes(F.col("text"), F.lower("text")).alias("x")).select(
        "doc_id", F.col("x.inserted").cast("long").alias("inserted"), F.col("x.deleted").cast("long").alias("deleted")
    )


@query(
    "SELECT p_partkey AS id, 1 + p_size % 9 + p_size % 4 AS cyclomatic, (p_size % 6) * (p_size % 6 + 1) // 2 AS cognitive, CASE WHEN p_size > 50 THEN "
    "'lines' ELSE '' END || CASE WHEN p_size > 50 AND 1 + p_size % 9 + p_size % 4 > 10 THEN ',' ELSE '' END || CASE WHEN 1 + p_size % 9 + p_size % "
    "4 > 10 THEN 'cyclomatic' ELSE '' END AS exceeded FROM part"
)
def complexity_scores(spark, d) -> DataFrame:
    cc = ratings.cyclomatic(F.col("p_size") % 9, F.col("p_size") % 4)
    nested = ratings.cognitive(F.when(F.col("p_size") % 6 == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.col("p_size") % 6)))
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), cc.alias("cyclomatic"), nested.cast("int").alias("cognitive"),
        F.array_join(ratings.exceeded({"lines": F.col("p_size"), "cyclomatic": cc}), ",").alias("exceeded")
    )


@query(
    "SELECT p_partkey AS id, p_size % 7 AS n, CASE WHEN s >= 0.98 THEN 'type-1' WHEN s >= 0.9 THEN 'type-2' WHEN s >= 0.8 THEN 'type-3' ELSE 'type-4' "
    "END AS clone_type, CASE WHEN p_size % 7 * s >= 4 THEN 'critical' WHEN p_size % 7 * s >= 2.5 THEN 'high' WHEN p_size % 7 * s >= 1.5 THEN 'medium' "
    "ELSE 'low' END AS priority FROM (SELECT *, (p_partkey % 50 + 50) / 100.0::DOUBLE AS s FROM part)"
)
def clone_ratings(spark, d) -> DataFrame:
    s, n = (F.col("p_partkey") % 50 + 50) / 100.0, F.col("p_size") % 7
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), n.alias("n"), ratings.clone_type(s).alias("clone_type"), ratings.clone_priority(n, s).alias("priority"))


@query(
    "WITH t AS (SELECT unnest(string_split(p_name, ' ')) AS name, p_size % 2 = 0 AS is_qualified FROM part UNION ALL SELECT 'List', false UNION ALL "
    "SELECT 'Timer', true) SELECT name, count(*) AS n FROM t WHERE name IN ('List', 'Timer', 'Path', 'File') AND NOT is_qualified GROUP BY 1"
)
def ambiguous_types(spark, d) -> DataFrame:
    from tessera.operators.merge import ambiguous_types as ambiguous

    t = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("name"), (F.col("p_size") % 2 == 0).alias("is_qualified"))
    return ambiguous(t.unionByName(spark.createDataFrame([("List", False), ("Timer", True)], "name string, is_qualified boolean"))).groupBy("name").agg(F.count("*").alias("n"))
