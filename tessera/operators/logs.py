"""Log files: formats, parsing, filters, context, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.ratings import log_level, status_level

# The lines' formats.
LOGCAT = r"^(\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d{3})\s+(\d+)\s+(\d+)\s+([VDIWEF])\s+(.+?)\s*:\s*(.*)$"
WEB = r'^(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\s+-\s+-\s+\[([^\]]+)\]\s+"([A-Z]+)\s+([^\s]+)\s+HTTP/[\d.]+"\s+(\d{3})\s+(\d+)'
PLAIN = r"^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})\s+\[([^\]]+)\]\s*(.*)$"
SNIFFED_LINES = 10
COLUMNS = ("line_number", "ts", "level", "message", "source", "stack_trace", "url", "path", "status_code", "raw_line")


def read_lines(spark, path: str) -> DataFrame:
    """file, line_number (from 1), line of text files; numbers are those within each file, whole files being one record only where lines are numbered."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", "\r?\n").alias("lines"))
    return whole.select("file", F.posexplode("lines").alias("n", "line")).select("file", (F.col("n") + 1).alias("line_number"), "line")


def sniffed(lines: DataFrame) -> DataFrame:
    """format (ECS, XML, Logcat, WebServer, PlainText or Unknown) by the first ten lines (line_number, line), blank ones left out."""
    first = lines.filter(F.col("line_number") <= SNIFFED_LINES).select("line_number", F.trim("line").alias("x")).filter("x <> ''")
    json = F.min(F.when(F.col("x").rlike(r"^\{.*\}$"), F.struct("line_number", "x")))["x"]
    parsed = F.get_json_object(json, "$['@timestamp']").isNotNull() | F.get_json_object(json, "$['log.level']").isNotNull()
    xml = F.bool_or((F.col("x").startswith("<") & F.contains("x", F.lit("<log"))) | F.contains("x", F.lit("<entry")))
    found = F.when(F.count("*") == 0, "Unknown").when(F.coalesce(parsed, F.lit(False)), "ECS").when(xml, "XML").when(F.bool_or(F.col("x").rlike(LOGCAT)), "Logcat").when(F.bool_or(F.col("x").rlike(WEB)), "WebServer")
    return first.agg(found.otherwise("PlainText").alias("format"))


def _row(lines: DataFrame, **values: Column) -> DataFrame:
    kinds = {"line_number": "int", "ts": "timestamp_ntz", "status_code": "int"}
    return lines.select(*[values.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS])


def parsed_plain(lines: DataFrame) -> DataFrame:
    """Entries of the lines that have the format; others are left out. A message that names an error is its own stack trace."""
    g = lambda i: F.regexp_extract("line", PLAIN, i)
    rows = lines.filter(F.col("line").rlike(PLAIN))
    trace = F.when(g(3).rlike(r"(?i)exception|error|stack\s*trace"), g(3))
    return _row(
        rows, line_number=F.col("line_number"), ts=F.try_to_timestamp(F.regexp_replace(g(1), r"\s+", " "), F.lit("yyyy-MM-dd HH:mm:ss")), level=log_level(g(2)),
        message=g(3), stack_trace=trace, raw_line=F.col("line")
    )


def parsed_logcat(lines: DataFrame, year: int) -> DataFrame:
    """Entries of logcat lines, which bear no year."""
    g = lambda i: F.regexp_extract("line", LOGCAT, i)
    rows = lines.filter(F.col("line").rlike(LOGCAT))
    ts = F.try_to_timestamp(F.concat(F.lit(f"{year}-"), F.regexp_replace(g(1), r"\s+", " ")), F.lit("yyyy-MM-dd HH:mm:ss.SSS"))
    return _row(rows, line_number=F.col("line_number"), ts=ts, level=log_level(g(4)), message=g(6), source=g(5), raw_line=F.col("line"))


def parsed_web(lines: DataFrame) -> DataFrame:
    """Entries of web access lines; the level follows the status."""
    g = lambda i: F.regexp_extract("line", WEB, i)
    rows = lines.filter(F.col("line").rlike(WEB))
    status = F.try_to_number(g(5), F.lit("999")).cast("int")
    ts = F.try_to_timestamp(F.substring(g(2), 1, 20), F.lit("dd/MMM/yyyy:HH:mm:ss"))
    return _row(rows, line_number=F.col("line_number"), ts=ts, level=status_level(status), message=F.concat_ws(" ", g(3), g(4)), url=g(4), path=g(4), status_code=status, raw_line=F.col("line"))


def parsed_ecs(lines: DataFrame) -> DataFrame:
    """Entries of JSON lines with dotted names, and additional_fields: what is not of the standard."""
    rows = lines.filter(F.col("line").rlike(r"^\s*\{.*\}\s*$"))
    get = lambda name: F.get_json_object("line", f"$['{name}']")
    fields = F.from_json("line", "map<string,string>")
    own = F.map_filter(fields, lambda k, v: ~(k.startswith("@") | k.startswith("log.") | k.startswith("error.") | k.startswith("http.") | k.startswith("url.") | k.isin("message", "service")))
    base = _row(
        rows.withColumn("__own", own), line_number=F.col("line_number"),
        ts=F.try_to_timestamp(F.substring(F.translate(get("@timestamp"), "T", " "), 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")), level=log_level(get("log.level")),
        message=get("message"), source=get("service"), stack_trace=get("error.stack_trace"), url=get("url.full"), path=get("url.path"),
        status_code=F.try_to_number(get("http.response.status_code"), F.lit("999")), raw_line=F.col("line")
    )
    return base.withColumn(
        "additional_fields",
        F.map_filter(
            F.from_json("raw_line", "map<string,string>"), lambda k,
            v: ~(k.startswith("@") | k.startswith("log.") | k.startswith("error.") | k.startswith("http.") | k.startswith("url.") | k.isin("message", "service"))
        )
    )


def parsed_xml(lines: DataFrame) -> DataFrame:
    """Entries of one-line <log> or <entry> elements with attributes or children level, timestamp, message."""
    rows = lines.filter(F.col("line").rlike(r"^\s*<(log|entry)\b.*>\s*$"))
    get = lambda n: F.nullif(F.coalesce(F.nullif(F.regexp_extract("line", rf'\b{n}="([^"]*)"', 1), F.lit("")), F.regexp_extract("line", rf"<{n}>(.*?)</{n}>", 1)), F.lit(""))
    return _row(
        rows, line_number=F.col("line_number"), ts=F.try_to_timestamp(F.substring(F.translate(get("timestamp"), "T", " "), 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")),
        level=log_level(get("level")), message=get("message"), raw_line=F.col("line")
    )


def filtered(
    entries: DataFrame, keywords: list[str] | None = None, levels: list[str] | None = None, statuses: list[int] | None = None, since: str | None = None,
    until: str | None = None
) -> DataFrame:
    """Entries with any keyword in message or stack trace (any case); level, status and time hold where the entry has none."""
    out = entries
    if keywords:
        met = F.lit(False)
        for k in keywords:
            met = met | F.contains(F.lower(F.coalesce("message", F.lit(""))), F.lit(k.lower())) | F.contains(F.lower(F.coalesce("stack_trace", F.lit(""))), F.lit(k.lower()))
        out = out.filter(met)
    or_null = lambda c, holds: F.col(c).isNull() | holds
    if levels:
        out = out.filter(or_null("level", F.col("level").isin(*levels)))
    if statuses:
        out = out.filter(or_null("status_code", F.col("status_code").isin(*statuses)))
    if since:
        out = out.filter(or_null("ts", F.col("ts") >= F.lit(since).cast("timestamp_ntz")))
    if until:
        out = out.filter(or_null("ts", F.col("ts") <= F.lit(until).cast("timestamp_ntz")))
    return out


def with_context(lines: DataFrame, matched: Column, before: int = 5, after: int = 5, partition: str | None = None, at: str = "line_number", text: str = "line") -> DataFrame:
    """Matching lines with context_before and context_after: the physical lines next to them, blank ones left out."""
    w = Window.partitionBy(*([partition] if partition else [])).orderBy(at)
    kept = F.when(F.trim(text) != "", F.col(text))
    out = lines.withColumn("context_before", F.collect_list(kept).over(w.rowsBetween(-before, -1))).withColumn("context_after", F.collect_list(kept).over(w.rowsBetween(1, after)))
    return out.filter(matched)


def brief(entries: DataFrame) -> DataFrame:
    return entries.drop("source", "additional_fields")
