"""Lookup and pattern search over symbol tables and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.similarity import fqn_score
from tessera.functions.text import name_matches, relevance_of_name

# Bits of a symbol's flags.
FLAGS = {
    "Public": 1 << 0, "Private": 1 << 1, "Internal": 1 << 2, "Protected": 1 << 3, "Class": 1 << 4, "Interface": 1 << 5, "Struct": 1 << 6, "Enum": 1 << 7, "Delegate": 1 << 8,
    "Static": 1 << 9, "Abstract": 1 << 10, "Sealed": 1 << 11, "Virtual": 1 << 12, "Override": 1 << 13, "ReadOnly": 1 << 14, "Method": 1 << 15, "Property": 1 << 16, "Field": 1 << 17,
    "Event": 1 << 18, "Constructor": 1 << 19, "Operator": 1 << 20, "Generic": 1 << 21, "Async": 1 << 22, "Extension": 1 << 23, "Partial": 1 << 24, "Nullable": 1 << 25, "Extern": 1 << 26,
    "TopLevel": 1 << 27, "Nested": 1 << 28, "GenericArgs": 1 << 29, "Parameters": 1 << 30, "Attributes": 1 << 31, "Namespace": 1 << 32, "Parameter": 1 << 33, "Local": 1 << 34,
    "NullableReference": 1 << 35, "NullableValue": 1 << 36,
}


def flag_bits(conditions: dict[str, Column]) -> Column:
    """The bitmask of the named flags whose condition holds."""
    bits = F.lit(0).cast("long")
    for name, holds in conditions.items():
        bits = bits.bitwiseOR(F.when(holds, F.lit(FLAGS[name]).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def has_all(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(F.lit(mask)) == mask


def has_any(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(F.lit(mask)) != 0


def has_none(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(F.lit(mask)) == 0


def scanned(symbols: DataFrame) -> DataFrame:
    """Rows as a scan keeps them: no implicit symbols, no aliases, arrays, pointers or dynamic kinds, names without `global::`, one row a name (the first by document and line)."""
    rows = symbols.filter(~F.coalesce("is_implicit", F.lit(False)) & ~F.coalesce("kind", F.lit("")).isin("Alias", "ArrayType", "PointerType", "DynamicType"))
    rows = rows.withColumn("canonical_fqn", F.regexp_replace("canonical_fqn", r"^global::", ""))
    first = F.row_number().over(Window.partitionBy("canonical_fqn").orderBy("document_id", "line_number"))
    return rows.withColumn("__n", first).filter("__n = 1").drop("__n")


def find(symbols: DataFrame, term: str, required: int = 0, excluded: int = 0, predicate: Column | None = None) -> DataFrame:
    """Symbols whose simple name equals term but for case; where none does, those whose simple or full name holds it. Flags: all of required, none of excluded."""
    low = term.lower()
    met = symbols.filter(F.contains(F.lower("simple_name"), F.lit(low)) | F.contains(F.lower("canonical_fqn"), F.lit(low))).withColumn("__exact", F.lower("simple_name") == low)
    # One flag over the hits decides; it is an aggregate, so hits need not meet in one task
    any_exact = met.agg(F.coalesce(F.bool_or("__exact"), F.lit(False)).alias("__any"))
    hits = met.join(F.broadcast(any_exact)).filter(F.col("__exact") | ~F.col("__any")).drop("__exact", "__any")
    hits = hits.filter(has_all(F.col("flags"), required) & has_none(F.col("flags"), excluded))
    return hits if predicate is None else hits.filter(predicate)


def by_fqn(symbols: DataFrame, fqn: str) -> DataFrame:
    return symbols.filter(F.col("canonical_fqn") == fqn)


def by_namespace(symbols: DataFrame, namespace: str, required: int = 0) -> DataFrame:
    return symbols.filter((F.lower("namespace") == namespace.lower()) & has_all(F.col("flags"), required))


def public_api(symbols: DataFrame) -> DataFrame:
    kinds = FLAGS["Class"] | FLAGS["Interface"] | FLAGS["Method"] | FLAGS["Property"]
    return symbols.filter(has_all(F.col("flags"), FLAGS["Public"]) & has_any(F.col("flags"), kinds))


def entity_search(entities: DataFrame, pattern: str, kinds: list[str] | None = None, namespace: str | None = None, limit: int = 20) -> DataFrame:
    """Entities (name, kind, namespace, ...) whose name meets the regular expression in any case, by relevance, then name."""
    hits = entities.filter(F.col("name").rlike(f"(?i){pattern}"))
    if kinds:
        hits = hits.filter(F.col("kind").isin(*kinds))
    if namespace:
        hits = hits.filter(F.contains("namespace", F.lit(namespace)))
    return hits.withColumn("relevance", relevance_of_name(F.col("name"), pattern)).orderBy(F.desc("relevance"), "name", *[c for c in entities.columns if c not in ("name",)]).limit(limit)


def content_search(docs: DataFrame, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, hits, first_line (trimmed, cut to 100) and relevance of the texts that the expression occurs in, in any case."""
    rx = f"(?i){pattern}"
    hits = docs.filter(F.col(text).rlike(rx))
    line = F.trim(F.filter(F.split(F.col(text), "\n"), lambda x: x.rlike(rx))[0])
    n = F.regexp_count(F.col(text), F.lit(rx))
    score = F.least(F.lit(1.0), n / F.greatest(F.floor(F.length(text) / 100), F.lit(1)))
    return hits.select(
        id_col, n.cast("long").alias("hits"), F.when(F.length(line) > 100, F.concat(F.substring(line, 1, 100), F.lit("..."))).otherwise(line).alias("first_line"),
        score.alias("relevance")
    )


def definition_search(units: DataFrame, pattern: str, limit: int = 20) -> DataFrame:
    """Units (file, parent, kind, text) whose text meets the expression (multiline, any case), generated files left out, one row a text; grouped as file, parent, kind with an array of texts."""
    hits = units.filter(~F.col("file").rlike(r"\.g\.cs$|\.Designer\.cs$") & F.col("text").rlike(f"(?im){pattern}"))
    first = F.row_number().over(Window.partitionBy("text").orderBy("file", "parent", "kind"))
    once = hits.withColumn("__n", first).filter("__n = 1").orderBy("file", "parent", "kind", "text").limit(limit)
    return once.groupBy("file", "parent", "kind").agg(F.array_sort(F.collect_list("text")).alias("texts"))


def bm25(docs: DataFrame, query: str, k: int, id_col: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The k best documents by BM25 over lower-cased words of letters and digits; a word of the query ending in * stands for all words that begin so.

    Term counts come from one pass over the texts in which only the query's words are counted, so no posting list of other words is moved.
    """
    terms = sorted({t.lower() for t in query.split()})
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1)
    rows = docs.select(F.col(id_col).alias("id"), words.alias("words"))
    counted = rows.select("id", F.size("words").alias("n"), *[_term_count(t).alias(f"tf{i}") for i, t in enumerate(terms)])
    totals = counted.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *[F.sum((F.col(f"tf{i}") > 0).cast("int")).alias(f"df{i}") for i in range(len(terms))])
    scored = counted.filter(" OR ".join(f"tf{i} > 0" for i in range(len(terms)))).join(F.broadcast(totals))
    parts = []
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.ln(1 + (F.col("docs") - df + 0.5) / (df + 0.5))
        parts.append(idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("n") / F.col("mean"))))
    score = parts[0]
    for p in parts[1:]:
        score = score + p
    return scored.select(F.col("id").alias(id_col), score.alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def _term_count(term: str) -> Column:
    if term.endswith("*"):
        return F.size(F.filter("words", lambda w: w.startswith(term[:-1])))
    return F.size(F.filter("words", lambda w: w == term))


def fuzzy_lookup(symbols: DataFrame, asked: str, limit: int = 20, floor: float = 0.7) -> DataFrame:
    """Symbols by fqn_score, best first, then by name; one match of 0.99 or more stands alone."""
    scored = symbols.withColumn("score", fqn_score(F.lit(asked), F.col("canonical_fqn"), F.col("is_constructor"))).filter(F.col("score") >= floor)
    best = scored.orderBy(F.desc("score"), "canonical_fqn").limit(limit)
    perfect = F.sum((F.col("score") >= 0.99).cast("int")).over(Window.partitionBy())
    return best.withColumn("__p", perfect).filter((F.col("__p") != 1) | (F.col("score") >= 0.99)).drop("__p")


def name_search(symbols: DataFrame, pattern: str, kind: str = "auto", column: str = "simple_name") -> DataFrame:
    return symbols.filter(name_matches(F.col(column), pattern, kind))


def type_search(types: DataFrame, pattern: str, limit: int) -> DataFrame:
    """Types whose full or simple name meets the expression in any case, one row a full name."""
    met = types.filter(F.col("fqn").rlike(f"(?i){pattern}") | F.col("name").rlike(f"(?i){pattern}"))
    return met.dropDuplicates(["fqn"]).orderBy("fqn").limit(limit)


def enclosing_scopes(units: DataFrame, start: str, most: int = 1000) -> DataFrame:
    """depth, id of the unit `start` (id, parent_id) and what encloses it, outwards; a cycle ends where it comes to a unit again. More than `most` steps are an error."""
    step = units.filter(F.col("id") == start).select("id", "parent_id").first()
    out, seen = [], set()
    while step and step.id not in seen:
        if len(out) > most:
            raise RuntimeError(f"more than {most} units around {start}")
        out.append((len(out), step.id))
        seen.add(step.id)
        step = units.filter(F.col("id") == step.parent_id).select("id", "parent_id").first() if step.parent_id is not None else None
    return units.sparkSession.createDataFrame(out, f"depth int, id {dict(units.dtypes)['id']}")


def shared_passages(passages: DataFrame, docs: DataFrame, passage_id: str, doc_id: str, words: int = 8, text: str = "text") -> DataFrame:
    """passage_id, doc_id, shared, windows: texts that share runs of `words` words, how many different ones, and how many the passage has. Whole texts on both sides meet by the hashes of their runs."""

    def windows(rows: DataFrame, name: str) -> DataFrame:
        split = rows.select(F.col(name), F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("w")).filter(F.size("w") >= words)
        runs = F.transform(F.sequence(F.lit(1), F.size("w") - (words - 1)), lambda i: F.md5(F.array_join(F.slice("w", i, words), " ")))
        return split.select(name, F.explode(F.array_distinct(runs)).alias("g"))

    asked = windows(passages, passage_id)
    total = asked.groupBy(passage_id).agg(F.count("*").alias("windows"))
    return asked.join(windows(docs, doc_id), "g").groupBy(passage_id, doc_id).agg(F.count("*").alias("shared")).join(total, passage_id).select(passage_id, doc_id, "shared", "windows")


def replace_preview(docs: DataFrame, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, container (number of the line from 1), n, conflict (more than one match in it) of the lines in which the pattern occurs."""
    lines = docs.select(F.col(id_col), F.posexplode(F.split(text, "\n")).alias("at", "line"))
    found = lines.withColumn("n", F.regexp_count("line", F.lit(pattern)).cast("long")).filter("n > 0")
    return found.select(id_col, (F.col("at") + 1).alias("container"), "n", (F.col("n") > 1).alias("conflict"))


def replaced(docs: DataFrame, pattern: str, replacement: str, mode: str = "BestEffort", id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, text, applied (lines changed) of the texts in which the pattern occurs. BestEffort leaves lines with more than one match as they are; AllOrNothing changes nothing if there is such a line anywhere."""
    if mode not in ("AllOrNothing", "BestEffort"):
        raise ValueError(f"no such mode: {mode}")
    once = lambda x: F.regexp_count(x, F.lit(pattern)) == 1
    lines = F.split(text, "\n")
    hit = docs.filter(F.col(text).rlike(pattern))
    out = hit.select(
        id_col, F.col(text).alias("old"), F.array_join(F.transform(lines, lambda x: F.when(once(x), F.regexp_replace(x, pattern, replacement)).otherwise(x)), "\n").alias("new"),
        F.size(F.filter(lines, once)).cast("long").alias("n"), F.exists(lines, lambda x: F.regexp_count(x, F.lit(pattern)) > 1).alias("conflict"),
    )
    if mode == "AllOrNothing":
        any_ = out.agg(F.coalesce(F.bool_or("conflict"), F.lit(False)).alias("stop"))
        out = out.join(F.broadcast(any_))
        return out.select(id_col, F.when(F.col("stop"), F.col("old")).otherwise(F.col("new")).alias("text"), F.when(F.col("stop"), 0).otherwise(F.col("n")).cast("long").alias("applied"))
    return out.select(id_col, F.col("new").alias("text"), F.col("n").alias("applied"))


def diagnostics_filtered(rows: DataFrame, least: str | None = None, ids: list[str] | None = None, projects: list[str] | None = None, globs: list[str] | None = None) -> DataFrame:
    """Diagnostics of a severity at least, not suppressed, by id, project (any case) and any of the path patterns."""
    from tessera.functions.ratings import SEVERITIES, severity_order
    from tessera.functions.text import glob_matches

    out = rows.filter(~F.coalesce("is_suppressed", F.lit(False)))
    if least:
        out = out.filter(severity_order(F.col("severity")) >= SEVERITIES.index(least))
    if ids:
        out = out.filter(F.col("diag_id").isin(*ids))
    if projects:
        out = out.filter(F.lower("project_name").isin(*(p.lower() for p in projects)))
    if globs:
        met = F.lit(False)
        for g in globs:
            met = met | glob_matches(F.col("file_path"), g)
        out = out.filter(met)
    return out


def page(rows: DataFrame, order: list[Column | str], skip: int, take: int) -> DataFrame:
    """Rows skip + 1 to skip + take in order, each with total and has_more; the total is an aggregate of its own."""
    total = rows.agg(F.count("*").alias("total"))
    shown = rows.orderBy(*order).offset(skip).limit(take)
    return shown.join(F.broadcast(total)).withColumn("has_more", F.col("total") > skip + take)


def pattern_search(entities: DataFrame, contents: DataFrame, semantic: DataFrame | None, pattern: str, mode: str = "hybrid", limit: int = 20) -> DataFrame:
    """id, score, sources of a search by names, by contents, by meaning (semantic: id, score) or by all three; without semantic hits the last two fall back to names.

    entities: id, name, kind, namespace; contents: id, text.
    """
    from tessera.operators.vector import weighted_fusion

    if not 1 <= limit <= 100:
        raise ValueError("limit must be from 1 to 100")
    if mode not in ("entity", "content", "semantic", "hybrid"):
        raise ValueError(f"no such mode: {mode}")
    if semantic is None and mode in ("semantic", "hybrid"):
        mode = "entity"
    by_name = entities.filter(F.col("name").rlike(f"(?i){pattern}")).select("id", relevance_of_name(F.col("name"), pattern).alias("score"))
    by_text = content_search(contents, pattern, "id").select("id", F.col("relevance").alias("score"))
    if mode == "hybrid":
        return weighted_fusion(by_name, by_text, semantic, limit)
    hits = {"entity": by_name, "content": by_text, "semantic": semantic}[mode]
    return hits.select("id", "score", F.lit(mode).alias("sources"), F.lit(1).cast("long").alias("n_sources")).orderBy(F.desc("score"), "id").limit(limit)


def resolved_share(cached: DataFrame, live: DataFrame, id_col: str, least: float = 0.8) -> DataFrame:
    """cached, resolved, usable: how many cached rows still are there, and whether enough to keep the cache."""
    there = live.select(F.col(id_col).alias("__there")).distinct()
    out = cached.join(there, F.col(id_col) == F.col("__there"), "left").agg(F.count("*").alias("cached"), F.count("__there").alias("resolved"))
    return out.withColumn("usable", F.col("resolved") >= least * F.col("cached"))
