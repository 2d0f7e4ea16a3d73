"""Rollups: diagnostics, complexity, validation, languages, technologies, indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.ratings import relevance, rule_verdict
from tessera.functions.text import latin_words, other_words
from tessera.operators.vector import centroid_pairs, centroids
from tessera.operators.lookup import FLAGS

# Rules of the presets.
PRESETS = {
    "performance": (
        "CA1845", "CA1847", "CA1850", "CA1851", "CA1853", "CA1854", "CA1855", "CA1858", "CA1859", "CA1860", "CA1861",
    ),
    "maintainability": (
        "CA1501", "CA1502", "CA1505", "CA1506", "CA1822",
    ),
    "security": (
        "CA2100", "CA2109", "CA2119", "CA2153", "CA2300", "CA2301", "CA2302", "CA2305", "CA2310", "CA2315", "CA2321", "CA2322",
        "CA2326", "CA2327", "CA2328", "CA2329", "CA2330", "CA3001", "CA3002", "CA3003", "CA3004", "CA3005", "CA3006", "CA3007",
        "CA3008", "CA3009", "CA3010", "CA3011", "CA3012", "CA5350", "CA5351", "CA5359", "CA5360", "CA5361", "CA5362", "CA5363",
        "CA5364", "CA5365", "CA5366", "CA5367", "CA5368", "CA5369", "CA5370", "CA5371", "CA5372", "CA5373", "CA5374", "CA5375",
        "CA5376", "CA5377", "CA5378", "CA5379", "CA5380", "CA5381", "CA5382", "CA5383", "CA5384", "CA5385", "CA5386", "CA5387",
        "CA5388", "CA5389", "CA5390", "CA5391", "CA5392", "CA5393", "CA5394", "CA5395", "CA5396", "CA5397", "CA5398", "CA5399",
        "CA5400", "CA5401", "CA5402", "CA5403", "CA5404", "CA5405",
    ),
    "reliability": (
        "CA2000", "CA2002", "CA2007", "CA2008", "CA2009", "CA2011", "CA2012", "CA2013", "CA2014", "CA2015", "CA2016", "CA2017",
        "CA2018", "CA2019", "CA2020",
    ),
    "usage": (
        "CA1031", "CA1303", "CA2201", "CA2207", "CA2208", "CA2211", "CA2213", "CA2214", "CA2215", "CA2216", "CA2217", "CA2218",
        "CA2219", "CA2224", "CA2225", "CA2226", "CA2227", "CA2229", "CA2231", "CA2234", "CA2235", "CA2237", "CA2241", "CA2242",
        "CA2243", "CA2244", "CA2245", "CA2246", "CA2247", "CA2248", "CA2249", "CA2250", "CA2251", "CA2252", "CA2253", "CA2254",
        "CA2255", "CA2256", "CA2257", "CA2258", "CA2259", "CA2260",
    ),
    "design": (
        "CA1000", "CA1001", "CA1002", "CA1003", "CA1005", "CA1008", "CA1010", "CA1012", "CA1014", "CA1016", "CA1017", "CA1018",
        "CA1019", "CA1021", "CA1024", "CA1027", "CA1028", "CA1030", "CA1031", "CA1032", "CA1033", "CA1034", "CA1036", "CA1040",
        "CA1041", "CA1043", "CA1044", "CA1045", "CA1046", "CA1047", "CA1050", "CA1051", "CA1052", "CA1053", "CA1054", "CA1055",
        "CA1056", "CA1058", "CA1060", "CA1061", "CA1062", "CA1063", "CA1064", "CA1065", "CA1066", "CA1067", "CA1068", "CA1069",
        "CA1070",
    ),
    "globalization": (
        "CA1303", "CA1304", "CA1305", "CA1307", "CA1308", "CA1309", "CA1310", "CA2101",
    ),
    "naming": (
        "CA1700", "CA1707", "CA1708", "CA1710", "CA1711", "CA1712", "CA1713", "CA1714", "CA1715", "CA1716", "CA1717", "CA1720",
        "CA1721", "CA1722", "CA1724", "CA1725", "CA1726",
    ),
    "documentation": (
        "CA1200", "CS1572", "CS1573", "CS1574", "CS1591",
    ),
    "logging": (
        "CA1848", "CA1849", "CA1850", "CA1852", "CA1853", "CA1854", "CA1855", "CA1856", "CA1857", "CA1858", "CA1859", "CA1860",
        "CA1861", "CA1862", "CA1863", "CA1864", "CA1865", "CA1866", "CA1867", "CA1868", "CA1869", "CA1870", "CA1871", "CA1872",
        "CA1873",
    ),
    "notable": (
        "CA1854", "CA1860", "CA1869",
    ),
    "trivial": (
        "CA1822",
    ),
}
PRESET_SUMS = {"critical": ("security",), "high": ("reliability", "notable"), "medium": ("performance", "maintainability"), "low": ("naming", "documentation", "trivial")}


def preset(name: str) -> set[str]:
    """Rule ids of a preset, in any case; an unknown name has none."""
    return {rule for part in PRESET_SUMS.get(name.lower(), (name.lower(),)) for rule in PRESETS.get(part, ())}


def diagnostic_stats(rows: DataFrame) -> DataFrame:
    """diag_id, n, files, projects, severity (the first by order of rows) of diagnostics (nth, diag_id, severity, file_path, project_name)."""
    return rows.groupBy("diag_id").agg(
        F.count("*").alias("n"), F.count_distinct("file_path").alias("files"), F.count_distinct("project_name").alias("projects"),
        F.min_by("severity", "nth").alias("severity")
    )


def diagnostic_clusters(rows: DataFrame, shown: int = 5) -> DataFrame:
    """diag_id, n, category, recommended, confidence, pattern, relevance, examples (the first messages)."""
    w = Window.partitionBy("diag_id").orderBy("nth")
    # Examples are ranked in each task before the shuffle, so a frequent rule moves few rows
    first = rows.withColumn("at", F.row_number().over(w)).filter(F.col("at") <= shown).groupBy("diag_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("at", "message"))), lambda x: x["message"]
    ).alias("examples"))
    words = {"logging": "Logging infrastructure", "performance": "Performance optimization", "security": "Security concern", "style": "Code style"}
    named = [F.bool_or(F.contains(F.lower("message"), F.lit(w))).alias(f"has_{w}") for w in words]
    grouped = rows.groupBy("diag_id").agg(F.count("*").alias("n"), F.collect_set("file_path").alias("files"), F.min_by("severity", "nth").alias("severity"), *named)
    out = grouped.withColumn("v", rule_verdict(F.col("diag_id"), F.col("n"), F.col("files"), F.col("severity"))).select("*", "v.*").drop("v", "files")
    pattern = F.col("category")
    for word, label in reversed(words.items()):
        pattern = F.when(F.col(f"has_{word}"), label).otherwise(pattern)
    out = out.withColumn("pattern", pattern).withColumn("relevance", relevance(F.col("category"), F.col("severity"), F.col("confidence"))).drop(*(f"has_{w}" for w in words))
    return out.join(first, "diag_id")


def category_histogram(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("category").agg(F.count("*").alias("clusters"), F.sum("n").alias("occurrences"))


def cluster_neighbours(messages: DataFrame, clusters: DataFrame, floor: float = 0.85) -> DataFrame:
    """diag_id, confidence: raised by 0.05 (to 1 at most) for each cluster of the same category whose centroid of message vectors (diag_id, embedding) is alike."""
    pairs = centroid_pairs(centroids(messages, "diag_id"), "diag_id", floor)
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    kind = clusters.select(F.col("diag_id").alias("b"), F.col("category").alias("of"))
    n = both.join(kind, "b").join(clusters.select(F.col("diag_id").alias("a"), "category"), "a").filter("of = category").groupBy("a").agg(F.count("*").alias("near"))
    out = clusters.join(n, F.col("diag_id") == F.col("a"), "left")
    return out.select("diag_id", F.least(F.lit(1.0), F.col("confidence") + 0.05 * F.coalesce("near", F.lit(0))).alias("confidence"))


def recommendations(clusters: DataFrame, least: float = 0.8) -> DataFrame:
    """diag_id, kind (rule or review), line: what a configuration file says of each cluster, by category, then id."""
    line = F.concat(F.lit("dotnet_diagnostic."), F.col("diag_id"), F.lit(".severity = "), F.lower("recommended"))
    return clusters.select(
        "category", "diag_id", F.when(F.col("confidence") >= least, "rule").otherwise("review").alias("kind"),
        F.when(F.col("confidence") >= least, line).otherwise(F.concat(F.lit("# review: "), F.col("diag_id"))).alias("line")
    ).orderBy("category", "diag_id")


def config_text(clusters: DataFrame, least: float = 0.8) -> DataFrame:
    """text: the recommendations of all clusters, one line each; a row a rule, so they fit one cell."""
    ordered = F.array_sort(F.collect_list(F.struct("category", "diag_id", "line")))
    return recommendations(clusters, least).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def symbol_stats(symbols: DataFrame) -> DataFrame:
    """total, names, namespaces, all_flags (bitwise or) and a number for each kind and accessibility."""
    kinds = ("Public", "Private", "Internal", "Protected", "Class", "Interface", "Struct", "Enum", "Method", "Property", "Field")
    each = [F.count_if(F.col("flags").bitwiseAND(F.lit(FLAGS[k])) != 0).alias(f"n_{k.lower()}") for k in kinds]
    return symbols.agg(F.count("*").alias("total"), F.count_distinct("simple_name").alias("names"), F.count_distinct("namespace").alias("namespaces"), F.bit_or("flags").alias("all_flags"), *each)


def cache_stats(entries: DataFrame) -> DataFrame:
    return entries.agg(
        F.count("*").alias("n"), F.sum(F.length("result")).alias("bytes"), F.count_distinct("operation").alias("operations"),
        F.count_distinct("solution").alias("solutions"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest")
    )


def complexity_rollup(methods: DataFrame, project: str, type_: str) -> DataFrame:
    """A row for each type and one for each project (type null): methods, sum, max and mean of cyclomatic, sum of cognitive, methods above 10, lines."""
    cc = F.col("cyclomatic")
    return methods.rollup(project, type_).agg(
        F.grouping_id().alias("level"), F.count("*").alias("methods"), F.sum(cc).alias("sum_cc"), F.max(cc).alias("max_cc"), F.avg(cc).alias("avg_cc"),
        F.sum("cognitive").alias("sum_cognitive"), F.count_if(cc > 10).alias("complex_methods"), F.sum("lines").alias("lines")
    ).filter("level < 3")


def type_metrics(members: DataFrame, type_: str) -> DataFrame:
    """type, a number for each kind of member, mean complexity of methods, distinct dependencies."""
    kinds = ("method", "property", "field", "event")
    return members.groupBy(type_).agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds], F.avg(F.when(F.col("kind") == "method", F.col("cyclomatic"))).alias("avg_cc"),
        F.count_distinct("depends_on").alias("dependencies")
    )


def language_mix(docs: DataFrame, text: str = "text") -> DataFrame:
    """latin, other, share (percent of other words), language: multilingual from 20 % and 50 words on, else english."""
    sums = docs.agg(F.coalesce(F.sum(latin_words(F.col(text))), F.lit(0)).alias("latin"), F.coalesce(F.sum(other_words(F.col(text))), F.lit(0)).alias("other"))
    total = F.col("latin") + F.col("other")
    share = F.when(total == 0, 0.0).otherwise(F.col("other") * 100.0 / F.greatest(total, F.lit(1)))
    return sums.withColumn("share", share).withColumn("language", F.when((total >= 50) & (share >= 20), "multilingual").otherwise("english"))


def size_class(files: DataFrame, text: str = "text") -> DataFrame:
    """files, lines, bytes, size (small, medium, large) of a code base."""
    out = files.agg(F.count("*").alias("files"), F.sum(F.size(F.split(text, "\n"))).alias("lines"), F.sum(F.length(text)).alias("bytes"))
    return out.withColumn("size", F.when(F.col("lines") < 10_000, "small").when(F.col("lines") < 100_000, "medium").otherwise("large"))


def validation_summary(rows: DataFrame, shown: int = 20) -> DataFrame:
    """file_path, errors, warnings, infos of the files with most errors and warnings."""
    of = lambda s: F.count_if(F.col("severity") == s)
    each = rows.groupBy("file_path").agg(of("Error").alias("errors"), of("Warning").alias("warnings"), of("Info").alias("infos"))
    return each.filter(F.col("errors") + F.col("warnings") > 0).orderBy(F.desc(F.col("errors") + F.col("warnings")), "file_path").limit(shown)


def validation_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """severity, before, after, change (improved, degraded or unchanged)."""
    n = lambda d, name: d.groupBy("severity").agg(F.count("*").alias(name))
    both = n(before, "before").join(n(after, "after"), "severity", "full_outer").na.fill(0, ["before", "after"])
    return both.withColumn("change", F.when(F.col("after") < F.col("before"), "improved").when(F.col("after") > F.col("before"), "degraded").otherwise("unchanged"))


def technologies(references: DataFrame) -> DataFrame:
    """category, package, versions, projects of package references (project, package, version, category), most used first."""
    out = references.groupBy("category", "package").agg(F.array_sort(F.collect_set("version")).alias("versions"), F.count_distinct("project").alias("projects"))
    return out.orderBy(F.desc("projects"), "package")


def import_usage(imports: DataFrame) -> DataFrame:
    """name, files, common (in every file that has imports)."""
    total = imports.agg(F.count_distinct("file").alias("total"))
    return imports.groupBy("name").agg(F.count_distinct("file").alias("files")).join(F.broadcast(total)).select("name", "files", (F.col("files") == F.col("total")).alias("common"))


def unique_imports(imports: DataFrame) -> DataFrame:
    """file, name: what a file imports (name, file) that not every file does."""
    once = imports.select("file", "name").distinct()
    rare = import_usage(imports).filter("NOT common").select("name")
    return once.join(rare, "name").select("file", "name")


def unit_stats(units: DataFrame) -> DataFrame:
    """type, units, files, embedded of indexed units (type, file, embedding)."""
    return units.groupBy("type").agg(F.count("*").alias("units"), F.count_distinct("file").alias("files"), F.count("embedding").alias("embedded"))


def project_listing(rows: DataFrame) -> DataFrame:
    """project, branches, vectors, first, last of stored rows (project, branch, ts)."""
    return rows.groupBy("project").agg(F.count_distinct("branch").alias("branches"), F.count("*").alias("vectors"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def score_histogram(rows: DataFrame, score: str) -> DataFrame:
    """bucket, n of scores: perfect, high (0.9), good (0.8), fair (0.7) or low."""
    bucket = F.when(F.col(score) >= 1, "perfect").when(F.col(score) >= 0.9, "high").when(F.col(score) >= 0.8, "good").when(F.col(score) >= 0.7, "fair").otherwise("low")
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
