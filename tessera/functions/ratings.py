"""Ladders: categories, types, priorities and scores from thresholds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds and weights.
CHANGES = ((0.98, "identical"), (0.95, "refactoring"), (0.85, "minor"), (0.70, "moderate"), (0.50, "major"))
LIKENESS = ((0.9, "very similar"), (0.7, "similar"), (0.5, "somewhat similar"))
CLONE_TYPES = ((0.98, "type-1"), (0.90, "type-2"), (0.80, "type-3"))
PRIORITIES = ((4.0, "critical"), (2.5, "high"), (1.5, "medium"))
CATEGORY_WEIGHTS = {"Security": 10.0, "Reliability": 9.0, "PerformanceCritical": 8.0, "Maintainability": 6.0, "Infrastructure": 5.0, "Style": 3.0, "FalsePositive": 1.0, "NeedsManualReview": 5.0}
SEVERITY_WEIGHTS = {"Error": 1.0, "Warning": 0.7, "Info": 0.4, "Hidden": 0.2}
SEVERITIES = ("Hidden", "Info", "Warning", "Error")
PERFORMANCE_IDS = ("CA1829", "CA1854", "CA1845", "CA1860")
LEVELS = {
    "Verbose": ("VERBOSE", "V", "TRACE"), "Debug": ("DEBUG", "D"), "Info": ("INFO", "I", "INFORMATION"),
    "Warning": ("WARN", "WARNING", "W"), "Error": ("ERROR", "E", "ERR"), "Fatal": ("FATAL", "F", "CRITICAL"),
}


def ladder(value: Column, steps: tuple[tuple[float, str], ...], last: str) -> Column:
    out = F.when(value >= steps[0][0], steps[0][1])
    for least, name in steps[1:]:
        out = out.when(value >= least, name)
    return out.otherwise(last)


def _mapped(key: Column, values: dict[str, float], last: float) -> Column:
    first, *rest = values.items()
    out = F.when(key == first[0], first[1])
    for k, v in rest:
        out = out.when(key == k, v)
    return out.otherwise(last)


def change_category(similarity: Column) -> Column:
    return ladder(similarity, CHANGES, "breaking")


def likeness(similarity: Column) -> Column:
    return ladder(similarity, LIKENESS, "different")


def clone_type(similarity: Column) -> Column:
    return ladder(similarity, CLONE_TYPES, "type-4")


def clone_priority(n: Column, similarity: Column) -> Column:
    return ladder(n * similarity, PRIORITIES, "low")


def priority_order(priority: Column) -> Column:
    return _mapped(priority, {"critical": 0, "high": 1, "medium": 2}, 3)


def rule_verdict(rule: Column, n: Column, files: Column, severity: Column) -> Column:
    """struct(category, recommended, confidence) of a diagnostic rule from its number of hits, its files (array) and severity."""

    def some(*parts: str) -> Column:
        return F.exists(files, lambda f: F.lower(f).rlike("|".join(parts)))

    def verdict(category: str, recommended: Column | str, confidence: float) -> Column:
        return F.struct(F.lit(category).alias("category"), (F.lit(recommended) if isinstance(recommended, str) else recommended).alias("recommended"), F.lit(confidence).alias("confidence"))

    return (
        F.when((rule == "CA1873") & some("log") & (n > 10), verdict("FalsePositive", "None", 0.9))
        .when((rule == "CA1822") & some("benchmark"), verdict("Infrastructure", "None", 0.85))
        .when(rule.isin(*PERFORMANCE_IDS), verdict("PerformanceCritical", "Warning", 0.8))
        .when(rule.startswith("CA2"), verdict("Security", "Error", 0.75))
        .when(rule.startswith("IDE"), verdict("Style", "Silent", 0.7))
        .when(rule.startswith("CA15"), verdict("Maintainability", "Suggestion", 0.7))
        .otherwise(verdict("NeedsManualReview", F.when(severity.isin("Warning", "Error"), "Warning").otherwise("Suggestion"), 0.5))
    )


def severity_order(severity: Column) -> Column:
    return _mapped(severity, {s: i for i, s in enumerate(SEVERITIES)}, -1)


def relevance(category: Column, severity: Column, confidence: Column) -> Column:
    """Product of the weights, rounded half to even at two places."""
    return F.bround(_mapped(category, CATEGORY_WEIGHTS, 5.0) * _mapped(severity, SEVERITY_WEIGHTS, 0.5) * confidence, 2)


def log_level(level: Column) -> Column:
    up = F.upper(level)
    out = F.when(level.isNull(), F.lit(None).cast("string"))
    for name, spellings in LEVELS.items():
        out = out.when(up.isin(*spellings), name)
    return out.otherwise("Unknown")


def status_level(status: Column) -> Column:
    return F.when(status >= 500, "Error").when(status >= 400, "Warning").otherwise("Info")


def change_intent(same_structure: Column, same_signature: Column) -> Column:
    """struct(intent, confidence)."""
    named = lambda i, c: F.struct(F.lit(i).alias("intent"), F.lit(c).alias("confidence"))
    return F.when(same_structure, named("CodeCleanup", 0.95)).when(~same_signature, named("APIChange", 0.9)).otherwise(named("Modification", 0.7))


def match_confidence(similarity: Column) -> Column:
    """Confidence of a match by similarity: a line for each class of 0.90, 0.75 and 0.60."""
    return F.when(similarity >= 0.90, 0.90 + (similarity - 0.90)).when(similarity >= 0.75, 0.70 + (similarity - 0.75) * 1.33).when(similarity >= 0.60, 0.50 + (similarity - 0.60) * 1.33).otherwise(similarity)


def path_confidence(depth: Column, reached: Column, mean: Column | None = None, high: Column | None = None) -> Column:
    """Of a call path: by depth and whether it reached an entry; with the frames' mean confidence and the number above 0.8, by those too."""
    if mean is None:
        return 1 / (1 + depth * 0.1) * F.when(reached, 1.0).otherwise(0.7)
    bonus = F.when(high > 0, 0.1 * F.least(F.lit(1.0), high / 3.0)).otherwise(0.0)
    score = (mean + bonus) * F.when(reached, 1.0).otherwise(0.85) / (1 + depth * 0.05)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def cyclomatic(branch_nodes: Column, logical_operators: Column) -> Column:
    return 1 + branch_nodes + logical_operators


def cognitive(branch_kinds: Column) -> Column:
    """Sum over branches (array, in order) of 1 + nesting, which only ever grows."""
    return F.aggregate(F.transform(branch_kinds, lambda x, i: 1 + i), F.lit(0), lambda n, x: n + x)


# Measures above which a method is reported.
METHOD_LIMITS = {"lines": 50, "cyclomatic": 10, "cognitive": 20, "parameters": 4, "locals": 10, "external_calls": 5}


def exceeded(measures: dict[str, Column]) -> Column:
    """Names of the measures above their limits (array)."""
    return F.filter(F.array(*(F.when(c > METHOD_LIMITS[k], k) for k, c in measures.items())), lambda x: x.isNotNull())
