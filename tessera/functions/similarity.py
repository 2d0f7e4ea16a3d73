"""Weighted similarities of feature rows, and of names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.vectors import alike, jaccard, sparse_cosine

# Weights and caps of the features of a method.
METHOD_WEIGHTS = {
    "invoked": 0.25, "operations": 0.20, "accessed_types": 0.15, "param_types": 0.10, "cyclomatic": 0.075,
    "return_type": 0.05, "blocks": 0.05, "branches": 0.05, "loops": 0.05, "param_count": 0.025,
}
METHOD_CAPS = {"blocks": 60, "branches": 25, "loops": 8, "cyclomatic": 30}
# Weight, cap of the count features of a class.
CLASS_COUNTS = {
    "avg_complexity": (0.05, 15.0), "public_methods": (0.03, 50), "properties": (0.03, 30), "fields": (0.03, 50), "lines": (0.02, 2000),
    "protected_methods": (0.02, 50), "private_methods": (0.02, 50), "static_methods": (0.02, 50), "abstract_methods": (0.02, 50), "virtual_methods": (0.02, 50),
    "read_only_properties": (0.01, 30), "static_properties": (0.01, 30), "static_fields": (0.01, 50), "read_only_fields": (0.01, 50), "const_fields": (0.01, 50),
    "events": (0.01, 20), "nested_classes": (0.01, 10), "nested_structs": (0.01, 10), "nested_enums": (0.01, 10), "nested_interfaces": (0.01, 10),
}
CLASS_SETS = {"interfaces": 0.15, "referenced_types": 0.15, "namespaces": 0.03}
CLASS_METHODS, CLASS_BASE = 0.20, 0.07


def _total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def method_similarity(a: Column, b: Column) -> Column:
    """Of structs with the fields of METHOD_WEIGHTS (invoked, accessed_types and param_types are arrays, operations a map of counts)."""
    w = METHOD_WEIGHTS
    n_a, n_b = F.size(a["param_types"]), F.size(b["param_types"])
    most = F.greatest(n_a, n_b)
    same_place = F.aggregate(F.zip_with(a["param_types"], b["param_types"], lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
    params = F.when(most == 0, 1.0).otherwise(same_place / F.greatest(most, F.lit(1)))
    counts = [w[k] * alike(a[k], b[k], cap) for k, cap in METHOD_CAPS.items()]
    return _total([
        w["invoked"] * jaccard(a["invoked"], b["invoked"]), w["operations"] * sparse_cosine(a["operations"], b["operations"]), w["accessed_types"] * jaccard(a["accessed_types"], b["accessed_types"]),
        w["param_types"] * params, w["return_type"] * F.when(a["return_type"] == b["return_type"], 1.0).otherwise(0.0), w["param_count"] * F.when(most == 0, 1.0).otherwise(1 - F.abs(n_a - n_b) / F.greatest(most, F.lit(1))),
        *counts,
    ])


def class_similarity(a: Column, b: Column, methods: Column) -> Column:
    """Of structs with base, the sets of CLASS_SETS and the counts of CLASS_COUNTS; methods is the similarity of their matched methods (see operators.similarity.assigned). Divided by the weights' sum."""
    parts = [CLASS_METHODS * methods, CLASS_BASE * F.when(F.coalesce(a["base"], F.lit("")) == F.coalesce(b["base"], F.lit("")), 1.0).otherwise(0.0)]
    parts += [w * jaccard(a[k], b[k]) for k, w in CLASS_SETS.items()]
    parts += [w * alike(a[k], b[k], cap) for k, (w, cap) in CLASS_COUNTS.items()]
    weight = CLASS_METHODS + CLASS_BASE + sum(CLASS_SETS.values()) + sum(w for w, _ in CLASS_COUNTS.values())
    return _total(parts) / F.lit(weight)


def capped_levenshtein(a: Column, b: Column) -> Column:
    """Edit distance, but the longer length where the lengths differ by more than half of it."""
    most = F.greatest(F.length(a), F.length(b))
    return F.when(F.abs(F.length(a) - F.length(b)) > F.floor(most / 2), most).otherwise(F.levenshtein(a, b))


def name_similarity(a: Column, b: Column) -> Column:
    """1 if equal but for case, else 1 - distance / longer length."""
    x, y = F.lower(a), F.lower(b)
    return F.when(x == y, 1.0).otherwise(1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1)))


def fuzzy_contains(a: Column, b: Column) -> Column:
    """1 if either holds the other, but for case; else 1 - capped distance / longer length; 0 if one is empty."""
    x, y = F.lower(a), F.lower(b)
    near = F.greatest(F.lit(0.0), 1 - capped_levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1)))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).when(F.contains(x, y) | F.contains(y, x), 1.0).otherwise(near)


def segment_match(hint: Column, target: Column) -> Column:
    """Share of target's segments that some segment of hint holds, is held by or nearly equals."""
    cut = lambda c, marks: F.filter(F.split(F.lower(c), f"[{marks}]"), lambda s: s != "")
    hints, targets = cut(hint, r".,<> ()"), cut(target, r".<>")
    met = F.filter(targets, lambda t: F.exists(hints, lambda h: F.contains(t, h) | F.contains(h, t) | (fuzzy_contains(h, t) > 0.85)))
    return F.when(F.size(targets) > 0, F.size(met) / F.size(targets)).otherwise(0.0)


def stack_confidence(hints: Column, name: Column, type_name: Column, full_type: Column, namespace: Column, signature: Column) -> Column:
    """The best that a method reaches over the hints (array) of a stack trace; 0 without hints."""

    def one(hint: Column) -> Column:
        low = F.lower(hint)
        over = lambda value, least, share: F.when(value > least, share * value).otherwise(0.0)
        looser = F.greatest(
            F.when(F.contains(low, F.lower(namespace)), 0.7).otherwise(0.0),
            over(fuzzy_contains(hint, type_name), 0.8, 0.6),
            over(fuzzy_contains(hint, name), 0.8, 0.5),
            over(segment_match(hint, full_type), 0.7, 0.65),
        )
        return F.when(F.contains(hint, signature), 1.0).when(F.contains(low, F.lower(F.concat_ws(".", type_name, name))), 0.95).otherwise(looser)

    return F.coalesce(F.array_max(F.transform(hints, one)), F.lit(0.0))


def bare_name(fqn: Column) -> Column:
    """Up to the first parenthesis."""
    return F.split(fqn, r"\(", 2)[0]


def plain_generics(fqn: Column) -> Column:
    """White space out, the contents of angle brackets replaced by one mark."""
    return F.regexp_replace(F.regexp_replace(fqn, r"\s+", ""), r"<[^<>]*>", "<T>")


def no_generics(fqn: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(fqn, r"<[^<>]*>", ""), r"<[^<>]*>", ""), r"`[0-9]+", "")


def fqn_score(asked: Column, known: Column, is_constructor: Column | None = None) -> Column:
    """How well a name as typed meets a canonical one, from 1 (equal) over cases, parameters and generic arguments to 0."""
    low = F.lower
    a, k = bare_name(asked), bare_name(known)
    had_a, had_k = F.length(asked) != F.length(a), F.length(known) != F.length(k)
    strip_a, strip_k = no_generics(a), no_generics(k)
    angle_a, angle_k = F.contains(a, F.lit("<")) & (a != strip_a), F.contains(k, F.lit("<")) & (k != strip_k)
    owner = F.regexp_replace(k, r"\.[^.]*$", "")
    made = is_constructor if is_constructor is not None else F.lit(False)
    return (
        F.when(asked == known, 1.0)
        .when(low(asked) == low(known), 0.99)
        .when(made & (low(a) == low(F.concat_ws(".", owner, F.substring_index(owner, ".", -1)))), 0.97)
        .when(made & (low(a) == low(owner)), 0.98)
        .when(low(a) == low(k), F.when(had_a & had_k, 0.7).otherwise(0.9))
        .when(low(plain_generics(a)) == low(plain_generics(k)), 0.95)
        .when(low(strip_a) == low(strip_k), F.when(angle_a & angle_k, 0.80).otherwise(0.85))
        .when(low(F.translate(strip_a, "+", ".")) == low(F.translate(strip_k, "+", ".")), 0.75)
        .otherwise(0.0)
    )
