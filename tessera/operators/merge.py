"""Matching and three-way merging of versioned units."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.ratings import change_intent, match_confidence
from tessera.functions.similarity import name_similarity
from tessera.functions.vectors import cosine
from tessera.operators.vector import knn_join

#: Tasks over which classes of contents are dealt (see renames).
PARTS = 64
# Keys in the order they are tried, with the confidence of a match by them.
CASCADE = (("content_hash", 1.0), ("structural_hash", 0.95), ("signature", 0.85), ("id", 0.7))
# Type names that many namespaces have.
COMMON_TYPES = (
    "Thread", "Task", "Timer", "Mutex", "Semaphore",
    "File", "Directory", "Path", "Stream",
    "List", "Dictionary", "Queue", "Stack", "Set",
    "Object", "String", "Type", "Exception", "Attribute", "Action", "Func", "Delegate", "Event",
    "HttpClient", "WebClient", "Socket", "Request", "Response",
    "Context", "Builder", "Factory", "Manager", "Service", "Repository", "Controller", "Model", "View",
)


def fast_match(base: DataFrame, target: DataFrame) -> DataFrame:
    """base_id, target_id, match_type, confidence: for each base unit the first target unit (smallest id) alike in the first key of CASCADE that has one; nulls in both where none has.

    Each key's target side is one row a key value, so the left joins don't multiply rows.
    """
    out = base
    for key, _ in CASCADE:
        side = target.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"__k_{key}")).agg(F.min("id").alias(f"__t_{key}"))
        out = out.join(side, F.col(key) == F.col(f"__k_{key}"), "left")
    hit = lambda values: F.coalesce(*[F.when(F.col(f"__t_{k}").isNotNull(), v) for k, v in values])
    return out.select(
        F.col("id").alias("base_id"), F.coalesce(*[F.col(f"__t_{k}") for k, _ in CASCADE]).alias("target_id"),
        hit([(k, F.lit(k)) for k, _ in CASCADE]).alias("match_type"), hit([(k, F.lit(c)) for k, c in CASCADE]).alias("confidence")
    )


def unmatched(base: DataFrame, matches: DataFrame) -> DataFrame:
    return base.join(matches.filter(F.col("target_id").isNotNull()).select(F.col("base_id").alias("id")), "id", "left_anti")


def match_stats(matches: DataFrame) -> DataFrame:
    """total, matched, unmatched, rate, and a number for each kind of match."""
    got = F.col("target_id").isNotNull()
    kinds = [F.count_if(F.coalesce(F.col("match_type") == k, F.lit(False))).alias(f"by_{k}") for k, _ in CASCADE]
    return matches.agg(F.count("*").alias("total"), F.count_if(got).alias("matched"), F.count_if(~got).alias("unmatched"), F.coalesce(F.avg(got.cast("double")), F.lit(0.0)).alias("rate"), *kinds)


def semantic_match(base: DataFrame, target: DataFrame, floor: float = 0.60, k: int = 10) -> DataFrame:
    """base_id, target_id, score, confidence: of a unit's k nearest target units the best after its type, name and length are weighed."""
    near = knn_join(base, target, k, floor)
    own = lambda d, p: d.select(F.col("id").alias(f"{p}_id"), F.col("type").alias(f"{p}_type"), F.col("name").alias(f"{p}_name"), F.length("content").alias(f"{p}_len"))
    x = near.join(own(base, "left"), "left_id").join(own(target, "right"), "right_id")
    ratio = F.least("left_len", "right_len") / F.greatest("left_len", "right_len", F.lit(1))
    raw = F.col("similarity") + F.when(F.col("left_type") == F.col("right_type"), 0.05).otherwise(0.0) + 0.1 * name_similarity(F.col("left_name"), F.col("right_name")) - F.when(ratio < 0.5, 0.1).otherwise(0.0)
    scored = x.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)))
    best = F.row_number().over(Window.partitionBy("left_id").orderBy(F.desc("score"), "right_id"))
    return scored.withColumn("n", best).filter((F.col("n") == 1) & (F.col("score") >= floor)).select(
        F.col("left_id").alias("base_id"), F.col("right_id").alias("target_id"), "score", match_confidence(F.col("score")).alias("confidence")
    )


def movements(pairs: DataFrame) -> DataFrame:
    """pairs (base_*, target_*: file, parent, fqn, type) with movement: FileChange, NamespaceChange, ClassChange, ParentChange, Rename or None."""
    moved = F.when(F.col("base_type") == "Type", "NamespaceChange").when(F.col("base_type").isin("Method", "Property", "Field"), "ClassChange").otherwise("ParentChange")
    ladder = F.when(
        ~F.col("base_file").eqNullSafe(F.col("target_file")), "FileChange"
    ).when(~F.col("base_parent").eqNullSafe(F.col("target_parent")), moved).when(~F.col("base_fqn").eqNullSafe(F.col("target_fqn")), "Rename")
    return pairs.withColumn("movement", ladder.otherwise("None"))


def renames(base: DataFrame, target: DataFrame, floor: float = 0.70) -> DataFrame:
    """base_id, target_id, score, confidence: units (id, type, signature_shape, name, file, start_line, content) renamed but otherwise alike. Type and shape are the join key.

    Structural similarity is that of the contents with the unit's own name taken out; place and name add to it, a much different length takes from it.

    Contents that are alike without the name are a class, and classes are compared first. Place and name add 0.1 at most, so a class that is further below the unit's best one cannot hold its best unit and is left out;
    only units of the others meet. Classes of one type and shape are dealt over PARTS tasks.
    """
    key = ["type", "signature_shape"]
    plain = F.replace("content", F.col("name"), F.lit("_"))
    side = lambda d, p: d.select(*key, plain.alias(f"{p}_plain"), *[F.col(c).alias(f"{p}_{c}") for c in ("id", "name", "file", "start_line")], F.length("content").alias(f"{p}_length"))
    a, b = side(base, "a"), side(target, "b")
    classes = lambda d, p: d.groupBy(*key, f"{p}_plain", f"{p}_length").agg(F.min(f"{p}_name").alias(f"{p}_low"), F.max(f"{p}_name").alias(f"{p}_high"))
    part = F.pmod(F.xxhash64("a_plain", "a_length"), F.lit(PARTS)).cast("int")
    dealt = classes(a, "a").withColumn("__part", part).repartition(PARTS, *key, "__part")
    every = classes(b, "b").withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).repartition(PARTS, *key, "__part")
    longest = F.greatest(F.length("a_plain"), F.length("b_plain"), F.lit(1))
    ratio = F.least("a_length", "b_length") / F.greatest("a_length", "b_length", F.lit(1))
    met = dealt.join(every, [*key, "__part"]).withColumn("structure", 1 - F.levenshtein("a_plain", "b_plain") / longest).filter(F.col("structure") >= floor)
    met = met.withColumn("less", F.when(ratio < 0.7, 0.1).otherwise(0.0)).withColumn("least", F.col("structure") - F.col("less"))
    # A class counts as a unit's best only if it surely holds one of another name
    sure = (F.col("b_low") != F.col("b_high")) | (F.col("b_low") < F.col("a_low")) | (F.col("b_high") > F.col("a_high"))
    best = F.max(F.when(sure, F.least("least", F.lit(1.0)))).over(Window.partitionBy(*key, "__part", "a_plain", "a_length"))
    near = met.withColumn("best", best).filter(F.col("best").isNull() | (F.col("best") <= 0) | (F.col("least") + 0.1 >= F.col("best") - 1e-9)).select(*key, "a_plain", "a_length", "b_plain", "b_length", "structure", "less")
    x = near.join(a, [*key, "a_plain", "a_length"]).join(b, [*key, "b_plain", "b_length"]).filter(F.col("a_name") != F.col("b_name"))
    apart = F.abs(F.col("a_start_line") - F.col("b_start_line"))
    file_name = lambda p: F.lower(F.substring_index(F.translate(F.col(f"{p}_file"), "\\", "/"), "/", -1))
    place = F.when(file_name("a") != file_name("b"), 0.0).when(apart <= 5, 1.0).when(apart <= 20, 0.7).when(apart <= 50, 0.3).otherwise(0.0)
    raw = F.col("structure") + 0.05 * place + 0.05 * name_similarity(F.col("a_name"), F.col("b_name")) - F.col("less")
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))
    # An aggregate keeps one row a unit and task, where a window would move all
    one = x.groupBy("a_id").agg(F.min(F.struct((-score).alias("minus"), "b_id")).alias("best")).select("a_id", "best.b_id", (-F.col("best.minus")).alias("score"))
    level = F.when(F.col("score") >= 0.95, "High").when(F.col("score") >= 0.85, "Medium").otherwise("Low")
    return one.select(F.col("a_id").alias("base_id"), F.col("b_id").alias("target_id"), "score", level.alias("confidence"))


def three_way(base: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """id, action, source, confidence, delete_modify of units (id, content_hash) of a base and two branches; rows that neither changed are left out.

    Update: one branch changed it (source A or B) or both alike (source both); Conflict: both, differently, for the resolver; Create: new in a branch (new in both, differently: Conflict);
    Delete: missing in both, or in one of them, for which delete_modify says whether the other changed it.
    """
    side = lambda d, p: d.select(F.col("id").alias(f"{p}_id"), F.col("content_hash").alias(f"{p}_hash"))
    ab = side(a, "a").join(side(b, "b"), F.col("a_id") == F.col("b_id"), "full_outer").withColumn("ab_id", F.coalesce("a_id", "b_id"))
    x = side(base, "o").join(ab, F.col("o_id") == F.col("ab_id"), "full_outer")
    o, ha, hb = F.col("o_hash"), F.col("a_hash"), F.col("b_hash")
    in_o, in_a, in_b = (F.col(f"{p}_id").isNotNull() for p in "oab")
    row = lambda action, source, conf, mixed=None: F.struct(
        F.lit(action).alias("action"), F.lit(source).alias("source"), F.lit(conf).alias("confidence"), (F.lit(False) if mixed is None else mixed).alias("delete_modify")
    )
    act = (
        F.when(in_o & ~in_a & ~in_b, row("Delete", "both", 1.0))
        .when(in_o & ~in_a, row("Delete", "A", 0.8, hb != o))
        .when(in_o & ~in_b, row("Delete", "B", 0.8, ha != o))
        .when(~in_o & in_a & in_b, F.when(ha == hb, row("Create", "both", 0.95)).otherwise(row("Conflict", "both", 0.0)))
        .when(~in_o & in_a, row("Create", "A", 0.95))
        .when(~in_o, row("Create", "B", 0.95))
        .when((ha == o) & (hb == o), None)
        .when(hb == o, row("Update", "A", 1.0))
        .when(ha == o, row("Update", "B", 1.0))
        .when(ha == hb, row("Update", "both", 1.0))
        .otherwise(row("Conflict", "both", 0.0))
    )
    return x.select(F.coalesce("o_id", "ab_id").alias("id"), act.alias("x")).filter(F.col("x").isNotNull()).select("id", "x.*")


def change_intents(pairs: DataFrame) -> DataFrame:
    """pairs (base_structural, target_structural, base_signature, target_signature) with intent and confidence."""
    named = change_intent(F.col("base_structural").eqNullSafe(F.col("target_structural")), F.col("base_signature").eqNullSafe(F.col("target_signature")))
    return pairs.withColumn("__i", named).select(*pairs.columns, "__i.intent", "__i.confidence")


def edits(base: list[str], new: list[str]) -> list[tuple[int, int, list[str]]]:
    """(start, end, lines): what turns base into new, in order; end exclusive, start = end where lines are added. By a longest common subsequence of lines as difflib finds it."""
    steps = difflib.SequenceMatcher(None, base, new, autojunk=False).get_opcodes()
    return [(i, j, new[k:n]) for tag, i, j, k, n in steps if tag != "equal"]


def changed_ranges(base: list[str], new: list[str]) -> list[tuple[int, int]]:
    """Ranges of base lines that new does without or has others for; an empty range where it adds lines."""
    return [(start, end) for start, end, _ in edits(base, new)]


def _clash(one: tuple[int, int, list[str]], other: tuple[int, int, list[str]], n: int) -> bool:
    """Whether two edits of different sides, one not after other, can't both be made to a base of n lines. Additions by both at the top or at the bottom can."""
    if other[0] < one[1]:
        return True
    outside = one[0] == one[1] == other[1] and one[0] in (0, n)
    return one[0] == other[0] and not outside


def merged_text(base: str, a: str, b: str) -> str | None:
    """The text with both sides' edits of base (a's first where both add at one end); None if two of them touch the same lines and differ."""
    old = base.split("\n")
    sides = [edits(old, text.split("\n")) for text in (a, b)]
    both = sorted((start, end, side, lines) for side, found in enumerate(sides) for start, end, lines in found)
    out, at, before = [], 0, None
    for start, end, side, lines in both:
        if before and before[2] != side:
            if before[:2] == (start, end) and before[3] == lines:
                continue
            if _clash((*before[:2], before[3]), (start, end, lines), len(old)):
                return None
        out += [*old[at:start], *lines]
        at, before = end, (start, end, side, lines)
    return "\n".join([*out, *old[at:]])


def resolved_conflicts(conflicts: DataFrame) -> DataFrame:
    """id, merged (null: to be resolved by hand), resolution of rows (id, base, a, b): only what the joins could not decide comes here."""

    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts = [merged_text(o or "", x or "", y or "") for o, x, y in zip(rows["base"], rows["a"], rows["b"], strict=True)]
            yield pd.DataFrame({"id": rows["id"], "merged": texts, "resolution": ["conflict" if t is None else "merged" for t in texts]})

    return conflicts.select("id", "base", "a", "b").mapInPandas(resolve, f"id {dict(conflicts.dtypes)['id']}, merged string, resolution string")


def closer_side(rows: DataFrame, alike: float = 0.95, apart: float = 0.3) -> DataFrame:
    """rows (base, a, b vectors) with decision: where a and b are alike the one further from base; where their changes point apart, both; else conflict."""
    from tessera.functions.vectors import subtract

    base, a, b = F.col("base_vector"), F.col("a_vector"), F.col("b_vector")
    pick = F.when(cosine(a, base) <= cosine(b, base), "A").otherwise("B")
    turn = 1 - F.abs(cosine(subtract(a, base), subtract(b, base)))
    return rows.withColumn("decision", F.when(cosine(a, b) >= alike, pick).when(turn >= apart, "both").otherwise("conflict"))


def ambiguous_types(references: DataFrame) -> DataFrame:
    """Unqualified references (name, is_qualified) to type names that many namespaces have."""
    return references.filter(F.col("name").isin(*COMMON_TYPES) & ~F.col("is_qualified"))


def position_changes(old: DataFrame, new: DataFrame, parent: str = "parent", children: str = "children") -> DataFrame:
    """parent, child, old_at, new_at of children (arrays) that stand elsewhere."""
    each = lambda d, n: d.select(parent, F.posexplode(children).alias(n, "child"))
    return each(old, "old_at").join(each(new, "new_at"), [parent, "child"]).filter(F.col("old_at") != F.col("new_at"))


def reordered_only(old: DataFrame, new: DataFrame, parent: str = "parent", children: str = "children") -> DataFrame:
    """parent, same, reordered: children alike in the same order, or alike once sorted."""
    x = old.select(parent, F.col(children).alias("x")).join(new.select(parent, F.col(children).alias("y")), parent)
    return x.select(parent, (F.col("x") == F.col("y")).alias("same"), ((F.col("x") != F.col("y")) & (F.array_sort("x") == F.array_sort("y"))).alias("reordered"))


def instructed(actions: DataFrame, include: list[str], exclude: list[str], prefer: dict[str, str]) -> DataFrame:
    """Merge actions (path, source) that free-text instructions leave: paths by pattern, the source of a path that holds a keyword."""
    from tessera.functions.text import glob_matches

    out = actions
    if include:
        met = F.lit(False)
        for g in include:
            met = met | glob_matches(F.col("path"), g)
        out = out.filter(met)
    for g in exclude:
        out = out.filter(~glob_matches(F.col("path"), g))
    for word, source in prefer.items():
        out = out.withColumn("source", F.when(F.contains(F.lower("path"), F.lit(word.lower())), source).otherwise(F.col("source")))
    return out


def instructions(text: str) -> dict[str, list[str]]:
    """include, exclude, prefer_source and prefer_target words from free text, one sentence a line."""
    import re

    out: dict[str, list[str]] = {"include": [], "exclude": [], "prefer_source": [], "prefer_target": []}
    for line in text.splitlines():
        low = line.strip().lower()
        words = re.findall(r"[\w*./\\-]+", line)
        patterns = [w for w in words if "*" in w or "/" in w or re.search(r"\.\w+$", w)]
        if re.match(r"(exclude|skip|ignore|without)\b", low):
            out["exclude"] += patterns
        elif re.match(r"(include|only|merge)\b", low):
            out["include"] += patterns
        for side in ("source", "target"):
            if m := re.search(rf"(?:prefer|keep|use)\s+{side}\s+(?:for|in)\s+(.+)", low):
                out[f"prefer_{side}"] += re.findall(r"[\w.-]+", m[1])
    return {k: list(dict.fromkeys(v)) for k, v in out.items()}


def replacement_conflicts(changes: DataFrame) -> DataFrame:
    """file, container, n of containers that more than one replacement touches."""
    return changes.groupBy("file", "container").agg(F.count("*").alias("n")).filter("n > 1")


def preview_impact(references: DataFrame) -> DataFrame:
    """symbol, locations, affected_files, breaking (the symbol is public)."""
    return references.groupBy("symbol").agg(F.count("*").alias("locations"), F.count_distinct("file").alias("affected_files"), F.bool_or("is_public").alias("breaking"))


# Extensions of files that are copied whole, and of those that are merged by unit.
BINARY = ("png", "jpg", "jpeg", "gif", "ico", "dll", "exe", "pdf", "zip", "bin")
SEMANTIC = ("cs", "json", "xml", "yaml", "yml", "ps1", "sh", "cmd", "bat")


def file_plan(source: DataFrame, target: DataFrame, pattern: str | None = None) -> DataFrame:
    """path, way, in_base, in_source, in_target of the files that the source branch changed (path, status: A, M, D; renamed_from): copied, merged by unit or merged as text."""
    from tessera.functions.text import glob_matches

    chosen = source if pattern is None else source.filter(glob_matches(F.col("path"), pattern))
    ext = F.lower(F.substring_index("path", ".", -1))
    other = target.select(F.col("path").alias("__path"), F.col("status").alias("__status"))
    both = chosen.join(other, F.coalesce("renamed_from", "path") == F.col("__path"), "left")
    way = F.when(ext.isin(*BINARY), "binary").when(ext.isin(*SEMANTIC), "semantic").otherwise("text")
    in_base = (F.col("status") != "A") & ~F.coalesce(F.col("__status") == "A", F.lit(False))
    in_target = F.when(F.col("__status").isNull(), F.col("status") != "A").otherwise(F.col("__status") != "D")
    return both.select("path", way.alias("way"), in_base.alias("in_base"), (F.col("status") != "D").alias("in_source"), in_target.alias("in_target"))
