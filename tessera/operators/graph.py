"""Traversals of edge tables (caller, callee) and hierarchies (child, parent)."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.ratings import path_confidence
from tessera.sources.staging import checkpointed

MOST_DEPTH, MOST_PATHS = 15, 5
# Order of member kinds.
KIND_ORDER = {"type": 1, "field": 2, "property": 3, "event": 4, "method": 5}


def callers(edges: DataFrame, method: str) -> DataFrame:
    return edges.filter(F.col("callee") == method).select("caller").distinct().orderBy("caller")


def callees(edges: DataFrame, method: str) -> DataFrame:
    return edges.filter(F.col("caller") == method).select("callee").distinct().orderBy("callee")


def _view(df: DataFrame, name: str) -> SparkSession:
    df.createOrReplaceTempView(name)
    return df.sparkSession


def backtrace(edges: DataFrame, method: str, start: str | None = None, most_depth: int = MOST_DEPTH, most_paths: int = MOST_PATHS, cycles: bool = False) -> DataFrame:
    """path (entry first), depth (edges), reached (an entry: start, or a method without callers), confidence; best first, then by the path.

    Ways up are followed to most_depth; unless cycles, a method is on a way once. Confidence falls with depth, so once most_paths ways have reached an entry, longer ones can't be among the best.
    """
    spark = edges.sparkSession
    up = checkpointed(edges.select("caller", F.col("callee").alias("head")).distinct())
    paths = spark.createDataFrame([([method], 0)], "path array<string>, depth int")
    done, found = None, 0
    for depth in range(most_depth + 1):
        head = F.col("path")[0]
        stop = F.lower(head) == start.lower() if start else F.lit(False)
        next_ = paths.withColumn("head", head).withColumn("stop", stop).join(up, "head", "left")
        if not cycles:
            next_ = next_.withColumn("caller", F.when(~F.array_contains("path", F.col("caller")), F.col("caller")))
        next_ = checkpointed(next_)
        ended = next_.groupBy("path", "depth").agg(F.bool_or("stop").alias("at_start"), F.count("caller").alias("n"))
        full = F.lit(depth >= most_depth)
        finished = ended.filter(F.col("at_start") | (F.col("n") == 0) | full).select("path", "depth", (F.col("at_start") | ~full).alias("reached"))
        done = finished if done is None else done.unionByName(finished)
        paths = next_.filter(~F.col("stop") & F.col("caller").isNotNull()).select(F.concat(F.array("caller"), "path").alias("path"), (F.col("depth") + 1).alias("depth")).distinct()
        if depth < most_depth:
            # One job tells how many have arrived and whether any goes on
            seen = ended.agg(F.count_if(F.col("at_start") | (F.col("n") == 0)).alias("reached"), F.bool_or(~F.col("at_start") & (F.col("n") > 0)).alias("more")).first()
            found += seen.reached
            if found >= most_paths or not seen.more:
                break
    return done.withColumn("confidence", path_confidence(F.col("depth"), F.col("reached"))).orderBy(F.desc("confidence"), F.array_join("path", ">")).limit(most_paths)


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """node, depth of all nodes that a way leads to from start (node), with the shortest depth; cycles end. A round handles the newest nodes only."""
    seen = checkpointed(start.select("node").distinct().withColumn("depth", F.lit(0)))
    newest = seen
    for depth in itertools.count(1):
        step = newest.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        newest = checkpointed(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if newest.limit(1).count() == 0:
            break
        seen = checkpointed(seen.unionByName(newest))
    return seen


def dependents(dependencies: DataFrame, changed: DataFrame) -> DataFrame:
    """node, depth of what depends on the changed nodes, directly or not (file, depends_on)."""
    return reachable(dependencies.select(F.col("depends_on").alias("src"), F.col("file").alias("dst")), changed)


def levels(nodes: DataFrame, dependencies: DataFrame) -> DataFrame:
    """node, level: 0 without dependencies, else one more than the highest of them. Where only cycles are left, the smallest node of them goes first."""
    left = checkpointed(nodes.select("node").distinct())
    deps = checkpointed(dependencies.select("node", "needs").distinct())
    out = None
    for level in itertools.count():
        waiting = deps.join(left.select("node"), "node", "left_semi").join(left.select(F.col("node").alias("needs")), "needs", "left_semi").select("node").distinct()
        ready = left.join(waiting, "node", "left_anti")
        if ready.limit(1).count() == 0:
            ready = left.orderBy("node").limit(1)
        placed = checkpointed(ready.withColumn("level", F.lit(level)))
        out = placed if out is None else out.unionByName(placed)
        if level % 50 == 49:
            out = checkpointed(out)
        left = checkpointed(left.join(placed, "node", "left_anti"))
        if left.limit(1).count() == 0:
            break
    return out


def descendants(hierarchy: DataFrame, root: str) -> DataFrame:
    """node, depth below root, by a recursive query over (child, parent); a tree."""
    spark = _view(hierarchy, "__hierarchy")
    return spark.sql(
        """WITH RECURSIVE down(node, depth) AS (
            SELECT CAST(:root AS STRING), 0 UNION ALL SELECT h.child, d.depth + 1 FROM down d JOIN __hierarchy h ON h.parent = d.node
        ) SELECT node, depth FROM down""",
        args={"root": root},
    )


def ancestors(hierarchy: DataFrame, node: str) -> DataFrame:
    """node, depth above, node itself first."""
    spark = _view(hierarchy, "__hierarchy")
    return spark.sql(
        """WITH RECURSIVE up(node, depth) AS (
            SELECT CAST(:node AS STRING), 0 UNION ALL SELECT h.parent, u.depth + 1 FROM up u JOIN __hierarchy h ON h.child = u.node WHERE h.parent IS NOT NULL
        ) SELECT node, depth FROM up""",
        args={"node": node},
    )


def member_tree(members: DataFrame) -> DataFrame:
    """parent, kind, members: the members of each parent (parent, kind, signature, line) by kind, by signature, then line."""
    order = F.lit(99)
    for kind, at in KIND_ORDER.items():
        order = F.when(F.col("kind") == kind, at).otherwise(order)
    grouped = members.groupBy("parent", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("signature", "line"))), lambda m: m["signature"]).alias("members"))
    return grouped.withColumn("kind_order", order).orderBy("parent", "kind_order", "kind")


def references_with_context(references: DataFrame, lines: DataFrame, limit: int = 20, around: int = 2) -> DataFrame:
    """file, line, context, total: the first references (file, line) by place with the trimmed lines around them; total counts all."""
    total = references.agg(F.count("*").alias("total"))
    first = references.orderBy("file", "line").limit(limit)
    near = first.join(lines.select("file", F.col("line").alias("at"), "text"), "file").filter(F.abs(F.col("at") - F.col("line")) <= around)
    shown = near.groupBy("file", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: F.trim(x["text"])), "\n").alias("context"))
    return shown.join(F.broadcast(total)).orderBy("file", "line")


def forward_paths(edges: DataFrame, entry: str, most_paths: int = 100, most_depth: int = 50) -> DataFrame:
    """path, conditions, ended (exit, revisit or depth) of the ways from entry through a flow graph (src, dst and, if there is one, condition), the first by path.

    A way ends where it has no next block, comes to one that it holds, or has most_depth edges. conditions: those of its edges that have one, in order.
    """
    spark = edges.sparkSession
    condition = F.col("condition") if "condition" in edges.columns else F.lit(None)
    steps = checkpointed(edges.select("src", "dst", condition.cast("string").alias("condition")).distinct())
    paths = spark.createDataFrame([([entry], [])], "path array<string>, conditions array<string>")
    out = None
    for depth in range(most_depth + 1):
        last = F.element_at("path", -1)
        next_ = checkpointed(paths.withColumn("src", last).join(steps, "src", "left"))
        revisit = F.coalesce(F.array_contains("path", F.col("dst")), F.lit(False))
        full = F.lit(depth >= most_depth)
        held = F.when(F.col("condition").isNull(), F.col("conditions")).otherwise(F.concat("conditions", F.array("condition")))
        gone = F.col("dst").isNull() | full
        way = F.when(gone, F.col("path")).otherwise(F.concat("path", F.array("dst")))
        kind = F.when(F.col("dst").isNull(), "exit").when(full, "depth").otherwise("revisit")
        ended = next_.filter(gone | revisit).select(way.alias("path"), F.when(gone, F.col("conditions")).otherwise(held).alias("conditions"), kind.alias("ended")).distinct()
        out = ended if out is None else out.unionByName(ended)
        paths = next_.filter(F.col("dst").isNotNull() & ~revisit).select(F.concat("path", F.array("dst")).alias("path"), held.alias("conditions"))
        if depth == most_depth or paths.limit(1).count() == 0:
            break
    return out.orderBy(F.array_join("path", ">"), F.array_join("conditions", ">")).limit(most_paths)


def feasible(paths: DataFrame, id_col: str = "id", conditions: str = "conditions") -> DataFrame:
    """id, feasible, unknown of paths with conditions (array): whether comparisons of names with numbers (x > 5, x <= 7, x == 1, x != 2) can all hold at once;
unknown counts those of other forms, which bind nothing.

    Each name's comparisons leave an interval without some points; a path can be taken if no name's is empty. All comparisons of a path and a name meet in one aggregate.
    """
    rx = r"^\s*([A-Za-z_][\w.]*)\s*(<=|>=|==|!=|<|>)\s*(-?[0-9]+(?:\.[0-9]+)?)\s*$"
    part = lambda i: F.regexp_extract("c", rx, i)
    each = paths.select(F.col(id_col).alias("id"), F.explode_outer(conditions).alias("c"))
    read = each.select("id", "c", part(1).alias("name"), part(2).alias("op"), F.when(part(3) != "", part(3).cast("double")).alias("x"))
    of = lambda f, *ops: f(F.when(F.col("op").isin(*ops), F.col("x")))
    bounds = read.groupBy("id", "name").agg(
        of(F.max, ">", ">=", "==").alias("low"), of(F.max, ">").alias("above"), of(F.min, "<", "<=", "==").alias("high"), of(F.min, "<").alias("below"),
        F.collect_set(F.when(F.col("op") == "!=", F.col("x"))).alias("other"), F.count_if(F.col("c").isNotNull() & (F.col("name") == "")).alias("unknown"),
    )
    point = F.coalesce(F.col("above") < F.col("low"), F.lit(True)) & F.coalesce(F.col("below") > F.col("high"), F.lit(True)) & ~F.array_contains("other", F.col("low"))
    holds = F.col("low").isNull() | F.col("high").isNull() | (F.col("low") < F.col("high")) | ((F.col("low") == F.col("high")) & point)
    return bounds.groupBy("id").agg(F.bool_and(holds).alias("feasible"), F.sum("unknown").alias("unknown"))


def overrides(members: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """type, signature, base: members (type, signature) of a type that has one of the same signature in a type right above it (hierarchy: child, parent); for interfaces, what implements them."""
    below = members.join(hierarchy, F.col("type") == F.col("child")).select("type", "signature", F.col("parent").alias("base"))
    above = members.select(F.col("type").alias("base"), "signature").distinct()
    return below.join(above, ["base", "signature"]).select("type", "signature", "base").distinct()


def exported(paths: DataFrame, form: str) -> DataFrame:
    """text: a graph of the paths (path, confidence) as dot, mermaid or graphml. An edge bears the best confidence of its paths."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.element_at("path", i).alias("a"), F.element_at("path", i + 1).alias("b")))
    edges = paths.filter(F.size("path") > 1).select(F.explode(pairs).alias("e"), "confidence").groupBy("e.a", "e.b").agg(F.max("confidence").alias("c"))
    shade = F.when(F.col("c") > 0.8, "green").when(F.col("c") > 0.5, "orange").otherwise("red")
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
    line = {
        "dot": F.concat(F.lit("  "), quoted(F.col("a")), F.lit(" -> "), quoted(F.col("b")), F.lit(" [color="), shade, F.lit("];")),
        "mermaid": F.concat(F.lit("  "), F.md5("a"), F.lit("["), quoted(F.col("a")), F.lit("] --> "), F.md5("b"), F.lit("["), quoted(F.col("b")), F.lit("]")),
        "graphml": F.concat(F.lit('    <edge source="'), F.col("a"), F.lit('" target="'), F.col("b"), F.lit('"/>')),
    }[form]
    head, tail = {"dot": ("digraph calls {", "}"), "mermaid": ("graph TD", ""), "graphml": ("<graphml>\n  <graph edgedefault=\"directed\">", "  </graph>\n</graphml>")}[form]
    return edges.agg(F.concat(F.lit(head + "\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n"), F.lit("\n" + tail)).alias("text"))
