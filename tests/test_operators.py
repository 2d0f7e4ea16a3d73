import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, layers, logs, lookup, merge, similarity, vector
from tessera.sources import tables, units
from tessera.streaming import streams


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_set_pairs_against_brute_force(spark):
    rng = random.Random(1)
    sets = [(i, [rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(0, 9))]) for i in range(60)]
    sets += [(60 + i, list(reversed(s))) for i, s in sets[:20]]
    classes = similarity.set_classes(frame(spark, sets, "id long, s array<string>"), "id", "s")
    first = {}
    for i, s in sets:
        first.setdefault(frozenset(s), i)
    assert {r.id: r.rep for r in classes.collect()} == {i: first[frozenset(s)] for i, s in sets if s}
    got = {(r.a, r.b): r.similarity for r in similarity.set_pairs(classes, 0.6).collect()}
    want = {}
    for (x, i), (y, j) in itertools.combinations([(x, i) for x, i in first.items() if x], 2):
        if len(x & y) / len(x | y) >= 0.6:
            want[min(i, j), max(i, j)] = len(x & y) / len(x | y)
    assert got == pytest.approx(want)


@pytest.mark.parametrize("kind", ["int", "string"])
def test_set_pairs_over_many_buckets(spark, monkeypatch, kind):
    """Long sets, variants of a few, in buckets of seven: pairs lie within a bucket and across; sets that merely share elements are not carried along."""
    monkeypatch.setattr(similarity, "BUCKET_SETS", 7)
    rng = random.Random(5)
    base = [rng.sample(range(4000), rng.randrange(5, 300)) for _ in range(12)]
    sets = [[x for x in rng.choice(base) if rng.random() > 0.08] + rng.sample(range(4000), rng.randrange(0, 9)) for _ in range(150)]
    named = {(str(i) if kind == "string" else i): frozenset(s) for i, s in enumerate(sets) if s}
    classes = similarity.set_classes(frame(spark, [(i, list(s)) for i, s in named.items()], f"id {kind}, s array<int>"), "id", "s")
    assert all((r.s is not None) == (r.id == r.rep) for r in classes.collect())
    out = similarity.set_pairs(classes, 0.8)
    want = {(a, b): len(x & y) / len(x | y) for (a, x), (b, y) in itertools.product(named.items(), named.items()) if a < b and x != y and len(x & y) / len(x | y) >= 0.8}
    assert len(want) > 100 and {(r.a, r.b): r.similarity for r in out.collect()} == pytest.approx(want)
    assert dict(out.dtypes)["a"] == kind


def test_set_groups_of_near_copies_without_all_their_pairs(spark, monkeypatch):
    """The groups that one pass in id order makes, in shuffled ids; a group of near copies has some thousands of pairs, of which few are made."""
    rng, compared = random.Random(3), []
    base = [f"w{x}" for x in rng.sample(range(900), 60)]
    sets = [[*base[:at], f"n{i}", *base[at + 1 :]] for i in range(80) for at in [rng.randrange(60)]]
    for _ in range(30):
        base = [x if rng.random() > 0.06 else f"w{rng.randrange(900)}" for x in base]
        sets.append(base)
    sets = dict(zip(rng.sample(range(500), len(sets)), map(frozenset, sets), strict=True))
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(sorted(sets), 2)}
    want, taken = {}, set()
    for a in sorted(sets):
        if a not in taken:
            mine = {b: (a, alike[a, b]) for b in sets if b > a and b not in taken and alike[a, b] >= 0.8}
            taken |= set(mine)
            want |= mine | ({a: (a, 1.0)} if mine else {})
    counted = similarity._compared
    monkeypatch.setattr(similarity, "_compared", lambda *args: compared.append(similarity.checkpointed(counted(*args))) or compared[-1])
    classes = similarity.checkpointed(similarity.set_classes(frame(spark, [(i, list(s)) for i, s in sets.items()], "id long, s array<string>"), "id", "s"))
    got = {r.member: (r.leader, r.similarity) for r in similarity.with_copies(similarity.set_groups(classes, 0.8), classes).collect()}
    assert {m: a for m, (a, _) in got.items()} == {m: a for m, (a, _) in want.items()} and {m: s for m, (_, s) in got.items()} == pytest.approx({m: s for m, (_, s) in want.items()})
    assert sum(x >= 0.8 for x in alike.values()) > 3000 and sum(x.count() for x in compared) < 1500


def test_copies_go_with_their_representative(spark):
    groups = frame(spark, [(1, 1, 1.0), (3, 1, 0.9)], "member long, leader long, similarity double")
    classes = frame(spark, [(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 6), (7, 6)], "id long, rep long")
    out = {r.member: (r.leader, r.similarity) for r in similarity.with_copies(groups, classes).collect()}
    assert out == {1: (1, 1.0), 2: (1, 1.0), 3: (1, 0.9), 4: (1, 0.9), 6: (6, 1.0), 7: (6, 1.0)}


@pytest.mark.parametrize("floor", [0.31, 0.72])
def test_sparse_pairs_against_brute_force(spark, floor):
    rng = random.Random(8)
    rows = {(i, rng.randrange(12) ** 2 % 40): rng.randrange(1, 4) for i in range(50) for _ in range(6)}
    got = {(r.a, r.b): r.similarity for r in similarity.sparse_pairs(frame(spark, [(*k, n) for k, n in rows.items()], "id long, key long, n int"), floor).collect()}
    maps = {i: {k: n for (j, k), n in rows.items() if i == j} for i in range(50)}
    size = {i: sum(n * n for n in m.values()) ** 0.5 for i, m in maps.items()}
    want = {}
    for a, b in itertools.combinations(maps, 2):
        x = sum(n * maps[b].get(k, 0) for k, n in maps[a].items()) / (size[a] * size[b])
        if x >= floor:
            want[a, b] = x
    assert want and got == pytest.approx(want)


def test_lsh_top_k_over_many_blocks(spark, monkeypatch):
    """All rows near, then those within the bits; blocks of seven rows, rows of another length and no vector."""
    import numpy as np

    monkeypatch.setattr(vector, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (60, 5)).astype(float)
    x[7] = 0
    rows = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)] + [(90, [1.0, 2.0]), (91, None)], "vec_id long, embedding array<double>")
    unit = x / np.where(np.linalg.norm(x, axis=1, keepdims=True) > 0, np.linalg.norm(x, axis=1, keepdims=True), 1)
    planes = np.random.Generator(np.random.PCG64(1)).normal(size=(2, 6, 5))
    signs = np.einsum("tbd,nd->ntb", planes, x) > 0
    for probes in (6, 1):
        got = {}
        for r in vector.lsh_top_k(rows.filter("vec_id % 20 = 0"), rows, 4, tables=2, probes=probes).collect():
            got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, round(r.similarity, 9))
        for q in (0, 20, 40):
            near = ((signs[q] != signs).sum(axis=2) <= probes).any(axis=1)
            want = sorted((-round(float(unit[q] @ unit[i]), 9), i) for i in range(60) if near[i] and round(float(unit[q] @ unit[i]), 9) >= 0)[:4]
            assert [s for _, (_, s) in sorted(got[q].items())] == [-s for s, _ in want]


def test_sparse_pairs_compares_whole_vectors_of_few(spark):
    """Vectors that share a key or two of forty are left out before their entries are joined; those alike are found, also over what lies behind the prefixes."""
    rng = random.Random(2)
    rows = {(i, k): 1 for i in range(120) for k in rng.sample(range(400), 40)} | {(500 + i, k): 1 + k % 2 for i in range(3) for k in range(i, 30)}
    out = similarity.sparse_pairs(frame(spark, [(*k, n) for k, n in rows.items()], "id long, key long, n int"), 0.3)
    maps = {}
    for (i, k), n in rows.items():
        maps.setdefault(i, {})[k] = n
    size = {i: sum(n * n for n in m.values()) ** 0.5 for i, m in maps.items()}
    each = {(a, b): sum(n * maps[b].get(k, 0) for k, n in maps[a].items()) / (size[a] * size[b]) for a, b in itertools.combinations(sorted(maps), 2)}
    assert {(r.a, r.b): r.similarity for r in out.collect()} == pytest.approx({p: x for p, x in each.items() if x >= 0.3})
    assert "AS part#" in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("same", [None, "label"])
def test_knn_join_against_brute_force(spark, monkeypatch, same):
    import numpy as np

    monkeypatch.setattr(vector, "BLOCK_ROWS", 9)
    rng = np.random.default_rng(5)
    x = rng.integers(-2, 3, (40, 4)).astype(float)
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(90, [1.0, 2.0], 0), (91, None, 1), (92, [0.0] * 4, 2)]
    e = frame(spark, rows, "id long, embedding array<double>, label int")
    got = [(r.left_id, r.rank, r.right_id, round(r.similarity, 9)) for r in vector.knn_join(e.filter("id % 4 = 0"), e, 3, 0.1, same=same).collect()]
    unit = {i: np.array(v) / (np.linalg.norm(v) or 1) for i, v, _ in rows if v and len(v) == 4}
    of = {i: label for i, _, label in rows}
    want = []
    for a in (i for i in unit if i % 4 == 0):
        near = sorted((-round(float(unit[a] @ unit[b]), 9), b) for b in unit if a != b and (not same or of[a] == of[b]) and unit[a] @ unit[b] >= 0.1)
        want += [(a, n + 1, b, -s) for n, (s, b) in enumerate(near[:3])]
    assert {(a, n, s) for a, n, _, s in got} == {(a, n, s) for a, n, _, s in want}
    every = vector.knn_join(e, e, None, 0.49, same=same).count()
    assert every == sum(a != b and unit[a] @ unit[b] >= 0.49 and (not same or of[a] == of[b]) for a in unit for b in unit)


def test_running_sums(spark):
    from tessera.operators.order import numbered, running

    rng = random.Random(3)
    rows = [(rng.randrange(50), i, rng.randrange(9)) for i in range(300)]
    out = running(frame(spark, rows, "a long, b long, v long"), [F.desc("a"), F.col("b")], before=F.col("v")).collect()
    total = 0
    for r in sorted(out, key=lambda r: (-r.a, r.b)):
        assert r.before == total
        total += r.v
    assert sorted(r.nth for r in numbered(frame(spark, rows, "a long, b long, v long"), ["a", "b"]).collect()) == list(range(300))
    assert numbered(frame(spark, [], "a long"), ["a"]).count() == 0


def test_greedy_groups_as_one_pass(spark):
    rng = random.Random(2)
    pairs = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(60)})
    got = {r.member: r.leader for r in similarity.greedy_groups(frame(spark, [(a, b, 0.9) for a, b in pairs], "a long, b long, similarity double")).collect()}
    leader = {}
    for i in range(40):
        if i not in leader:
            for j in range(i + 1, 40):
                if (i, j) in pairs and j not in leader:
                    leader[j] = i
                    leader[i] = i
    assert got == leader


@pytest.mark.parametrize("few", [0, 5, 100_000])
def test_greedy_groups_leave_no_row_open(spark, few):
    n = 1000 if few == 100_000 else 10
    out = similarity.greedy_groups(frame(spark, [(i, i + 1, 0.9) for i in range(n - 1)], "a long, b long, similarity double"), few).collect()
    assert {r.member: r.leader for r in out} == {i: i - i % 2 for i in range(n)}


def test_greedy_assignment(spark):
    rows = [("p", 1, 10, 0.9), ("p", 1, 11, 0.8), ("p", 2, 10, 0.95), ("p", 2, 11, 0.5), ("p", 1, 12, 0.1), ("p", 2, 12, 0.1)]
    out = similarity.assigned(frame(spark, rows, "pair string, l long, r long, s double"), ["pair"], "l", "r", "s").first()
    assert (out.n, out.similarity) == (2, pytest.approx((0.9 + 0.5) / 2))


def test_layers(spark):
    base = frame(spark, [(1, "a"), (2, "b"), (3, "c")], "id long, v string")
    delta = frame(spark, [(1, "A", "M"), (2, "b", "D"), (9, "n", "A"), (8, "x", "M")], "id long, v string, op string")
    assert sorted(layers.applied(base, delta).collect()) == [(1, "A"), (3, "c"), (9, "n")]
    assert layers.resolved(base, delta, None, "MAIN").count() == 3
    up = frame(spark, [(9, "m", "M"), (2, "again", "A"), (1, "A", "D")], "id long, v string, op string")
    assert {(r.id, r.op, r.v) for r in layers.merged(delta, up).collect()} == {(1, "D", "A"), (2, "M", "again"), (9, "A", "m"), (8, "M", "x")}
    assert layers.applied(layers.applied(base, delta.filter("id <> 8")), up).count() == layers.applied(base, layers.merged(delta.filter("id <> 8"), up)).count()


def test_a_clients_own_rows_stand_beside_those_of_their_id(spark):
    base = frame(spark, [(1, "a"), (2, "b"), (3, "c")], "id long, v string")
    branch = frame(spark, [(3, "branch", "A")], "id long, v string, op string")
    own = frame(spark, [(1, "new", "A"), (2, "B", "M"), (8, "x", "M"), (3, "n", "A"), (9, "n", "A")], "id long, v string, op string")
    assert sorted(layers.resolved(base, branch, own, "feature").collect()) == [(1, "a"), (1, "new"), (2, "B"), (3, "branch"), (3, "n"), (9, "n")]


def test_notifications_of_one_project_are_many_tasks(spark):
    changes = frame(spark, [(i, "p", i % 7) for i in range(600)] + [(900, "q", 1), (901, None, 1), (902, "p", None)], "id long, project string, author long")
    told = frame(spark, [("p", i) for i in (1, 2, 2, 30)] + [("q", 1), (None, 2)], "project string, subscriber long")
    out = layers.notifications(changes, told)
    assert sorted((r.id, r.project, r.author, r.subscriber) for r in out.collect()) == [(i, "p", i % 7, s) for i in range(600) for s in (1, 2, 30) if s != i % 7]
    assert out.select(F.spark_partition_id()).distinct().count() > 20


def test_renames_compare_classes_of_contents_first(spark, monkeypatch):
    """Against all pairs: copies of contents, names alike on both sides, lengths far apart, ties. Names are compared for few pairs only."""
    monkeypatch.setattr(merge, "PARTS", 3)
    rng = random.Random(4)
    unit = lambda i, new: (i, rng.choice("MP"), rng.randrange(2), new + rng.choice(["Alpha", "Beta", "Gamma9"]), f"src/f{rng.randrange(3)}.cs", rng.randrange(40))
    full = lambda u: (*u, f"call {u[3]} with {rng.choice(['11.5', '11.6', '92.75', '7', 'x' * 40, 'x' * 31 + 'y' * 9])}")
    base, target = [full(unit(i, "")) for i in range(60)], [full(unit(i, rng.choice(["", "New"]))) for i in range(60)]
    schema = "id long, type string, signature_shape int, name string, file string, start_line int, content string"
    out = merge.renames(frame(spark, base, schema), frame(spark, target, schema), 0.5)

    def distance(a, b):
        line = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, line[0] = line[0], i
            for j, y in enumerate(b, 1):
                before, line[j] = line[j], min(line[j] + 1, line[j - 1] + 1, before + (x != y))
        return line[-1]

    want = {}
    for a in base:
        best = []
        for b in target:
            if a[1:3] == b[1:3] and a[3] != b[3]:
                x, y = a[6].replace(a[3], "_"), b[6].replace(b[3], "_")
                structure = 1 - distance(x, y) / max(len(x), len(y))
                apart = abs(a[5] - b[5])
                place = 0.0 if a[4] != b[4] else 1.0 if apart <= 5 else 0.7 if apart <= 20 else 0.3
                name = 1 - distance(a[3].lower(), b[3].lower()) / max(len(a[3]), len(b[3]))
                less = 0.1 if min(len(a[6]), len(b[6])) / max(len(a[6]), len(b[6])) < 0.7 else 0.0
                if structure >= 0.5:
                    best.append((-round(min(1.0, max(0.0, structure + 0.05 * place + 0.05 * name - less)), 9), b[0]))
        if best:
            want[a[0]] = min(best)[::-1]
    got = {r.base_id: (r.target_id, -round(r.score, 9)) for r in out.collect()}
    assert len(want) > 50 and {i: s for i, (_, s) in got.items()} == {i: s for i, (_, s) in want.items()}
    assert sum(got[i] != w for i, w in want.items()) <= 2  # sums that differ in their last bit


def test_notifications_take_little_disk_when_written(spark, tmp_path):
    changes = spark.range(2_000).select("id", F.lit("p").alias("project"), (F.col("id") % 3_600).alias("author"))
    told = spark.range(3_000).select(F.lit("p").alias("project"), F.col("id").alias("subscriber"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for larger tables
    try:
        layers.notifications(changes, told).select("id", "subscriber").write.option("compression", "snappy").parquet(str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    n = 2_000 * 3_000 - sum(i % 3_600 < 3_000 for i in range(2_000))
    assert spark.read.parquet(str(tmp_path / "out")).count() == n
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.6 * n


def test_notifications_of_more_subscribers_than_a_block(spark):
    changes = spark.range(12).select("id", F.when(F.col("id") % 3 == 0, "q").otherwise("p").alias("project"), F.when(F.col("id") > 1, F.col("id") * 7).alias("author"))
    told = spark.range(layers.PARTS * layers.BLOCK + 900).select(F.explode(F.array(F.lit("p"), F.lit("q"), F.lit("r"))).alias("project"), F.when(F.col("id") != 50, F.col("id")).alias("subscriber"))
    told = told.filter("project <> 'q' OR subscriber = 21 OR subscriber = 42").unionByName(told.filter("subscriber < 9"))
    plain = changes.join(told.distinct(), "project").filter("subscriber <> author")
    out = layers.notifications(changes, told)
    assert out.columns == plain.columns and out.count() == plain.count() > 30_000
    assert not out.exceptAll(plain).count()


def test_empty_layers(spark):
    none = frame(spark, [], "id long, v string")
    assert layers.applied(none, frame(spark, [], "id long, v string, op string")).count() == 0


def test_three_way_and_text_merge(spark):
    side = lambda *rows: frame(spark, rows, "id long, content_hash string")
    out = {r.id: (r.action, r.source, r.delete_modify) for r in merge.three_way(
        side((1, "o"), (2, "o"), (3, "o"), (4, "o"), (5, "o")), side((1, "x"), (2, "o"), (3, "x"), (5, "y"), (6, "n")), side((1, "o"), (2, "o"), (3, "y"), (4, "z"))
    ).collect()}
    assert out == {1: ("Update", "A", False), 3: ("Conflict", "both", False), 4: ("Delete", "A", True), 5: ("Delete", "B", True), 6: ("Create", "A", False)}
    assert merge.merged_text("a\nb\nc", "A\nb\nc", "a\nb\nC") == "A\nb\nC"
    assert merge.merged_text("a\nb", "x\na\nb", "a\nb\ny") == "x\na\nb\ny"
    assert merge.merged_text("a", "b", "c") is None
    assert merge.merged_text("a", "a", "c") == "c"


@pytest.mark.parametrize(
    ("base", "a", "b", "want"),
    [
        ("a\nb\nc", "a\nB\nc", "a\nX\nc", None),  # the same line, differently
        ("a\nb\nc", "a\nB\nc", "a\nB\nc\nd", "a\nB\nc\nd"),  # the same line alike, and one more
        ("a", "p\na", "q\na", "p\nq\na"),  # both add at the top
        ("a", "a\np", "a\nq", "a\np\nq"),  # both add at the bottom
        ("a\nb", "a\nx\nb", "a\ny\nb", None),  # both add between
        ("a\nb\nc\nd", "a\nc\nd", "a\nb\nc\nD", "a\nc\nD"),  # one deletes, one changes elsewhere
        ("a\nb\nc\nd", "a\nd", "a\nb\nX\nd", None),  # one deletes what the other changes
        ("a\nb\nc\nd\ne", "b\nc\nd\ne", "a\nb\nc\ne\nd", "b\nc\ne\nd"),  # one deletes, one moves lines
    ],
)
def test_merged_text(base, a, b, want):
    assert merge.merged_text(base, a, b) == want


def test_merged_text_keeps_both_sides_edits():
    rng = random.Random(4)
    for _ in range(200):
        base = [f"line {i}" for i in range(30)]
        sides = []
        for part in (range(0, 14), range(16, 30)):
            lines = list(base)
            for i in sorted(rng.sample(part, 4), reverse=True):
                lines[i : i + 1] = rng.choice([[], ["new"], [lines[i], "added"]])
            sides.append(lines)
        want = sides[0][: sides[0].index("line 14")] + ["line 14", "line 15"] + sides[1][sides[1].index("line 15") + 1 :]
        assert merge.merged_text(*("\n".join(x) for x in (base, *sides))) == "\n".join(want)


def test_changed_ranges():
    assert merge.changed_ranges(["a", "b", "c"], ["a", "x", "c"]) == [(1, 2)]
    assert merge.changed_ranges(["a", "b"], ["a"]) == [(1, 2)]
    assert merge.changed_ranges([], ["a"]) == [(0, 0)]
    assert merge.changed_ranges(["a", "b"], ["a", "x", "b"]) == [(1, 1)]
    assert merge.changed_ranges(["a", "b", "c", "d"], ["b", "c", "d", "a"]) == [(0, 1), (4, 4)]
    assert len(merge.COMMON_TYPES) == 37 and len(set(merge.COMMON_TYPES)) == 37


def test_instructions(spark):
    got = merge.instructions("Exclude *.md and docs/\nPrefer source for billing")
    assert got["exclude"] == ["*.md", "docs/"] and got["prefer_source"] == ["billing"]
    actions = frame(spark, [("a/billing.cs", "target"), ("x.md", "source")], "path string, source string")
    assert [tuple(r) for r in merge.instructed(actions, [], ["*.md"], {"billing": "source"}).collect()] == [("a/billing.cs", "source")]


def test_cycles_end(spark):
    edges = frame(spark, [("a", "b"), ("b", "a"), ("c", "a")], "caller string, callee string")
    paths = {">".join(r.path) for r in graph.backtrace(edges, "b", most_depth=6).collect()}
    assert "c>a>b" in paths and all(len(set(p.split(">"))) == len(p.split(">")) for p in paths)
    nodes = frame(spark, [("a",), ("b",), ("c",)], "node string")
    got = dict(graph.levels(nodes, edges.selectExpr("caller AS node", "callee AS needs")).collect())
    assert got == {"a": 0, "b": 1, "c": 1}
    reached = dict(graph.reachable(edges.selectExpr("caller AS src", "callee AS dst"), frame(spark, [("c",)], "node string")).collect())
    assert reached == {"c": 0, "a": 1, "b": 2}


def test_logs(spark):
    lines = frame(spark, [(1, "2024-01-02 03:04:05 [WARN] careful"), (2, "  at x"), (3, "")], "line_number int, line string")
    row = logs.parsed_plain(lines).first()
    assert (row.level, row.message, str(row.ts)) == ("Warning", "careful", "2024-01-02 03:04:05")
    assert logs.sniffed(lines).first()[0] == "PlainText"
    assert logs.sniffed(lines.filter("line_number = 3")).first()[0] == "Unknown"
    xml = frame(spark, [(1, '<entry level="error" timestamp="2024-01-02T03:04:05"><message>m</message></entry>')], "line_number int, line string")
    assert logs.sniffed(xml).first()[0] == "XML" and tuple(logs.parsed_xml(xml).select("level", "message").first()) == ("Error", "m")
    none = logs.parsed_plain(lines).withColumn("level", F.lit(None).cast("string"))
    assert logs.filtered(none, levels=["Error"], since="2024-01-01 00:00:00").count() == 1
    context = logs.with_context(lines, F.contains("line", F.lit("at x")), 1, 1).first()
    assert (context.context_before, context.context_after) == (["2024-01-02 03:04:05 [WARN] careful"], [])


def test_unit_extractors(spark):
    ids = lambda rows: [(r[0], r[2]) for r in rows]
    assert ids(units.json_units('{"a": {"b": [1, {"c": 2}]}}')) == [("$", "JsonObject"), ("a", "JsonObject"), ("a.b", "JsonArray"), ("a.b[1]", "JsonObject"), ("a.b[1].c", "JsonProperty")]
    assert [r[0] for r in units.markup_units("<a><b>t</b><c/></a>")] == ["a[0]", "a[0]/b[0]", "a[0]/c[1]"]
    assert ("a.b[0]", "YamlScalar") in ids(units.yaml_units("a:\n  b:\n    - x\n    - y\n"))
    assert [r[0] for r in units.script_units("f() {\n}\nfunction g () {\n}", "shell")] == ["f", "g"]
    bad = units.extracted(frame(spark, [("x.json", "{"), ("y.txt", None)], "id string, text string"), "id", "text")
    assert [r.type for r in bad.collect()] == ["File", "File"]


def test_sources(spark, tmp_path):
    rows = frame(spark, [("N.T.m(int)", 1, "d", "f", 3), ("Top", 1, None, "f", 4)], "canonical_fqn string, flags long, document_id string, file_path string, line_number int")
    got = {r.simple_name: (r.namespace, r.namespace_depth) for r in tables.symbol_rows(rows).collect()}
    assert got["Top"] == ("", 0)
    for form in ("parquet", "json", "orc", "csv"):
        tables.write(rows, f"{tmp_path}/{form}", form)
        assert tables.read(spark, f"{tmp_path}/{form}", form, schema=rows.schema).count() == 2
    assert tables.load_once(rows, f"{tmp_path}/t", f"{tmp_path}/m", "h1") and not tables.load_once(rows, f"{tmp_path}/t", f"{tmp_path}/m", "h1")
    refs = units.package_references(frame(spark, [("p", '<PackageReference Include="X" Version="1.0" />')], "project string, content string")).first()
    assert tuple(refs) == ("p", "X", "1.0")


def test_fusion_arguments(spark):
    lists = frame(spark, [(0, 1, 0)], "list int, id long, rank0 int")
    with pytest.raises(ValueError):
        vector.rank_fusion(lists, -1)
    with pytest.raises(ValueError):
        vector.rank_fusion(lists, weights={0: 0.0})
    assert vector.rank_fusion(lists, 0).first().score == float("inf")
    same = frame(spark, [(1, 0.5), (2, 0.5)], "id long, s double")
    assert {r.normalised for r in vector.score_range(same, "s").collect()} == {1.0}


def test_find_falls_back_to_contains(spark):
    s = frame(spark, [(1, "Foo", "N.Foo", 1), (2, "FooBar", "N.FooBar", 1)], "id long, simple_name string, canonical_fqn string, flags long")
    assert [r.id for r in lookup.find(s, "foo").collect()] == [1]
    assert sorted(r.id for r in lookup.find(s, "oo").collect()) == [1, 2]
    assert lookup.find(s, "zzz").count() == 0


def test_stream_is_its_batch(spark, tmp_path):
    batches = [
        [(i % 4, i, "A" if i < 4 else "M", f"v{i}") for i in range(20)],
        [(0, 20, "D", "x"), (1, 21, "M", "w"), (9, 22, "M", "new here?"), (8, 23, "A", "n")],
        [(7, 24, "M", "z"), (8, 25, "M", "n2")],
    ]
    base = frame(spark, [(7, "old"), (6, "kept"), (5, "gone")], "id long, v string")
    schema = "id long, ts long, op string, v string"
    for i, rows in enumerate(batches):
        frame(spark, rows + ([(5, 19, "D", "x")] if not i else []), schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        streams.ingest(stream, f"{tmp_path}/out", f"{tmp_path}/cp", ["v"]).awaitTermination(60)
    # In the first batch an id's last change is a change of a row that it also adds
    first = spark.read.parquet(f"{tmp_path}/out/batch=0")
    assert sorted((r.id, r.op, r.v) for r in first.collect()) == [(0, "M", "v16"), (1, "M", "v17"), (2, "M", "v18"), (3, "M", "v19"), (5, "D", "x")]
    assert sorted(map(tuple, streams.ingested(base, f"{tmp_path}/out").collect())) == [(6, "kept"), (7, "z"), (8, "n2")]


def test_windowed_stream(spark, tmp_path):
    events = spark.sql("SELECT timestamp_seconds(1700000000 + id * 60) AS ts, id % 2 AS k FROM range(120)")
    events.write.parquet(f"{tmp_path}/in")
    stream = streams.windowed(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), "ts", "10 minutes", ["k"], watermark="0 minutes")
    q = stream.writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    want = sorted(map(tuple, streams.windowed(events, "ts", "10 minutes", ["k"]).collect()))
    assert sorted(map(tuple, spark.table("windowed").collect())) == want


def test_forward_paths_and_feasibility(spark):
    edges = frame(spark, [("a", "b", "x > 5"), ("a", "c", "x <= 5"), ("b", "d", "x < 3"), ("b", "e", None), ("c", "a", "y != 2"), ("e", "e", None)], "src string, dst string, condition string")
    out = [(r.path, r.conditions, r.ended) for r in graph.forward_paths(edges, "a").collect()]
    assert out == [(["a", "b", "d"], ["x > 5", "x < 3"], "exit"), (["a", "b", "e", "e"], ["x > 5"], "revisit"), (["a", "c", "a"], ["x <= 5", "y != 2"], "revisit")]
    assert [(r.path, r.ended) for r in graph.forward_paths(edges, "a", most_depth=1).collect()] == [(["a", "b"], "depth"), (["a", "c"], "depth")]
    cases = [
        (["x > 5", "x < 3"], False, 0), (["x >= 5", "x <= 5"], True, 0), (["x >= 5", "x < 5"], False, 0), (["x == 5", "x != 5"], False, 0), (["x == 1", "x == 2"], False, 0),
        (["x > 1", "y < 0", "z()"], True, 1), ([], True, 0), (["x != 1", "x != 2"], True, 0), (["a.b >= -1.5", "a.b <= -1.5"], True, 0), (["x > 1", "x > 3", "x <= 3"], False, 0),
    ]
    got = {r.id: (r.feasible, r.unknown) for r in graph.feasible(frame(spark, [(i, c[0]) for i, c in enumerate(cases)], "id int, conditions array<string>")).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}


def test_versions(spark, tmp_path):
    from tessera.sources import versions

    root, rows = str(tmp_path / "t"), lambda *x: frame(spark, [(i,) for i in x], "id long")
    assert versions.listed(spark, root).count() == 0
    with pytest.raises(ValueError):
        versions.current(spark, root)
    assert [versions.create(rows(*range(n)), root) for n in (3, 4, 5, 6)] == [0, 1, 2, 3]
    versions.rollback(spark, root, 1)
    with pytest.raises(ValueError):
        versions.rollback(spark, root, 9)
    assert versions.current(spark, root).count() == 4
    assert versions.cleanup(spark, root, 1) == [0, 2] and versions.cleanup(spark, root, 1) == []
    assert sorted(versions.listed(spark, root).collect()) == [(1, 4, True), (3, 6, False)]
    delta = frame(spark, [(0, "D"), (70, "A")], "id long, op string")
    assert not versions.compact(spark, root, delta, threshold=2) and versions.compact(spark, root, delta, threshold=1)
    assert sorted(r.id for r in versions.current(spark, root).collect()) == [1, 2, 3, 70]


def test_structural_forms(spark):
    from tessera.functions.text import sequence_calls, structural_of

    row = frame(
        spark, [('{ "a b" : [1, 2] }', '<?xml version="1.0"?>\n<a>\n <b>x y</b>\n</a>\n', 'f("// no"); // yes\n/* a\n * b */ g( 1 );', "x  \n\n\n\ny\n")],
        "j string, x string, c string, t string"
    )
    got = row.select(*[structural_of(F.col(c), F.lit(e)) for c, e in (("j", "json"), ("x", ".XML"), ("c", ".cs"), ("t", "txt"))]).first()
    assert tuple(got) == ('{"a b":[1,2]}', "<a><b>x y</b></a>", 'f("// no"); g( 1 );', "x\n\ny")
    calls = frame(spark, [("a.Where(x).Foo().OrderBy<int>(y).ToList()",)], "t string").select(sequence_calls(F.col("t")).alias("c")).first().c
    assert [tuple(c) for c in calls] == [("Where", True), ("OrderBy", True), ("ToList", False)]


def test_bloom_filter_has_no_false_negatives(spark):
    from tessera.operators import bloom

    keys = frame(spark, [(f"key{i}" if i else None,) for i in range(400)], "k string")
    f = bloom.merged(bloom.built(keys.limit(200), F.col("k"), 4000, 7), bloom.built(keys, F.col("k"), 4000, 7))
    assert bloom.asked(keys, F.col("k"), f, 4000, 7).filter("might_contain").count() == 399
    others = frame(spark, [(f"other{i}",) for i in range(1000)], "k string")
    rate = bloom.stats(f, 4000, 7).first().rate
    assert abs(bloom.asked(others, F.col("k"), f, 4000, 7).filter("might_contain").count() / 1000 - rate) < 0.03


def test_routes(spark):
    modes = [(m, x, y) for m in ("local", "hub", "any", "both") for x in (True, False) for y in (True, False)]
    got = {(r.m, r.x, r.y): r.to for r in frame(spark, modes, "m string, x boolean, y boolean").withColumn("to", vector.search_route(F.col("m"), F.col("x"), F.col("y"))).collect()}
    assert got["local", False, True] == "none" and got["hub", True, True] == "hub" and got["any", True, True] == "local" and got["any", False, True] == "hub" and got["both", True, True] == "both" and got["both", False, True] == "hub"


def test_git_source(spark, tmp_path):
    import subprocess

    from tessera.sources import git

    def run(*args):
        subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *args], cwd=tmp_path, check=True, capture_output=True)

    def put(name, text):
        (tmp_path / name).write_text(text)

    run("init", "-q", "-b", "main")
    put("a.cs", "one"), put("b.txt", "two"), put("old name.md", "a longer text that is moved as it is\n" * 5)
    run("add", "."), run("commit", "-qm", "1"), run("checkout", "-qb", "side")
    put("a.cs", "ONE"), put("c.json", "{}"), run("rm", "-q", "b.txt"), run("mv", "old name.md", "new.md"), run("add", "."), run("commit", "-qm", "2")
    run("checkout", "-q", "main"), put("d.cs", "later"), run("add", "."), run("commit", "-qm", "3")
    out = {(r.path, r.status, r.renamed_from) for r in git.changed_files(spark, str(tmp_path), "main", "side").collect()}
    assert out == {("a.cs", "M", None), ("b.txt", "D", None), ("c.json", "A", None), ("new.md", "R", "old name.md")}
    assert {(r.path, r.content) for r in git.files(spark, str(tmp_path), "side").filter("path LIKE '%.cs'").collect()} == {("a.cs", "ONE")}
    assert {r.path for r in git.files(spark, str(tmp_path), "main").collect()} == {"a.cs", "b.txt", "d.cs", "old name.md"}


def test_vector_service(spark, tmp_path):
    import json

    from tessera.sources import service

    store = service.VectorService(spark, str(tmp_path / "store"))
    ask = lambda **x: json.loads(store.answer(json.dumps(x)))
    assert ask(command="get_status") == {"ok": True, "count": 0, "dimensions": 384}
    assert ask(command="index_code", id="1", content="def f(): pass", metadata={"kind": "method"})["ok"]
    assert ask(command="index_batch", items=[{"id": "2", "content": "class A"}, {"id": "1", "content": "def g(): pass"}, {"id": "3", "content": " CLASS a "}])["count"] == 3
    assert ask(command="get_status")["count"] == 3
    hits = ask(command="search_similar", content="class a", limit=2)["hits"]
    assert [h["id"] for h in hits] == ["2", "3"] and all(h["similarity"] > 0.999 for h in hits)
    assert not ask(command="nonsense")["ok"] and not json.loads(store.answer("no json"))["ok"]
    assert ask(command="clear") == {"ok": True, "count": 0} and ask(command="get_status")["count"] == 0


def test_maintenance(spark, tmp_path):
    from tessera.sources import versions

    root = str(tmp_path / "t")
    versions.create(frame(spark, [(1, "a"), (2, "b")], "id long, v string"), root)
    deltas = frame(spark, [(1, "x", "M", "main1"), (3, "c", "A", "main1"), (9, "z", "A", "gone")], "id long, v string, op string, branch string")
    branches = frame(spark, [("main1",)], "branch string")
    left = versions.maintained(spark, root, deltas, branches, threshold=1, keep=1)
    assert left.count() == 0 and sorted(map(tuple, versions.current(spark, root).collect())) == [(1, "x"), (2, "b"), (3, "c")]
    left = versions.maintained(spark, root, deltas, branches, threshold=5, keep=1)
    assert sorted(r.id for r in left.collect()) == [1, 3] and versions.listed(spark, root).count() == 1
