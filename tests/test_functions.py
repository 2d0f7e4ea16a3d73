import pytest
from pyspark.sql import functions as F

from tessera.functions import ratings, similarity, text, vectors


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def strings(*items):
    return F.array(*map(F.lit, items)) if items else F.array().cast("array<string>")


@pytest.mark.parametrize(("a", "b", "want"), [((), (), 1.0), (("x",), (), 0.0), (("x", "y"), ("y", "z"), 1 / 3), (("x", "x"), ("x",), 1.0)])
def test_jaccard(spark, a, b, want):
    assert value(spark, vectors.jaccard(strings(*a), strings(*b))) == pytest.approx(want)


def test_cosine_edges(spark):
    v = lambda *x: F.array(*map(F.lit, x))
    assert value(spark, vectors.cosine(v(0.0, 0.0), v(1.0, 2.0))) == 0
    assert value(spark, vectors.cosine(v(1.0), v(1.0, 2.0))) == 0
    assert value(spark, vectors.cosine(v(1.0, 2.0), v(2.0, 4.0))) == pytest.approx(1)


def test_sparse_cosine(spark):
    m = lambda **x: F.create_map(*[F.lit(y) for kv in x.items() for y in kv]) if x else F.create_map().cast("map<string,int>")
    assert value(spark, vectors.sparse_cosine(m(), m())) == 1
    assert value(spark, vectors.sparse_cosine(m(a=1), m())) == 0
    assert value(spark, vectors.sparse_cosine(m(a=1, b=1), m(b=1, c=1))) == pytest.approx(0.5)


def test_normalised_difference(spark):
    assert value(spark, vectors.normalised_difference(F.lit(3), F.lit(9), 3)) == 2
    assert value(spark, vectors.normalised_difference(F.lit(3), F.lit(3), 0)) == 0


@pytest.mark.parametrize(("a", "b", "want"), [("ab", "abcdefgh", 8), ("kitten", "sitting", 3), ("", "", 0), ("abc", "", 3)])
def test_capped_levenshtein(spark, a, b, want):
    assert value(spark, similarity.capped_levenshtein(F.lit(a), F.lit(b))) == want


@pytest.mark.parametrize(
    ("asked", "known", "made", "want"),
    [
        ("A.B", "A.B", False, 1.0), ("a.b", "A.B", False, 0.99), ("N.T.T", "N.T.ctor", True, 0.97), ("N.T", "N.T.ctor", True, 0.98), ("A.B", "A.B(int)", False, 0.9), ("A.B(x)", "A.B(int)", False, 0.7),
        ("A.L<int>", "A.L<T>", False, 0.95), ("A.L", "A.L<T>", False, 0.85), ("A.B.C", "A.B+C", False, 0.75), ("X", "Y", False, 0.0),
    ],
)
def test_fqn_score(spark, asked, known, made, want):
    assert value(spark, similarity.fqn_score(F.lit(asked), F.lit(known), F.lit(made))) == want


def test_stack_confidence(spark):
    score = lambda *hints: value(
        spark,
        similarity.stack_confidence(strings(*hints), F.lit("Run"), F.lit("Engine"), F.lit("My.Space.Engine"), F.lit("My.Space"), F.lit("My.Space.Engine.Run(int)"))
    )
    assert score() == 0
    assert score("at My.Space.Engine.Run(int) in x") == 1
    assert score("at engine.run") == pytest.approx(0.95)
    assert score("my.space only") == pytest.approx(0.7)


def test_method_similarity_of_itself_is_one(spark):
    f = F.struct(
        strings("a").alias("invoked"), F.create_map(F.lit("op"), F.lit(2)).alias("operations"), strings().alias("accessed_types"), strings("int").alias("param_types"), F.lit("void").alias("return_type"),
        F.lit(1).alias("blocks"), F.lit(2).alias("branches"), F.lit(0).alias("loops"), F.lit(3).alias("cyclomatic"),
    )
    assert value(spark, similarity.method_similarity(f, f)) == pytest.approx(1)


# Rules, their hits and verdicts as given.
RULES = [
    ("CA1873", 11, ["LogA.cs"], "Info", "FalsePositive", 0.9, "None"), (
        "CA1822", 2, ["BenchmarkRunner.cs"], "Warning", "Infrastructure", 0.85, "None"
    ), ("CA1829", 2, ["A.cs"], "Info", "PerformanceCritical", 0.8, "Warning"),
    ("CA2000", 1, ["A.cs"], "Warning", "Security", 0.75, "Error"), ("IDE0005", 1, ["A.cs"], "Info", "Style", 0.7, "Silent"), ("CS8600", 1, ["A.cs"], "Warning", "NeedsManualReview", 0.5, "Warning"),
    ("CA1873", 10, ["LogA.cs"], "Info", "NeedsManualReview", 0.5, "Suggestion"),
]


@pytest.mark.parametrize(("rule", "n", "files", "severity", "category", "confidence", "recommended"), RULES)
def test_rule_verdict(spark, rule, n, files, severity, category, confidence, recommended):
    got = value(spark, ratings.rule_verdict(F.lit(rule), F.lit(n), strings(*files), F.lit(severity)))
    assert (got.category, got.confidence, got.recommended) == (category, confidence, recommended)


def test_relevance_rounds_half_to_even(spark):
    assert value(spark, ratings.relevance(F.lit("Security"), F.lit("Warning"), F.lit(0.75))) == 5.25
    assert value(spark, ratings.relevance(F.lit("?"), F.lit("?"), F.lit(0.5))) == 1.25


@pytest.mark.parametrize(("pattern", "kind"), [("Foo", "exact"), ("Fo*", "wildcard"), ("F?o", "wildcard"), ("F.*", "regex"), ("^F", "regex"), ("a|b", "regex"), ("a.b", "exact")])
def test_kind_of_pattern(pattern, kind):
    assert text.kind_of_pattern(pattern) == kind


@pytest.mark.parametrize(
    ("name", "pattern", "replacement", "want"),
    [
        ("GetUser", "Get*", "Load*", "LoadUser"), ("a1b", "a?b", "x?y", "x1y"), ("Foo", "Foo", "Bar", "Bar"), ("Food", "Foo", "Bar", "Food"),
        ("x_y", "^(.)_(.)$", "$2$1", "yx"), ("a$b", "a$b", "c", "a$b"), ("GetUser", "Get*", "$*", "$User")
    ],
)
def test_rewritten(spark, name, pattern, replacement, want):
    assert value(spark, text.rewritten(F.lit(name), pattern, replacement)) == want


@pytest.mark.parametrize(
    ("path", "pattern", "want"),
    [("src/a/b.cs", "src/**", True), ("lib/b.cs", "src/**", False), ("src/B.CS", "src/*.cs", True), ("src/b.cs", "b.CS", True), ("x/src/b", "**/b", True), ("a.b", "a*", True)]
)
def test_glob(spark, path, pattern, want):
    assert value(spark, text.glob_matches(F.lit(path), pattern)) is want


def test_text_forms(spark):
    assert value(spark, text.normalised(F.lit("a \r\nb\t\r\n\r\n"))) == "a\nb\n"
    assert value(spark, text.structural(F.lit("\n\n a  \n\n\n\nb \n"))) == "a\n\nb"
    assert value(spark, text.snippet(F.lit("abcdef"), 3)) == "abc..."


def test_levels(spark):
    got = [value(spark, ratings.log_level(F.lit(x))) for x in ("trace", "W", "err", "critical", "?", None)]
    assert got == ["Verbose", "Warning", "Error", "Fatal", "Unknown", None]


def test_path_confidence(spark):
    assert value(spark, ratings.path_confidence(F.lit(0), F.lit(True))) == 1
    assert value(spark, ratings.path_confidence(F.lit(10), F.lit(False))) == pytest.approx(0.35)
    assert value(spark, ratings.path_confidence(F.lit(0), F.lit(True), F.lit(0.95), F.lit(3))) == 1


def test_embedding_text_keeps_both_ends(spark):
    long = "sig\n" + "a" * 300 + "z" * 300
    got = value(spark, text.embedding_text(F.lit("Block"), F.lit("n"), F.lit(None).cast("string"), F.lit(long), strings(), 200))
    assert got.startswith("sig\naaa") and got.endswith("zzz") and "..." in got and len(got) <= 200
    assert value(spark, text.embedding_text(F.lit("File"), F.lit("n"), F.lit("s"), F.lit(long), strings(), 200)) == ""
