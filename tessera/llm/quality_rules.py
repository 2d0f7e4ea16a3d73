"""Quality rules of documents and of their hosts, in DataFrame operations only.

Each document is measured by itself. A host's failures are then counted, its
failure rate is shrunk towards that of all hosts by a Beta prior fitted to the
hosts (method of moments), and the verdict goes back to the host's documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WORD_GAP, checkpointed, column_of, let

MIN_WORDS = 50
#: Percent of the words that may stand in repeated 3-word windows.
MAX_REPEAT = 50
#: Shrunk failure rate above which a host's documents go.
HOST_LIMIT = 0.5
#: Bounds of the prior's strength, in documents.
WEAKEST, STRONGEST = 1.0, 1e6
SYMBOLS = "[#*$%&|<>]"


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more: windows are sorted by hash, equal neighbours marked, their spans united. Words are compared only where hashes meet."""
    hashed = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    windows = F.when(F.size(words) >= 3, F.array_sort(F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(hashed(i).alias("h"), i.alias("at")))))

    def repeated(s: Column) -> Column:
        def same(x: Column, y: Column) -> Column:
            alike = x["h"] == y["h"]
            for k in range(3):
                alike = alike & (F.get(words, x["at"] + k) == F.get(words, y["at"] + k))
            return F.coalesce(alike, F.lit(False))

        marked = F.filter(F.transform(s, lambda x, i: F.when(same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)), x["at"])), lambda x: x.isNotNull())
        united = F.aggregate(
            F.sort_array(marked),
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda acc, x: F.struct((acc["n"] + x + 3 - F.greatest(x, acc["end"])).alias("n"), (x + 3).alias("end")),
        )
        return united["n"]

    return F.coalesce(let(windows, repeated), F.lit(0))


def document_metrics(docs: DataFrame) -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed of each row.

    A null text has no words; a null source is a host of its own. Further columns of docs are left out, so clashing names don't matter.
    """
    text = F.coalesce(column_of(docs, "text", "string"), F.lit(""))
    words = F.filter(F.split(text, WORD_GAP), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("word_chars"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
        ),
    )
    return (
        docs.select("doc_id", column_of(docs, "source", "string").alias("host"), of_words.alias("w"), (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"), let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
        .select("doc_id", "host", "w.n_words", "w.word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words")
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words")))
    )


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """(a, b) of the Beta prior that fits the hosts' n and failed; one row reaches the driver.

    The spread of the hosts' rates beyond that of sampling gives the strength; without such a spread the prior is at its strongest. No rows: (1, 1).
    """
    n, failed = F.col("n"), F.col("failed")
    h, docs, bad, squares = hosts.agg(F.count("*"), F.sum(n), F.sum(failed), F.sum(failed * failed / n)).first()
    if not docs:
        return 1.0, 1.0
    mean = (bad + 0.5) / (docs + 1)
    within = mean * (1 - mean)
    between = squares / docs - 2 * mean * bad / docs + mean * mean - within * h / docs
    strength = STRONGEST if between <= within / (STRONGEST + 1) else min(max(within / between - 1, WEAKEST), STRONGEST)
    return mean * strength, (1 - mean) * strength


def host_verdicts(metrics: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """host, n_host_docs, host_rate (shrunk), host_failed: a row a host. Counts are summed before the shuffle, so a large host is one row a task."""
    hosts = metrics.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    a, b = beta_prior(hosts)
    rate = (F.col("failed") + F.lit(a)) / (F.col("n") + F.lit(a + b))
    return hosts.select("host", F.col("n").alias("n_host_docs"), rate.alias("host_rate"), (rate > limit).alias("host_failed"))


def quality_rules(docs: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """The metrics of each row of docs with host_rate and kept: neither it nor its host failed.

    The measured rows (no texts) are kept in the shared folder, as hosts and documents both read them. Texts are measured whole, however long; a null or empty one has no words, so it fails. Rows that
    repeat are rows each, also in their host's counts. A rate just at the limit keeps the host. An empty table gives an empty result.
    """
    metrics = checkpointed(document_metrics(docs))
    hosts = host_verdicts(metrics, limit).withColumnRenamed("host", "of_host")
    joined = metrics.join(hosts, F.col("host").eqNullSafe(F.col("of_host")), "left")
    return joined.select(*metrics.columns, "n_host_docs", "host_rate", (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"))
