"""Versions of a table in a folder: written once each, listed in a table of their own, rolled back to by a further entry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import layers

ENTRIES = "entry long, version long, action string, n_rows long"


def entries(spark: SparkSession, root: str) -> DataFrame:
    """entry, version, action (create, rollback or remove), n_rows: what was done, by number."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/entries")
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(ENTRIES).parquet(f"{root}/entries") if there else spark.createDataFrame([], ENTRIES)


def _noted(spark: SparkSession, root: str, version: int, action: str, n_rows: int | None) -> None:
    last = entries(spark, root).agg(F.max("entry")).first()[0]
    spark.createDataFrame([(0 if last is None else last + 1, version, action, n_rows)], ENTRIES).coalesce(1).write.mode("append").parquet(f"{root}/entries")


def listed(spark: SparkSession, root: str) -> DataFrame:
    """version, n_rows, current of the versions that are there: the current one is that of the last entry that created or rolled back."""
    done = entries(spark, root)
    gone = done.filter("action = 'remove'").select("version")
    now = done.filter("action <> 'remove'").agg(F.max_by("version", "entry").alias("now"))
    made = done.filter("action = 'create'").join(gone, "version", "left_anti").select("version", "n_rows")
    return made.join(F.broadcast(now)).select("version", "n_rows", (F.col("version") == F.col("now")).alias("current"))


def current(spark: SparkSession, root: str) -> DataFrame:
    """The rows of the current version."""
    row = listed(spark, root).filter("current").select("version").first()
    if row is None:
        raise ValueError(f"no version at {root}")
    return spark.read.parquet(f"{root}/version={row[0]}")


def create(rows: DataFrame, root: str) -> int:
    """Writes rows as a new version, which becomes the current one; returns its number. The entry follows the data, so a version that was not written whole is not listed."""
    spark = rows.sparkSession
    last = entries(spark, root).agg(F.max("version")).first()[0]
    version = 0 if last is None else last + 1
    path = f"{root}/version={version}"
    rows.write.mode("overwrite").parquet(path)
    _noted(spark, root, version, "create", spark.read.parquet(path).count())
    return version


def rollback(spark: SparkSession, root: str, version: int) -> None:
    """Makes an earlier version the current one; later ones stay."""
    if not listed(spark, root).filter(F.col("version") == version).count():
        raise ValueError(f"no version {version} at {root}")
    _noted(spark, root, version, "rollback", None)


def cleanup(spark: SparkSession, root: str, keep: int) -> list[int]:
    """Removes all but the newest `keep` versions and the current one; returns those removed."""
    nth = F.row_number().over(Window.orderBy(F.desc("version")))
    old = listed(spark, root).withColumn("nth", nth).filter((F.col("nth") > keep) & ~F.col("current")).select("version").orderBy("version")
    out = [r[0] for r in old.collect()]
    for version in out:
        _noted(spark, root, version, "remove", None)
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/version={version}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return out


def compact(spark: SparkSession, root: str, delta: DataFrame, threshold: int = layers.COMPACT_FROM, id_col: str = "id") -> bool:
    """Writes the current version with the delta in it as a new one, if the delta has more than `threshold` changes; returns whether it did."""
    if delta.limit(threshold + 1).count() <= threshold:
        return False
    create(layers.applied(current(spark, root), delta, id_col), root)
    return True


def evict(deltas: DataFrame, root: str, keep: int = layers.KEPT_BRANCHES, by: str = "branch", ts: str = "last_modified") -> DataFrame:
    """The changes of the `keep` branches changed last; those of the others are written below root by branch, where restored() finds them."""
    branches = deltas.groupBy(by).agg(F.max(ts).alias("last_modified")).withColumnRenamed(by, "branch")
    kept = layers.recent_branches(branches, keep).select(F.col("branch").alias(by))
    deltas.join(kept, by, "left_anti").write.mode("append").partitionBy(by).parquet(f"{root}/evicted")
    return deltas.join(kept, by, "left_semi")


def restored(spark: SparkSession, root: str, branch: str, by: str = "branch") -> DataFrame:
    """The evicted changes of a branch, read from its own folder only."""
    return spark.read.parquet(f"{root}/evicted").filter(F.col(by) == branch)


def maintained(spark: SparkSession, root: str, deltas: DataFrame, branches: DataFrame, threshold: int = layers.COMPACT_FROM, keep: int = 2, by: str = "branch", id_col: str = "id") -> DataFrame:
    """What a scheduled run does, and the changes that are left: those of branches that are gone are dropped, a delta of more than `threshold` changes is compacted into a new version, old versions go."""
    live = deltas.join(branches.select(by), by, "left_semi").select(deltas.columns)
    done = compact(spark, root, live.drop(by), threshold, id_col)
    cleanup(spark, root, keep)
    return live.limit(0) if done else live


def committed(branch_delta: DataFrame, working_delta: DataFrame, id_col: str = "id") -> DataFrame:
    """What a commit leaves as the branch's changes: the working ones on top; the working changes are then empty."""
    return layers.merged(branch_delta, working_delta, id_col)


def pulled(old: DataFrame, new: DataFrame, compared: list[str], id_col: str = "id") -> DataFrame:
    """What a pull adds to a branch's changes: the differences of two snapshots as changes (id, op, payload)."""
    kinds = layers.snapshot_diff(old, new, id_col, compared)
    op = F.when(F.col("change") == "Added", "A").when(F.col("change") == "Deleted", "D").otherwise("M")
    return kinds.select(id_col, op.alias("op")).join(new, id_col, "left")
