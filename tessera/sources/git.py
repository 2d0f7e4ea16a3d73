"""Tables of a Git repository: changed files between two branches, and files with their contents at a commit. Git itself is run on the driver; contents are read where the rows are."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

CHANGES = "path string, status string, renamed_from string"
#: Paths whose contents one task reads.
TASK_FILES = 200


def _run(repository: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repository, *args], check=True, capture_output=True, text=True).stdout


def merge_base(repository: str, one: str, other: str) -> str:
    return _run(repository, "merge-base", one, other).strip()


def changed_files(spark: SparkSession, repository: str, target: str, source: str) -> DataFrame:
    """path, status (A, M, D, R), renamed_from of what the source branch changed since it left the target branch."""
    fields = _run(repository, "diff", "--name-status", "-z", "-M", merge_base(repository, target, source), source).split("\0")
    rows, at = [], 0
    while at < len(fields) - 1:
        status = fields[at][0]
        moved = status in "RC"
        rows.append((fields[at + 1 + moved], status, fields[at + 1] if moved else None))
        at += 2 + moved
    return spark.createDataFrame(rows, CHANGES)


def files(spark: SparkSession, repository: str, commit: str) -> DataFrame:
    """path, content of all files at a commit. The repository must be at the same path on all executors; contents that are not UTF-8 have marks for what can't be read."""
    paths = [p for p in _run(repository, "ls-tree", "-r", "--name-only", "-z", commit).split("\0") if p]
    resolved = _run(repository, "rev-parse", commit).strip()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [subprocess.run(["git", "-C", repository, "show", f"{resolved}:{p}"], check=True, capture_output=True).stdout.decode("utf-8", "replace") for p in batch["path"]]
            yield pd.DataFrame({"path": batch["path"], "content": texts})

    listed = spark.createDataFrame([(p,) for p in paths], "path string")
    return listed.repartition(max(1, len(paths) // TASK_FILES)).mapInPandas(read, "path string, content string")
