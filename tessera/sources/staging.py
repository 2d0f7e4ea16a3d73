"""Where intermediate tables go."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share. Where it is unset, a temporary folder stands in, but only if there is no other machine; a cluster without one is an error."""
    sc = spark.sparkContext
    own = sc._jsc.sc().getCheckpointDir()
    found = spark.conf.get("spark.checkpoint.dir", None) or (own.get() if own.isDefined() else None)
    if found:
        return found.rstrip("/")
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once into the shared folder, where the loss of an executor doesn't reach it."""
    sc = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """df written as Parquet into the shared folder and read again, and its path for `removed`: for rows whose columns repeat, which Parquet folds."""
    path = f"{shared_folder(df.sparkSession)}/tessera-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Deletes what was written at path."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def released(spark: SparkSession) -> None:
    """Has the driver look for tables that nothing refers to any more, so that Spark deletes their shuffles; those of a table since checkpointed would stay otherwise."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ship_code(spark) -> None:
    """Sends this package to the executors, once a session, so that Python functions find it there whatever their path."""
    import io
    import os
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, str(Path(package.name) / f.relative_to(package)))
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-"), f"{package.name}.zip")
    Path(path).write_bytes(data.getvalue())
    sc.addPyFile(path)
    sc._tessera_shipped = True
