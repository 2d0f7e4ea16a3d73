"""Every query with SQL against DuckDB on the smallest tables; the others run."""

import os

import pytest

from tests.oracle import assert_same, connect
from tessera.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    assert_same(QUERIES[name](spark, SF), duck, ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns == ["vec_id", "similarity", "rank"] and out.count() == 20
    assert set(ORACLES) <= set(QUERIES)


def test_lsh_recall_against_brute_force(spark):
    import numpy as np

    e = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    x = np.array(e.embedding.tolist(), float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = e.vec_id.to_numpy()
    got = {}
    for r in QUERIES["lsh_topk"](spark, SF).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    asked = [i for i in ids if i % 20 == 0]
    assert set(got) == set(asked) and len(asked) > 1
    recall = []
    for i in asked:
        best = ids[np.argsort(-(x @ x[ids == i][0]), kind="stable")[:10]]
        recall.append(len(got[i] & set(best)) / 10)
    assert np.mean(recall) >= 0.9


def test_entry_without_the_training_data_operators(tmp_path):
    """The other queries stay if the subpackage and the pipeline are deleted; an error in it would not be hidden."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    show = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    run = lambda: subprocess.run([sys.executable, "-c", show], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert run().stdout.split() == [str(len(QUERIES)), str(len(ORACLES))]
    (tmp_path / "tessera/llm").mkdir()
    (tmp_path / "tessera/llm/__init__.py").touch()
    (tmp_path / "tessera/llm/oracles.py").write_text("import no_such_module")
    (tmp_path / "tessera/llm/queries.py").touch()
    assert "no_such_module" in run().stderr
