"""A vector store behind one-line JSON requests: index_code, index_batch, search_similar, get_status and clear."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import vector
from tessera.sources import versions

STORE = "id string, content string, metadata string, embedding array<double>"


class VectorService:
    """Rows (id, content, metadata, embedding) in a versioned table at root; each request that writes makes a version, and `keep` of them stay."""

    def __init__(self, spark: SparkSession, root: str, embedder: Callable[[Column], Column] = vector.embed, dimensions: int = 384, keep: int = 2):
        self.spark, self.root, self.embedder, self.dimensions, self.keep = spark, root, embedder, dimensions, keep

    def rows(self) -> DataFrame:
        there = versions.listed(self.spark, self.root).limit(1).count()
        return versions.current(self.spark, self.root) if there else self.spark.createDataFrame([], STORE)

    def _write(self, rows: DataFrame) -> None:
        versions.create(rows, self.root)
        versions.cleanup(self.spark, self.root, self.keep)

    def _index(self, items: list[dict]) -> dict:
        given = [(str(x["id"]), x["content"], json.dumps(x.get("metadata")), n) for n, x in enumerate(items)]
        new = self.spark.createDataFrame(given, "id string, content string, metadata string, nth long")
        made = vector.embed_once(new, "content", self.embedder)
        self._write(vector.upsert(self.rows(), made, "id", "nth"))
        return {"count": len(items)}

    def _search(self, content: str, limit: int, floor: float) -> dict:
        query = vector.embed_once(self.spark.createDataFrame([(content,)], "content string"), "content", self.embedder).first()["embedding"]
        found = vector.top_k(self.rows(), query, limit, floor, id_col="id")
        return {"hits": [{"id": r.id, "similarity": r.similarity, "content": r.content, "metadata": json.loads(r.metadata)} for r in found.orderBy("rank").collect()]}

    def answer(self, line: str) -> str:
        """The answer to a request, as one line; ok is False, with the error, where it could not be met."""
        try:
            request = json.loads(line)
            command = request["command"]
            if command == "index_code":
                out = self._index([request])
            elif command == "index_batch":
                out = self._index(request["items"])
            elif command == "search_similar":
                out = self._search(request["content"], int(request.get("limit", 10)), float(request.get("floor", 0.0)))
            elif command == "get_status":
                out = {"count": self.rows().count(), "dimensions": self.dimensions}
            elif command == "clear":
                self._write(self.rows().limit(0))
                out = {"count": 0}
            else:
                raise ValueError(f"no such command: {command}")
        except (KeyError, TypeError, ValueError) as e:
            return json.dumps({"ok": False, "error": str(e)})
        return json.dumps({"ok": True} | out)
