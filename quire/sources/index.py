"""The stored vector index: chunks with unit vectors, a document at a time, in a versioned table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from quire.functions.geometry import normalised
from quire.sources.versioned import BUCKETS, Store


class VectorIndex:
    """chunks(doc_id, ord, embedding, ...) of many documents. What was loaded stays cached until the store has a new version."""

    def __init__(self, store: Store, name: str = "chunks"):
        self.store, self.name = store, name
        self._cached: dict[object, DataFrame] = {}
        self._version = 0

    def build(self, chunks: DataFrame, buckets: int = BUCKETS) -> int:
        """The documents in chunks replace their own part, with vectors of length 1 (or 0) as floats; others stay. Returns the version.

        ValueError without chunks, with a vector that is null, empty or holds something that is no number, or with vectors of several sizes.
        """
        rows = chunks.withColumn("embedding", normalised(F.col("embedding")).cast("array<float>"))
        bad = F.col("embedding").isNull() | F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
        n, n_bad, least, most = rows.agg(F.count("*"), F.count_if(bad | (F.size("embedding") == 0)), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
        if not n:
            raise ValueError("no chunks to index")
        if n_bad or least != most:
            raise ValueError(f"{n_bad} chunks have no vector, sizes are from {least} to {most}")
        fields = StructType([StructField(f.name, ArrayType(FloatType()) if f.name == "embedding" else f.dataType) for f in chunks.schema])
        with self.store.change() as c:
            c.create(self.name, fields, "doc_id", buckets)
            stored = self.store._rows(self.name, c.tables[self.name]).select(F.size("embedding")).first()
            if stored and stored[0] != least:
                raise ValueError(f"vectors have size {least}, those of the index {stored[0]}")
            c.replace(self.name, rows)
        return self.store.version

    def load(self, doc_id: object | None = None) -> DataFrame:
        """One document's chunks (its bucket alone is read), or all: from the cache, else from disk; FileNotFoundError if there are none."""
        version = self.store.version
        if version != self._version:
            self.close()
            self._version = version
        if doc_id not in self._cached:
            if self.name not in self.store.tables(version):
                raise FileNotFoundError("nothing is indexed")
            rows = self.store.read(self.name, version) if doc_id is None else self.store.read_key(self.name, doc_id, version)
            if rows.isEmpty():
                raise FileNotFoundError(f"no index of document {doc_id}")
            self._cached[doc_id] = rows.cache()
        return self._cached[doc_id]

    def close(self) -> None:
        for rows in self._cached.values():
            rows.unpersist()
        self._cached = {}
