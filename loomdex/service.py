"""The engine as functions: envelopes, search, ingest, snapshots of a library on shared storage."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import schemas
from .operators import library as L
from .storage import Change, Store, Version


def envelope_column(command: Column, result: Column) -> Column:
    """One JSON line for each row."""
    return F.to_json(F.struct(F.lit(True).alias("ok"), command.alias("command"), result.alias("result")))


def success(command: str, result: Any, hints: list[str] | None = None, meta: dict | None = None) -> dict:
    out = {"ok": True, "command": command, "result": result}
    if hints:
        out["nextActions"] = hints
    if meta:
        out["meta"] = meta
    return out


def failure(command: str, code: str, message: str, details: Any = None) -> dict:
    error = {"code": code, "message": message}
    if details is not None:
        error["details"] = details
    return {"ok": False, "command": command, "error": error}


def json_line(envelope: dict) -> str:
    return json.dumps(envelope, ensure_ascii=False, separators=(",", ":"), default=str)


SECRETS = ("apikey", "api_key", "token", "password", "secret", "authtoken")


def redact(value: Any) -> Any:
    """A configuration with the values of secret keys hidden, at any depth."""
    if isinstance(value, dict):
        return {k: "[redacted]" if k.lower() in SECRETS and v else redact(v) for k, v in value.items()}
    return [redact(v) for v in value] if isinstance(value, list) else value


#: The key by which rows of each table are replaced or removed.
KEYS = {
    "documents": "id",
    "chunks": "doc_id",
    "embeddings": "chunk_id",
    "concepts": "id",
    "concept_hierarchy": "concept_id",
    "concept_relations": "concept_id",
    "document_concepts": "doc_id",
    "concept_embeddings": "concept_id",
    "chunk_clusters": "chunk_id",
    "cluster_summaries": "id",
    "ingest_failures": "path",
    "library_metadata": "key",
}
#: Metadata that a refresh sets; the rest of a document's metadata stays.
REFRESHED = ("chunker", "visuals")


class NotFound(LookupError):
    """No document has that id or title."""


class Exists(ValueError):
    """A document that was to be added is there."""


class Library:
    """Tables of a knowledge base in a ``Store``: each change is atomic, and writers that do not touch the same rows do not wait for
    each other."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root, KEYS)

    def table(self, name: str, at: Version | None = None) -> DataFrame:
        rows = self.store.read(name, at, lambda df: schemas.migrate(df, name))
        return schemas.empty(self.spark, name) if rows is None else rows

    def _seen(self, change: Change, name: str, keys: DataFrame) -> DataFrame:
        rows = change.rows(name, keys, lambda df: schemas.migrate(df, name))
        return schemas.empty(self.spark, name) if rows is None else rows

    def commit(self, since: Version | None = None, **tables: DataFrame) -> Version:
        """All given tables are replaced together; a ``Conflict`` if one of them changed after the version ``since``."""
        for name, df in tables.items():
            schemas.verify(df, name)
        change = Change(self.store, since) if since else self.store.begin()
        for name, df in tables.items():
            change.replace(name, df.select(*schemas.schema(name).names))
        return change.commit()

    def replace_documents(self, documents: DataFrame, chunks: DataFrame, embeddings: DataFrame, mode: str = "add", source: tuple[str, int] | None = None) -> Version:
        """Documents with all their chunks and embeddings, in one step.

        ``add``: none of the documents may be there (``Exists``). ``refresh``: those that are not there are left out, with
        their chunks; size, pages, type and source hash become those given, nulls included, in metadata only ``REFRESHED``
        is set; title, path, tags and the time of addition stay. Either way old chunks go, with their embeddings.
        ``source`` (name, batch) makes a batch count once however often it is sent.
        """
        if mode not in ("add", "refresh"):
            raise ValueError(f"no such mode: {mode}")
        for name, df in (("documents", documents), ("chunks", chunks), ("embeddings", embeddings)):
            schemas.verify(df, name)

        def step(change: Change) -> None:
            if source:
                change.once(*source)
            ids = documents.select("id")
            old = self._seen(change, "documents", ids)
            if mode == "add":
                if there := [r.id for r in old.select("id").limit(5).collect()]:
                    raise Exists(f"already there: {', '.join(there)}")
                new, mine, vectors = documents, chunks, embeddings
            else:
                new = L.refresh(old, documents, REFRESHED, key="id")
                mine = chunks.join(old.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select(*chunks.columns)
                vectors = embeddings.join(mine.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi").select(*embeddings.columns)
            held = self._seen(change, "chunks", ids.toDF("doc_id"))
            change.put("documents", new.select(*schemas.schema("documents").names))
            change.put("chunks", mine.select(*schemas.schema("chunks").names), keys=ids.toDF("doc_id"))
            change.put("embeddings", vectors.select(*schemas.schema("embeddings").names), keys=held.select("id").union(mine.select("id")).toDF("chunk_id"))
            change.remove("chunk_clusters", held.select("id").toDF("chunk_id"))

        return self.store.change(step)

    def ingest(self, documents: DataFrame, chunks: DataFrame, embeddings: DataFrame, failures: DataFrame, source: tuple[str, int] | None = None) -> Version:
        """Adds the documents that are not there, with their chunks and embeddings, and notes the failed files, in one step.

        Of rows that share an id the one of the least path is taken. Totals of the version grow with it: added, skipped, failed,
        chunks. ``source`` (name, batch) makes a batch count once: sent again it changes nothing."""
        for name, df in (("documents", documents), ("chunks", chunks), ("embeddings", embeddings), ("ingest_failures", failures)):
            schemas.verify(df, name)
        one = documents.withColumn("_n", F.row_number().over(W.partitionBy("id").orderBy("path"))).where("_n = 1").drop("_n")

        def step(change: Change) -> None:
            if source:
                change.once(*source)
            there = self._seen(change, "documents", one.select("id")).select("id")
            change.put("documents", one.join(there, "id", "left_anti").select(*schemas.schema("documents").names))
            new = change.written("documents").select("id")
            change.put("chunks", chunks.join(new.toDF("doc_id"), "doc_id", "left_semi").select(*schemas.schema("chunks").names), keys=new.toDF("doc_id"))
            mine = change.written("chunks").select(F.col("id").alias("chunk_id"))
            change.put("embeddings", embeddings.join(mine, "chunk_id", "left_semi").select(*schemas.schema("embeddings").names))
            change.put("ingest_failures", failures.select(*schemas.schema("ingest_failures").names))
            n = new.count()
            change.add_to(added=n, skipped=one.count() - n, failed=change.written("ingest_failures").count(), chunks=mine.count())

        return self.store.change(step)

    def totals(self) -> dict:
        return dict.fromkeys(("added", "skipped", "failed", "chunks"), 0) | self.store.latest().totals

    def _found(self, change: Change, text: str) -> DataFrame:
        rows = change.table("documents", lambda df: schemas.migrate(df, "documents"))
        found = L.lookup(rows, text) if rows is not None else None
        row = found.first() if found is not None else None
        if row is None:
            raise NotFound(f"no document: {text}")
        return self.spark.createDataFrame([row], schemas.schema("documents"))

    def remove(self, text: str) -> DataFrame:
        """Removes the document of that id or title with all that hangs on it; gives its row as it was."""
        kept: list[DataFrame] = []

        def step(change: Change) -> None:
            row = self._found(change, text)
            ids = row.select("id")
            held = self._seen(change, "chunks", ids.toDF("doc_id")).select("id")
            change.remove("documents", ids)
            for name, keys in (("chunks", ids), ("document_concepts", ids), ("embeddings", held), ("chunk_clusters", held)):
                change.remove(name, keys)
            kept[:] = [row]

        self.store.change(step)
        return kept[0]

    def tag(self, text: str, tags: list[str]) -> DataFrame:
        """Sets the tags of the document of that id or title; gives its row as it was."""
        kept: list[DataFrame] = []

        def step(change: Change) -> None:
            row = self._found(change, text)
            change.put("documents", row.withColumn("tags", F.array(*[F.lit(t) for t in tags]).cast("array<string>")))
            kept[:] = [row]

        self.store.change(step)
        return kept[0]

    def reindex(self, text: str, embedder) -> dict:
        """Embeds all chunks of a document anew; its id, title, and how many chunks and embeddings."""
        out: dict = {}

        def step(change: Change) -> None:
            row = self._found(change, text)
            chunks = self._seen(change, "chunks", row.select("id").toDF("doc_id"))
            vectors = embed(chunks, embedder)
            change.put("embeddings", vectors)
            n = chunks.count()
            if not n:
                raise NotFound(f"no chunks found for document {row.first().id}")
            out.update(docId=row.first().id, title=row.first().title, chunks=n, embeddings=n)

        self.store.change(step)
        return out


class HashingEmbedder:
    """Deterministic vectors without a model: signed hashes of words, to unit length."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def __call__(self, texts: list[str]) -> list[list[float]]:
        import hashlib

        out = []
        for t in texts:
            v = [0.0] * self.dims
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % self.dims] += 1.0 if h >> 63 else -1.0
            n = sum(x * x for x in v) ** 0.5
            out.append([x / n for x in v] if n else [1.0] + v[1:])
        return out


def embed(chunks: DataFrame, embedder, text: str = "embedding_content", batch: int = 20) -> DataFrame:
    """(chunk_id, embedding) of all chunks (id, text), in batches; any invalid vector fails the job, so nothing is half done."""
    import math

    import pandas as pd

    def run(frames):
        dims = None
        for f in frames:
            for a in range(0, len(f), batch):
                part = f.iloc[a : a + batch]
                vectors = embedder(part[text].tolist())
                for v in vectors:
                    dims = dims or len(v)
                    if not v or len(v) != dims or not all(map(math.isfinite, v)):
                        raise ValueError("the embedder gave an invalid vector")
                yield pd.DataFrame({"chunk_id": part["id"], "embedding": vectors})

    return chunks.select("id", text).mapInPandas(run, "chunk_id string, embedding array<float>")
