"""Table schemas of a knowledge base, their creation, migration and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DDL = {
    "documents": "id string, title string, path string, added_at timestamp, page_count int, size_bytes bigint, tags array<string>, file_type string, metadata string, source_hash_algorithm string, source_hash string",
    "chunks": "id string, doc_id string, page int, chunk_index int, content string, embedding_content string",
    "embeddings": "chunk_id string, embedding array<float>",
    "concepts": "id string, pref_label string, alt_labels array<string>, definition string, created_at timestamp",
    "concept_hierarchy": "concept_id string, broader_id string",
    "concept_relations": "concept_id string, related_id string, relation_type string",
    "document_concepts": "doc_id string, concept_id string, confidence double, source string",
    "concept_embeddings": "concept_id string, embedding array<float>",
    "chunk_clusters": "chunk_id string, cluster_id int, distance double, created_at timestamp",
    "cluster_summaries": "id int, centroid array<float>, summary string, embedding array<float>, concept_id string, concept_confidence double, chunk_count int, created_at timestamp",
    "ingest_failures": "path string, error string, source_hash string",
    "library_metadata": "key string, value string, updated_at timestamp",
}
FILE_TYPES = ("pdf", "markdown", "docx", "odt", "txt")


class SchemaError(ValueError):
    """A table does not have the columns or types that it must have."""


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[name])


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schema(name))


def migrate(df: DataFrame, name: str) -> DataFrame:
    """Adds what an older table lacks, filled in from what it has, and orders the columns."""
    fill = {
        ("documents", "file_type"): lambda: F.expr("case when lower(path) rlike '[.](md|markdown)$' then 'markdown' when lower(path) like '%.docx' then 'docx' when lower(path) rlike '[.](odt|fodt)$' then 'odt' when lower(path) like '%.txt' then 'txt' else 'pdf' end"),
        ("chunks", "embedding_content"): lambda: F.col("content"),
    }
    for field in schema(name):
        if field.name not in df.columns:
            make = fill.get((name, field.name))
            df = df.withColumn(field.name, (make() if make else F.lit(None)).cast(field.dataType))
    return df.select(*[f.name for f in schema(name)])


def verify(df: DataFrame, name: str) -> DataFrame:
    """``df`` itself, or an error that names every column that is missing or of another type."""
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f"{f.name}: {have.get(f.name, 'missing')}" for f in schema(name) if f.name not in have or have[f.name].simpleString() != f.dataType.simpleString()]
    if wrong:
        raise SchemaError(f"{name}: incompatible schema ({', '.join(wrong)})")
    return df


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """The keys that are not unique, with their counts: Spark itself checks no uniqueness."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def dimension(embeddings: DataFrame, column: str = "embedding") -> int | None:
    """The one size of all vectors; None for an empty table; an error if sizes differ."""
    low, high = embeddings.agg(F.min(F.size(column)), F.max(F.size(column))).first()
    if low != high:
        raise SchemaError(f"vectors of {low} to {high} dimensions in one table")
    return low
