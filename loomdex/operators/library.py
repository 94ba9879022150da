"""The library's tables: counts, orphans, edits as new snapshots, audits and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.session import stored


#: What a refresh may set; title, path, tags and time of addition stay.
REFRESH = ("page_count", "size_bytes", "file_type", "source_hash_algorithm", "source_hash")


def stats(documents: DataFrame, chunks: DataFrame, embeddings: DataFrame | None) -> DataFrame:
    """One row: how many documents, chunks, embeddings (0 without that table)."""
    n = documents.agg(F.count("*").alias("documents")).join(chunks.agg(F.count("*").alias("chunks")), F.lit(True))
    if embeddings is None:
        return n.withColumn("embeddings", F.lit(0).cast("long"))
    return n.join(embeddings.agg(F.count("*").alias("embeddings")), F.lit(True))


def chunks_per_document(ids: DataFrame, chunks: DataFrame) -> DataFrame:
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    return ids.select("doc_id").join(n, "doc_id", "left").select("doc_id", F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks"))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows whose parent is missing (a null key has none)."""
    return child.join(parent.select(F.col(parent_key).alias("__p")).distinct(), F.col(child_key) == F.col("__p"), "left_anti")


def by_tag(documents: DataFrame, *tags: str) -> DataFrame:
    """Documents with any of the tags."""
    return documents.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))


def newest_first(documents: DataFrame) -> DataFrame:
    """All documents of a listing by time of addition, the last first and the least id first of several, with their ``place``. A
    listing is what a reader is shown: it is sorted as a whole, and numbered by the sort's own order."""
    return numbered(documents, F.desc("added_at"), F.asc("id"))


def numbered(rows: DataFrame, *order) -> DataFrame:
    """Rows with ``place``, from 1, in a total order: range partitions are numbered each, and shifted by the sizes of those before."""
    s = rows.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("long"), 33))
    s = stored(s, "numbered")
    sizes = s.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    return s.join(F.broadcast(before), "_part").withColumn("place", (F.col("_before") + F.col("_at") + 1).cast("int")).drop("_part", "_at", "_before")


def lookup(documents: DataFrame, text: str, newest: str = "added_at") -> DataFrame:
    """The document of that id, else the newest whose title holds the text in any case or whose id starts with it."""
    exact = documents.where(F.col("id") == text).withColumn("__rank", F.lit(0))
    near = documents.where((F.col("id") != text) & (F.contains(F.lower("title"), F.lit(text.lower())) | F.startswith("id", F.lit(text)))).withColumn("__rank", F.lit(1))
    return exact.unionByName(near).orderBy("__rank", F.desc(newest), "id").limit(1).drop("__rank")


def chunks_of(chunks: DataFrame, doc_id, page: int | None = None) -> DataFrame:
    out = chunks.where(F.col("doc_id") == doc_id)
    return (out.where(F.col("page") == page) if page is not None else out).orderBy("page", "chunk_index")


def page_text(chunks: DataFrame, separator: str = "\n\n") -> DataFrame:
    """(doc_id, page, text): the page's chunks in order, joined. A page is bounded by its document."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "content")))
    return chunks.groupBy("doc_id", "page").agg(F.array_join(F.transform(parts, lambda s: s["content"]), separator).alias("text"))


def number_chunks(chunks: DataFrame) -> DataFrame:
    """Chunk ids from their place in the document: <doc_id>-<ordinal from 0>."""
    w = W.partitionBy("doc_id").orderBy("page", "chunk_index")
    return chunks.withColumn("ordinal", F.row_number().over(w) - 1).withColumn("chunk_id", F.concat_ws("-", "doc_id", "ordinal"))


def append_after(chunks: DataFrame, more: DataFrame) -> DataFrame:
    """``more`` (doc_id, seq, content) with chunk indexes that go on after each document's last."""
    last = chunks.groupBy("doc_id").agg(F.max("chunk_index").alias("last"))
    w = W.partitionBy("doc_id").orderBy("seq")
    return more.join(last, "doc_id", "left").withColumn("chunk_index", F.coalesce(F.col("last") + 1, F.lit(0)) + F.row_number().over(w) - 1).drop("last")


def delete_documents(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """All tables without the documents and what hangs on them. ``ids``: doc_id."""
    out = dict(tables)
    out["documents"] = tables["documents"].join(ids, "doc_id", "left_anti")
    out["chunks"] = tables["chunks"].join(ids, "doc_id", "left_anti")
    for name in ("embeddings", "chunk_clusters"):
        if name in tables:
            out[name] = tables[name].join(out["chunks"].select("chunk_id"), "chunk_id", "left_semi")
    if "document_concepts" in tables:
        out["document_concepts"] = tables["document_concepts"].join(ids, "doc_id", "left_anti")
    return out


def json_put(text, **values):
    """A JSON object with some of its fields set to JSON values, and the others as they are whatever they nest; null and what is no
    object count as the empty object, a null value puts a JSON null."""
    fields = F.coalesce(F.try_parse_json(text).try_cast("map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))
    kept = F.map_filter(fields, lambda k, _: ~k.isin(*values))
    put = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.coalesce(F.try_parse_json(v), F.parse_json(F.lit("null"))))])
    return F.to_json(F.to_variant_object(F.map_concat(kept, put)))


def refresh(documents: DataFrame, new: DataFrame, metadata: tuple[str, ...] = (), key: str = "doc_id") -> DataFrame:
    """Documents with what ``new`` gives of the fields a refresh sets, nulls included; all other fields, and documents that ``new``
    does not have, stay. Of the metadata only the named JSON fields are set, to null where ``new`` has none."""
    fields = [c for c in REFRESH if c in new.columns and c in documents.columns]
    given = new.select(key, F.lit(True).alias("__given"), *[F.col(c).alias(f"__{c}") for c in (*fields, *(("metadata",) if metadata else ()))])
    out = documents.join(given, key, "left")
    put = {c: F.when(F.col("__given"), F.col(f"__{c}")).otherwise(F.col(c)) for c in fields}
    if metadata:
        theirs = F.try_parse_json("__metadata")
        values = {m: F.to_json(F.try_variant_get(theirs, f"$.{m}", "variant")) for m in metadata}
        put["metadata"] = F.when(F.col("__given"), json_put(F.col("metadata"), **values)).otherwise(F.col("metadata"))
    return out.withColumns(put).select(*documents.columns)


def set_tags(documents: DataFrame, doc_id, tags: list[str]) -> DataFrame:
    return documents.withColumn("tags", F.when(F.col("doc_id") == doc_id, F.array(*[F.lit(t) for t in tags])).otherwise(F.col("tags")))


def relocate(documents: DataFrame, doc_id, path: str, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """The new table, and one report row: old and new path and whether anything changed."""
    here = F.col("doc_id") == doc_id
    report = documents.where(here).select("doc_id", F.col("path").alias("old_path"), F.lit(path).alias("new_path"), (F.lit(not dry_run) & (F.col("path") != path)).alias("changed"))
    return (documents if dry_run else documents.withColumn("path", F.when(here, F.lit(path)).otherwise(F.col("path")))), report


def postings(chunks: DataFrame) -> DataFrame:
    """(term, chunk_id, doc_id, position) of a full-text index."""
    from .retrieval import tokens

    return chunks.select("chunk_id", "doc_id", F.posexplode(tokens(F.col("content"))).alias("position", "term"))


def maintain_postings(index: DataFrame, chunks: DataFrame, changed: DataFrame) -> DataFrame:
    """The index after the documents in ``changed`` (doc_id) were inserted, edited or deleted: only theirs are computed anew."""
    return index.join(changed, "doc_id", "left_anti").unionByName(postings(chunks.join(changed, "doc_id", "left_semi")).select(*index.columns))


HASH = "^[0-9a-f]{64}$"


def identity_status(algorithm, digest):
    """missing if both are null, valid for sha256 and 64 small hex digits, else invalid."""
    return F.when(algorithm.isNull() & digest.isNull(), "missing").when((algorithm == "sha256") & digest.rlike(HASH), "valid").otherwise("invalid")


def audit_sources(stored: DataFrame, current: DataFrame) -> DataFrame:
    """doc_id, issue: one of unreadable, identity_missing, identity_invalid, hash_mismatch, size_mismatch, ok.

    ``stored`` (doc_id, algorithm, digest, size_bytes); ``current`` (doc_id, digest, size_bytes), a row for each readable source."""
    c = current.select("doc_id", F.col("digest").alias("now"), F.col("size_bytes").alias("now_bytes"))
    status = identity_status(F.col("algorithm"), F.col("digest"))
    issue = F.when(F.col("now").isNull(), "unreadable").when(status == "missing", "identity_missing").when(status == "invalid", "identity_invalid").when(F.col("digest") != F.col("now"), "hash_mismatch").when(F.col("size_bytes") != F.col("now_bytes"), "size_mismatch").otherwise("ok")
    return stored.join(c, "doc_id", "left").select("doc_id", issue.alias("issue"))


def assess_chunker(meta, chunker_id: str, version: int, size: int, overlap: int):
    """ok, or the first fault of a document's chunker metadata (a JSON string)."""
    m = F.from_json(meta, "struct<id string, version int, config struct<unit string, chunkSize int, chunkOverlap int>>")
    bad = m.isNull() | m.id.isNull() | m.version.isNull() | m.config.isNull() | (F.coalesce(m.config.unit, F.lit("")) != "chars") | m.config.chunkSize.isNull() | m.config.chunkOverlap.isNull()
    return F.when(bad, "missing_metadata").when((m.id != chunker_id) | (m.version != version), "id_version_mismatch").when((m.config.chunkSize != size) | (m.config.chunkOverlap != overlap), "config_mismatch").otherwise("ok")


def rechunk_plan(docs: DataFrame, include_all: bool = False, include_missing: bool = False) -> DataFrame:
    """doc_id, include, reason of each row of (doc_id, chunker, identity, issue, visuals_stale).

    Of several reasons the first counts: source changed, identity invalid, identity missing (if asked for), visuals, chunker."""
    reason = (
        F.when(F.col("issue").isin("hash_mismatch", "size_mismatch"), "source_changed")
        .when(F.col("identity") == "invalid", "identity_invalid")
        .when((F.col("identity") == "missing") & F.lit(include_missing), "identity_missing")
        .when(F.col("visuals_stale"), "visuals_stale")
        .when(F.col("chunker") != "ok", F.col("chunker"))
    )
    return docs.select("doc_id", (reason.isNotNull() | F.lit(include_all)).alias("include"), F.coalesce(reason, F.when(F.lit(include_all), "all"), F.lit("up_to_date")).alias("reason"))


def health(checks: DataFrame) -> DataFrame:
    """One row from (name, ok): checks, failed, healthy."""
    return checks.agg(F.count("*").alias("checks"), F.count(F.when(~F.col("ok"), 1)).alias("failed"), F.every("ok").alias("healthy"))


def cap_images(images: DataFrame, max_bytes: int, most: int) -> DataFrame:
    """Images not too large, the first of each hash in a document, at most so many of a document. (doc_id, seq, hash, byte_size)"""
    fit = images.where(F.col("byte_size") <= max_bytes)
    first = fit.withColumn("n", F.row_number().over(W.partitionBy("doc_id", "hash").orderBy("seq"))).where("n = 1")
    return first.withColumn("n", F.row_number().over(W.partitionBy("doc_id").orderBy("seq"))).where(F.col("n") <= most).drop("n")


def select_paths(found: DataFrame, excluded: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Distinct found paths of all roots that no root excludes and that are not there yet."""
    out = found.select("path").distinct().join(excluded.select("path"), "path", "left_anti")
    return out.join(existing.select("path"), "path", "left_anti") if existing is not None else out


def selection_counts(found: DataFrame, excluded: DataFrame, selected: DataFrame) -> DataFrame:
    one = found.agg(F.countDistinct("path").alias("discovered")).join(excluded.agg(F.countDistinct("path").alias("excluded")), F.lit(True))
    return one.join(selected.agg(F.count("*").alias("selected")), F.lit(True))
