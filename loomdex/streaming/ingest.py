"""Streaming ingest and event windows (an extension: the batch engine has no streams of its own)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import filename
from ..functions.text import clean_title, filename_tags
from ..operators.chunking import chunked
from ..operators.library import number_chunks
from ..plans.session import stored
from ..service import Library, embed
from ..sources.files import parsed
from ..storage import AlreadyDone


def document_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 20) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def ingest(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs all that is there through ``handle`` in gated batches, each once, and stops. Batches carry on after a failure."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def file_stream(spark: SparkSession, path: str, glob: str = "*", files_per_trigger: int | None = None, bytes_per_trigger: int | None = None) -> DataFrame:
    """Files as they come (path, content, length), so many or so many bytes of them in a batch. Spark leaves out files of no bytes."""
    r = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
    r = r.option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    if bytes_per_trigger:
        r = r.option("maxBytesPerTrigger", bytes_per_trigger)
    elif files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.load(path)


def prepared(files: DataFrame, embedder, pdf=None, size: int = 2000, overlap: int = 200) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Documents, chunks, embeddings and failures of files (path, content). A file without text is a failure.

    Files are parsed and chunks embedded once: both are stored before they are used again."""
    rows = stored(parsed(files, pdf, empty=True), "parsed")
    good, bad = rows.where("section is not null"), rows.where("section is null")
    failures = bad.select("path", F.coalesce("error", F.lit("no text")).alias("error"), F.col("sha256").alias("source_hash"))
    name = filename(F.col("path"))
    none = lambda kind: F.lit(None).cast(kind)
    docs = good.groupBy("id", "path", "file_type", "sha256").agg(F.max("section").alias("page_count"), F.sum(F.octet_length("text")).alias("size_bytes"))
    docs = docs.select("id", clean_title(name).alias("title"), "path", none("timestamp").alias("added_at"), "page_count", "size_bytes", filename_tags(name).alias("tags"), "file_type", none("string").alias("metadata"), F.lit("sha256").alias("source_hash_algorithm"), F.col("sha256").alias("source_hash"))
    place = F.split("place", "#")
    cut = chunked(good.select(F.concat_ws("#", "id", "section").alias("place"), "text"), "place", "text", size, overlap)
    cut = number_chunks(cut.select(place[0].alias("doc_id"), place[1].cast("int").alias("page"), "chunk_index", "content"))
    chunks = stored(cut.select(F.col("chunk_id").alias("id"), "doc_id", "page", "chunk_index", "content", F.col("content").alias("embedding_content")), "chunks")
    return docs, chunks, stored(embed(chunks, embedder), "embeddings"), failures


def library_sink(library: Library, prepare: Callable[[DataFrame], tuple], name: str) -> Callable[[DataFrame, int], None]:
    """A handler for ``ingest``: each batch is one commit under (name, batch number), so a batch that is sent again after a failure
    between its commit and the stream's own log adds nothing twice, and one that failed before its commit left nothing."""

    def handle(batch: DataFrame, number: int) -> None:
        done = library.store.latest().done.get(name, -1)
        if number <= done:
            return
        try:
            library.ingest(*prepare(batch), source=(name, number))
        except AlreadyDone:
            pass

    return handle


def new_paths(stream: DataFrame, at: str, late: str = "1 hour") -> DataFrame:
    """The first row of each path within the time that rows may be late."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(["path"])


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Counts and sums by event type and hour; rows later than ``late`` are not counted."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.col("w.start").alias("hour"), "n", "total")
