"""Ingest as a stream into a library: batches count once, totals are those of all files at once."""

import pytest
from pyspark.sql import functions as F

from loomdex.service import HashingEmbedder, Library
from loomdex.streaming import ingest as I


@pytest.fixture
def folder(tmp_path):
    at = tmp_path / "in"
    (at / "sub").mkdir(parents=True)
    for k in range(7):
        (at / f"note_{k}.txt").write_text(f"Note {k} on storage.\n\n" + "Some more words. " * 30 * k)
    (at / "sub" / "paper.md").write_text("# One\n\nfirst part\n\n# Two\n\nsecond part\n")
    (at / "empty.txt").write_text(" \n\n")
    (at / "broken.docx").write_bytes(b"PK\x03\x04 not a package")
    return str(at)


def prepare(batch):
    return I.prepared(batch, HashingEmbedder(4), size=300, overlap=50)


def content(lib):
    return {n: sorted(map(str, lib.table(n).collect())) for n in ("documents", "chunks", "embeddings", "ingest_failures")}


def test_a_stream_gives_what_a_batch_gives(spark, tmp_path, folder):
    whole, streamed = (Library(spark, f"file://{tmp_path}/{n}") for n in ("whole", "streamed"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    whole.ingest(*prepare(files))
    run = lambda: I.ingest(I.file_stream(spark, folder, files_per_trigger=3), I.library_sink(streamed, prepare, "notes"), f"{tmp_path}/cp").awaitTermination(120)
    run()
    assert whole.totals() == streamed.totals() | {"skipped": 0}
    assert whole.totals()["added"] == 8 and whole.totals()["failed"] == 2 and whole.totals()["chunks"] == whole.table("chunks").count() > 9
    assert content(whole) == content(streamed)
    assert {r.path.rsplit("/", 1)[1]: r.error == "no text" for r in streamed.table("ingest_failures").collect()} == {"empty.txt": True, "broken.docx": False}
    # nothing new: nothing changes; the same files from another source are skipped
    last = streamed.store.latest().number
    run()
    assert streamed.store.latest().number == last
    streamed.ingest(*prepare(files), source=("again", 0))
    assert streamed.totals()["skipped"] == 8 and content(whole)["documents"] == content(streamed)["documents"]


def test_a_batch_sent_again_changes_nothing(spark, tmp_path, folder):
    lib = Library(spark, f"file://{tmp_path}/lib")
    files = spark.read.format("binaryFile").load(f"{folder}/note_*.txt")
    handle = I.library_sink(lib, prepare, "s")
    # a writer that died after its rows and before its commit
    dead = lib.store.begin()
    dead.put("documents", prepare(files)[0])
    handle(files, 0)
    before, number = content(lib), lib.store.latest().number
    handle(files, 0)
    assert content(lib) == before and lib.store.latest().number == number and lib.totals()["added"] == 7
    handle(files.limit(0), 1)
    assert content(lib) == before


def test_admission_by_bytes(spark, tmp_path, folder):
    seen = []
    I.ingest(I.file_stream(spark, folder, glob="note_*", bytes_per_trigger=2500), lambda df, i: seen.append(df.agg(F.count("*"), F.sum("length")).first()), f"{tmp_path}/cp").awaitTermination(60)
    assert sum(n for n, _ in seen) == 7 and len(seen) > 2 and all(size <= 2500 or n == 1 for n, size in seen)
