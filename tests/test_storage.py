"""Atomic changes with several writers, and what a library does with them."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from loomdex import schemas
from loomdex.operators import library as L
from loomdex.service import Exists, HashingEmbedder, Library, NotFound, embed
from loomdex.storage import AlreadyDone, Change, Conflict, Store


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/s", {"t": "k", "u": "k"})


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k long, v string")


def keys(spark, *ks):
    return spark.createDataFrame([(k,) for k in ks], "k long")


def held(store, name="t", at=None):
    df = store.read(name, at)
    return None if df is None else sorted((r.k, r.v) for r in df.collect())


def test_rows_replace_those_of_their_key(spark, store):
    assert held(store) is None and store.latest().number == 0
    one = store.change(lambda c: c.put("t", rows(spark, (1, "a"), (1, "b"), (2, "c"))))
    store.change(lambda c: c.put("t", rows(spark, (1, "d"))))
    store.change(lambda c: c.remove("t", keys(spark, 2)))
    store.change(lambda c: c.put("t", rows(spark, (2, "e"), (3, "f"))))
    assert held(store) == [(1, "d"), (2, "e"), (3, "f")]
    assert held(store, at=one) == [(1, "a"), (1, "b"), (2, "c")]
    store.compact()
    assert held(store) == [(1, "d"), (2, "e"), (3, "f")] and len(store.latest().tables["t"]["parts"]) == 1
    assert store.vacuum(keep=1, hours=24) == []
    assert len(store.vacuum(keep=1, hours=-1)) > 3 and held(store) == [(1, "d"), (2, "e"), (3, "f")]


def test_writers_of_other_keys_do_not_conflict(spark, store):
    store.change(lambda c: c.put("t", rows(spark, (1, "a"), (2, "b"), (3, "c"))))
    one, two, three = store.begin(), store.begin(), store.begin()
    one.put("t", rows(spark, (1, "A")))
    two.put("t", rows(spark, (2, "B")))
    three.put("u", rows(spark, (1, "other table")))
    two.commit()
    one.commit()
    three.commit()
    assert held(store) == [(1, "A"), (2, "B"), (3, "c")] and held(store, "u") == [(1, "other table")]


def test_writers_of_the_same_keys_conflict(spark, store):
    store.change(lambda c: c.put("t", rows(spark, (1, "a"), (2, "b"))))
    one, two = store.begin(), store.begin()
    one.put("t", rows(spark, (1, "one")))
    two.remove("t", keys(spark, 1))
    one.commit()
    with pytest.raises(Conflict, match="same rows"):
        two.commit()
    # what was read counts too: some keys, or the whole table
    some, whole, fine = store.begin(), store.begin(), store.begin()
    assert [r.v for r in some.rows("t", keys(spark, 2)).collect()] == ["b"]
    whole.table("t")
    fine.rows("t", keys(spark, 1))
    store.change(lambda c: c.put("t", rows(spark, (2, "now"))))
    for change in (some, whole, fine):
        change.put("u", rows(spark, (9, "result")))
    for change in (some, whole):
        with pytest.raises(Conflict):
            change.commit()
    fine.commit()
    replaced, late = store.begin(), store.begin()
    replaced.replace("t", rows(spark, (7, "all")))
    late.put("t", rows(spark, (8, "late")))
    replaced.commit()
    with pytest.raises(Conflict):
        late.commit()
    assert held(store) == [(7, "all")]


def test_a_conflict_runs_the_change_again(spark, store):
    store.change(lambda c: c.put("t", rows(spark, (1, "a"))))
    tries = []

    def add(letter):
        def step(change):
            old = change.rows("t", keys(spark, 1)).first().v
            if not tries:
                tries.append(letter)
                store.change(add("x"))
            change.put("t", rows(spark, (1, old + letter)))

        return step

    store.change(add("y"))
    assert held(store) == [(1, "axy")]


def test_many_writers_lose_nothing(spark, store):
    store.change(lambda c: c.put("t", rows(spark, (0, ""))))

    def count(k):
        def step(change):
            old = change.rows("t", keys(spark, 0)).first().v
            change.put("t", rows(spark, (0, old + str(k)), (k, "own")))
            change.add_to(n=1)

        store.change(step, attempts=30)

    threads = [threading.Thread(target=count, args=(k,)) for k in range(1, 6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got = dict(held(store))
    assert sorted(got.pop(0)) == list("12345") and got == {k: "own" for k in range(1, 6)}
    assert store.latest().totals == {"n": 5}


def test_a_batch_counts_once(spark, store):
    def batch(k):
        def step(change):
            change.once("stream", k)
            change.put("t", rows(spark, (k, "x")))

        return step

    store.change(batch(0))
    store.change(batch(1))
    for k in (0, 1):
        with pytest.raises(AlreadyDone):
            store.change(batch(k))
    early = store.begin()
    batch(2)(early)
    store.change(batch(2))
    with pytest.raises(AlreadyDone):
        early.commit()
    assert held(store) == [(0, "x"), (1, "x"), (2, "x")]


def test_a_writer_that_dies_before_its_claim_changes_nothing(spark, store):
    store.change(lambda c: c.put("t", rows(spark, (1, "a"))))
    dead = store.begin()
    dead.put("t", rows(spark, (1, "half"), (2, "done")))
    assert held(store) == [(1, "a")]
    store.change(lambda c: c.put("t", rows(spark, (2, "b"))))
    assert held(store) == [(1, "a"), (2, "b")]


# ---- library


def document(spark, i, metadata=None, **more):
    row = dict(id=i, title=f"Title {i}", path=f"/{i}", added_at=None, page_count=1, size_bytes=5, tags=["t"], file_type="txt", metadata=metadata, source_hash_algorithm="sha256", source_hash="0" * 64) | more
    return spark.createDataFrame([tuple(row[n] for n in schemas.schema("documents").names)], schemas.schema("documents"))


def chunks(spark, i, *texts):
    return spark.createDataFrame([(f"{i}-{k}", i, 1, k, t, t) for k, t in enumerate(texts)], schemas.schema("chunks"))


def put(lib, spark, i, *texts, mode="add", **more):
    c = chunks(spark, i, *texts)
    return lib.replace_documents(document(spark, i, **more), c, embed(c, HashingEmbedder(4)), mode)


def test_replace_adds_or_refreshes_a_whole_document(spark, tmp_path):
    lib = Library(spark, f"file://{tmp_path}/lib")
    put(lib, spark, "a", "one", "two", metadata='{"chunker":{"id":"old"},"author":"me","deep":{"x":[1,{"y":"2"}]}}')
    put(lib, spark, "b", "other")
    with pytest.raises(Exists, match="a"):
        put(lib, spark, "a", "again")
    put(lib, spark, "a", "new", mode="refresh", title="Ignored", tags=["no"], size_bytes=9, page_count=None, metadata='{"chunker":{"id":"new","n":[2]},"author":"no"}')
    r = lib.table("documents").where("id = 'a'").first()
    assert (r.title, r.tags, r.size_bytes, r.page_count) == ("Title a", ["t"], 9, None)
    assert json.loads(r.metadata) == {"chunker": {"id": "new", "n": [2]}, "visuals": None, "author": "me", "deep": {"x": [1, {"y": "2"}]}}
    assert sorted((c.id, c.content) for c in lib.table("chunks").collect()) == [("a-0", "new"), ("b-0", "other")]
    assert sorted(e.chunk_id for e in lib.table("embeddings").collect()) == ["a-0", "b-0"]
    put(lib, spark, "missing", "text", mode="refresh")
    assert lib.table("documents").count() == 2 and lib.table("chunks").count() == 2


def test_two_writers_keep_both_changes(spark, tmp_path):
    lib = Library(spark, f"file://{tmp_path}/lib")
    put(lib, spark, "a", "one")
    put(lib, spark, "b", "one")
    before = lib.store.latest()
    lib.tag("a", ["tagged"])
    put(lib, spark, "b", "two", mode="refresh")
    # a writer that still stands on the version before both, as the old pointer would have let it
    late = Change(lib.store, before)
    late.put("documents", document(spark, "c"))
    late.commit()
    got = {r.id: r.tags for r in lib.table("documents").collect()}
    assert got == {"a": ["tagged"], "b": ["t"], "c": ["t"]}
    with pytest.raises(Conflict):
        lib.commit(since=before, documents=lib.table("documents", before))
    assert {r.id for r in lib.table("documents").collect()} == {"a", "b", "c"}


def test_remove_tag_and_reindex_by_id_or_title(spark, tmp_path):
    lib = Library(spark, f"file://{tmp_path}/lib")
    put(lib, spark, "a", "one", "two")
    put(lib, spark, "b", "three")
    assert lib.tag("title a", ["x", "y"]).first().tags == ["t"]
    assert lib.table("documents").where("id = 'a'").first().tags == ["x", "y"]
    assert lib.reindex("b", HashingEmbedder(6)) == {"docId": "b", "title": "Title b", "chunks": 1, "embeddings": 1}
    assert {r.chunk_id: len(r.embedding) for r in lib.table("embeddings").collect()} == {"a-0": 4, "a-1": 4, "b-0": 6}
    assert lib.remove("a").first().tags == ["x", "y"]
    assert [t.count() for t in map(lib.table, ("documents", "chunks", "embeddings"))] == [1, 1, 1]
    for step in (lambda: lib.remove("a"), lambda: lib.tag("nothing", []), lambda: lib.reindex("x", HashingEmbedder(2))):
        with pytest.raises(NotFound):
            step()


@pytest.mark.parametrize(
    "text,values,want",
    [
        (None, {"a": "1"}, {"a": 1}),
        ("{}", {"a": '{"b":[1,"2"]}', "c": None}, {"a": {"b": [1, "2"]}, "c": None}),
        ('{"x":"1","a":{"old":true},"z":null}', {"a": '"s"'}, {"x": "1", "a": "s", "z": None}),
        ("no json", {"a": "2"}, {"a": 2}),
        ("[1]", {"a": "2"}, {"a": 2}),
    ],
)
def test_json_fields_are_set_alone(spark, text, values, want):
    df = spark.createDataFrame([(text, *values.values())], "t string, " + ", ".join(f"{k} string" for k in values))
    assert json.loads(df.select(L.json_put(F.col("t"), **{k: F.col(k) for k in values})).first()[0]) == want
