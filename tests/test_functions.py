import pytest
from pyspark.sql import functions as F

from loomdex.functions import paths as P
from loomdex.functions import text as X
from loomdex.operators import chunking as K
from loomdex.operators import clustering as C
from loomdex.operators import library as L
from loomdex.operators import retrieval as R
from loomdex.operators import taxonomy as G


def one(spark, col, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(col).first()[0]


def test_overlap_prefix():
    assert K.overlap_prefix("First sentence. Second sentence. Third sentence.", 20) == "Third sentence."
    assert K.overlap_prefix("", 20) == "" and K.overlap_prefix("abc", 0) == ""


def test_adjacent_overlap():
    text = "Alpha starts here. Beta carries forward.\n\nGamma starts the next chunk."
    assert K.chunks(text, 45, 24)[1] == "Beta carries forward.\n\nGamma starts the next chunk."


def test_hard_chunks():
    assert [len(c) for c in K.chunks("x" * 65, 30, 0)] == [30, 30, 5]


def test_chunk_config():
    with pytest.raises(K.ChunkingError, match=r"chunkOverlap \(100\) must be smaller than chunkSize \(100\)"):
        K.chunks("x", 100, 100)


def test_chunks_keep_all_words_and_sizes():
    text = "\n\n".join(f"Para {i} has words. " * (i % 7 + 1) for i in range(40))
    out = K.chunks(text, 120, 0)
    assert all(len(c) <= 120 for c in out)
    assert "".join("".join(out).split()) == "".join(text.split())


def test_runs_fill_their_room():
    import random

    r = random.Random(1)
    for _ in range(200):
        n, room, joint = [r.randrange(1, 30) for _ in range(r.randrange(12))], r.randrange(1, 60), r.randrange(3)
        got = [n[s] for s in K.runs(n, room, joint)]
        assert sum(got, []) == n
        size = lambda x: sum(x) + joint * (len(x) - 1)
        assert all(size(x) <= room or len(x) == 1 for x in got)
        assert all(size([*x, y[0]]) > room for x, y in zip(got, got[1:]))


def test_chunks_golden():
    text = "One two three. Four five six. Seven eight nine ten.\n\nShort.\n\n" + "x" * 45 + "\n\nEnd."
    assert K.chunks(text, 30, 0) == ['One two three. Four five six.', 'Seven eight nine ten.\n\nShort.', 'xxxxxxxxxxxxxxxxxxxxxxxxxxxxxx', 'xxxxxxxxxxxxxxx', 'End.']
    assert K.chunks("a\n\nb", 30, 5) == ["a\n\nb"] and K.chunks("", 30, 5) == []


def test_json_repair(spark):
    import json

    t = F.col("t")
    mend = lambda x: one(spark, X.json_repair(t), t=x)
    assert json.loads(mend("Here:\n```json\n{lang: 'en', \"tags\": ['a', 'b',], ok: true, n: 3,}\n``` done")) == {"lang": "en", "tags": ["a", "b"], "ok": True, "n": 3}
    assert json.loads(mend('x {"a": "it\'s, fine: yes"} y')) == {"a": "it's, fine: yes"}
    assert mend("nothing here") is None and mend("}{") is None


def test_tables_and_code():
    table = "| a | b |\n|---|---|\n" + "".join(f"| {i} | {'x' * 20} |\n" for i in range(10))
    parts = K.split_table(table, 80)
    assert len(parts) > 1 and all(p.startswith("| a | b |\n|---|---|") for p in parts)
    assert K.table_text("| Name | Value |\n| --- | --- |\n| Accuracy | High |") == "Columns: Name | Value\nRow 1: Name=Accuracy; Value=High"
    code = "```py\n" + "\n".join(f"line {i} $1" for i in range(30)) + "\n```"
    assert all(c.startswith("```py") for c in K.markdown_chunks(code, 100, 0))


def test_titles_and_lines(spark):
    t = F.col("t")
    assert one(spark, X.is_section_title(t), t="QUARTERLY RESULTS") and one(spark, X.is_section_title(t), t="Annual Report")
    assert not one(spark, X.is_section_title(t), t="This is a plain sentence.")
    assert one(spark, X.is_page_number(t), t="Page 3 of 9") and not one(spark, X.is_page_number(t), t="3 apples")
    assert one(spark, X.clean_title(t), t="my_great-book (2nd edition).pdf") == "my Great Book"
    assert one(spark, X.clean_title(t), t="foo(2nd edition)bar.pdf") == "Foobar"
    assert one(spark, X.clean_title(t), t="(ISBN 1_2)a b%20ISO (notes).epub") == "a b ISO (notes)"
    assert one(spark, X.author(t), t="Title - Smith.pdf") == "Smith"
    assert one(spark, X.normal_tag(t), t="C++ & Rust!") == "c-rust"


@pytest.mark.parametrize("name,kind", [("paper.pdf", "pdf"), ("notes.md", "markdown"), ("notes.markdown", "markdown"), ("brief.docx", "docx"), ("draft.odt", "odt"), ("draft.fodt", "odt"), ("notes.txt", "txt")])
def test_file_type(spark, name, kind):
    assert one(spark, P.file_type(F.col("t")), t=name) == kind


def test_sizes_pages_and_addresses(spark):
    assert one(spark, P.size_bytes(F.col("t")), t="500kb") == 512000
    assert one(spark, P.size_bytes(F.col("t")), t="1.5mb") == 1572864
    assert one(spark, P.size_bytes(F.col("t")), t="0kb") is None
    assert one(spark, P.pages_of(F.col("t"), F.lit(6)), t="5-2,3") == [2, 3, 4, 5]
    assert one(spark, P.pages_of(F.col("t"), F.lit(4)), t="5-2,3") is None
    assert P.is_private("10.1.2.3") and P.is_private("::ffff:127.0.0.1") and not P.is_private("8.8.8.8") and not P.is_private("2606:4700::1")


def test_hybrid_score(spark):
    v = spark.createDataFrame([(1, 0.8), (2, 0.99), (3, 0.3)], "id int, score double")
    f = spark.createDataFrame([(1, 0.5), (2, 0.2), (4, 0.4)], "id int, score double")
    got = {r.id: (r.score, r.match_type) for r in R.hybrid_merge(v, f, "id").collect()}
    assert got == {1: (0.84, "hybrid"), 2: (1.0, "hybrid"), 3: (0.3, "vector"), 4: (0.4, "fts")}


def test_query_dedupe(spark):
    hits = spark.createDataFrame([(1, "q1", 0.7), (1, "q2", 0.9)], "vec_id int, query_id string, score double")
    assert [tuple(r) for r in R.dedupe_queries(hits).collect()] == [(1, 0.9, "q1,q2")]


def test_closure_on_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "concept_id string, broader_id string")
    got = G.closure(e, spark.createDataFrame([("a",)], "id string"))
    assert {r.id for r in got.collect()} == {"a", "b", "c"}


def hierarchy(edges):
    """Fewest steps up between concepts, and all paths down from roots."""
    up, down, steps, paths = {}, {}, {}, []
    for a, b in set(edges):
        up.setdefault(a, set()).add(b)
        down.setdefault(b, set()).add(a)
    for s in up:
        front, seen, d = {s}, set(), 0
        while front:
            d += 1
            front = {y for x in front for y in up.get(x, ())} - seen
            seen |= front
            steps |= {(s, y): d for y in front}

    def walk(trail):
        paths.append((trail[-1], " > ".join(trail), len(trail)))
        for c in down.get(trail[-1], ()):
            if c not in trail:
                walk([*trail, c])

    for r in {x for e in edges for x in e} - up.keys():
        walk([r])
    return steps, sorted(paths)


def test_closures_and_trees_of_any_depth(spark):
    chain = [(f"d{i:02}", f"d{i + 1:02}") for i in range(40)]
    mixed = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("x", "r"), ("y", "r"), ("z", "x"), ("z", "y"), ("z", "r"), ("x", "y"), ("s", "s"), ("z", "x")]
    e = spark.createDataFrame(chain + mixed, "concept_id string, broader_id string")
    steps, paths = hierarchy(chain + mixed)
    ids = e.select(F.col("concept_id").alias("id"))
    assert {(r.start, r.id): r.depth for r in G.closure(e, ids).collect()} == steps
    assert sorted(tuple(r) for r in G.tree_paths(e, ids).collect()) == paths
    down = G.closure(e, spark.createDataFrame([("r",), ("none",)], "id string"), up=False)
    assert {(r.id, r.start): r.depth for r in down.collect()} == {k: d for k, d in steps.items() if k[1] == "r"}
    none = e.limit(0)
    assert G.closure(none, ids).count() == 0 and G.tree_paths(none, ids.limit(1)).count() == 1


def test_places_follow_the_whole_order(spark):
    rows = [(f"{i % 97:03}-{i}", i % 11) for i in range(500)]
    df = spark.createDataFrame(rows, "id string, n int").repartition(7)
    got = [(r.n, r.id) for r in L.numbered(df, F.desc("n"), F.asc("id")).orderBy("place").collect()]
    assert got == sorted(((n, i) for i, n in rows), key=lambda x: (-x[0], x[1]))
    assert L.numbered(df.limit(0), F.asc("id")).count() == 0


def test_concept_match_boundary_and_tie(spark):
    cl = spark.createDataFrame([(0, [1.0, 0.0], "First. More"), (1, [0.0, 1.0], "A" * 60 + ". Ignored")], "cluster_id int, centroid array<double>, summary string")
    co = spark.createDataFrame([("x", 0, [0.8, 0.6]), ("y", 1, [0.8, 0.6]), ("z", 2, [0.0, 0.0]), ("w", 3, [1.0])], "concept_id string, ordinal int, v array<double>")
    got = {r.cluster_id: r for r in C.concept_match(cl, co, 0.8).collect()}
    assert (got[0].concept_id, got[0].confidence, got[0].suggested_label) == ("x", 0.8, None)
    assert (got[1].concept_id, got[1].suggested_label) == (None, "A" * 50)


def test_k_means_on_blobs(spark):
    import random

    r = random.Random(42)
    rows = [(i, [(1.0 if d == i % 3 else 0.0) + r.random() * 0.2 for d in range(4)]) for i in range(60)]
    v = spark.createDataFrame(rows, "vec_id long, v array<double>")
    for fn in (C.k_means, C.mini_batch_k_means):
        _, a = fn(v, 3, seed=1)
        by = {}
        for x in a.collect():
            by.setdefault(x.cluster_id, set()).add(x.vec_id % 3)
        assert len(by) == 3 and all(len(s) == 1 for s in by.values())
    for k, n in ((0, v), (61, v), (2, v.limit(0))):
        with pytest.raises(C.ClusterError):
            C.k_means(n, k)


def plain_k_means(x, k, seed):
    """k-means++ and Lloyd's rounds in memory; the residual."""
    import numpy as np

    rng = np.random.default_rng(seed)
    c = x[[rng.integers(len(x))]]
    for _ in range(k - 1):
        d = ((x[:, None] - c[None]) ** 2).sum(2).min(1)
        c = np.vstack([c, x[rng.choice(len(x), p=d / d.sum())]])
    for _ in range(100):
        near = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(k)])
    return ((x[:, None] - c[None]) ** 2).sum(2).min(1).sum()


def test_k_means_seeded_in_tasks_is_as_good_as_in_memory(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=8) * 6 + rng.normal(size=(n, 8)) for n in (300, 40, 40, 60, 80, 100)])
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, v array<double>").repartition(4)
    c, a = C.k_means(v, 6, seed=3)
    rss = C.residual(v, C.centroid_frame(spark, c), a).first().rss
    assert rss <= 1.01 * min(plain_k_means(x, 6, s) for s in range(5))
    assert len(C.initial(v, 6)) == 6 and C.initial(v, 6) == C.initial(v.repartition(2), 6)
    # equal vectors: fewer distinct starts than clusters
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "vec_id long, v array<double>")
    assert {r.distance for r in C.k_means(same, 3)[1].collect()} == {0.0}


def test_the_number_of_soft_clusters(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    x = np.vstack([np.array([10.0 * j, 0.0, 0.0]) + rng.normal(size=(60, 3)) * 0.3 for j in range(3)])
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, v array<double>")
    k, m = C.soft(v, most=5, seed=2)
    assert k == 3
    top = {r.vec_id: r.cluster_id for r in m.where("probability > 0.9").collect()}
    assert len(top) == 180 and all(len({top[i] for i in range(60 * j, 60 * j + 60)}) == 1 for j in range(3))
    with pytest.raises(C.ClusterError):
        C.soft(v.union(spark.createDataFrame([(999, [1.0])], "vec_id long, v array<double>")))


def test_images(spark):
    i = spark.createDataFrame([(1, 0, "a", 10), (1, 1, "a", 10), (1, 2, "b", 2000), (1, 3, "c", 10)], "doc_id int, seq int, hash string, byte_size int")
    assert [r.hash for r in L.cap_images(i, 1000, 1).collect()] == ["a"]


def test_with_section(spark):
    col = X.with_section(F.lit("text"), F.col("above"), F.col("own"))
    assert one(spark, col, above=["A", "B"], own="B") == "# A > B\n\ntext"
    assert one(spark, col, above=[""], own="B") == "# B\n\ntext"
    assert one(spark, col, above=[""], own="") == "text"


def test_download_name(spark):
    col = P.download_name(F.col("url"), F.col("kind"))
    name = lambda url, kind: one(spark, col, url=url, kind=kind)
    assert name("https://a.org/x/paper.pdf?v=1", "pdf") == "paper.pdf"
    assert name("https://a.org/x/paper", "markdown") == "paper.md"
    assert name("https://a.org/notes.MARKDOWN", "markdown") == "notes.markdown"
    assert name("https://a.org/flat.fodt", "odt") == "flat.fodt"
    assert name("https://a.org/flat.txt", "odt") == "flat.odt"
    assert name("https://a.org/", "docx") == "download.docx"
    assert name(None, "pdf") is None


@pytest.mark.parametrize(
    "rows, usable",
    [([["a", "b"], ["c", "d"]], True), ([["a", "b"], ["c", " "]], False), ([["a"], ["b"], ["c"], ["d"]], False), ([["a", "b", "c", "d"], [""]], False), ([], False)],
)
def test_usable_table(spark, rows, usable):
    df = spark.createDataFrame([(rows,)], "t array<array<string>>")
    assert df.select(X.usable_table(F.col("t"))).first()[0] is usable
