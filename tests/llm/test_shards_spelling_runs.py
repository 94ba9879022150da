"""Operators 11 to 13 against brute force on small and awkward tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest

from loomdex.llm import periodic, sharding, spelling
from loomdex.llm import textkit as tk

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, slot string, word string, n string, runs string"


def table(spark, rows, where, parts=3):
    """Documents with columns whose names clash with those of results, as a table on disk."""
    df = spark.createDataFrame([(i, t, None, "s", 0, "x", "x", "x", "x", "x") for i, t in rows], DOCS)
    path = str(where / f"t{random.getrandbits(40)}")
    df.repartition(parts).write.parquet(f"{path}/documents.parquet")
    return path


AWKWARD = [(None, None), (None, "shared text of rows without an id"), (None, "shared text of rows without an id"), (5, ""), (5, " \n\t"), (-1, "日本語 テキスト é"), (-1, "日本語 テキスト é"), (2**62, "z" * 3000)]


# ---- 11

KEYS = tk.mix(np.arange(40_000, dtype=np.uint64))


def test_one_more_shard_takes_keys_only_into_itself():
    before = None
    for n in range(1, 36):
        shard = sharding.choose(KEYS, sharding.grown(n))
        count = np.bincount(shard, minlength=n)
        assert len(count) == n and (abs(count - len(KEYS) / n) < 6 * (len(KEYS) / n) ** 0.5).all()
        if before is not None:
            assert ((shard == before) | (shard == n - 1)).all()
        before = shard


def uneven(weights, provision=None):
    """Regions of racks of shards with the given weights, numbered through."""
    number, regions = iter(range(99)), []
    for r, region in enumerate(weights):
        regions.append(sharding.Node(r, tuple(sharding.Node(k, tuple(sharding.Shard(next(number), w, provision) for w in rack)) for k, rack in enumerate(region))))
    return tuple(regions)


def test_weights_are_shares_and_changes_stay_in_their_shard():
    weights = [[[4, 1], [2]], [[3, 3, 1]], [[2], [2, 2]]]
    one = sharding.choose(KEYS, uneven(weights, 4))
    flat = np.array([w for region in weights for rack in region for w in rack])
    want = len(KEYS) * flat / flat.sum()
    assert (abs(np.bincount(one, minlength=len(flat)) - want) < 6 * want**0.5).all()
    weights[1][0][1] = 1
    less = sharding.choose(KEYS, uneven(weights, 4))
    assert ((one == less) | (one == 4)).all() and (one != less).any()
    weights[0][1][0] = 4
    more = sharding.choose(KEYS, uneven(weights, 4))
    assert ((more == less) | (more == 2)).all() and (more != less).any()
    weights[2][1][0] = 0
    gone = sharding.choose(KEYS, uneven(weights, 4))
    assert ((gone == more) | (more == 7)).all() and not (gone == 7).any()


def test_a_new_rack_moves_keys_of_its_region_only():
    two = uneven([[[1, 1]], [[1, 1], [1]]])
    three = (two[0], sharding.Node(1, (*two[1].children, sharding.Node(9, (sharding.Shard(9),)))))
    before, after = sharding.choose(KEYS, two), sharding.choose(KEYS, three)
    moved = before != after
    # from the other region into this one, or inside it: never into the region whose weight stays
    assert moved.any() and (after[moved] >= 2).all()


def test_a_tree_without_weight_is_refused():
    with pytest.raises(ValueError, match="no shard"):
        sharding.choose(KEYS, sharding.grown(0))


def test_slots_have_no_gaps(spark, tmp_path):
    rows = AWKWARD + [(i, f"text {i}") for i in range(300)] + [(7, "hot")] * 400
    got = sharding.op11_weighted_shards(spark, table(spark, rows, tmp_path)).toPandas()
    again = sharding.op11_weighted_shards(spark, table(spark, rows[::-1], tmp_path, 5)).toPandas()
    for d in (got, again):
        d.sort_values(["shard", "slot"], inplace=True, ignore_index=True)
    pd.testing.assert_frame_equal(got, again)
    want = collections.Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert collections.Counter((None if pd.isna(a) else int(a), b, c) for a, b, c in zip(got.doc_id, got["size"], got.text_crc32, strict=True)) == want
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert set(got.law) == {"key"} and ((got.grown_shard == got.shard) | (got.grown_shard == 24)).all()
    assert got.fillna(-9).groupby("doc_id").shard.nunique().max() == 1
    assert sharding.op11_weighted_shards(spark, table(spark, [], tmp_path)).count() == 0


def test_many_copies_are_written_in_blocks(spark):
    df = spark.createDataFrame([(0, 1)] * 250 + [(0, 2)] * 3 + [(1, 1)] * 40, "shard int, doc_id long")
    got = sharding.slots(df, 293, bucket_rows=10, copies=16).toPandas()
    assert {s: sorted(g.slot) for s, g in got.groupby("shard")} == {0: list(range(253)), 1: list(range(40))}
    assert got.groupby(["shard", "doc_id"]).size().to_dict() == {(0, 1): 250, (0, 2): 3, (1, 1): 40}


# ---- 12


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelt(rows):
    """All of the query's result by the letter of its contract."""
    total = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    words = {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}
    by_size = collections.defaultdict(list)
    for w in words:
        by_size[len(w)].append(w)
    form, out = {}, {}
    for w, n in words.items():
        close = [v for k in (-1, 0, 1) for v in by_size[len(w) + k] if near(w, v)]
        best = min(close, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
        out[w] = (n, len(close))
    def root(w):
        return w if form[w] is None else root(form[w])
    return {(w, form[w], root(w), n, k, words.get(form[w])) for w, (n, k) in out.items()}


def test_the_automaton_numbers_words_and_finds_near_ones():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(7, 10))) for _ in range(400)} | {"", "a"})
    machine = spelling.Automaton(words)
    assert [machine.number(machine.root, w, 0) for w in words] == list(range(len(words)))
    assert machine.number(machine.root, "abab", 0) == -1
    assert len(machine.edges) < sum(map(len, words)) / 2
    for w in words[::7]:
        for exact in {0, len(w) // 2, len(w)}:
            assert {words[k] for k in machine.near(w, exact)} == {v for v in words if near(w, v) and v[:exact] == w[:exact]}
    assert spelling.Automaton([]).near("word", 0) == set()


@pytest.fixture(scope="module")
def misspelt():
    rng = random.Random(8)
    base = ["strasse", "straßen", "Écrivain", "documentation", "reference", "aaaaaaaa", "abababab"] + ["".join(rng.choice("abc") for _ in range(rng.randrange(7, 10))) for _ in range(60)]
    rows = []
    for i in range(120):
        words = [rng.choice(base[: 1 + int(len(base) * rng.random() ** 3)]) for _ in range(120)]
        for k in range(0, 120, 9):
            w, p = words[k], rng.randrange(len(words[k]))
            words[k] = rng.choice([w[:p] + w[p + 1 :], w[:p] + "b" + w[p:], w[:p] + "c" + w[p + 1 :], w.upper()])
        rows.append((i, rng.choice([" ", "\n", "-", "1"]).join(words)))
    return rows + AWKWARD + [(3, rows[0][1])] * 3


@pytest.mark.parametrize("hot,block", [(8192, 16384), (2, 5), (30, 64)])
def test_spelling_is_exact_however_groups_are_cut(spark, misspelt, tmp_path, monkeypatch, hot, block):
    monkeypatch.setattr(spelling, "HELD", 50)
    counts = spelling.word_counts(spark.read.parquet(f"{table(spark, misspelt, tmp_path)}/documents.parquet")).where("length(word) >= 7 and n >= 2")
    got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(counts, hot, block).collect()}
    assert got == spelt(misspelt) and any(r[1] for r in got)


def test_chains_of_forms_end_at_their_root(spark):
    words = [("aaaaaaa", 2), ("aaaaaab", 20), ("aaaaabb", 200), ("aaaabbb", 2000), ("aaabbbb", 20000), ("aabbbbb", 200000), ("zzzzzzzz", 3)]
    got = {r.word: (r.form, r.root) for r in spelling.variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert got == {w: (words[k + 1][0] if k < 5 else None, "aabbbbb" if k < 6 else w) for k, (w, _) in enumerate(words)}


def test_spelling_of_edges(spark, tmp_path, monkeypatch):
    assert spelling.op12_spelling_variants(spark, table(spark, [], tmp_path)).count() == 0
    assert spelling.op12_spelling_variants(spark, table(spark, [(1, None), (2, "")], tmp_path)).count() == 0
    # very long texts are cut between words, very long words are not
    monkeypatch.setattr(spelling, "PIECE", 64)
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("abÉ") for _ in range(rng.randrange(3, 12))) for _ in range(2000)), "x" * 1000 + " " + "y" * 70, None]
    want = collections.Counter()
    for i, t in zip((4, None, 6), texts):
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            run = run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] += len(run) >= 7
    assert spelling.spoilt_counts([4, None, 6], texts) == {w: n for w, n in want.items() if n}


# ---- 13


def all_runs(x, least=12):
    out = {}
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def sequences(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        n, k = rng.randrange(150), rng.choice([1, 2, 2, 3, 5, 20])
        x = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randrange(4)):
            a, p = rng.randrange(n + 1), 1 + rng.randrange(20)
            for i in range(a, min(n, a + rng.randrange(100))):
                x[i] = x[a + (i - a) % p]
        yield x
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    yield b  # a Fibonacci word has as many runs as nearly any
    yield [0] * 300


def test_runs_are_those_of_the_definition():
    for x in sequences(2, 1500):
        want = all_runs(x)
        assert periodic.runs(x) == want
        kept = [(s + a, n, q) for a, b in periodic.stretches(np.array(x, np.int64), np.zeros(len(x), np.int64)) for s, n, q in periodic.runs(x[a:b])]
        assert kept == want


def test_factors_are_the_longest_that_began_earlier():
    for x in sequences(4, 200):
        at = 0
        for start, size, source in periodic.factors(x):
            assert start == at
            longest = max((next((k for k in range(len(x) - start) if x[s + k] != x[start + k]), len(x) - start) for s in range(start)), default=0)
            assert size == max(1, longest)
            assert (source < 0) == (longest == 0) and (source < 0 or source < start and x[source : source + size] == x[start : start + size])
            at += size
        assert at == len(x)


def test_runs_of_documents(spark, tmp_path):
    rng = random.Random(6)
    rows = list(AWKWARD)
    for i, x in enumerate(sequences(9, 150)):
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(f"w{c}é" for c in x)))
    rows += [(400, rows[20][1])] * 2 + [(401, "a b c d e f g h i j k l m n o p " * 3000)]
    got = collections.Counter(tuple(r) for r in periodic.op13_periodic_runs(spark, table(spark, rows, tmp_path)).collect())
    want = collections.Counter()
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n = len(w)
        h = zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        found = [(0, 48000, 16)] if i == 401 and h % 10 else all_runs(w)
        top = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        gone = {k for s, m, q in found for k in range(s + q, s + m)}
        lines, rest = "".join(f"{s},{m},{q}\n" for s, m, q in found), " ".join(x for k, x in enumerate(w) if k not in gone)
        want[i, len(found), *(top or (None,) * 3), top and 1000 * top[1] // top[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(rest.encode()).hexdigest()] += 1
    assert got == want
    assert periodic.op13_periodic_runs(spark, table(spark, [], tmp_path)).count() == 0


def test_operator_gives_spans_and_text(spark):
    docs = spark.createDataFrame([(1, "x " + "a b c " * 5 + "y")], "doc_id long, text string")
    r = periodic.find_runs(docs).first()
    assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed) == (17, [(1, 15, 3)], "x a b c y")
    with pytest.raises(ValueError):
        periodic.find_runs(docs, least=4)
