import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomdex.llm import bpe, html, jaccard, language, mixing, quality, search, suffixes, tokencount, toxicity
from loomdex.llm import textkit as tk

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(rng, n):
    return " ".join(rng.choice(["the", "of", "lorem", "ipsum", "dolor", "sit", "amet", "x1", "é", "ß"]) + str(rng.randrange(400)) for _ in range(n))


@pytest.fixture(scope="module")
def cases():
    """Rows of every awkward kind: copies, near copies, nulls, short, long, shared passages, repeats inside a text."""
    rng = random.Random(5)
    base = [words_of(rng, n) for n in (3, 4, 5, 6, 7, 9, 12, 20, 60, 200, 900)]
    rows = [(i, t, "en", "a") for i, t in enumerate(base)]
    for t in base:
        w = t.split()
        for _ in range(4):
            v = list(w)
            v[rng.randrange(len(v))] = "changed" + str(rng.randrange(9))
            rows.append((len(rows), " ".join(v), "en", "b"))
        rows.append((len(rows), t.upper() if rng.random() < 0.3 else t, "de", None))
    passage = words_of(rng, 90)
    near = words_of(rng, 120).split()
    for _ in range(60):
        rows.append((len(rows), words_of(rng, 80) + "\n" + passage + "\n" + words_of(rng, 50), "fr", "c"))
        v = list(near)
        v[rng.randrange(len(v))] = "n" + str(rng.randrange(999))
        rows.append((len(rows), " ".join(v), "fr", "c"))
    rows += [(len(rows) + i, t, lang, s) for i, (t, lang, s) in enumerate([(None, "en", "a"), ("", None, "a"), (" \n\t", "en", None), ("z" * 1500, "en", "a"), ("ab" * 700 + "q" + "ab" * 300, "en", "a"), ("日本語 テキスト", "ja", "d"), ("!!! ??? 123", "en", "d"), ("a b c d e a b c d e a b c", "en", "d")])]
    return rows


@pytest.fixture(scope="module")
def docs(spark, cases):
    df = spark.createDataFrame([(*r, len(r[1] or ""), 0.5, "clash") for r in cases], "doc_id long, text string, lang string, source string, n_chars long, score double, key string")
    return df.repartition(5).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


# ---- 1

def test_search_is_exact(spark, docs, cases, none):
    queries = docs.where("doc_id % 7 = 0")
    got = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in search.top_k(docs.select("doc_id", "text"), queries.select("doc_id", "text")).collect()}
    term = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tf = {r[0]: collections.Counter(term.findall((r[1] or "").translate(low))) for r in cases}
    df = collections.Counter(t for c in tf.values() for t in c)
    mean = sum(sum(c.values()) for c in tf.values()) / len(tf)
    want = {}
    for q in (r[0] for r in cases if r[0] % 7 == 0):
        s = {}
        for d, c in tf.items():
            x = sum(n * np.log(1 + (len(tf) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for t, n in tf[q].items() if t in c)
            if x > 0:
                s[d] = round(x, 6)
        for k, d in enumerate(sorted(s, key=lambda d: (-s[d], d))[:10], 1):
            want[q, k] = (d, s[d])
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-6 for k in want)
    assert search.top_k(none.select("doc_id", "text"), none.select("doc_id", "text")).count() == 0


def test_search_prunes_blocks():
    import pyarrow as pa

    texts = ["alpha beta " * 5] * 10 + ["gamma delta"] * 3000 + ["alpha rare"] * 10
    q = search.Queries([1], ["alpha"])
    q.weigh(np.ones(len(q.vocab)))
    best = search.Best(1, 5)
    scored, seen = search.search_segment(pa.array(texts, pa.large_string()), np.arange(len(texts)), q, 2.0, best)
    assert scored < seen or seen == 1
    assert (best.doc[0] < 10).all()


# ---- 2

def test_language(spark, sf_dir, docs, none):
    got = language.op2_language_id(spark, "/root/testdata/sf0.01").toPandas()
    truth = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")[["doc_id", "lang"]]
    held = got[got.held_out].merge(truth, on="doc_id")
    assert (held.lang_pred == held.lang).mean() > 0.97
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(got.doc_id, got.held_out))
    protos = language.prototypes(docs)
    r = {x.doc_id: x for x in language.identify(docs, protos).collect()}
    assert len(r) == docs.count()
    odd = {x.doc_id for x in docs.where("text is null or text = '' or text = '!!! ??? 123'").collect()}
    assert all(r[i].lang_pred == "und" and r[i].score == 0 for i in odd)
    assert all(0 <= x.score <= 1 for x in r.values())
    assert language.identify(none, language.prototypes(none)).count() == 0


# ---- 3

@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("<html><head><title>T</title></head><body><nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>One\n two<br>three<p>Next &lt;x&gt;</article><footer>&copy; me</footer></body></html>", "A & B\nOne two three\nNext <x>"),
        ('<body><div class="ad">Buy</div><article><p>Text</p><aside>Side</aside><section class="comments"><article><p>Reader says</p></article></section></article></body>', "Text"),
        ('<div id="sidebar">S<div>T</div></div><main><form><p>Name</p></form><script>var a="</p>";</script><style>p{}</style><p>Main <b>bold</b></p><!-- no --></main>', "Main bold"),
        ("<article><p>Un<b>closed<p>Two", "Unclosed\nTwo"),
        ('<article><div class="cookie-notice">We use cookies</div><ul><li>a<li>b</ul></article>', "a\nb"),
        ('<div class="ad">open <article><p>In</p></article>', "In"),
    ],
)
def test_html(page, text):
    assert html.main_text(page) == text


def test_html_without_structure():
    long = "The house is on the hill and it was in the valley of the river that they had to go to for the water. " * 4
    page = f"<body><div><a href=1>Home</a> <a href=2>About</a></div><h2>Title here</h2><p>{long}</p><p>Short one.</p><p>{long}</p><div><a href=3>Next</a></div></body>"
    assert html.main_text(page).split("\n") == ["Title here", long.strip(), "Short one.", long.strip()]


def test_html_article_is_one_piece_of_evidence():
    long = "The house is on the hill and it was in the valley of the river that they had to go to for the water. " * 4
    junk = "Zq9 xk-77 vvbn qqrt 0x1f zzkw plmn wrtz ggh7 kkj2 " * 5
    # main text beside a teaser article: judged by density and length, short blocks by their neighbours
    page = f"<body><p>{junk}</p><div><p>{long}</p><p>Short one.</p><p>{long}</p></div><article><p>A teaser.</p></article><p>Posted today</p></body>"
    assert html.main_text(page).split("\n") == [long.strip(), "Short one.", long.strip(), "A teaser."]
    # inside, a block without stop words goes with its neighbours
    page = f"<article><div><a href=1>Tags</a></div><p>{junk}</p><div><a href=2>More</a></div><p>{long}</p><p>{junk}</p></article>"
    assert html.main_text(page).split("\n") == [long.strip(), junk.strip()]


def test_html_pages(spark, sf_dir):
    got = html.op3_html_extraction(spark, sf_dir).toPandas()
    assert len(got) == len(pd.read_parquet(f"{sf_dir}/pages.parquet")) and (got.text.str.len() == got.n_chars).all()


# ---- 4

def brute_components(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard(docs, cases, none):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.joined(docs.select("doc_id", "text")).collect()}
    assert got == brute_components([(r[0], r[1]) for r in cases])
    assert jaccard.joined(none.select("doc_id", "text")).count() == 0


def test_jaccard_with_frequent_shingles(docs, cases, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT_FROM", 3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.joined(docs.select("doc_id", "text")).collect()}
    assert got == brute_components([(r[0], r[1]) for r in cases])


def test_jaccard_in_blocks(spark, monkeypatch):
    """A chain of near copies, a passage that many share, blocks of two rows and no short lists."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    base, passage, rows = [word() for _ in range(90)], [word() for _ in range(60)], []
    for i in range(40):
        base = list(base)
        base[rng.randrange(90)] = word()
        rows.append((i, " ".join(base)))
    for i in range(40, 70):
        own = [word() for _ in range(rng.randrange(4, 30))]
        rows.append((i, " ".join(own[: len(own) // 2] + passage + own[len(own) // 2 :])))
    rows += [(70, rows[3][1]), (71, None), (72, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_components(rows)
    monkeypatch.setattr(jaccard, "ROWS", 2)
    monkeypatch.setattr(jaccard, "SHORT", 1)
    monkeypatch.setattr(jaccard, "BROADCAST", 0)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.joined(docs).collect()}
    assert got == want


def test_jaccard_without_doc_ids(spark):
    """Rows without an id link as others do: near copies of them are in one component, named by the least id there is."""
    words = [f"w{i}" for i in range(60)]
    near = " ".join([*words[:-1], "x"])
    rows = [(None, " ".join(words)), (4, near), (None, near + " y"), (None, None), (9, "some other words than those above are here")]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(None, 56, 4), (4, 56, 4), (None, 57, 4), (None, 0, None), (9, 4, 9)}


# ---- 5

def test_quality_figures(spark, docs, cases, none):
    got = {r.doc_id: r for r in quality.judged(docs.select("doc_id", "text", "lang", "source")).collect()}
    assert len(got) == len(cases)
    for i, t, *_ in cases:
        t = t or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        three = collections.Counter(zip(w, w[1:], w[2:]))
        rep = {k + j for k in range(len(w) - 2) if three[tuple(w[k : k + 3])] > 1 for j in range(3)}
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(rep) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality.judged(none.select("doc_id", "text", "lang", "source")).count() == 0


def test_quality_sketch_and_verdict(spark):
    vals = [0, 1, 63, 64, 65, 100, 127, 128, 1000, 99999]
    bins = [r.b for r in spark.createDataFrame([(v,) for v in vals], "v long").select(quality.bin_of(F.col("v")).alias("b")).collect()]
    assert bins == sorted(bins) and all(v <= quality.top_of(b) <= v + max(0, v // 32) for v, b in zip(vals, bins))
    got = quality.op5_quality_rules(spark, "/root/testdata/sf0.01").toPandas()
    labels = pd.read_parquet("/root/testdata/sf0.01/labels.parquet")
    m = got[~got.base_failed].merge(labels, on="doc_id")
    assert m[m.quality == 1].kept.mean() > 0.9


def test_quality_verdicts_by_brute_force(spark):
    """Thresholds of each group from exact fractions of all texts, in groups of one text and of hundreds, one of them a third of all."""
    from fractions import Fraction

    rng = random.Random(8)
    groups = [("en", "a"), ("en", "a"), ("en", "b"), ("de", None), (None, "a"), ("fr", "c"), ("en", "d")]
    rows = []
    for i in range(420):
        lang, source = groups[rng.randrange(6)] if i else groups[6]
        w = words_of(rng, rng.randrange(50, 90)).split()
        for _ in range(rng.choice([0, 0, 1, 4, 30])):
            w[rng.randrange(len(w))] = rng.choice(["###", "$$", "wordwordwordwordword", "&"])
        rows.append((i, " ".join(w) + "\nsame line of text" * rng.choice([1, 1, 2, 9]), lang, source))
    feats = [r.asDict() for r in quality.features(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()]

    def top(v):
        return v if v < 64 else ((v >> (v.bit_length() - 6)) + 1 << (v.bit_length() - 6)) - 1

    def share(some, rate):
        c = collections.Counter(top(r[rate]) for r in some)
        return {v: Fraction(n) for v, n in c.items()}

    def blend(own, prior):
        each = Fraction(quality.PRIOR) / sum(prior.values())
        return {v: own.get(v, 0) + each * prior.get(v, 0) for v in own.keys() | prior.keys()}

    def at(dist, q):
        seen = 0
        for v in sorted(dist):
            seen += dist[v]
            if seen >= q * sum(dist.values()):
                return v

    used = [r for r in feats if r["n_words"] >= 50]
    want = {}
    for r in feats:
        mine = [x for x in used if x["lang"] == r["lang"]]
        fine = not r["base_failed"]
        for rate in quality.RATES:
            d = blend(share([x for x in mine if x["source"] == r["source"]], rate), blend(share(mine, rate), share(used, rate)))
            lo, mid, hi = (at(d, Fraction(k, 4)) for k in (1, 2, 3))
            slack = quality.SLACK["long_words" if rate == "word_length" else rate]
            fine &= r[rate] <= max(hi + quality.SPREAD * (hi - mid), mid + slack)
            if rate == "word_length":
                fine &= r[rate] >= min(lo - quality.SPREAD * (mid - lo), mid - slack)
        want[r["doc_id"]] = fine
    got = quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert {r.doc_id: r.kept for r in got} == want
    assert 0 < sum(not r.kept and not r.base_failed for r in got) < 200


# ---- 6

def test_bpe_equals_the_library(docs, cases):
    import base64

    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path(bpe.VOCABULARY)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    mine = bpe.load(path)
    extra = ["  a  b \n\n c", " lead", "trail ", "x" * 4000, "!" * 3001, "👍🏽 ok", "\t\n  ", "aaa bbb'll  don't 123 45.6\r\n", "é ́x", "the" * 900, "<|endoftext|>"]
    for t in extra:
        ids = np.frombuffer(mine.encode_batch([t])[0], "<u4")
        assert ids.tolist() == lib.encode_ordinary(t) and mine.decode(ids) == t.encode()
    got = {r.doc_id: r for r in bpe.encoded(docs).collect()}
    for i, t, *_ in cases:
        ids = np.array(lib.encode_ordinary(t or ""), "<u4")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_rank_queue():
    q = bpe.RankQueue(50000)
    rng = random.Random(1)
    ranks = [rng.randrange(50000) for _ in range(300)]
    for i, r in enumerate(ranks):
        q.push(r, np.array([i]))
    out = []
    while (x := q.pop()) is not None:
        out += [x[0]] * len(x[1])
    assert out == sorted(ranks)


# ---- 7

def test_token_counts(docs, cases):
    import public_tokenizers

    tok = tokencount.load(public_tokenizers.path(tokencount.VOCABULARY))
    n = lambda t: len(tok.encode(t, add_special_tokens=False))
    got = {r.doc_id: r for r in tokencount.counted(docs).collect()}
    for i, t, *_ in cases:
        assert (got[i].n_bytes, got[i].n_tokens) == (len((t or "").encode()), n(t or ""))
        assert got[i].over_limit == (n(t or "") > 2048)
    huge = ("word " * 50 + "q" * 700 + " ") * 20 + "z" * 5000 + " <|endoftext|> end <|startoftext|>" * 20 + "café é"
    for chunk, overlap in ((100, 8), (1000, 16), (333, 5)):
        assert tokencount.count_huge(tok, huge, chunk, overlap) == n(huge)
    odd = ["a b　c\x1cd", "İstanbul ΣΑΣ x", "<|endoftext|>hello"]
    assert tokencount.count_batch(tok, odd, {}) == [n(t) for t in odd]


# ---- 8

def brute_cut(rows, window=400):
    raw = {i: (t or "").encode() for i, t in rows}
    seen = collections.Counter(b[k : k + window] for b in raw.values() for k in range(len(b) - window + 1))
    out = {}
    for i, b in raw.items():
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - window + 1):
            if seen[b[k : k + window]] > 1:
                gone[k] += 1
                gone[k + window] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("hot", [2000, 1])
def test_suffixes(docs, cases, none, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    found = suffixes.figures(docs.select("doc_id", "text")).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found}
    assert got == brute_cut([(r[0], r[1]) for r in cases])
    assert {r.doc_id: r.n_shared for r in found} == {i: x[1] for i, x in brute_cut([(r[0], r[1]) for r in cases], suffixes.SHORT).items()}
    assert suffixes.figures(none.select("doc_id", "text")).count() == 0


def test_cover():
    c = set(suffixes.COVER.tolist())
    assert all(any((a - b) % suffixes.PERIOD == d for a in c for b in c) for d in range(suffixes.PERIOD))


# ---- 9

def test_toxicity(spark, docs, none):
    got = toxicity.op9_toxicity(spark, "/root/testdata/sf0.1").toPandas()
    labels = pd.read_parquet("/root/testdata/sf0.1/labels.parquet")
    m = got[got.held_out].merge(labels, on="doc_id")
    hit = ((m.predicted == 1) & (m.toxic == 1)).sum()
    assert hit / m.toxic.sum() > 0.85 and hit / m.predicted.sum() > 0.85
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    few = spark.createDataFrame([(0, 0), (1, None)], "doc_id long, toxic int")
    assert toxicity.scored(docs.select("doc_id", "text"), few).count() == docs.count()
    assert toxicity.scored(none.select("doc_id", "text"), few).count() == 0


def test_toxic_lexicon_is_whole(spark):
    rng = random.Random(3)
    letters = "abcdefghij"
    word = lambda a, i: a + "".join(letters[int(c)] for c in f"{i:03d}")
    rows = [(" ".join(word("bad", (r + k * 7) % 600) for k in range(6)) + " " + word("of", rng.randrange(50)), 1) for r in range(600)]
    rows += [(" ".join(word("of", rng.randrange(50)) for _ in range(6)) + " " + word("new", r), 0) for r in range(3000)]
    train = spark.createDataFrame(rows, "text string, y int").repartition(3).cache()
    pos, every = collections.Counter(), collections.Counter()
    for t, y in rows:
        every.update(toxicity.entries_of(t))
        pos.update(toxicity.entries_of(t) if y else ())
    p, n, want = 600, len(rows), {}
    for e, k in pos.items():
        m = every[e]
        cells = ((k, m * p / n), (m - k, m * (n - p) / n), (p - k, (n - m) * p / n), (n - p - m + k, (n - m) * (n - p) / n))
        odds = np.log((k + 0.5) / (p + 1)) - np.log((m - k + 0.5) / (n - p + 1))
        if odds > np.log(4) and 2 * sum(a * np.log(a / b) for a, b in cells if a) >= 10.83:
            want[e] = odds
    assert len(want) >= 1200  # two spellings of 600 words in 6 rows each
    got = toxicity.mined(train)
    assert {e for e, _ in got} == set(want) and all(abs(o - want[e]) < 1e-9 for e, o in got)


def test_linear_fit_is_the_optimum():
    rng = np.random.default_rng(1)
    hits = [sorted(rng.choice(30, rng.integers(0, 6), replace=False).tolist()) for _ in range(400)]
    y, odds = rng.random(400), rng.random(30) * 3
    w, b = toxicity.fit_linear(hits, y, 30, odds)
    x = np.zeros((400, 30))
    for i, h in enumerate(hits):
        x[i, h] = 1
    gap = 1 / (1 + np.exp(-(x @ w + b))) - y
    assert np.abs(x.T @ gap + w - 0.5 * odds).max() < 1e-4 and abs(gap.sum()) < 1e-3


def test_label_model_learns_rates():
    rng = np.random.default_rng(0)
    y = rng.random(20000) < 0.1
    fire = np.stack([np.where(y, rng.random(20000) < a, rng.random(20000) < b) for a, b in ((0.9, 0.01), (0.8, 0.02), (0.7, 0.05))], 1)
    masks, inv, n = np.unique(fire @ np.array([1, 2, 4]), return_inverse=True, return_counts=True)
    known = rng.random(20000) < 0.1
    pos = np.bincount(inv[known & y], minlength=len(masks))
    neg = np.bincount(inv[known & ~y], minlength=len(masks))
    post = toxicity.label_model(masks, n, pos, neg, voters=3)
    assert (((post[inv] > 0.5) == y).mean()) > 0.98


# ---- 10

def test_targets():
    got = mixing.targets([("a", 100), ("b", 100), (None, 1000)])
    # shares 5 : 2 : 1 of 1800; a and b stop at 200, the rest goes to the null source
    assert got["a"] == 200 and got["b"] == 200 and got[None] == 1400
    assert mixing.targets([]) == {}


def test_permutation_and_draws():
    for n in (1, 2, 3, 64, 1000):
        j = np.arange(n)
        assert sorted(mixing.permuted(j, np.full(n, n), np.full(n, 9))) == list(range(n))
    wanted = [500, 300, 7]
    whole = list(mixing.draws(wanted, 100, 9))
    assert sorted(x[0] for x in whole) == list(range(9))
    whole.sort(key=lambda x: x[0])
    assert sum(x[2] for x in whole).tolist() == wanted and [int(x[2].sum()) for x in whole] == [100] * 8 + [7]
    assert all((b[1] == a[1] + a[2]).all() for a, b in zip(whole, whole[1:]))
    # a task's own shards are drawn as they are in the whole
    part = sorted(mixing.draws(wanted, 100, 9, 3, 6), key=lambda x: x[0])
    assert [x[0] for x in part] == [3, 4, 5] and all((x[1] == y[1]).all() and (x[2] == y[2]).all() for x, y in zip(part, whole[3:]))
    rng = np.random.Generator(np.random.PCG64(1))
    good, bad, n = 3 * 10**9, 7 * 10**9, 4 * 10**9
    x = np.array([mixing.hypergeometric(rng, good, bad, n) for _ in range(4000)], float)
    spread = (n * 0.3 * 0.7 * (good + bad - n) / (good + bad - 1)) ** 0.5
    assert abs(x.mean() - 0.3 * n) < 4 * spread / 4000**0.5 and 0.95 < x.std() / spread < 1.05


def test_mixing(spark, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("source", F.when(F.col("source") != "src9", F.col("source")))
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 50 != 0, F.col("text")))
    got = mixing.mix(docs).toPandas()
    again = mixing.mix(docs.repartition(3)).toPandas()
    key = ["doc_id", "taken"]
    assert got[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()
    assert len(got) == docs.count() and (got.taken <= 2 * got["size"]).all()
    sums = got.groupby(got.source.fillna("~")).agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"), source_size=("source_size", "first"))
    assert (sums["size"] == sums.source_size).all()
    assert ((sums.taken - sums.target).abs() <= np.maximum(200, 0.02 * sums.target)).all()
    want = mixing.targets([(None if s == "~" else s, int(n)) for s, n in sums["size"].items()])
    assert all(abs(float(want[None if s == "~" else s]) - t) < 1e-6 for s, t in sums.target.items())
    assert mixing.mix(none.select("doc_id", "text", "source")).count() == 0


# ---- plumbing

def test_words_match_the_pattern():
    rng = random.Random(3)
    import pyarrow as pa

    texts = ["".join(rng.choice("ab \t\n\x0b\x1cé") for _ in range(rng.randrange(40))) for _ in range(200)] + ["", " "]
    w = tk.Words(*tk.string_buffer(pa.array(texts)))
    assert np.diff(w.first).tolist() == [len(WORD.findall(t)) for t in texts]
    flat = [x for t in texts for x in WORD.findall(t)]
    assert len(set(flat)) == len(set(w.hash.tolist())) and len({(a, b) for a, b in zip(flat, w.hash.tolist())}) == len(set(flat))
