"""Toxicity by weak supervision.

Voters: each is a lexicon of words (exact, folded to small letters, or by their
first six letters) found from labelled training rows by their log odds and a
fixed test of significance (all that pass, however many), cut into ``VOTERS`` lexicons by strength and kind, and two patterns (runs of
exclamation marks, words in capitals). A text is the bit mask of the voters that
fire on it. A generative label model explains how often each mask occurs over
all documents: given the hidden label each voter fires with its own rate
(expectation maximisation, with masks of labelled training rows held at their
labels), and correlations of voters within a class discount the weight of
voters that say the same. A linear classifier over single lexicon entries is
then fitted to the posterior labels of at most ``FIT_ROWS`` training rows (the
least by hash of doc_id), and scores every whole text.

Statistics over words cover all training rows, mask counts all documents.
The driver gets the entries that pass, at most ``BITS`` hashes of those counted,
2**VOTERS masks and FIT_ROWS rows. Null and empty texts score as texts in which nothing fires. Without
training labels of both kinds every score is the share of label 1 (0 if there
is none). Labels that are null are unlabelled; of several labels of a doc_id
the largest holds. Extra columns are ignored; repeated rows score alike.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk

VOTERS, FIT_ROWS, PREFIX = 10, 20_000, 6
#: An entry is kept if it is at least so many times as likely in toxic rows, at a log-likelihood ratio (chi-squared of one degree, 0.1 %) of at least that.
ODDS, SIGNIFICANT = 4, 10.83
#: Bits of the map of entries that could pass; entries a task holds before it gives them on.
BITS, HELD = 1 << 24, 400_000
CUT = 0.3
_WORD = re.compile(r"[^\W\d_]+")
_SHOUT = re.compile(r"!{2,}")


def entries_of(text: str) -> set[str]:
    """Every entry a text could match: =word, ~word in small letters, ^first letters of a longer word."""
    words = set(_WORD.findall(text))
    return {"=" + w for w in words} | {"~" + w.lower() for w in words} | {"^" + w[:PREFIX] for w in words if len(w) > PREFIX}


def counted(rows: DataFrame, among: np.ndarray | None = None) -> DataFrame:
    """(entry, n): rows (text) that have each entry, or each whose bit is in the map ``among``. A task adds up what it reads before the shuffle."""
    shared = rows.sparkSession.sparkContext.broadcast(among) if among is not None else None

    def run(batches):
        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen.update(entries_of(t or ""))
            if len(seen) > HELD:
                yield out(seen)
                seen.clear()
        if seen:
            yield out(seen)

    def out(seen):
        got = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["entry", "n"])
        if shared is None:
            return got
        at = np.fromiter((zlib.crc32(e.encode()) for e in seen), np.int64, len(seen)) % BITS
        return got.filter(pa.array((shared.value[at >> 3] >> (at & 7) & 1).astype(bool)))

    return rows.select("text").mapInArrow(run, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))


def evidence(k, rest, p: int, n: int) -> tuple[F.Column, F.Column]:
    """Log odds and log-likelihood ratio of an entry in ``k`` of ``p`` toxic rows and ``rest`` of the others of ``n``."""

    def part(a, share):
        return F.when(a > 0, a * F.log(a / ((k + rest) * share))).otherwise(0.0)

    def left(a, share):
        return F.when(a > 0, a * F.log(a / ((F.lit(n) - k - rest) * share))).otherwise(0.0)

    odds = F.log((k + 0.5) / (p + 1.0)) - F.log((rest + 0.5) / (n - p + 1.0))
    return odds, 2 * (part(k, p / n) + part(rest, (n - p) / n) + left(F.lit(p) - k, p / n) + left(F.lit(n - p) - rest, (n - p) / n))


def mined(train: DataFrame) -> list[tuple[str, float]]:
    """All entries at least ``ODDS`` times as likely in toxic rows at the level of ``SIGNIFICANT``, with log odds.

    Counts meet by entry. Of the other rows only entries that could pass are shuffled: a bit map leaves out most others,
    the join the rest."""
    total = train.agg(F.sum("y").alias("p"), F.count("*").alias("n")).first()
    p, n = int(total.p or 0), int(total.n or 0)
    if not 0 < p < n:
        return []
    # an entry of no other row has the most evidence that so many toxic rows can give
    could = evidence(F.col("n"), F.lit(0), p, n)
    pos = tk.stored(counted(train.where("y = 1")).where((could[0] > float(np.log(ODDS))) & (could[1] >= SIGNIFICANT)), "toxic")
    at = pos.select((F.crc32(F.encode("entry", "UTF-8")) % BITS).cast("int").alias("at")).distinct().toArrow().column("at").to_numpy()
    bits = np.zeros(BITS, bool)
    bits[at] = True
    others = counted(train.where("y <> 1"), np.packbits(bits, bitorder="little")).withColumnRenamed("n", "rest")
    odds, ratio = evidence(F.col("n"), F.col("rest"), p, n)
    both = pos.join(others, "entry", "left").fillna(0, ["rest"]).withColumn("odds", odds).withColumn("ratio", ratio)
    good = both.where((F.col("odds") > float(np.log(ODDS))) & (F.col("ratio") >= SIGNIFICANT)).select("entry", "n", "odds").collect()
    tk.discard(pos)
    return [(r.entry, r.odds) for r in sorted(good, key=lambda r: (-r.n * r.odds, r.entry))]


def voters_of(lexicon: list[tuple[str, float]]) -> list[int]:
    """The voter of each entry: exact and folded words in turn over the strong and the weak lexicons, prefixes in two of their own."""
    out, turn = [], [0, 0]
    mid = float(np.median([o for _, o in lexicon])) if lexicon else 0.0
    for e, o in lexicon:
        if e[0] == "^":
            out.append(6 if o >= mid else 7)
        else:
            strong = int(o >= mid)
            out.append(3 * (1 - strong) + turn[strong] % 3)
            turn[strong] += 1
    return out


class Matcher:
    """Entries of a lexicon that a text has, found in one pass over the text and one over its small letters."""

    def __init__(self, lexicon: list[str]):
        import ahocorasick

        self.exact, self.folded = ahocorasick.Automaton(), ahocorasick.Automaton()
        both: dict[str, list[tuple[int, bool]]] = {}
        fold: dict[str, list[tuple[int, bool]]] = {}
        for i, e in enumerate(lexicon):
            (fold if e[0] == "~" else both).setdefault(e[1:], []).append((i, e[0] == "^"))
        for auto, found in ((self.exact, both), (self.folded, fold)):
            for w, hits in found.items():
                auto.add_word(w, (len(w), hits))
            if found:
                auto.make_automaton()
        self.use = bool(both), bool(fold)

    @staticmethod
    def _inside(text: str, i: int) -> bool:
        return 0 <= i < len(text) and _WORD.match(text[i]) is not None

    def __call__(self, text: str) -> list[int]:
        got: set[int] = set()
        for auto, use, t in ((self.exact, self.use[0], text), (self.folded, self.use[1], text.lower())):
            if not use or not t:
                continue
            for end, (n, hits) in auto.iter(t):
                if self._inside(t, end - n):
                    continue
                after = self._inside(t, end + 1)
                got.update(i for i, prefix in hits if prefix == after)
        return sorted(got)


def matched(docs: DataFrame, lexicon: list[tuple[str, float]]) -> DataFrame:
    """doc_id, hits (entries), mask (voters that fire) of every row."""
    words, voters = [e for e, _ in lexicon], voters_of(lexicon)
    cache: list[Matcher] = []

    def run(batch):
        if not cache:
            cache.append(Matcher(words))
        texts = [t or "" for t in batch.column(0).to_pylist()]
        hits = [cache[0](t) for t in texts]
        masks = []
        for t, h in zip(texts, hits):
            m = 0
            for i in h:
                m |= 1 << voters[i]
            m |= (len(_SHOUT.findall(t)) > 2) << 8 | (len(t) > 20 and t.isupper()) << 9
            masks.append(m)
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array(hits, pa.list_(pa.int32())), pa.array(masks, pa.int32())], ["doc_id", "hits", "mask"])

    return tk.per_batch(docs.select("text", "doc_id"), run, "doc_id long, hits array<int>, mask int")


def label_model(masks: np.ndarray, n: np.ndarray, pos: np.ndarray, neg: np.ndarray, voters: int = VOTERS, rounds: int = 50) -> np.ndarray:
    """Posterior of label 1 for each mask. n: documents with the mask; pos, neg: labelled training rows among them."""
    fire = (masks[:, None] >> np.arange(voters)) & 1
    free = np.maximum(n - pos - neg, 0).astype(float)
    known = pos.sum() + neg.sum()
    prior = (pos.sum() + 1) / (known + 2)
    post = np.where(pos + neg > 0, (pos + prior) / (pos + neg + 1), prior)
    for _ in range(rounds):
        one, zero = pos + free * post, neg + free * (1 - post)
        prior = np.clip(one.sum() / max(1e-9, one.sum() + zero.sum()), 1e-4, 1 - 1e-4)
        rate1 = (one @ fire + 0.5) / (one.sum() + 1)
        rate0 = (zero @ fire + 0.05) / (zero.sum() + 1)
        weight = np.ones(voters)
        for w, rate in ((one, rate1), (zero, rate0)):
            dev = fire - rate
            cov = (dev * w[:, None]).T @ dev / max(1.0, w.sum())
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            rho = np.clip(cov / np.outer(sd, sd), 0, 1)
            np.fill_diagonal(rho, 0)
            weight = np.minimum(weight, 1 / (1 + rho.sum(1)))
        gain = fire * np.log(rate1 / rate0) + (1 - fire) * np.log((1 - np.minimum(rate1, 0.999)) / (1 - np.minimum(rate0, 0.999)))
        new = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + gain @ weight, -30, 30)))
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    return post


def fit_linear(hits: list[list[int]], y: np.ndarray, entries: int, odds: np.ndarray, l2: float = 1.0, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton steps, drawn towards the entries' scaled log odds.

    The steps are solved by conjugate gradients over the hits alone, so that memory grows with them and not with rows x entries."""
    row = np.repeat(np.arange(len(hits)), np.fromiter(map(len, hits), np.int64, len(hits)))
    col = np.fromiter((i for h in hits for i in h), np.int64, len(row))

    def times(v):
        return np.bincount(row, v[col], len(hits)) + v[-1]

    def back(r):
        return np.append(np.bincount(col, r[row], entries), r.sum())

    def loss(w):
        z = times(w)
        return float((np.logaddexp(0, z) - y * z).sum() + (reg * (w - start) ** 2).sum() / 2)

    w = np.append(0.5 * odds, np.log((y.mean() + 1e-4) / (1 - y.mean() + 1e-4)) if len(y) else 0.0)
    start = w.copy()
    reg = np.full(entries + 1, l2)
    reg[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(times(w), -30, 30)))
        curve = p * (1 - p) + 1e-6
        diag = back(curve) + reg
        step, r = np.zeros(entries + 1), back(p - y) + reg * (w - start)
        small = 1e-16 * float(r @ (r / diag))
        d, rz = r / diag, float(r @ (r / diag))
        for _ in range(10 * (entries + 1)):
            if rz <= small:
                break
            hd = back(curve * times(d)) + reg * d
            a = rz / float(d @ hd)
            step += a * d
            r = r - a * hd
            z = r / diag
            new = float(r @ z)
            d, rz = z + new / rz * d, new
        at = loss(w)
        while np.abs(step).max() >= 1e-5 and loss(w - step) > at:  # a step too far
            step /= 2
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return w[:-1], float(w[-1])


def weighed(feats: DataFrame, weights: np.ndarray, base: float) -> DataFrame:
    """doc_id, score of every row: the logistic function of the sum of its entries' weights."""
    shared = feats.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for batch in batches:
            hits = batch.column(1)
            row = np.repeat(np.arange(len(hits)), hits.value_lengths().to_numpy())
            z = base + np.bincount(row, shared.value[hits.flatten().to_numpy()], len(hits))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-z)), pa.float64())], ["doc_id", "score"])

    return feats.select("doc_id", "hits").mapInArrow(run, "doc_id long, score double")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``; labels (doc_id, toxic) of held-out rows are not read."""
    known = labels.where(F.col("toxic").isNotNull() & ~tk.held_out("doc_id")).groupBy("doc_id").agg(F.max(F.col("toxic")).cast("int").alias("y"))
    # the one join that moves texts; its result is read three times
    train = tk.stored(docs.where("text is not null").join(known.hint("merge"), "doc_id").select("text", "y"), "train")
    lexicon = mined(train)
    feats = tk.stored(matched(docs, lexicon), "tox")
    marked = feats.join(known, "doc_id", "left")
    rows = marked.groupBy("mask").agg(F.count("*").alias("n"), F.count(F.when(F.col("y") == 1, 1)).alias("pos"), F.count(F.when(F.col("y") == 0, 1)).alias("neg")).orderBy("mask").collect()
    masks, n, pos, neg = (np.array([r[i] for r in rows], np.int64) for i in range(4))
    if lexicon:
        post = dict(zip(masks.tolist(), label_model(masks, n, pos, neg).tolist()))
        sample = feats.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS).select("hits", "mask", "y").collect()
        soft = np.array([post[r.mask] for r in sample])
        odds = np.array([o for _, o in lexicon])
        w, b = fit_linear([r.hits for r in sample], soft, len(lexicon), odds)
    else:
        share = pos.sum() / max(1, pos.sum() + neg.sum())
        w, b = np.zeros(0), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    return weighed(feats, w, b).select("doc_id", tk.held_out("doc_id").alias("held_out"), "score").withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tk.only(tk.table(spark, sf_dir, "documents"), doc_id="bigint", text="string")
    return scored(docs, tk.only(tk.table(spark, sf_dir, "labels"), doc_id="bigint", toxic="int"))
