"""Token counts of whole texts, huge ones by overlap resynchronisation.

A text longer than ``CHUNK`` characters is encoded in overlapping chunks, with
the offsets of each token in the text. Two neighbours are spliced at a boundary
in their overlap that is proven stable: it follows an ASCII white-space
character, which the tokenizer drops and across which neither its normaliser
nor its splitter nor an added token reaches, and from it to the end of the
overlap both chunks have the same tokens at the same offsets. If there is no
such boundary (one giant word, say) the overlap is doubled and the left chunk
encoded again, at worst up to the end of the text.

Shorter texts are cut at ASCII white space, equally stable, and the library's
count of each distinct part is memoised up to ``MEMO`` parts per worker.

Null and empty texts have 0 bytes and 0 tokens. Special strings inside texts
are special tokens, as is the library's default. Repeated rows give repeated
results; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk

VOCABULARY = "word_bpe_49k.json"
CHUNK, OVERLAP, MEMO, LIMIT = 1 << 16, 1 << 8, 500_000, 2048
_WHITE = re.compile(r"[\t-\r ]")
_SEPARATORS = re.compile("[\x1c-\x1f]")


@lru_cache(maxsize=4)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def spans(tok, text: str, a: int, b: int) -> list[tuple[int, int, int]]:
    """(start, end, id) of the tokens of text[a:b], by place in the text."""
    e = tok.encode(text[a:b], add_special_tokens=False)
    return [(a + s, a + t, i) for (s, t), i in zip(e.offsets, e.ids)]


def splice_point(left, right, text: str, a: int, b: int) -> int | None:
    """The first stable boundary in a..b after which left and right agree up to the last one, or None."""
    cuts = [m.end() for m in _WHITE.finditer(text, a, b)]
    if len(cuts) < 2:
        return None
    end = cuts[-1]
    tail = [x for x in left if x[0] >= a and x[1] <= end]
    head = [x for x in right if x[0] >= a and x[1] <= end]
    for cut in cuts[:-1]:
        mine = [x for x in tail if x[0] >= cut]
        if mine and mine == [x for x in head if x[0] >= cut] and not any(x[0] < cut < x[1] for x in left + right):
            return cut
    return None


def count_huge(tok, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    n = len(text)
    total, begin, at = 0, 0, 0  # begin: of the text not counted yet; at: where its chunk starts
    while True:
        end = min(n, at + chunk)
        wide = overlap
        while True:
            stop = min(n, end + wide)
            left = spans(tok, text, at, stop)
            if stop == n:
                return total + sum(x[0] >= begin for x in left)
            # the right chunk's own encoding of the overlap and a margin beyond it
            right = spans(tok, text, end, min(n, stop + wide))
            cut = splice_point(left, right, text, end, stop)
            if cut is not None:
                break
            wide *= 2
        total += sum(begin <= x[0] < cut for x in left)
        begin, at = cut, end


_COUNTS: dict[str, int] = {}


def count_batch(tok, texts: list[str], memo: dict[str, int] | None = None) -> list[int]:
    memo = _COUNTS if memo is None else memo
    if len(memo) > MEMO:
        memo.clear()
    parts = [_parts(t) if len(t) <= CHUNK else None for t in texts]
    missing = list({w for p in parts if p for w in p}.difference(memo))
    for a in range(0, len(missing), 4096):
        some = missing[a : a + 4096]
        memo.update(zip(some, map(len, tok.encode_batch_fast(some, add_special_tokens=False))))
    return [count_huge(tok, t) if p is None else sum(map(memo.__getitem__, p)) for t, p in zip(texts, parts)]


def _parts(text: str) -> list[str]:
    """Cut at white space; split() also takes 0x1C to 0x1F for white space, which the tokenizer does not."""
    if _SEPARATORS.search(text):
        return [x for x in _WHITE.split(text) if x]
    return text.split()


def counted(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    def run(batch):
        tok = load(path or public_tokenizers.path(VOCABULARY))
        texts = [t or "" for t in batch.column(0).to_pylist()]
        n = count_batch(tok, texts)
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return tk.per_batch(docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("bigint").alias("doc_id")), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(tk.table(spark, sf_dir, "documents"))
