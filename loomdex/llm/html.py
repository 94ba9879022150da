"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Structure that is never main
text (head, nav, footer, aside, forms, scripts, styles) is dropped; where it
stands inside a line, the line goes on behind it. Blocks in an element named as
advert, menu, notice or comments are bad. A name is a whole word of class, id or
role whose parts are all such names or mere position and shape (``site-footer``,
not ``has-sidebar`` or ``share-price-report``). The first pass decides each
other block by stop-word density, length, link density and whether an article
element or a heading holds it: good, bad, or undecided if it is short. On a page
with hardly any stop word (another language) length stands for density.
An article is evidence, not a switch: inside it a lower density is enough and a
low one leaves a block undecided; outside it blocks are judged as on a page
without one. In the second pass an undecided block takes the label that its
nearest decided neighbours agree on, and that of the nearer one if they differ
(the earlier one on a tie). Neighbours are those on the same side of an
article's edge; the edge stands for a far neighbour, good to the blocks inside
and bad to those outside. If no block is good, names that hold more than half of
the page's text do not count, and if still none is, all blocks are kept that are
neither named nor mostly links. Blocks are in page order; no block is cut or
capped.

Null, empty and tag-only pages give an empty text. Unclosed and stray tags are
tolerated: a block-level tag ends a block whatever is open, and an element that
is never closed ends with its parent. Extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk

BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROP = frozenset("head nav footer aside form script style noscript template svg math canvas iframe object button select option textarea title menu dialog noembed noframes audio video".split())
#: Elements that the named tags close when still open.
CLOSED_BY = {"p": {"p"}, "li": {"p", "li"}, "dt": {"p", "dt", "dd"}, "dd": {"p", "dt", "dd"}, "tr": {"p", "td", "th", "tr"}, "td": {"p", "td", "th"}, "th": {"p", "td", "th"}, "option": {"option"}}
SCOPES = frozenset("table ul ol dl article div section blockquote".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts of a class, id or role that mark boilerplate, and parts that may stand beside them.
NAMED = frozenset("ad ads banner menu sidebar footer header masthead breadcrumb breadcrumbs cookie cookies consent gdpr notice alert popup modal overlay subscribe newsletter signup login social share sharing related recommended comment comments disqus respond replies reply widget widgets toolbar pagination pager copyright legal contentinfo complementary search".split())
NAMED_START = ("advert", "sponsor", "promo", "nav")
BESIDE = frozenset("site page main global top bottom left right primary secondary inner outer first last container wrapper wrap box bar block list section area panel row column col item items group links link form button buttons body content text title js fixed sticky small large mobile desktop".split())
#: Words of high frequency in the languages at hand.
STOP = frozenset("""a an and are as at be by for from has have he her his i in is it its not of on or she that the their they this to was we were which who will with you but all can had him if into more my no our out so some than them then there these up what when your
au aux avec ce ces dans de des du elle en est et eux il je la le les leur lui ma mais me mes nous on ou par pas pour qu que qui sa se ses son sur ta te un une vos votre vous sont plus
aber als am an auch auf aus bei bin bis das dass dem den der des die dies du durch ein eine einem einen einer es für hat ich ihr im in ist ja kann man mit nach nicht noch nur oder sich sie sind so über um und uns von vor war was wenn wer wie wir zu zum zur
al como con de del el ella en entre era es esa ese eso esta este esto la las le lo los me mi muy no nos o para pero por que se si sin sobre su sus te tu un una uno y ya""".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>\x00]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
_NAMES = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z])(?=\d)")

LONG, SHORT, STOP_HIGH, STOP_LOW, LINKS = 200, 70, 0.30, 0.15, 0.5
#: Share of stop words among all words under which a page is in another language.
STRANGE = 0.05


def _is_name(word: str) -> bool:
    parts = [x.lower() for x in _PARTS.split(word.replace("side-bar", "sidebar")) if x]
    named = [x in NAMED or x.startswith(NAMED_START) for x in parts]
    return any(named) and all(n or x in BESIDE or x.isdigit() for x, n in zip(parts, named, strict=True))


def _named(tag: str, attrs: str) -> bool:
    if not attrs.strip() or tag in ("body", "html", "article", "main"):
        return False
    for m in _NAMES.finditer(attrs):
        if m[1].lower() in ("class", "id", "role") and any(map(_is_name, (m[2] or m[3] or m[4] or "").split())):
            return True
    return False


def _hidden(tag: str, attrs: str) -> bool:
    if not attrs.strip() or tag in ("body", "html", "article", "main"):
        return False
    return any(m[1].lower() == "hidden" or m[1].lower() == "aria-hidden" and (m[2] or m[3] or m[4]) == "true" for m in _NAMES.finditer(attrs))


def blocks(page: str):
    """(text, characters in links, inside an article or main element, is a heading, numbers of the named elements it is in) of each
    block that is not dropped."""
    out: list[tuple[str, int, bool, bool, tuple[int, ...]]] = []
    stack: list[tuple[str, bool]] = []
    names: list[int] = []
    n_names = 0
    text: list[str] = []
    drop = article = anchor = 0
    linked = 0
    heading = seen = False

    def flush():
        nonlocal linked, heading
        if text:
            s = _SPACE.sub(" ", _html.unescape("".join(text))).strip()
            if s:
                out.append((s, linked, article > 0, heading, tuple(names)))
            text.clear()
        linked, heading = 0, False

    def pop():
        nonlocal drop, article, anchor
        tag, dropped = stack.pop()
        drop -= dropped == 1
        if dropped == 2:
            names.pop()
        article -= tag in ("article", "main")
        anchor -= tag == "a"

    def add(s: str):
        nonlocal linked, heading
        if s and not drop:
            text.append(s)
            if anchor:
                linked += len(s.strip())
            if any(t in HEADINGS for t, _ in stack[-3:]):
                heading = True

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            if m[1]:
                add(m[1])
            continue
        if tag in ("br", "wbr"):
            if tag == "br":
                add(" ")
            continue
        if tag in BLOCK and not drop:
            flush()
        if m[2]:
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            if k < 0:
                continue
            if tag in BLOCK or tag in DROP or not any(t in BLOCK for t, _ in stack[k + 1 :]):
                while len(stack) > k:
                    pop()
            elif tag == "a":  # closed across a block: only the link ends
                anchor -= 1
                stack[k] = ("", stack[k][1])
            continue
        if tag in VOID or m[4].rstrip().endswith("/") and tag in ("svg", "path", "use", "circle", "rect"):
            continue
        # 1: gone, 2: named
        dropped = int(tag in DROP or _hidden(tag, m[4]) or tag == "header" and not article)
        if not dropped and _named(tag, m[4]):
            dropped = 2 if tag in BLOCK else 1
        if tag in ("article", "main") and (drop or names) and not seen:  # what was left open before the article ends here
            while drop or names:
                pop()
        seen = seen or tag in ("article", "main")
        for gone in CLOSED_BY.get(tag, {"p"} if tag in BLOCK else ()):
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == gone), -1)
            if k >= 0 and not any(t in SCOPES for t, _ in stack[k + 1 :]):
                while len(stack) > k:
                    pop()
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        stack.append((tag, dropped))
        drop += dropped == 1
        if dropped == 2:
            n_names += 1
            names.append(n_names)
        article += tag in ("article", "main")
        anchor += tag == "a"
    flush()
    return out


GOOD, BAD, UNDECIDED = 1, 0, -1


def density(s: str) -> tuple[int, int]:
    """Stop words and words."""
    words = s.split()
    return sum(w.strip(".,;:!?\"'()").lower() in STOP for w in words), len(words)


def classify(items: list[tuple[str, int, bool, bool]]) -> list[bool]:
    """First pass by each block's own figures, second pass by its neighbours."""
    first: list[int] = []
    counts = [density(x[0]) for x in items]
    foreign = sum(n for n, _ in counts) < STRANGE * sum(n for _, n in counts)
    for (s, linked, inside, heading), (n, of) in zip(items, counts, strict=True):
        stop = n / max(1, of)
        if linked > LINKS * len(s):
            first.append(BAD)
        elif foreign:
            # scripts without blanks between words say more in a character
            first.append(GOOD if len(s) >= (LONG if of * 15 > len(s) else SHORT) else UNDECIDED)
        elif len(s) < SHORT:
            first.append(UNDECIDED)
        elif stop >= STOP_HIGH or (inside or len(s) >= LONG) and stop >= STOP_LOW:
            first.append(GOOD)
        elif inside or stop >= STOP_LOW or heading:
            first.append(UNDECIDED)
        else:
            first.append(BAD)

    def nearest(order) -> list[tuple[int, int]]:
        """(label, distance) of the last decided block of the same side, in that order."""
        got, last, side = [(BAD, 0)] * len(items), (BAD, 0), None
        for i in order:
            if items[i][2] != side:
                side = items[i][2]
                last = (GOOD if side else BAD, 1 << 60)
            last = (first[i], 0) if first[i] != UNDECIDED else (last[0], last[1] + 1)
            got[i] = last
        return got

    before, after = nearest(range(len(items))), nearest(reversed(range(len(items))))
    out = []
    for i, x in enumerate(first):
        if x != UNDECIDED:
            out.append(x == GOOD)
        elif items[i][3]:  # a heading goes with what follows it
            out.append(after[i][0] == GOOD)
        else:
            (b, db), (a, da) = before[i], after[i]
            out.append((b if db <= da else a) == GOOD)
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    items, names = [x[:4] for x in found], [set(x[4]) for x in found]
    for named in (names, _less(items, names)):
        kept = [k for k, n in enumerate(named) if not n]
        good = [k for k, ok in zip(kept, classify([items[k] for k in kept]), strict=True) if ok]
        if good:
            break
    else:
        good = [k for k in kept if items[k][1] <= LINKS * len(items[k][0])]
    return "\n".join(items[k][0] for k in good)


def _less(items: list[tuple[str, int, bool, bool]], names: list[set[int]]) -> list[set[int]]:
    """The named elements of each block without those that hold over half of the page's text."""
    total, size = 0, Counter()
    for x, n in zip(items, names, strict=True):
        total += len(x[0])
        size.update(dict.fromkeys(n, len(x[0])))
    return [{k for k in n if 2 * size[k] <= total} for n in names]


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    def run(batch):
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([main_text(x) for x in batch.column(2).to_pylist()], pa.string())], ["page_id", "url", "text"])

    src = pages.select(F.col(key).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return tk.per_batch(src, run, "page_id bigint, url string, text string", text="html")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(tk.table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
