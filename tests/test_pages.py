"""The chain of paged documents against the rules line by line."""

import math
import random
import re
from collections import Counter

import pytest

from loomdex.operators import chunking as K
from loomdex.operators import pages as PG


def normal(line):
    return re.sub(r"\s+", " ", line.replace("\x00", "").replace("\u00a0", " "), flags=re.ASCII).strip().lower()


def number(line):
    return re.fullmatch(r"(?:page\s*)?\d+(?:\s*(?:/|of)\s*\d+)?", line.strip(), re.I)


def cleaned(pages):
    """pages: {page: text} of one document."""
    lines = {p: re.sub(r"\r\n?", "\n", t or "").split("\n") for p, t in pages.items()}
    edges, filled, counts = {}, {}, Counter()
    for p, ls in lines.items():
        filled[p] = f = [i for i, x in enumerate(ls) if normal(x)]
        top, bottom = (1, 2) if len(f) <= 5 else (3, 3)
        edges[p] = {*f[:top], *f[-bottom:]}
        counts.update({x for x in (normal(ls[i]) for i in edges[p]) if len(x) <= 120})
    often = {x for x, n in counts.items() if n >= max(2, math.ceil(len(pages) / 2))}
    gone = lambda p, i, x: i in edges[p] and normal(x) in often or filled[p] and i in (filled[p][0], filled[p][-1]) and number(x)
    return {p: "\n".join(x for i, x in enumerate(ls) if not normal(x) or not gone(p, i, x)) for p, ls in lines.items()}


@pytest.fixture(scope="module")
def documents():
    rng = random.Random(7)
    report = {k: f"Quarterly Report\nBody {k} went up.\n\u00a0 Confidential\nPage {k} of 3" for k in (1, 2, 3)}
    body = {k: f"Header\nIntro {k}\nMore {k}\nImportant finding.\nDetail {k}\nClosing {k}\n{k}" for k in (1, 2)}
    numbers = {k: f"Header\nIntro {k}\n42\nBody\n{k}" for k in (1, 2)}
    odd = {1: None, 2: "", 3: " \n\t\n", 4: "7", 5: "a\r\nb\rc", 6: "x" * 200 + "\nend", 7: "x" * 200 + "\nend"}
    out = {1: report, 2: body, 3: numbers, 4: odd, 5: {1: "alone\nPage 1"}}
    for d in range(10, 60):
        out[d] = {p: "\n".join(rng.choice(["Head", "HEAD ", "", "text %d" % rng.randrange(9), "12", "Page 3", "tail"]) for _ in range(rng.randrange(1, 9))) for p in range(rng.randrange(1, 6))}
    return out


def table(spark, documents):
    return spark.createDataFrame([(d, p, t) for d, ps in documents.items() for p, t in ps.items()], "doc_id long, page long, text string").repartition(4)


def test_running_lines_and_page_numbers_go(spark, documents):
    got = {(r.doc_id, r.page): r.text for r in PG.clean_pages(table(spark, documents)).collect()}
    want = {(d, p): t for d, ps in documents.items() for p, t in cleaned(ps).items()}
    assert got == want
    assert got[1, 2] == "Body 2 went up." and "Important finding." in got[2, 1] and "Header" not in got[2, 1] and "42" in got[3, 1]
    assert PG.clean_pages(table(spark, documents).limit(0)).count() == 0


@pytest.mark.parametrize(
    "text,want",
    [
        (None, ""),
        ("inter-\nnational law\nis old", "international law is old"),
        ("One line\u00a0of text\r\nwrapped  here.\n\n\n\nNext.", "One line of text wrapped here.\n\nNext."),
        ("body above.\nANNUAL RESULTS\nbody below, in small letters.", "body above.\n\n# ANNUAL RESULTS\n\nbody below, in small letters."),
        ("Market Overview\nStrategy And Risks\nit went well.", "# Market Overview\n\n# Strategy And Risks\n\nit went well."),
        ("| a |  b |\n|---|---|\n| 1 | 2 |\nlast", "| a | b |\n|---|---|\n| 1 | 2 |\nlast"),
        ("Ends With A Mark.\n12\nPage 3", "Ends With A Mark. 12 Page 3"),
        ("a\x00b\fc", "ab c"),
    ],
)
def test_paragraphs(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(PG.paragraphs(PG.F.col("t"))).first()[0] == want


def test_tables_come_below_their_page(spark):
    pages = spark.createDataFrame([(1, 1, " text \n"), (1, 2, ""), (2, 1, None)], "doc_id long, page long, text string")
    found = [(1, 1, 1, [["x", "y"], ["3", "4|5"]]), (1, 1, 0, [["a", "b"], ["1", "2"]]), (1, 2, 0, [["only"], ["one"]]), (1, 2, 1, [["p", "q"], ["r", ""], ["", "s"]])]
    got = {(r.doc_id, r.page): r.text for r in PG.with_tables(pages, spark.createDataFrame(found, "doc_id long, page long, seq int, rows array<array<string>>")).collect()}
    assert got[1, 1] == "text\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\n| x | y |\n| --- | --- |\n| 3 | 4\\|5 |"
    assert got[1, 2].startswith("| p | q |") and "only" not in got[1, 2] and got[2, 1] == ""


def test_chunks_of_pages_keep_all_words(spark, documents):
    pages = table(spark, {1: {1: "Head\n" + "Some words stand here. " * 90 + "\n1", 2: "Head\nMARKET VIEW\nother text\n2"}, 2: {1: None}})
    got = {(r.doc_id, r.page, r.chunk_index): r.content for r in PG.page_chunks(pages, 300, 0).collect()}
    assert got[1, 2, 0] == "# MARKET VIEW\n\nother text" and not any(k[0] == 2 for k in got)
    assert " ".join(got[1, 1, i] for i in range(len(got) - 1)).split() == ("Some words stand here. " * 90).split()
    assert all(len(x) <= 300 for x in got.values())
    with pytest.raises(ValueError):
        PG.page_chunks(pages, 100, 100)
    assert K.render_table([]) == ""


def test_running_lines_read_the_pages_once(spark, tmp_path):
    rows = [(d, p, f"Report {d}\nbody {d} {p}\nPage {p}") for d in (1, 2) for p in range(4)] + [(None, 0, "x\ny"), (None, 1, "x\ny"), (3, 0, "alone")]
    path = str(tmp_path / "pages")
    spark.createDataFrame(rows, "doc_id long, page long, text string").write.parquet(path)
    found = PG.running_lines(spark.read.parquet(path))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    assert {(r.doc_id, *r.running) for r in found.collect()} == {(1, "report 1"), (2, "report 2")}
