import io
import zipfile

import pytest

from loomdex import schemas
from loomdex.service import HashingEmbedder, Library, embed, failure, json_line, redact, success
from loomdex.sources import files as S

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/media/image1.png", b"x" * 100)
    return out.getvalue()


P = "<w:p>{0}<w:r><w:t>{1}</w:t></w:r></w:p>"
H = '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>'


def test_docx():
    body = P.format(H, "Top") + P.format("", "Text") + "<w:tbl><w:tr><w:tc>" + P.format("", "a|b") + "</w:tc><w:tc>" + P.format("", "c") + "</w:tc></w:tr></w:tbl>"
    kind, got = S.read_sections(docx(body), "x.docx")
    assert kind == "docx" and got[0]["heading"] == "Top" and "Text" in got[0]["text"] and "| a\\|b | c |" in got[0]["text"]
    assert S.images_of(docx(body))[0]["byte_size"] == 100


def test_fodt():
    xml = '<?xml version="1.0"?><office:document xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0" office:mimetype="application/vnd.oasis.opendocument.text"><office:body><office:text><text:h text:outline-level="1">Head</text:h><text:p>One<text:s text:c="2"/>two</text:p></office:text></office:body></office:document>'
    kind, got = S.read_sections(xml.encode(), "x.fodt")
    assert kind == "odt" and got == [{"section": 1, "heading": "Head", "text": "# Head\n\nOne  two"}]


def test_markdown_and_frontmatter():
    head, rest = S.frontmatter("---\ntitle: T\ntags: [a, 1, b]\n---\n# A\n\ntext\n## B\n```\n# no heading\n```\n")
    assert head == {"title": "T", "tags": ["a", "b"]}
    assert [s["heading"] for s in S.sections(S.markdown_blocks(rest))] == ["A", "A > B"]
    assert S.frontmatter("---\n: [\n---\nx")[0] == {}


def test_text_and_detection():
    assert S.plain_text("﻿a  \r\n\r\n\r\n\r\nb\x00".encode()) == "a\n\nb"
    assert S.detect(b"junk%PDF-1.7", "x.txt") == "pdf"
    for bad in (b"\xff\xfe\xfa", b"a\x00b", b"PK\x03\x04broken"):
        with pytest.raises(S.SourceError):
            S.detect(bad, "x.txt")


def test_discovery(spark, tmp_path):
    for name in ("a.md", "sub/b.txt", "sub/c.bin", "sub/deep/d.md", "LICENSE"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("# Title\n\ntext")
    rel = lambda **k: sorted(r.rel for r in S.discover(spark, str(tmp_path), **k).collect())
    assert rel() == ["LICENSE", "a.md", "sub/b.txt", "sub/deep/d.md"]
    assert rel(recursive=False) == ["LICENSE", "a.md"]
    assert rel(include=["**/*.md"], exclude=["sub/**"]) == ["a.md"]
    got = S.read_documents(S.discover(spark, str(tmp_path), include=["**/*.{md,txt}"])).collect()
    assert sorted(r.file_type for r in got) == ["markdown", "markdown", "txt"] and all(r.error is None for r in got)
    assert S.resolve_filters({"include": ["a"], "exclude": ["b"]}, ["c"], ["b", "d"]) == (["c"], ["b", "d"])


def test_library_snapshots(spark, tmp_path):
    lib = Library(spark, f"file://{tmp_path}/lib")
    assert lib.table("chunks").count() == 0
    c = spark.createDataFrame([("d-0", "d", 1, 0, "storage", "storage")], schemas.schema("chunks"))
    lib.commit(chunks=c, embeddings=embed(c, HashingEmbedder(3)))
    assert lib.table("chunks").first().content == "storage" and schemas.dimension(lib.table("embeddings")) == 3
    lib.commit(chunks=lib.table("chunks").limit(0))
    assert lib.table("chunks").count() == 0 and lib.table("embeddings").count() == 1
    with pytest.raises(schemas.SchemaError):
        lib.commit(chunks=c.drop("page"))


def test_envelopes():
    assert json_line(success("stats", {"n": 1})) == '{"ok":true,"command":"stats","result":{"n":1}}'
    assert failure("x", "E", "m")["error"] == {"code": "E", "message": "m"}
    assert redact({"a": {"apiKey": "s"}, "b": [{"token": "t"}]}) == {"a": {"apiKey": "[redacted]"}, "b": [{"token": "[redacted]"}]}


def test_streams(spark, tmp_path, sf_dir):
    from loomdex.streaming import ingest as I

    seen = []
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    d.repartition(3).write.parquet(str(tmp_path / "in"))
    q = I.ingest(I.document_stream(spark, str(tmp_path / "in"), "doc_id long, text string", 1), lambda df, i: seen.append(df.count()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert len(seen) == 3 and sum(seen) == d.count()
