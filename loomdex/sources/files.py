"""Files as documents: discovery with globs, type detection, text, Markdown, DOCX and ODT readers.

PDF pages come from a callable that the caller gives (bytes -> list of page texts): no PDF library is needed otherwise.
"""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import document_id, file_type
from ..operators.chunking import render_table

SUPPORTED = (".pdf", ".md", ".markdown", ".docx", ".odt", ".fodt", ".txt")
MB = 1 << 20
MAX_TEXT = 20 * MB
# Limits of office packages (package, entries, total, entry, XML, content.xml).
ZIP_LIMITS = {"package": 200 * MB, "entries": 10_000, "total": 500 * MB, "entry": 100 * MB, "xml": 50 * MB, "content.xml": 20 * MB}


class SourceError(ValueError):
    """A file that cannot be read as what it is."""


def glob_regex(pattern: str) -> str:
    """A path glob as a regular expression: ** crosses folders, * and ? do not, {a,b} and [..] as usual."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "{":
            end = pattern.find("}", i)
            if end < 0:
                out += r"\{"
            else:
                out += "(?:" + "|".join(map(glob_regex_part, pattern[i + 1 : end].split(","))) + ")"
                i = end
        elif c == "[":
            end = pattern.find("]", i + 1)
            if end < 0:
                out += r"\["
            else:
                body = pattern[i + 1 : end]
                out += "[" + ("^" + body[1:] if body[:1] in "!^" else body) + "]"
                i = end
        else:
            out += re.escape(c)
        i += 1
    return out


def glob_regex_part(part: str) -> str:
    return glob_regex(part)


def discover(spark: SparkSession, root: str, include=(), exclude=(), recursive: bool = True) -> DataFrame:
    """(path, rel, size_bytes, modified) of files with a known extension or none; include first, exclude wins."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root).select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))
    base = root.rstrip("/").split("://")[-1]
    base = re.sub("^file:/*", "/", base)
    files = files.withColumn("rel", F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + re.escape(base) + "/?", ""))
    name = F.lower(F.regexp_extract("rel", "([^/]*)$", 1))
    known = ~F.contains(name, F.lit(".")) | F.regexp_like(name, F.lit("(" + "|".join(re.escape(x) for x in SUPPORTED) + ")$"))
    files = files.where(known)
    if not recursive:
        files = files.where(~F.contains("rel", F.lit("/")))
    any_of = lambda globs: F.regexp_like("rel", F.lit("^(?:" + "|".join(map(glob_regex, globs)) + ")$"))
    if include:
        files = files.where(any_of(include))
    if exclude:
        files = files.where(~any_of(exclude))
    return files


def resolve_filters(config: dict, include=None, exclude=None) -> tuple[list[str], list[str]]:
    """Given includes replace the configured ones; excludes add to them, each once."""
    return list(include if include else config.get("include", [])), list(dict.fromkeys([*config.get("exclude", []), *(exclude or [])]))


_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")


def is_binary_text(text: str) -> bool:
    return "\x00" in text or len(_CONTROL.findall(text)) > 0.05 * len(text)


def detect(content: bytes, name: str) -> str:
    """pdf, docx, odt (package), fodt (flat), markdown or txt; an error for anything else."""
    lower = name.lower()
    if b"%PDF-" in content[:1034]:
        return "pdf"
    if content[:4] == b"PK\x03\x04":
        names = office_entries(content)
        if "word/document.xml" in names:
            return "docx"
        if "content.xml" in names:
            return "odt"
        raise SourceError(f"{name}: a package that is no text document")
    head = content[:4096].lstrip(b"\xef\xbb\xbf \r\n\t")
    if head.startswith(b"<?xml") and b"office:document" in head and b"opendocument.text" in head or lower.endswith(".fodt"):
        return "fodt"
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError as e:
        raise SourceError(f"{name}: not UTF-8 text") from e
    if is_binary_text(text):
        raise SourceError(f"{name}: looks binary")
    if lower.endswith((".md", ".markdown")):
        return "markdown"
    if lower.endswith((".pdf", ".docx", ".odt")):
        raise SourceError(f"{name}: content does not match its extension")
    return "txt"


def office_entries(content: bytes) -> dict[str, zipfile.ZipInfo]:
    """The entries of a package within all limits, by their declared sizes."""
    if len(content) > ZIP_LIMITS["package"]:
        raise SourceError("package too large")
    try:
        infos = zipfile.ZipFile(io.BytesIO(content)).infolist()
    except zipfile.BadZipFile as e:
        raise SourceError("broken package") from e
    if len(infos) > ZIP_LIMITS["entries"]:
        raise SourceError("too many entries")
    if sum(i.file_size for i in infos) > ZIP_LIMITS["total"] or any(i.file_size > ZIP_LIMITS["entry"] for i in infos):
        raise SourceError("unpacked package too large")
    return {i.filename: i for i in infos}


def office_part(content: bytes, part: str) -> bytes:
    """One XML part, read no further than its limit whatever size it declares."""
    infos = office_entries(content)
    if part not in infos:
        raise SourceError(f"no {part}")
    limit = ZIP_LIMITS.get(part, ZIP_LIMITS["xml"])
    with zipfile.ZipFile(io.BytesIO(content)).open(infos[part]) as f:
        data = f.read(limit + 1)
    if len(data) > limit:
        raise SourceError(f"{part} too large")
    if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
        raise SourceError(f"{part} declares entities")
    return data


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_ODF = {"text": "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}", "table": "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}", "office": "{urn:oasis:names:tc:opendocument:xmlns:office:1.0}"}


def docx_blocks(content: bytes) -> Iterator[tuple[int, str]]:
    """(heading level or 0, text) of each paragraph and table of a DOCX file."""
    body = ElementTree.fromstring(office_part(content, "word/document.xml")).find(f"{_W}body")

    def words(p):
        return "".join(e.text or "" if e.tag == f"{_W}t" else "\t" if e.tag == f"{_W}tab" else "\n" if e.tag == f"{_W}br" else "" for e in p.iter()).strip()

    for e in body if body is not None else ():
        if e.tag == f"{_W}p":
            style = e.find(f"{_W}pPr/{_W}pStyle")
            m = re.fullmatch(r"(?i)heading\s*([1-6])", style.get(f"{_W}val", "")) if style is not None else None
            if t := words(e):
                yield int(m[1]) if m else 0, t
        elif e.tag == f"{_W}tbl":
            rows = [["\n".join(filter(None, map(words, c.iter(f"{_W}p")))) for c in r.findall(f"{_W}tc")] for r in e.findall(f"{_W}tr")]
            if rows:
                yield 0, render_table(rows)


def odt_blocks(content: bytes, flat: bool = False) -> Iterator[tuple[int, str]]:
    """(heading level or 0, text) of each heading, paragraph and table of an ODT or flat ODT file."""
    if flat and len(content) > ZIP_LIMITS["content.xml"]:
        raise SourceError("flat document too large")
    if flat and (b"<!DOCTYPE" in content or b"<!ENTITY" in content):
        raise SourceError("document declares entities")
    t, tab = _ODF["text"], _ODF["table"]

    def words(e):
        out = e.text or ""
        for c in e:
            out += " " * int(c.get(f"{t}c", "1")) if c.tag == f"{t}s" else "\t" if c.tag == f"{t}tab" else "\n" if c.tag == f"{t}line-break" else words(c)
            out += c.tail or ""
        return out

    def walk(e):
        for c in e:
            if c.tag == f"{t}h":
                if s := words(c).strip():
                    yield min(6, int(c.get(f"{t}outline-level", "1"))), s
            elif c.tag == f"{t}p":
                if s := words(c).strip():
                    yield 0, s
            elif c.tag == f"{tab}table":
                rows = [["\n".join(words(p).strip() for p in cell.iter(f"{t}p")) for cell in r.findall(f"{tab}table-cell")] for r in c.iter(f"{tab}table-row")]
                if rows:
                    yield 0, render_table(rows)
            else:
                yield from walk(c)

    root = ElementTree.fromstring(content if flat else office_part(content, "content.xml"))
    for body in root.iter(f"{_ODF['office']}text"):
        yield from walk(body)


def sections(blocks) -> list[dict]:
    """Blocks cut at headings: section number, chain of headings above, text."""
    out: list[dict] = []
    chain: list[str] = []
    text: list[str] = []

    def flush():
        if text:
            out.append({"section": len(out) + 1, "heading": " > ".join(x for x in chain if x), "text": "\n\n".join(text)})
            text.clear()

    for level, s in blocks:
        if level:
            flush()
            chain = (chain + [""] * level)[: level - 1] + [s]
        text.append(f"{'#' * level} {s}" if level else s)
    flush()
    return out


_HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*#*$")


def markdown_blocks(text: str) -> Iterator[tuple[int, str]]:
    """Headings and what is between them; headings inside code are text."""
    held: list[str] = []
    fence = ""
    for line in text.replace("\x00", "").split("\n"):
        mark = re.match(r"\s*(`{3,}|~{3,})", line)
        if mark and (not fence or line.strip().startswith(fence)):
            fence = "" if fence else mark[1]
        m = None if fence else _HEADING.match(line)
        if m:
            if body := "\n".join(held).strip():
                yield 0, body
            held = []
            yield len(m[1]), m[2]
        else:
            held.append(line)
    if body := "\n".join(held).strip():
        yield 0, body


def frontmatter(text: str) -> tuple[dict, str]:
    """The YAML head of a Markdown file ({} if malformed) and the rest."""
    m = re.match(r"﻿?---[ \t]*\n(.*?)\n---[ \t]*(?:\n|$)", text, re.S)
    if not m:
        return {}, text
    try:
        import yaml

        got = yaml.safe_load(m[1])
    except Exception:  # a YAML error, or no YAML library: the file is read without its head
        return {}, text[m.end() :]
    if not isinstance(got, dict):
        return {}, text[m.end() :]
    if "tags" in got:
        got["tags"] = [t for t in got["tags"] if isinstance(t, str)] if isinstance(got["tags"], list) else []
    return got, text[m.end() :]


def plain_text(content: bytes) -> str:
    if len(content) > MAX_TEXT:
        raise SourceError("text file too large")
    text = content.decode("utf-8-sig").replace("\x00", "").replace("\r\n", "\n").replace("\r", "\n")
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x.rstrip() for x in text.split("\n"))).strip()


def read_sections(content: bytes, name: str, pdf: Callable[[bytes], list[str]] | None = None) -> tuple[str, list[dict]]:
    """The type of a file and its sections."""
    kind = detect(content, name)
    if kind == "pdf":
        if pdf is None:
            raise SourceError(f"{name}: no PDF reader given")
        return kind, [{"section": i, "heading": "", "text": t} for i, t in enumerate(pdf(content), 1)]
    if kind == "docx":
        return kind, sections(docx_blocks(content))
    if kind in ("odt", "fodt"):
        return "odt", sections(odt_blocks(content, kind == "fodt"))
    if kind == "markdown":
        return kind, sections(markdown_blocks(frontmatter(content.decode("utf-8-sig"))[1]))
    text = plain_text(content)
    return kind, [{"section": 1, "heading": "", "text": text}] if text else []


def images_of(content: bytes, smallest: int = 1) -> list[dict]:
    """The images of a DOCX package: name, bytes, sha256."""
    out = []
    for name, info in office_entries(content).items():
        if name.startswith("word/media/") and info.file_size >= smallest:
            data = zipfile.ZipFile(io.BytesIO(content)).read(info)
            out.append({"name": name, "byte_size": len(data), "hash": hashlib.sha256(data).hexdigest()})
    return out


def read_documents(files: DataFrame, pdf: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """(id, path, file_type, sha256, section, heading, text, error): the sections of each file of ``discover``.

    Files are read where they are, a partition at a time. One that cannot be read gives a row with its error.
    """
    spark = files.sparkSession
    paths = [r.path for r in files.select("path").toLocalIterator()]
    if not paths:
        return spark.createDataFrame([], "id string, path string, file_type string, sha256 string, section int, heading string, text string, error string")
    return parsed(spark.read.format("binaryFile").load(paths), pdf)


def parsed(raw: DataFrame, pdf: Callable[[bytes], list[str]] | None = None, empty: bool = False) -> DataFrame:
    """What ``read_documents`` gives, of files already read (path, content), in a batch or a stream; with ``empty`` a row without a
    section for each file without text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path, content in zip(f["path"], f["content"]):
                digest = hashlib.sha256(content).hexdigest()
                try:
                    kind, parts = read_sections(content, path, pdf)
                    out += [(path, kind, digest, p["section"], p["heading"], p["text"], None) for p in parts]
                    if empty and not parts:
                        out.append((path, kind, digest, None, None, None, None))
                except (SourceError, ElementTree.ParseError, UnicodeDecodeError) as e:
                    out.append((path, None, digest, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "file_type", "sha256", "section", "heading", "text", "error"]).astype({"section": "Int32"})

    got = raw.select("path", "content").mapInPandas(run, "path string, file_type string, sha256 string, section int, heading string, text string, error string")
    return got.select(document_id(F.col("path")).alias("id"), "path", F.coalesce("file_type", F.when(F.col("error").isNull(), file_type(F.col("path")))).alias("file_type"), "sha256", "section", "heading", "text", "error")
