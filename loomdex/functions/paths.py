"""Paths, types, sizes, ids, selectors, network addresses."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

# Networks that are not public.
PRIVATE_NETWORKS = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16",
    "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4", "::/128", "::1/128", "fc00::/7", "fe80::/10", "ff00::/8", "2001:db8::/32",
)
SIZE_UNITS = {"b": 1, "kb": 1024, "mb": 1024**2, "gb": 1024**3}
DURATION_UNITS = {"ms": 1, "s": 1000, "m": 60_000}
# Fixed value: endings of documents.
DOCUMENT_NAME = r"(?i)[.](pdf|md|markdown|txt|docx|odt|fodt)$"


def file_type(path: Column) -> Column:
    p = F.lower(path)
    return F.when(p.rlike("[.](md|markdown)$"), "markdown").when(p.endswith(".docx"), "docx").when(p.rlike("[.](odt|fodt)$"), "odt").when(p.endswith(".txt"), "txt").otherwise("pdf")


def document_id(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 12)


def filename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)[/\\]*$", 1)


def measured(value: Column, units: dict[str, int]) -> Column:
    """A number with a unit as a whole number of the least unit; null if it is no such thing or not positive."""
    pattern = rf"(?i)^\s*(\d+(?:\.\d+)?)\s*({'|'.join(units)})\s*$"
    unit = F.lower(F.regexp_extract(value, pattern, 2))
    factor = F.lit(None).cast("double")
    for u, n in units.items():
        factor = F.when(unit == u, F.lit(float(n))).otherwise(factor)
    out = F.floor(F.regexp_extract(value, pattern, 1).try_cast("double") * factor).cast("long")
    return F.when(out > 0, out)


def size_bytes(value: Column) -> Column:
    return measured(value, SIZE_UNITS)


def duration_ms(value: Column) -> Column:
    return measured(value, DURATION_UNITS)


def pages_of(selector: Column, page_count: Column) -> Column:
    """Distinct pages of a selector like 5-2,3 in order; null if it is malformed or beyond the last page."""
    ok = F.regexp_replace(selector, r"\s", "").rlike(r"^\d+(-\d+)?(,\d+(-\d+)?)*$")
    parts = F.split(F.regexp_replace(selector, r"\s", ""), ",")

    def span(p):
        a, b = F.get(F.split(p, "-"), F.lit(0)).try_cast("int"), F.get(F.split(p, "-"), F.size(F.split(p, "-")) - 1).try_cast("int")
        return F.sequence(F.least(a, b), F.greatest(a, b))

    pages = F.array_sort(F.array_distinct(F.flatten(F.transform(F.when(ok, parts), span))))
    return F.when((F.array_min(pages) >= 1) & (F.array_max(pages) <= page_count), pages)


def safe_id(doc_id: Column) -> Column:
    """No reserved or control character, no trailing dot or blank, no device name."""
    base = F.upper(F.split(doc_id, "[.]")[0])
    return ~((doc_id == "") | doc_id.isin(".", "..") | doc_id.rlike("[. ]$") | doc_id.rlike(r'[/\\<>:"|?*\x00-\x1f\x7f-\x9f]') | base.rlike("^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$"))


def ipv4_number(address: Column) -> Column:
    part = lambda i: F.get(F.split(address, "[.]"), F.lit(i)).try_cast("long")
    return F.when(address.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), part(0) * 16777216 + part(1) * 65536 + part(2) * 256 + part(3))


def is_private_ipv4(address: Column) -> Column:
    ranges = [ipaddress.ip_network(net) for net in PRIVATE_NETWORKS if "." in net]

    def inside(n):
        out = F.lit(False)
        for x in ranges:
            out = out | n.between(int(x.network_address), int(x.broadcast_address))
        return out

    # the number is bound once: written out for every network its code would be too long to compile
    return F.coalesce(F.get(F.transform(F.array(ipv4_number(address)), inside), F.lit(0)), F.lit(False))


def is_private(address: str) -> bool:
    """Also for IPv6, and for IPv4 addresses mapped into it; what is no address counts as private."""
    try:
        a = ipaddress.ip_address(address.strip("[]"))
    except ValueError:
        return True
    a = getattr(a, "ipv4_mapped", None) or a
    return any(a in ipaddress.ip_network(n) for n in PRIVATE_NETWORKS if ipaddress.ip_network(n).version == a.version)


def download_type(url: Column, mime: Column, preview: Column) -> Column:
    """pdf, markdown, txt, docx or odt, by MIME type, then extension, then a look at plain text."""
    from .text import looks_like_markdown

    path = F.lower(F.regexp_extract(url, r"^[^?#]*", 0))
    has = lambda s: F.contains(F.lower(mime), F.lit(s))
    md, plain, xml = has("text/markdown") | has("text/x-markdown"), has("text/plain"), has("text/xml") | has("application/xml")
    text = md | plain | xml
    return (
        F.when(has("pdf") | (path.endswith(".pdf") & ~text), "pdf")
        .when(md | path.rlike("[.](md|markdown)$"), "markdown")
        .when(path.endswith(".txt") & ~xml, "txt")
        .when(has("application/vnd.openxmlformats-officedocument.wordprocessingml.document") | (path.endswith(".docx") & ~text), "docx")
        .when(has("application/vnd.oasis.opendocument.text") | (path.rlike("[.](odt|fodt)$") & (~plain | xml)), "odt")
        .when(plain & looks_like_markdown(F.left(preview, F.lit(4096))), "markdown")
        .when(plain, "txt")
        .otherwise("pdf")
    )


def is_loopback(host: str) -> bool:
    h = host.strip("[]").lower()
    return h == "localhost" or h == "::1" or h.startswith("127.") and is_private(h)


def url_filename(url: Column) -> Column:
    """The last part of the URL's path, with .pdf unless it ends as a document does; null if it is no URL."""
    name = F.regexp_extract(F.try_parse_url(url, F.lit("PATH")), r"([^/]*)/*$", 1)
    return F.when(name.rlike(DOCUMENT_NAME), name).otherwise(F.concat(name, F.lit(".pdf")))


def download_name(url: Column, kind: Column) -> Column:
    """The file name a download of this type gets: the URL's name with the ending of the type, ``download`` if there is none."""
    name = url_filename(url)
    stem = F.coalesce(F.nullif(F.regexp_replace(name, DOCUMENT_NAME, ""), F.lit("")), F.lit("download"))
    ending = F.lower(F.regexp_extract(name, r"[.][^.]*$", 0))
    kept = F.when((kind == "markdown") & (ending == ".markdown"), ending).when((kind == "odt") & (ending == ".fodt"), ending)
    return F.when(name.isNotNull(), F.concat(stem, F.coalesce(kept, F.when(kind == "markdown", ".md").otherwise(F.concat(F.lit("."), kind)))))
