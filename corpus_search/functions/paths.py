"""Column expressions over object paths and URIs (native)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower-cased extension -> reader format. The reference routes pdf, doc, docx,
# xls, xlsx and txt; everything else is reported as unsupported. html/htm go to our markup
# text extractor (the generic loader).
FORMATS = {
    "pdf": "pdf",
    "doc": "word",
    "docx": "word",
    "xls": "sheet",
    "xlsx": "sheet",
    "txt": "text",
    "html": "markup",
    "htm": "markup",
}

URI = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def scheme(uri) -> Column:
    return F.lower(F.regexp_extract(_c(uri), URI, 1))


def authority(uri) -> Column:
    """Host (web) or bucket (object store) part of ``scheme://authority/key``."""
    return F.regexp_extract(_c(uri), URI, 2)


def key(uri) -> Column:
    """Object key: the path without its leading slash, query or fragment."""
    return F.regexp_replace(F.regexp_extract(_c(uri), URI, 3), "^/+", "")


def basename(path) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def parent(path) -> Column:
    return F.regexp_extract(_c(path), "^(.*)/[^/]*$", 1)


def extension(path) -> Column:
    """Lower-cased extension of the base name, '' when there is none."""
    return F.lower(F.regexp_extract(basename(path), r"\.([^./]+)$", 1))


def relative_to(path, prefix: str) -> Column:
    """Path below ``prefix`` (kept whole, so equal names in two folders never collide)."""
    p = prefix.rstrip("/") + "/"
    c = _c(path)
    return F.when(c.startswith(p), F.substring(c, len(p) + 1, 2147483647)).otherwise(c)


def route_format(ext) -> Column:
    expr = F.lit(None).cast("string")
    for e, fmt in FORMATS.items():
        expr = F.when(_c(ext) == e, F.lit(fmt)).otherwise(expr)
    return expr
