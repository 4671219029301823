"""Book container: a deterministic zip per document."""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterable
from xml.sax import saxutils

import pandas as pd
from pyspark.sql import DataFrame

MIMETYPE = "application/epub+zip"
STAMP = (1980, 1, 1, 0, 0, 0)
_QUOTE = {'"': "&quot;"}
#: Fixed value: code points that XML 1.0 forbids.
_FORBIDDEN = re.compile("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\ufffe\\uffff]")


def escape(text: str, more: dict[str, str]) -> str:
    """Plain text as XML, without the code points that XML forbids."""
    return saxutils.escape(_FORBIDDEN.sub("", text), more)


def pack(files: dict[str, bytes]) -> bytes:
    """Mimetype first and stored, the rest by name; fixed times, no extra fields: equal files, equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name in ("mimetype", *sorted(n for n in files if n != "mimetype")):
            info = zipfile.ZipInfo(name, STAMP)
            info.compress_type = zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED
            info.external_attr = 0o644 << 16
            z.writestr(info, MIMETYPE if name == "mimetype" else files[name])
    return out.getvalue()


#: Fixed values that the format prescribes: the container file, and the declarations of each kind of file.
CONTAINER = '<?xml version="1.0"?>\n<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
DECLARATION = '<?xml version="1.0" encoding="utf-8"?>\n'
PAGE = DECLARATION + '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{title}</title></head><body>{body}</body></html>'
NCX = DECLARATION + '<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head><meta name="dtb:uid" content="{uid}"/><meta name="dtb:depth" content="1"/><meta name="dtb:totalPageCount" content="0"/><meta name="dtb:maxPageNumber" content="0"/></head><docTitle><text>{title}</text></docTitle><navMap>{points}</navMap></ncx>'
PACKAGE = DECLARATION + '<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{uid}</dc:identifier><dc:title>{title}</dc:title><dc:language>{language}</dc:language><meta property="dcterms:modified">{modified}</meta></metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>{items}</manifest><spine toc="ncx">{spine}</spine></package>'


def book_files(uid: str, title: str, chapters: Iterable[tuple[str, str]], language: str = "en", modified: str = "1970-01-01T00:00:00Z") -> dict[str, bytes]:
    """The files of a book from its chapters (title, body). Titles are plain text, bodies XHTML content."""
    title, named = escape(title, _QUOTE), [(f"ch{k:03d}", escape(t, _QUOTE), body) for k, (t, body) in enumerate(chapters, 1)]
    files = {f"OEBPS/{name}.xhtml": PAGE.format(title=t, body=body) for name, t, body in named}
    listed = "".join(f'<li><a href="{name}.xhtml">{t}</a></li>' for name, t, _ in named)
    files["OEBPS/nav.xhtml"] = PAGE.format(title="Contents", body=f'<nav epub:type="toc"><ol>{listed}</ol></nav>')
    points = "".join(f'<navPoint id="{name}" playOrder="{k}"><navLabel><text>{t}</text></navLabel><content src="{name}.xhtml"/></navPoint>' for k, (name, t, _) in enumerate(named, 1))
    files["OEBPS/toc.ncx"] = NCX.format(uid=escape(uid, _QUOTE), title=title, points=points)
    items = "".join(f'<item id="{name}" href="{name}.xhtml" media-type="application/xhtml+xml"/>' for name, *_ in named)
    spine = "".join(f'<itemref idref="{name}"/>' for name, *_ in named)
    files["OEBPS/content.opf"] = PACKAGE.format(uid=escape(uid, _QUOTE), title=title, language=escape(language, _QUOTE), modified=modified, items=items, spine=spine)
    files["META-INF/container.xml"] = CONTAINER
    return {name: text.encode() for name, text in files.items()}


def books(chapters: DataFrame) -> DataFrame:
    """``(doc_id, book)`` from chapters (``doc_id, chapter, title, body``); titles are plain text, body is XHTML content. One task holds one document."""
    def build(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chapter")
        uid = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'doc:{key[0]}')}"
        return pd.DataFrame({"doc_id": [key[0]], "book": [pack(book_files(uid, f"Document {key[0]}", zip(rows["title"], rows["body"], strict=True)))]})

    return chapters.groupBy("doc_id").applyInPandas(build, "doc_id long, book binary")
