"""Blocks and tables of a document as an office file, written and read with the standard library's zip alone."""

from __future__ import annotations

import sys
from collections import Counter

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Functions travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

#: Fixed values of the format.
REQUIRED = ("[Content_Types].xml", "_rels/.rels", "word/document.xml")
NAMESPACE = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
CONTENT_TYPES = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    '<Default Extension="jpeg" ContentType="image/jpeg"/>'
    '<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
)
RELATIONS = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
)
#: Paragraph styles by role; others have none.
STYLES = {"title": "Heading1", "heading1": "Heading1", "heading2": "Heading2", "ordered": "ListNumber", "bullet": "ListBullet", "plugin": "ListBullet"}


def paragraph(role: str, text: str, list_id: int | None = None) -> str:
    from xml.sax.saxutils import escape

    style = f'<w:pStyle w:val="{STYLES[role]}"/>' if role in STYLES else ""
    number = f'<w:numPr><w:ilvl w:val="0"/><w:numId w:val="{list_id}"/></w:numPr>' if list_id else ""
    clean = escape("".join(c for c in text if c >= " " or c in "\t\n"))
    return f'<w:p><w:pPr>{style}{number}</w:pPr><w:r><w:t xml:space="preserve">{clean}</w:t></w:r></w:p>'


def table(cells: list[tuple[int, int, int, int, str]], header_rows: int = 1) -> str:
    """A table of (row, col, row_span, col_span, text): cells of several columns are merged in their row, those of several rows downwards."""
    taken = {(r + i, c): (i > 0, rows, cols, text) for r, c, rows, cols, text in cells for i in range(rows)}
    out = []
    for r in sorted({r for r, _ in taken}):
        row = "<w:trPr><w:cantSplit/>" + ("<w:tblHeader/>" if r < header_rows else "") + "</w:trPr>"
        for c in sorted(c for k, c in taken if k == r):
            below, rows, cols, text = taken[(r, c)]
            merge = ('<w:vMerge/>' if below else '<w:vMerge w:val="restart"/>') if rows > 1 else ""
            row += f'<w:tc><w:tcPr><w:gridSpan w:val="{cols}"/>{merge}</w:tcPr>{paragraph("body", "" if below else text)}</w:tc>'
        out.append(f"<w:tr>{row}</w:tr>")
    return '<w:tbl><w:tblPr><w:tblLayout w:type="fixed"/></w:tblPr>' + "".join(out) + "</w:tbl>"


def archive(body: list[str], media: list[bytes] = ()) -> bytes:
    """The file; the same bytes for the same content."""
    import io
    import zipfile

    xml = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="{NAMESPACE}"><w:body>{"".join(body)}<w:sectPr/></w:body></w:document>'
    parts = dict(zip(REQUIRED, (CONTENT_TYPES, RELATIONS, xml), strict=True)) | {f"word/media/image{k + 1}.jpeg": m for k, m in enumerate(media)}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def documents(blocks: DataFrame, key: str, *order: str) -> DataFrame:
    """(key, content): a file for each key from its blocks (role, text, list_id), in order; a block of role "table" is a table of its lines, cells split at tabs.

    A file is one value, so a document's blocks are gathered by key; documents are as long as their texts.
    """
    kind = dict(blocks.dtypes)[key]
    rows = blocks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, "role", "text", F.col("list_id").cast("int").alias("list_id")))).alias("blocks"))

    def run(batches):
        for batch in batches:
            files = []
            for one in batch.column(1).to_pylist():
                body = []
                for b in one:
                    if b["role"] == "table":
                        body.append(table([(r, c, 1, 1, x) for r, line in enumerate((b["text"] or "").split("\n")) for c, x in enumerate(line.split("\t"))]))
                    else:
                        body.append(paragraph(b["role"], b["text"] or "", b["list_id"]))
                files.append(archive(body))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], [key, "content"])

    return rows.mapInArrow(run, f"`{key}` {kind}, content binary")


def inspect(data: bytes | None) -> dict:
    """What a file holds; entries that are missing or broken leave zip_ok false and the counts 0."""
    import io
    import re
    import zipfile
    from xml.etree import ElementTree

    out = dict.fromkeys(("media_count", "xml_bytes", "text_nodes", "paragraphs", "tables", "cells", "headings", "bullets", "ordered", "text_chars"), 0) | {"zip_ok": False, "complete": False}
    try:
        with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
            names = set(z.namelist())
            out["zip_ok"], out["complete"] = z.testzip() is None, set(REQUIRED) <= names
            out["media_count"] = sum(n.startswith("word/media/") for n in names)
            xml = z.read("word/document.xml")
    except (OSError, zipfile.BadZipFile, KeyError):
        return out
    out["xml_bytes"], out["text_nodes"] = len(xml), xml.count(b"<w:t")
    w = f"{{{NAMESPACE}}}"
    body = ElementTree.fromstring(xml).find(f"{w}body")
    text_of = lambda p: "".join(t.text or "" for t in p.iter(f"{w}t"))
    own = body.findall(f"{w}p")
    styles = Counter(s.get(f"{w}val") for p in own for s in p.iter(f"{w}pStyle"))
    found = [c for t in body.findall(f"{w}tbl") for c in t.iter(f"{w}tc")]
    texts = [text_of(p) for p in own] + [text_of(c) for c in found]
    counts = {"paragraphs": len(own), "tables": len(body.findall(f"{w}tbl")), "cells": len(found), "bullets": styles["ListBullet"], "ordered": styles["ListNumber"]}
    return out | counts | {"headings": sum(n for s, n in styles.items() if s.startswith("Heading")), "text_chars": len(re.sub(r"\s+", "", "".join(texts)))}


INSPECTED = "media_count bigint, xml_bytes bigint, text_nodes bigint, paragraphs bigint, tables bigint, cells bigint, headings bigint, bullets bigint, ordered bigint, text_chars bigint, zip_ok boolean, complete boolean"


def metrics(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, what inspect() finds) for each file; broken ones give a row too."""
    kind = dict(files.dtypes)[key]
    names = [f.split()[0] for f in INSPECTED.split(", ")]

    def run(batches):
        for batch in batches:
            found = [inspect(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([f[n] for f in found], pa.bool_() if n in ("zip_ok", "complete") else pa.int64()) for n in names]], [key, *names])

    return files.select(key, content).mapInArrow(run, f"`{key}` {kind}, {INSPECTED}")
