"""Word files → document rows, as an Arrow-batched Spark job.

Spark reads and distributes the files; the helper below only unpacks one file's paragraphs, runs, tables and
images with the standard library. A file that cannot be read becomes a row with a problem, never a failed job.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape as xml_escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from prosopon.sources import schemas

# Names in the Office Open XML format.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
FALLBACK = "{http://schemas.openxmlformats.org/markup-compatibility/2006}Fallback"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
RELATIONS = "word/_rels/document.xml.rels"
STYLES = "word/styles.xml"
MEDIA = "word/media/"
MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml"}


def _set(properties: ET.Element | None, name: str) -> bool | None:
    """Whether a property is switched on or off; None where nothing is said."""
    node = None if properties is None else properties.find(W + name)
    return None if node is None else node.get(W + "val", "true") not in ("0", "false", "off", "none")


class Styles:
    """Bold, italic and underline of runs, by the run itself, its character style, the paragraph's style and the document's defaults.

    A style says what it or the nearest style it is based on says. Bold and italic are toggles: a character style switches what the paragraph's style has
    set, a default that is on stays on, and what the run itself says holds in any case. Of underline the nearest word holds.
    """

    def __init__(self, styles: ET.Element | None):
        self.own: dict[str, tuple[str | None, ET.Element | None]] = {}
        self.usual: dict[str, str] = {}
        self.defaults = None if styles is None else styles.find(f"{W}docDefaults/{W}rPrDefault/{W}rPr")
        for style in () if styles is None else styles.findall(W + "style"):
            name, base = style.get(W + "styleId", ""), style.find(W + "basedOn")
            self.own[name] = (None if base is None else base.get(W + "val"), style.find(W + "rPr"))
            if style.get(W + "default") in ("1", "true"):
                self.usual[style.get(W + "type", "")] = name
        self.known: dict[tuple[str | None, str], bool | None] = {}

    def says(self, style: str | None, name: str) -> bool | None:
        if (style, name) not in self.known:
            found, seen, at = None, set(), style
            while found is None and at in self.own and at not in seen:
                seen.add(at)
                at, properties = self.own[at][0], self.own[at][1]
                found = _set(properties, name)
            self.known[style, name] = found
        return self.known[style, name]

    def of(self, run: ET.Element | None, paragraph: str | None) -> dict[str, bool]:
        named = None if run is None else run.find(W + "rStyle")
        character = self.usual.get("character") if named is None else named.get(W + "val")
        paragraph = paragraph or self.usual.get("paragraph")
        flags = {}
        for flag, name in (("bold", "b"), ("italic", "i"), ("underline", "u")):
            said, inner, outer, usual = _set(run, name), self.says(character, name), self.says(paragraph, name), _set(self.defaults, name)
            if said is not None:
                flags[flag] = said
            elif flag == "underline":
                flags[flag] = next((x for x in (inner, outer, usual) if x is not None), False)
            else:
                flags[flag] = bool(usual) or bool(inner) != bool(outer)
        return flags


def _runs(node: ET.Element) -> Iterator[ET.Element]:
    """Runs in document order; of alternative contents only the first choice counts."""
    for child in node:
        if child.tag != FALLBACK:
            if child.tag == W + "r":
                yield child
            yield from _runs(child)


def _blocks(node: ET.Element) -> Iterator[ET.Element]:
    """Paragraphs and tables, also inside content controls, tracked insertions and other wrappers."""
    for child in node:
        if child.tag in (W + "p", W + "tbl"):
            yield child
        elif child.tag != FALLBACK:
            yield from _blocks(child)


def _spans(paragraph: ET.Element, style: str | None, styles: Styles) -> list[dict]:
    spans = []
    for run in _runs(paragraph):
        text = "".join(
            "\t" if node.tag == W + "tab" else "\n" if node.tag in (W + "br", W + "cr") else node.text or ""
            for node in run
            if node.tag in (W + "t", W + "tab", W + "br", W + "cr")
        )
        if text:
            spans.append({"text": text, **styles.of(run.find(W + "rPr"), style)})
    return spans


def _paragraph(node: ET.Element, styles: Styles) -> dict:
    style = node.find(f"{W}pPr/{W}pStyle")
    name = "" if style is None else style.get(W + "val", "")
    spans = _spans(node, name or None, styles)
    kind, level = "paragraph", None
    if name.lower().startswith("heading") and name[7:].isdigit():
        kind, level = "heading", int(name[7:])
    elif node.find(f"{W}pPr/{W}numPr") is not None:
        kind = "list"
    return {"kind": kind, "level": level, "text": "".join(s["text"] for s in spans), "spans": spans, "html": None}


def _html_text(text: str) -> str:
    return text.replace("&", "&#x26;").replace("<", "&#x3C;")


def _span_html(span: dict) -> str:
    html = _html_text(span["text"])
    for flag, tag in (("bold", "strong"), ("italic", "em"), ("underline", "u")):
        if span[flag]:
            html = f"<{tag}>{html}</{tag}>"
    return html


def _table(node: ET.Element, styles: Styles) -> dict:
    rows, texts = [], []
    for row in node.findall(W + "tr"):
        cells = []
        for cell in row.findall(W + "tc"):
            parts = []
            for block in _blocks(cell):
                inner = _table(block, styles) if block.tag == W + "tbl" else _paragraph(block, styles)
                parts.append(inner["html"] or f"<p>{''.join(map(_span_html, inner['spans']))}</p>")
                texts.append(inner["text"])
            cells.append(f"<td>{''.join(parts)}</td>")
        rows.append("<tr>" + "".join(cells) + "</tr>")
    html = "<table><tbody>" + "".join(rows) + "</tbody></table>"
    return {"kind": "table", "level": None, "text": "".join(texts), "spans": [], "html": html}


def _image_order(archive: zipfile.ZipFile, document: ET.Element) -> list[str]:
    """Image files as the document shows them, then those it does not show, numbers in names counting as numbers."""
    names = [n for n in archive.namelist() if n.startswith(MEDIA)]
    shown: list[str] = []
    if RELATIONS in archive.namelist():
        targets = {r.get("Id"): r.get("Target", "") for r in ET.fromstring(archive.read(RELATIONS))}
        used = (targets.get(node.get(RELATION + key), "") for node in document.iter() for key in ("embed", "id"))
        shown = [f"word/{t}" if not t.startswith("/") else t[1:] for t in used if t]
    place = {name: i for i, name in reversed(list(enumerate(shown)))}
    natural = lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)]
    return sorted(names, key=lambda n: (place.get(n, len(shown)), natural(n)))


def read_docx(content: bytes) -> tuple[list[dict], list[dict]]:
    """(blocks, attachments) of one file."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        document = ET.fromstring(archive.read("word/document.xml"))
        body = document.find(W + "body")
        styles = Styles(ET.fromstring(archive.read(STYLES)) if STYLES in archive.namelist() else None)
        blocks = [_paragraph(node, styles) if node.tag == W + "p" else _table(node, styles) for node in ([] if body is None else _blocks(body))]
        attachments = []
        for name in _image_order(archive, document):
            short = name[len(MEDIA):]
            extension = short.rpartition(".")[2].lower() if "." in short else ""
            attachments.append({"name": short, "extension": extension, "mime": MIME.get(extension, ""), "data": archive.read(name)})
    return blocks, attachments


def write_docx(lines: list[str], images: dict[str, bytes] | None = None) -> bytes:
    """A minimal file with one paragraph per line; used to make test corpora."""
    paragraphs = "".join(
        f'<w:p><w:r><w:t xml:space="preserve">{xml_escape(line)}</w:t></w:r></w:p>' for line in lines
    )
    document = f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{W[1:-1]}"><w:body>{paragraphs}</w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("word/document.xml", document)
        for name, data in (images or {}).items():
            archive.writestr(MEDIA + name, data)
    return out.getvalue()


def _decoded(content: bytes) -> tuple:
    try:
        return (*read_docx(content), None)
    except Exception as err:  # noqa: BLE001 - whatever is wrong with one file is that file's problem
        return [], [], f"{type(err).__name__}: {err}"


def _decode_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        parts = pd.DataFrame([_decoded(c) for c in batch["content"]], columns=["blocks", "attachments", "problem"], index=batch.index)
        yield batch.drop(columns="content").join(parts)


def decode(files: DataFrame, carried: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """(doc_id, content) → documents; the columns named in `carried` come along; `partitions` deals the files out anew first."""
    kept = files.select("doc_id", *carried, "content")
    kept = kept if partitions is None else kept.repartition(partitions)
    documents = StructType.fromDDL(schemas.DOCUMENTS).fields
    out = StructType([f for f in kept.schema.fields if f.name != "content"] + [f for f in documents if f.name != "doc_id"])
    return kept.mapInPandas(_decode_batches, out)
