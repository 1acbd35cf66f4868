"""Extractors: the only Python between files and relations.

Each emits plain rows and never fails a task: what cannot be read becomes a row
with an issue.  Structure, citations and layout are worked out by operators.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
MAX_BYTES = 100 << 20
#: Elements whose text is no part of a paragraph, and containers that the body's walk leaves out.
SILENT = {W + t for t in ("del", "moveFrom", "txbxContent", "drawing", "pict")}
SKIPPED = {W + t for t in ("del", "moveFrom", "sectPr")}

PARAGRAPHS = "doc_id string, pos int, block_id string, kind string, paragraph_index int, table_index int, row_index int, cell_index int, note_id string, note_type string, style_level int, text string, note_refs array<struct<kind:string,id:string,offset:int>>, issue string"


class _Text:
    """Text and note references of a paragraph, in document order."""

    def __init__(self, paragraph: ET.Element):
        self.parts: list[str] = []
        self.refs: list[dict] = []
        self.size = 0
        self.read(paragraph)

    def add(self, piece: str) -> None:
        self.parts.append(piece)
        self.size += len(piece)

    def read(self, node: ET.Element) -> None:
        for child in node:
            tag = child.tag
            if tag in SILENT:
                continue
            if tag == W + "t":
                self.add(child.text or "")
            elif tag == W + "tab":
                self.add("\t")
            elif tag in (W + "br", W + "cr"):
                self.add("\n")
            elif tag in (W + "footnoteReference", W + "endnoteReference"):
                self.refs.append({"kind": tag.removeprefix(W).removesuffix("Reference"), "id": child.get(W + "id"), "offset": self.size})
            else:
                self.read(child)


def _levels(raw: bytes | None) -> dict[str, int]:
    levels = {}
    for style in ET.fromstring(raw).iter(W + "style") if raw else ():
        outline, name = style.find(f"{W}pPr/{W}outlineLvl"), style.find(W + "name")
        numbered = re.search(r"(?:heading|标题)\s*(\d)", name.get(W + "val", ""), re.I) if name is not None else None
        if outline is not None:
            levels[style.get(W + "styleId")] = int(outline.get(W + "val")) + 1
        elif numbered:
            levels[style.get(W + "styleId")] = int(numbered[1])
    return levels


def docx_paragraphs(name: str, content: bytes) -> Iterator[dict]:
    """All paragraphs of a package, blank ones too: body, table cells, then notes."""
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        if sum(i.file_size for i in package.infolist()) > MAX_BYTES:
            raise ValueError("package too large")
        members = {m: package.read(f"word/{m}.xml") for m in ("document", "styles", "footnotes", "endnotes") if f"word/{m}.xml" in package.namelist()}
    levels = _levels(members.get("styles"))
    body = ET.fromstring(members["document"]).find(W + "body") if "document" in members else None
    if body is None:
        raise ValueError("no document body")
    count = {"p": 0, "t": 0}

    def row(p: ET.Element, block: str, kind: str, index: int, **place) -> dict:
        text, style = _Text(p), p.find(f"{W}pPr/{W}pStyle")
        return {"doc_id": name, "block_id": block, "kind": kind, "paragraph_index": index, "style_level": levels.get(style.get(W + "val")) if style is not None else None, "text": "".join(text.parts), "note_refs": text.refs, **place}

    def walk(node: ET.Element) -> Iterator[dict]:
        for child in node:
            if child.tag == W + "p":
                count["p"] += 1
                yield row(child, f"P{count['p']:06d}", "paragraph", count["p"])
            elif child.tag == W + "tbl":
                count["t"] += 1
                t = count["t"]
                for r, line in enumerate(child.findall(W + "tr"), 1):
                    for c, cell in enumerate(line.findall(W + "tc"), 1):
                        for n, p in enumerate(cell.findall(W + "p"), 1):
                            yield row(p, f"T{t}.R{r}.C{c}.P{n}", "table_cell", n, table_index=t, row_index=r, cell_index=c)
            elif child.tag not in SKIPPED:
                yield from walk(child)

    yield from walk(body)
    for kind in ("footnote", "endnote"):
        for note in ET.fromstring(members[kind + "s"]).findall(W + kind) if kind + "s" in members else ():
            for n, p in enumerate(note.findall(W + "p"), 1):
                yield row(p, f"{kind.upper()}{note.get(W + 'id')}.P{n}", kind, n, note_id=note.get(W + "id"), note_type=note.get(W + "type"))


def docx_diagnostics(content: bytes) -> dict[str, int]:
    """Numbers of revisions, nested tables and drawings of a package."""
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        root = ET.fromstring(package.read("word/document.xml"))
    tags = [n.tag for n in root.iter()]
    return {"revisions": sum(t in {W + x for x in ("ins", "del", "moveFrom", "moveTo")} for t in tags), "nested_tables": len(root.findall(f".//{W}tc/{W}tbl")), "drawings": sum(t in (W + "drawing", W + "pict") for t in tags)}


def read_docx(files: DataFrame) -> DataFrame:
    """PARAGRAPHS of files (relative_path, content); a file that cannot be read is one row with an issue."""
    shape = StructType.fromDDL(PARAGRAPHS)
    names = shape.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(shape)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    rows = [r | {"pos": i} for i, r in enumerate(docx_paragraphs(name, content.as_py()), 1)]
                except Exception as error:  # noqa: BLE001  a bad file is a row, not a failed task
                    rows = [{"doc_id": name, "issue": str(error)[:200] or type(error).__name__}]
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], schema.field(n).type) for n in names], names=names)

    return files.select("relative_path", "content").mapInArrow(run, PARAGRAPHS)


GLYPHS = "source_id string, pdf_page int, glyph_pos int, ch string, top double, x0 double, x1 double, size double, width double, height double, issue string"


def read_glyphs(files: DataFrame, extract: Callable[[bytes], Iterator[tuple]] | None = None) -> DataFrame:
    """GLYPHS of PDF files by a plug-in that yields (page, pos, ch, top, x0, x1, size, width, height); without one, pdfplumber's if it is installed."""

    def plumber(content: bytes) -> Iterator[tuple]:
        import pdfplumber

        with pdfplumber.open(io.BytesIO(content)) as pdf:
            for number, page in enumerate(pdf.pages, 1):
                for i, c in enumerate(page.chars):
                    yield number, i, c["text"], c["top"], c["x0"], c["x1"], c.get("size", 0), page.width, page.height

    use = extract or plumber

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for name, content in zip(pdf["relative_path"], pdf["content"], strict=True):
                try:
                    rows += [(name, *g, None) for g in use(bytes(content))]
                except Exception as error:  # noqa: BLE001
                    rows.append((name, *[None] * 9, str(error)[:200] or type(error).__name__))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in GLYPHS.split(", ")])

    return files.select("relative_path", "content").mapInPandas(run, GLYPHS)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Whole JSON documents: typed by a schema, or as text for schema_findings."""
    if schema:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    return spark.read.option("wholetext", True).text(path).selectExpr("_metadata.file_path as ledger_id", "value as json")


def read_diagnostics(files: DataFrame) -> DataFrame:
    """doc_id, revisions, nested_tables, drawings of files (relative_path, content); null where a file cannot be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["revisions", "nested_tables", "drawings"]
        for batch in batches:
            rows = []
            for content in batch.column(1):
                try:
                    rows.append(docx_diagnostics(content.as_py()))
                except Exception:  # noqa: BLE001  a bad file is a row, not a failed task
                    rows.append(dict.fromkeys(names))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[n] for r in rows], pa.int64()) for n in names]], names=["doc_id", *names])

    return files.select("relative_path", "content").mapInArrow(run, "doc_id string, revisions long, nested_tables long, drawings long")


def read_texts(files: DataFrame, read: Callable[[bytes], Iterator[tuple[int, str]]]) -> DataFrame:
    """source_id, pdf_page, text, issue of files by a plug-in that yields (page, text): another reader of the text layer, or OCR."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    rows += [(name, page, text, None) for page, text in read(content.as_py())]
                except Exception as error:  # noqa: BLE001
                    rows.append((name, None, None, str(error)[:200] or type(error).__name__))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["source_id", "pdf_page", "text", "issue"])

    return files.select("relative_path", "content").mapInArrow(run, "source_id string, pdf_page int, text string, issue string")


def plain_text(content: bytes) -> Iterator[tuple[int, str]]:
    """Page texts as pypdf has them."""
    import pypdf

    for number, page in enumerate(pypdf.PdfReader(io.BytesIO(content)).pages, 1):
        yield number, page.extract_text() or ""
