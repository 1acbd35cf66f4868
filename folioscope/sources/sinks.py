"""Sinks: JSON lines and Parquet by Spark, and a report as a DOCX package."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

from folioscope.functions.text import STATUS_LABELS


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    (df.write.partitionBy(*partition_by) if partition_by else df.write).mode("overwrite").parquet(path)


def _paragraph(text: str, style: str | None = None, bold: bool = False) -> str:
    look = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f'<w:p>{look}<w:r>{"<w:rPr><w:b/></w:rPr>" if bold else ""}<w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'


def report_docx(title: str, manuscript: str, rows: list[dict], labels: list[dict]) -> bytes:
    """A report of one ledger's report_rows and source_labels: summary, matrix with a header that repeats, claims, sources, page numbers."""
    claims: dict[int, list[dict]] = {}
    for r in sorted(rows, key=lambda r: (r["claim_pos"], r["evidence_pos"] or 0)):
        claims.setdefault(r["claim_pos"], []).append(r)
    counts = {v: sum(c[0]["status"] == v for c in claims.values()) for v in STATUS_LABELS.values()}
    name = {x["source_id"]: x["label"] for x in labels}
    cell = lambda t: f"<w:tc>{_paragraph(t)}</w:tc>"
    head = "<w:tr><w:trPr><w:tblHeader/></w:trPr>" + "".join(cell(t) for t in ("#", "heading", "status", "sources")) + "</w:tr>"
    matrix = head + "".join("<w:tr>" + cell(c[0]["claim_id"]) + cell(c[0]["heading"]) + cell(c[0]["status"]) + cell(", ".join(dict.fromkeys(name.get(r["source_id"], "") for r in c if r["source_id"]))) + "</w:tr>" for c in claims.values())
    body = [_paragraph(title, "Title"), _paragraph(manuscript), _paragraph("; ".join(f"{k} {n}" for k, n in counts.items())), f"<w:tbl>{matrix}</w:tbl>"]
    for c in claims.values():
        body.append(_paragraph(f"{c[0]['claim_id']} {c[0]['heading']}", "Heading1"))
        body.append(_paragraph(c[0]["status"], bold=c[0]["status"] != STATUS_LABELS["direct"]))
        body += [_paragraph(f"{name.get(r['source_id'], r['source_id'])} p. {r['pdf_page'] or '-'}: {r['quote']}") for r in c if r["source_id"]]
    body += [_paragraph(f"{x['label']} {x['source_id']}") for x in sorted(labels, key=lambda x: x["label"])]
    page = '<w:p><w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText>PAGE</w:instrText></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r></w:p>'
    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    main = "application/vnd.openxmlformats-officedocument.wordprocessingml"
    kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    files = {
        "[Content_Types].xml": f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="{main}.document.main+xml"/><Override PartName="/word/footer1.xml" ContentType="{main}.footer+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{kind}/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/_rels/document.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r2" Type="{kind}/footer" Target="footer1.xml"/></Relationships>',
        "word/footer1.xml": f"<w:ftr {space}>{page}</w:ftr>",
        "word/document.xml": f'<w:document {space}><w:body>{"".join(body)}<w:sectPr><w:footerReference w:type="default" r:id="r2"/></w:sectPr></w:body></w:document>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as package:
        for path, text in files.items():
            package.writestr(path, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
    return out.getvalue()
