"""Readers of office files from their XML parts, with the standard library only."""

from __future__ import annotations

import re
import zipfile
from io import BytesIO
from xml.etree import ElementTree as ET

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
DRAW = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _number(name: str) -> int:
    return int(re.search(r"(\d+)\.xml$", name)[1])


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheets(data: bytes) -> list[tuple[str, list[list[str | None]]]]:
    """(name, rows) of each sheet of a workbook; cells as text, None where empty."""
    with zipfile.ZipFile(BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]
        targets = {}
        if "xl/_rels/workbook.xml.rels" in names:
            targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for k, sheet in enumerate(ET.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet"), 1):
            target = targets.get(sheet.get(REL), f"worksheets/sheet{k}.xml").lstrip("/")
            part = target if target.startswith("xl/") else f"xl/{target}"
            rows = []
            for row in ET.fromstring(z.read(part)).iter(f"{MAIN}row"):
                cells: list[str | None] = []
                for c in row.iter(f"{MAIN}c"):
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at - len(cells) + 1)
                    if c.get("t") == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
                    else:
                        v = c.find(f"{MAIN}v")
                        if v is not None and v.text is not None:
                            cells[at] = shared[int(v.text)] if c.get("t") == "s" else v.text
                rows.append(cells)
            out.append((sheet.get("name"), rows))
        return out


def workbook_text(data: bytes) -> str:
    """All sheets under their headings, a line a row, non-empty cells joined by bars."""
    lines = []
    for name, rows in sheets(data):
        lines.append(f"--- Sheet: {name} ---")
        lines += [" | ".join(c for c in row if c is not None) for row in rows if any(c is not None for c in row)]
    return "\n".join(lines)


def slides(data: bytes) -> list[list[str]]:
    """The paragraphs of each slide, tables included."""
    with zipfile.ZipFile(BytesIO(data)) as z:
        parts = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=_number)
        out = []
        for part in parts:
            said = ("".join(t.text or "" for t in p.iter(f"{DRAW}t")) for p in ET.fromstring(z.read(part)).iter(f"{DRAW}p"))
            out.append([s for s in said if s.strip()])
        return out


def presentation_text(data: bytes) -> str:
    return "\n".join("\n".join([f"--- Slide {k} ---", *said]) for k, said in enumerate(slides(data), 1))


def presentation_profile(data: bytes) -> dict[str, int]:
    """Counts of slides, tables, text boxes and pictures."""
    with zipfile.ZipFile(BytesIO(data)) as z:
        parts = [z.read(n).decode("utf-8", "replace") for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)]
    return {"slides": len(parts), "tables": sum(p.count("<a:tbl>") for p in parts), "text_boxes": sum(p.count("<p:txBody>") for p in parts), "pictures": sum(p.count("<p:pic>") for p in parts)}


def workbook(header: list[str], rows: list[list[str | None]], redacted: set[int] = frozenset()) -> bytes:
    """A workbook of one sheet of texts; the cells of ``redacted`` columns are white on red."""
    from xml.sax.saxutils import escape

    def name(i: int) -> str:
        out = ""
        i += 1
        while i:
            i, r = divmod(i - 1, 26)
            out = chr(65 + r) + out
        return out

    def cell(value: str | None, column: int, row: int, style: int) -> str:
        return "" if value is None else f'<c r="{name(column)}{row}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'

    lines = [f'<row r="{r}">' + "".join(cell(v, c, r, int(r > 1 and c in redacted)) for c, v in enumerate(values)) + "</row>" for r, values in enumerate([header, *rows], 1)]
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    parts = {
        "[Content_Types].xml": f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook {ns} xmlns:r="{rel}"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="{rel}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet {ns}><fonts count="2"><font/><font><color rgb="FFFFFFFF"/></font></fonts><fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FFFF0000"/></patternFill></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" fillId="2" applyFont="1" applyFill="1"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f"<worksheet {ns}><sheetData>{''.join(lines)}</sheetData></worksheet>",
    }
    out = BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for part, body in parts.items():
            z.writestr(part, head + body)
    return out.getvalue()
