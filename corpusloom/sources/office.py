"""Text of zipped office files and profiles of small tables: per-file helpers used inside tasks."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET

import pandas as pd

from corpusloom import constants as C

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _xml(book: zipfile.ZipFile, name: str) -> ET.Element:
    return ET.fromstring(book.read(name))


def _targets(book: zipfile.ZipFile, folder: str, part: str) -> dict[str, str]:
    """Relationship id to part name."""
    rels = _xml(book, f"{folder}/_rels/{part}.rels")
    return {
        r.get("Id"): t[1:] if (t := r.get("Target", "")).startswith("/") else f"{folder}/{t}"
        for r in rels
    }


def _paragraph(p: ET.Element) -> str:
    marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    runs = [r for r in p.iter(f"{_W}r")]
    return "".join(
        (n.text or "") if n.tag == f"{_W}t" else marks.get(n.tag, "") for r in runs for n in r
    )


def _table_rows(table: ET.Element) -> list[list[str]]:
    """Cell texts on the grid: a cell over several columns or rows is repeated in each."""
    rows: list[list[str]] = []
    for tr in table.findall(f"{_W}tr"):
        row: list[str] = []
        for tc in tr.findall(f"{_W}tc"):
            span = tc.find(f"{_W}tcPr/{_W}gridSpan")
            merge = tc.find(f"{_W}tcPr/{_W}vMerge")
            text = "\n".join(_paragraph(p) for p in tc.findall(f"{_W}p")).strip()
            if merge is not None and merge.get(f"{_W}val", "continue") == "continue" and rows:
                text = rows[-1][len(row)] if len(row) < len(rows[-1]) else text
            row += [text] * (int(span.get(f"{_W}val", "1")) if span is not None else 1)
        rows.append(row)
    return rows


def docx(data: bytes) -> dict:
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        body = _xml(book, "word/document.xml").find(f"{_W}body")
    paragraphs = [_paragraph(p) for p in body.findall(f"{_W}p")]
    tables = body.findall(f"{_W}tbl")
    parts = [p for p in paragraphs if p.strip()]
    for table in tables:
        lines = [" | ".join(row) for row in _table_rows(table)]
        if lines:
            parts.append("\n[Table]\n" + "\n".join(lines))
    return {
        "content": "\n\n".join(parts),
        "stats": {"paragraphs": len(paragraphs), "tables": len(tables)},
    }


def pptx(data: bytes) -> dict:
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        order = [s.get(f"{_R}id") for s in _xml(book, "ppt/presentation.xml").iter(f"{_P}sldId")]
        targets = _targets(book, "ppt", "presentation.xml")
        slides = [_xml(book, targets[r]) for r in order]
    lines: list[str] = []
    for number, slide in enumerate(slides, 1):
        lines.append(f"\n[Slide {number}]")
        for shape in slide.findall(f"{_P}cSld/{_P}spTree/{_P}sp"):
            text = "\n".join(
                "".join("\v" if n.tag == f"{_A}br" else n.text or "" for n in p.iter() if n.tag in (f"{_A}t", f"{_A}br"))
                for p in shape.findall(f"{_P}txBody/{_A}p")
            ).strip()
            if text:
                lines.append(text)
    return {"content": "\n".join(lines), "stats": {"slides": len(slides)}}


def odt(data: bytes) -> dict:
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        root = _xml(book, "content.xml")
    texts = ((e.text or "").strip() for e in root.iter())
    return {"content": "\n".join(t for t in texts if t), "stats": {}}


def _column(reference: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", reference).group():
        n = n * 26 + ord(ch) - 64
    return n - 1


def _cell(c: ET.Element, strings: list[str]):
    kind, raw = c.get("t", "n"), c.findtext(f"{_S}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{_S}t"))
    if raw is None:
        return None
    if kind == "s":
        return strings[int(raw)]
    if kind == "b":
        return raw == "1"
    if kind in ("str", "e"):
        return raw
    number = float(raw)
    return int(number) if number.is_integer() and "." not in raw else number


def _sheet(root: ET.Element, strings: list[str]) -> pd.DataFrame:
    rows: list[list] = []
    for r in root.iter(f"{_S}row"):
        at = int(r.get("r", len(rows) + 1))
        rows += [[] for _ in range(at - len(rows))]
        for i, c in enumerate(r.findall(f"{_S}c")):
            col = _column(c.get("r")) if c.get("r") else i
            rows[at - 1] += [None] * (col + 1 - len(rows[at - 1]))
            rows[at - 1][col] = _cell(c, strings)
    while rows and all(v is None for v in rows[-1]):
        rows.pop()
    if not rows:
        return pd.DataFrame()
    width = max(len(r) for r in rows)
    rows = [r + [None] * (width - len(r)) for r in rows]
    head = [f"Unnamed: {i}" if v is None else v for i, v in enumerate(rows[0])]
    return pd.DataFrame(rows[1:], columns=head)


def xlsx(data: bytes) -> dict:
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        strings: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = _xml(book, "xl/sharedStrings.xml").findall(f"{_S}si")
            strings = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in shared]
        targets = _targets(book, "xl", "workbook.xml")
        named = [(s.get("name"), targets[s.get(f"{_R}id")]) for s in _xml(book, "xl/workbook.xml").iter(f"{_S}sheet")]
        frames = [(name, _sheet(_xml(book, part), strings)) for name, part in named]
    lines, sheets = [], []
    for name, df in frames:
        lines += [
            f"\n[Sheet: {name}]",
            f"Rows: {len(df)}, Columns: {len(df.columns)}",
            "Columns: " + ", ".join(df.columns.tolist()),
            "\nData Preview:",
            df.head(C.SHEET_PREVIEW_ROWS).to_string(),
        ]
        sheets.append({"name": name, "rows": len(df), "columns": len(df.columns)})
    return {"content": "\n".join(lines), "stats": {"total_sheets": len(sheets)}, "sheets": sheets}


def table_profile(rows: int, columns: list[str], head: pd.DataFrame) -> str:
    lines = [
        f"CSV Data with {rows} rows and {len(columns)} columns\n",
        "Columns: " + ", ".join(columns),
        "\nData Preview:",
        head.to_string(),
    ]
    if rows > C.CSV_PREVIEW_ROWS:
        lines.append(f"\n... and {rows - C.CSV_PREVIEW_ROWS} more rows")
    return "\n".join(lines)


def csv(data: bytes) -> dict:
    df = pd.read_csv(io.BytesIO(data))
    columns = df.columns.tolist()
    return {
        "content": table_profile(len(df), columns, df.head(C.CSV_PREVIEW_ROWS)),
        "stats": {"rows": len(df), "columns": len(columns)},
        "column_names": columns,
    }


# Format to handler and to the name used in its error text.
HANDLERS = {
    "docx": (docx, "DOCX"),
    "powerpoint": (pptx, "PowerPoint"),
    "odt": (odt, "ODT"),
    "excel": (xlsx, "Excel"),
    "csv": (csv, "CSV"),
}
