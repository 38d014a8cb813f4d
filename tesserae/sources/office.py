"""Office files by zip and XML from the standard library: workbooks, documents, slides."""

from __future__ import annotations

import io
import re
import zipfile
from datetime import datetime, timedelta
from xml.etree import ElementTree

MOST_INFLATED, MOST_RATIO = 1 << 30, 150


class UnsafeContainer(ValueError):
    """No zip archive, or one that inflates beyond reason."""


def check_container(content: bytes) -> zipfile.ZipFile:
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        raise UnsafeContainer("not a zip container") from None
    total = sum(i.file_size for i in z.infolist())
    packed = sum(i.compress_size for i in z.infolist())
    if total > MOST_INFLATED or total > MOST_RATIO * max(packed, 1):
        raise UnsafeContainer(f"{total} bytes from {packed}")
    return z


def _name(el) -> str:
    return el.tag.rsplit("}", 1)[-1]


def _all(el, name: str):
    return [x for x in el.iter() if _name(x) == name]


def _attr(el, name: str, default=None):
    return next((v for k, v in el.attrib.items() if k.rsplit("}", 1)[-1] == name), default)


def _xml(z: zipfile.ZipFile, name: str):
    try:
        return ElementTree.fromstring(z.read(name))
    except KeyError:
        return None


def _place(ref: str) -> tuple[int, int]:
    letters, digits = re.match(r"([A-Z]+)(\d+)", ref).groups()
    col = 0
    for ch in letters:
        col = col * 26 + ord(ch) - 64
    return int(digits) - 1, col - 1


def workbook_grids(content: bytes) -> list[tuple[str, list[list]]]:
    """(sheet name, rows of text cells) of the visible sheets. Vertically merged cells repeat their
    value downwards; horizontally merged ones stay blank."""
    z = check_container(content)
    shared_xml = _xml(z, "xl/sharedStrings.xml")
    shared = [] if shared_xml is None else ["".join(t.text or "" for t in _all(si, "t")) for si in shared_xml if _name(si) == "si"]
    styles, date_styles = _xml(z, "xl/styles.xml"), set()
    if styles is not None:
        own = {int(_attr(f, "numFmtId")): _attr(f, "formatCode", "") for f in _all(styles, "numFmt")}
        for xfs in [x for x in styles if _name(x) == "cellXfs"]:
            for i, xf in enumerate(xfs):
                n = int(_attr(xf, "numFmtId", 0))
                code = re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(n, ""))
                if 14 <= n <= 22 or re.search(r"[ymdh]", code, re.I):
                    date_styles.add(i)
    rels = {_attr(r, "Id"): _attr(r, "Target") for r in _xml(z, "xl/_rels/workbook.xml.rels")}
    out = []
    for sheet in _all(_xml(z, "xl/workbook.xml"), "sheet"):
        if _attr(sheet, "state", "visible") != "visible":
            continue
        target = rels[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))].lstrip("/")
        root = _xml(z, target if target.startswith("xl/") else f"xl/{target}")
        cells: dict[tuple[int, int], str] = {}
        for c in _all(root, "c"):
            kind, at = _attr(c, "t"), _place(_attr(c, "r"))
            v = next((x.text for x in c if _name(x) == "v"), None)
            if kind == "inlineStr":
                cells[at] = "".join(t.text or "" for t in _all(c, "t"))
            elif v is None:
                continue
            elif kind == "s":
                cells[at] = shared[int(v)]
            elif kind == "b":
                cells[at] = "TRUE" if v == "1" else "FALSE"
            elif kind not in ("str", "e") and int(_attr(c, "s", 0)) in date_styles:
                cells[at] = str(datetime(1899, 12, 30) + timedelta(seconds=round(float(v) * 86400))).removesuffix(" 00:00:00")
            else:
                cells[at] = v[:-2] if v.endswith(".0") else v
        for m in _all(root, "mergeCell"):
            a, _, b = _attr(m, "ref").partition(":")
            (r1, c1), (r2, _) = _place(a), _place(b or a)
            for r in range(r1 + 1, r2 + 1):
                if (r1, c1) in cells:
                    cells[r, c1] = cells[r1, c1]
        height = max((r for r, _ in cells), default=-1) + 1
        width = max((c for _, c in cells), default=-1) + 1
        out.append((_attr(sheet, "name"), [[cells.get((r, c)) for c in range(width)] for r in range(height)]))
    return out


def _pipe(rows: list[list[str]]) -> str:
    line = lambda r: "| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in r) + " |"
    return "\n".join([line(rows[0]), "|" + "---|" * len(rows[0]), *map(line, rows[1:])]) if rows else ""


def _element(kind: str, text: str, page: int | None, **more) -> dict:
    return {"kind": kind, "text": text, "page": page, "line_start": None, "line_end": None, "heading_level": None} | more


def parse_docx(content: bytes) -> list[dict]:
    """Paragraphs and tables in order; pages by explicit breaks."""
    body = next(x for x in _xml(check_container(content), "word/document.xml") if _name(x) == "body")
    page, out = 1, []
    for el in body:
        if _name(el) == "p":
            breaks = sum(_attr(b, "type") == "page" for b in _all(el, "br")) + len(_all(el, "lastRenderedPageBreak"))
            text = "".join((t.text or "") if _name(t) == "t" else "\t" for t in el.iter() if _name(t) in ("t", "tab")).strip()
            style = next((_attr(s, "val", "") for s in _all(el, "pStyle")), "")
            level = re.match(r"(?i)heading\s*(\d)", style)
            if text:
                if level or style.lower() == "title":
                    out.append(_element("heading", text, page, heading_level=int(level[1]) if level else 1))
                elif _all(el, "numPr") or style.lower().startswith("list"):
                    if out and out[-1]["kind"] == "list" and out[-1]["page"] == page:
                        out[-1]["text"] += f"\n- {text}"
                    else:
                        out.append(_element("list", f"- {text}", page))
                else:
                    out.append(_element("paragraph", text, page))
            page += breaks
        elif _name(el) == "tbl":
            rows = [
                [" ".join("".join(t.text or "" for t in _all(p, "t")) for p in _all(c, "p")).strip() for c in tr if _name(c) == "tc"]
                for tr in el
                if _name(tr) == "tr"
            ]
            if rows:
                out.append(_element("table", _pipe(rows), page, table_rows=rows))
    return out


def parse_pptx(content: bytes) -> list[dict]:
    """Slides in order: shapes from top to bottom, titles as headings, tables, notes."""
    z = check_container(content)
    number = lambda n: int(re.search(r"(\d+)\.xml$", n)[1])
    slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=number)
    out = []
    text_of = lambda p: "".join(t.text or "" for t in _all(p, "t")).strip()
    for page, name in enumerate(slides, 1):
        shapes = []
        for el in _xml(z, name).iter():
            if _name(el) not in ("sp", "graphicFrame"):
                continue
            off = next(iter(_all(el, "off")), None)
            at = (int(_attr(off, "y", 0)), int(_attr(off, "x", 0))) if off is not None else (0, 0)
            shapes.append((at, len(shapes), el))
        for _, _, el in sorted(shapes, key=lambda s: s[:2]):
            tables = _all(el, "tbl")
            if tables:
                rows = [[" ".join(map(text_of, _all(c, "p"))).strip() for c in tr if _name(c) == "tc"] for tr in tables[0] if _name(tr) == "tr"]
                out.append(_element("table", _pipe(rows), page, table_rows=rows))
                continue
            holder = next(iter(_all(el, "ph")), None)
            lines = [x for x in map(text_of, _all(el, "p")) if x]
            if not lines:
                continue
            if holder is not None and _attr(holder, "type") in ("title", "ctrTitle"):
                out.append(_element("heading", " ".join(lines), page, heading_level=1))
            elif len(lines) > 1:
                out.append(_element("list", "\n".join(f"- {x}" for x in lines), page))
            else:
                out.append(_element("paragraph", lines[0], page))
        notes = _xml(z, f"ppt/notesSlides/notesSlide{number(name)}.xml")
        if notes is not None:
            said = [x for x in map(text_of, _all(notes, "p")) if x and not x.isdigit()]
            if said:
                out.append(_element("notes", "\n".join(said), page))
    return out
