"""Plain text and Markdown to elements."""

from __future__ import annotations

import re


def decode(content: bytes) -> str:
    """UTF-8 with or without mark, else the encoding that bytes suggest, else Latin-1."""
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        pass
    try:
        from charset_normalizer import from_bytes

        best = from_bytes(content).best()
        if best is not None:
            return str(best)
    except ImportError:
        pass
    return content.decode("latin-1")


def _element(kind: str, text: str, first: int | None, last: int | None, **more) -> dict:
    return {"kind": kind, "text": text, "line_start": first, "line_end": last, "heading_level": None, "page": None} | more


def _looks_like_heading(line: str) -> bool:
    words = line.split()
    if not words or len(line) > 80 or len(words) > 12 or line[-1] in ".,;:!?":
        return False
    return line.isupper() or bool(re.match(r"\d+(\.\d+)*\.?\s+\S", line)) or line.istitle()


def parse_text(text: str) -> list[dict]:
    """Blocks between blank lines: headings (underlined, capital, numbered or title case lines that
    stand alone), lists, paragraphs; with 1-based lines."""
    out, block, start = [], [], 1
    lines = text.split("\n")
    for i, line in enumerate([*lines, ""], 1):
        if line.strip():
            if not block:
                start = i
            block.append(line.rstrip())
            continue
        if block:
            end = start + len(block) - 1
            if len(block) == 2 and re.fullmatch(r"\s*(=+|-+)\s*", block[1]):
                level = 1 if "=" in block[1] else 2
                out.append(_element("heading", block[0].strip(), start, end, heading_level=level))
            elif len(block) == 1 and _looks_like_heading(block[0].strip()):
                out.append(_element("heading", block[0].strip(), start, end, heading_level=2))
            else:
                marks = sum(bool(re.match(r"\s*([-*•]|\d+[.)])\s+", x)) for x in block)
                kind = "list" if marks * 2 >= len(block) and marks else "paragraph"
                out.append(_element(kind, "\n".join(block).strip(), start, end))
            block = []
    return out


_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")
_ITEM = re.compile(r"^ {0,3}([-*+]|\d{1,9}[.)])\s+")


def parse_markdown(text: str, page: int | None = None) -> list[dict]:
    """Headings, lists, quotes, fences, pipe tables, HTML blocks and paragraphs, with lines."""
    lines = text.split("\n")
    out: list[dict] = []
    i = 0

    def take(j: int, go) -> int:
        while j < len(lines) and go(j):
            j += 1
        return j

    while i < len(lines):
        line = lines[i]
        if not line.strip():
            i += 1
            continue
        start = i
        fence = _FENCE.match(line)
        head = re.match(r"^ {0,3}(#{1,6})\s+(.*?)\s*#*\s*$", line)
        more: dict = {}
        if fence:
            i = take(i + 1, lambda j: not re.match(rf"^ {{0,3}}{re.escape(fence[1][0])}{{{len(fence[1])},}}\s*$", lines[j]))
            kind, body, i = "code", "\n".join(lines[start : i + 1]), i + 1
            more["language"] = fence[2].strip() or None
        elif head:
            kind, body, i = "heading", head[2], i + 1
            more["heading_level"] = len(head[1])
        elif re.match(r"^ {0,3}([-*_])( *\1){2,}\s*$", line):
            i += 1
            continue
        elif "|" in line and i + 1 < len(lines) and re.match(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$", lines[i + 1]) and "|" in lines[i + 1]:
            i = take(i, lambda j: "|" in lines[j])
            kind, body = "table", "\n".join(lines[start:i])
            split = lambda r: [c.strip() for c in re.split(r"(?<!\\)\|", r.strip().strip("|"))]
            more["table_rows"] = [split(r) for k, r in enumerate(lines[start:i]) if k != 1]
        elif line.lstrip().startswith(">"):
            i = take(i, lambda j: bool(lines[j].strip()))
            kind, body = "paragraph", "\n".join([re.sub(r"^\s*>\s?", "", x) for x in lines[start:i]])
        elif _ITEM.match(line):
            i = take(i, lambda j: bool(lines[j].strip()) or (j + 1 < len(lines) and bool(re.match(r"^( {2,}\S|\t)", lines[j + 1]))))
            kind, body = "list", "\n".join(lines[start:i])
        elif re.match(r"^ {0,3}<[A-Za-z/!]", line):
            i = take(i, lambda j: bool(lines[j].strip()))
            kind, body = "paragraph", "\n".join(lines[start:i])
        else:
            i = take(
                i + 1,
                lambda j: bool(lines[j].strip()) and not re.match(r"^ {0,3}(#{1,6}\s|>)", lines[j]) and not _FENCE.match(lines[j]),
            )
            body = lines[start:i]
            if len(body) > 1 and re.fullmatch(r" {0,3}(=+|-+)\s*", body[-1]):
                more["heading_level"] = 1 if "=" in body[-1] else 2
                kind, body = "heading", " ".join([x.strip() for x in body[:-1]])
            else:
                kind, body = "paragraph", "\n".join([x.strip() for x in body])
        span = (None, None) if page else (start + 1, i)
        out.append(_element(kind, body.strip(), *span) | more | {"page": page})
    return out
