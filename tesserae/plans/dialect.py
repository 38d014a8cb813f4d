"""Rewrites of analyst SQL that Spark's parser does not take: strftime, QUALIFY and DISTINCT ON.

The text is cut into tokens, so quotes, comments and brackets are respected; a rewrite works on the
clauses at the top of one query, and subqueries are rewritten before the query that holds them.
"""

from __future__ import annotations

import re

_TOKEN = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|[A-Za-z_]\w*|.", re.S)
# Codes of strftime and the letters of Spark's datetime patterns.
STRFTIME = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss",
    "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%j": "DDD", "%p": "a", "%f": "SSSSSS",
}
_ENDS = ("order", "limit", "offset")
_SETS = ("union", "intersect", "except")


class UnsafeSQLError(ValueError):
    """The statement is not a single read-only query over the allowed tables."""


def _tokens(sql: str) -> list[str]:
    return [" " if t.startswith(("--", "/*")) else t for t in _TOKEN.findall(sql)]


def _closing(tokens: list[str], at: int) -> int:
    """Index of the bracket that closes the one at ``at``."""
    depth = 0
    for i in range(at, len(tokens)):
        depth += (tokens[i] == "(") - (tokens[i] == ")")
        if depth == 0:
            return i
    raise UnsafeSQLError("a bracket is not closed")


def _nest(tokens: list[str]) -> list[str]:
    """Every bracket with what it holds, rewritten, as one token."""
    out, i = [], 0
    while i < len(tokens):
        if tokens[i] != "(":
            out.append(tokens[i])
            i += 1
            continue
        end = _closing(tokens, i)
        inner = _nest(tokens[i + 1 : end])
        before = [t.lower() for t in out if t.strip()][-1:]
        if before == ["strftime"]:
            while out.pop().lower() != "strftime":
                pass
            out.append(_strftime(inner))
        else:
            out.append("(" + _query(inner) + ")")
        i = end + 1
    return out


def _split(tokens: list[str]) -> list[str]:
    parts, part = [], []
    for t in [*tokens, ","]:
        if t == ",":
            parts.append("".join(part).strip())
            part = []
        else:
            part.append(t)
    return parts


def _strftime(inner: list[str]) -> str:
    args = _split(inner)
    if len(args) != 2 or not re.fullmatch(r"'[^']*'", args[1]):
        raise UnsafeSQLError("strftime takes a value and a literal format")

    def piece(m: re.Match) -> str:
        if m[0].startswith("%"):
            if m[0] not in STRFTIME:
                raise UnsafeSQLError(f"strftime code {m[0]} is not known")
            return STRFTIME[m[0]]
        return f"''{m[0]}''"

    pattern = re.sub(r"%.?|[A-Za-z]+", piece, args[1][1:-1])
    return f"date_format({args[0]}, '{pattern}')"


def _query(tokens: list[str]) -> str:
    """One query, its brackets already single tokens."""
    words = [t.lower() for t in tokens]
    starts = [i for i, w in enumerate(words) if w == "select"]
    if len(starts) != 1 or any(w in _SETS for w in words[: starts[0]]):
        return "".join(tokens)
    head, body, low = "".join(tokens[: starts[0]]), tokens[starts[0] + 1 :], words[starts[0] + 1 :]
    solid = [i for i, w in enumerate(low) if w.strip()]
    on = None
    if len(solid) > 2 and [low[i] for i in solid[:2]] == ["distinct", "on"] and body[solid[2]].startswith("("):
        on = body[solid[2]][1:-1]
        body, low = body[solid[2] + 1 :], low[solid[2] + 1 :]
    if on is None and "qualify" not in low:
        return "".join(tokens)
    end = next((i for i, w in enumerate(low) if w in _ENDS), len(low))
    tail, main, low = body[end:], body[:end], low[:end]
    kept = None
    if "qualify" in low:
        at = low.index("qualify")
        kept, main, low = "".join(main[at + 1 :]).strip(), main[:at], low[:at]
    source = low.index("from") if "from" in low else len(low)
    listed, rest = "".join(main[:source]).strip(), "".join(main[source:]).strip()
    hidden = [] if kept is None else [("__kept", f"({kept})")]
    order, after = _order(tail)
    if on is not None:
        by = ", ".join(order) if order else on
        hidden.append(("__place", f"row_number() OVER (PARTITION BY {on} ORDER BY {by})"))
    keys = []
    for n, item in enumerate(order):
        value, way = re.fullmatch(r"(?is)(.*?)((?:\s+(?:asc|desc))?(?:\s+nulls\s+(?:first|last))?)", item).groups()
        if on is None and re.fullmatch(r"\w+|\"[^\"]+\"", value):
            keys.append(item)  # a result column or its position
            continue
        hidden.append((f"__key{n}", value))
        keys.append(f"__key{n}{way}")
    inner = f"SELECT {listed}, " + ", ".join(f"{value} AS {name}" for name, value in hidden) + f" {rest}"
    tests = (["__kept"] if kept is not None else []) + (["__place = 1"] if on is not None else [])
    out = f"SELECT * EXCEPT ({', '.join(n for n, _ in hidden)}) FROM ({inner}) AS __rows WHERE {' AND '.join(tests)}"
    return f"{head}{out}" + (f" ORDER BY {', '.join(keys)}" if keys else "") + (f" {after}" if after else "")


def _order(tail: list[str]) -> tuple[list[str], str]:
    """The sort items and what follows them."""
    low = [t.lower() for t in tail]
    if not low or low[0] != "order":
        return [], "".join(tail).strip()
    by = low.index("by")
    end = next((i for i, w in enumerate(low) if w in _ENDS and i > by), len(low))
    return _split(tail[by + 1 : end]), "".join(tail[end:]).strip()


def rewrite(sql: str) -> str:
    """The statement in Spark's dialect; raises UnsafeSQLError where a form is not known."""
    return _query(_nest(_tokens(sql)))
