"""Tables: report-style grids to clean typed tables, type coercion, profiles, cards.

A sheet is rows of text cells with their place. Finding titles, merged headers and blocks is a
sequential walk over one sheet, done per sheet by applyInPandas; typing, totals and profiles are
one aggregate and one projection over any number of rows.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import text as T

DATE = (
    r"(?i)^(\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}"
    r"|\d{1,2}\s+[a-z]{3,9}\.?\s+\d{4}|[a-z]{3,9}\.?\s+\d{1,2},?\s+\d{4})"
    r"([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?)?\s*(z|[+-]\d{2}:?\d{2})?$"
)
DATE_FORMATS = (
    "yyyy-M-d[ H:m[:s]]", "yyyy-M-d'T'H:m[:s]", "yyyy/M/d[ H:m[:s]]", "yyyy.M.d", "M/d/yyyy", "d.M.yyyy", "d-M-yyyy",
    "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "MMM d yyyy", "MMMM d yyyy",
)
NUMERIC_SHARE = 0.9
_PLAIN_NUMBER = re.compile(r"^\(?-?[$€£¥₹]?-?[\d,]*\.?\d+%?\)?$")


def is_empty(value: Column | str) -> Column:
    c = T.col(value)
    return c.isNull() | (F.trim(c.cast("string")) == "")


def sql_identifier(name: object, fallback: str = "col") -> str:
    out = re.sub("[^0-9a-zA-Z]+", "_", str(name)).strip("_").lower() or fallback
    return (f"{fallback}_{out}" if out[0].isdigit() else out)[:60]


def unique_names(names: list[str]) -> list[str]:
    """Repeated names get _2, _3 and so on; a made name never meets a given one."""
    taken: set[str] = set()
    out = []
    for name in names:
        made, n = name, 2
        while made in taken or (made != name and made in names):
            made, n = f"{name}_{n}", n + 1
        taken.add(made)
        out.append(made)
    return out


def unique_table_name(base: str, taken: set[str]) -> str:
    name = sql_identifier(base, "table")[:48]
    made, n = name, 2
    while made in taken:
        made, n = f"{name}_{n}", n + 1
    return made


# -- grids ---------------------------------------------------------------------------------------
def _filled(row: list) -> list[str]:
    return [str(c).strip() for c in row if c is not None and str(c).strip()]


def _wordy(row: list) -> bool:
    cells = _filled(row)
    return bool(cells) and not any(_PLAIN_NUMBER.match(c.replace(" ", "")) or re.match(DATE, c) for c in cells)


def _labels(head: list[list]) -> list[str]:
    """One label a column: header rows joined, blanks of all but the last row filled from the left."""
    rows = []
    for i, row in enumerate(head):
        held, out = None, []
        for cell in row:
            text = None if cell is None or not str(cell).strip() else str(cell).strip()
            held = text or held
            out.append(text if i == len(head) - 1 else held)
        rows.append(out)
    labels = []
    for parts in zip(*rows, strict=True):
        kept = [p for i, p in enumerate(parts) if p and p not in parts[:i]]
        labels.append(" ".join(kept))
    return labels


def rows_to_table(rows: list[list], first_row: int = 1) -> dict:
    """Header and body of a block. A second and third header row are taken only if the first has
    blanks or repeats and the next is text as well."""
    first = [None if c is None or not str(c).strip() else str(c).strip() for c in rows[0]]
    merged = None in first or len(set(first)) < len(first)
    depth = 1
    while merged and depth < min(3, len(rows) - 1) and _wordy(rows[depth]):
        depth += 1
    labels = [x or f"column {i + 1}" for i, x in enumerate(_labels(rows[:depth]))]
    body = [(first_row + i, r) for i, r in enumerate(rows) if i >= depth]
    return {"labels": labels, "names": unique_names([sql_identifier(x) for x in labels]), "rows": body}


def grid_to_tables(grid: list[list]) -> list[dict]:
    """The tables of a sheet; lines with a single cell above a table are its title and notes."""
    blocks: list[tuple[int, list[list]]] = []
    for i, row in enumerate(grid):
        if not _filled(row):
            continue
        if blocks and blocks[-1][0] + len(blocks[-1][1]) == i:
            blocks[-1][1].append(row)
        else:
            blocks.append((i, [row]))
    tables, titles = [], []
    for start, rows in blocks:
        width = max(map(len, rows))
        rows = [[*r, *[None] * (width - len(r))] for r in rows]
        used = [j for j in range(width) if any(_filled([r[j]]) for r in rows)]
        rows = [[r[j] for j in used] for r in rows]
        while rows and len(_filled(rows[0])) == 1 and (len(used) > 1 or len(rows) == 1):
            titles += _filled(rows.pop(0))
            start += 1
        if len(rows) < 2 or len(used) < 2:
            titles += [" ".join(_filled(r)) for r in rows]
            continue
        tables.append(rows_to_table(rows, start + 1) | {"title": titles[0] if titles else None, "notes": titles[1:]})
        titles = []
    return tables


_TABLE_ROWS = (
    "sheet string, table_no int, title string, notes array<string>, names array<string>, labels array<string>, "
    "_row long, cells array<string>"
)


def sheets_to_tables(cells: DataFrame) -> DataFrame:
    """Rows ``(sheet, row, cells)``, row counted from 0, to table rows with 1-based source rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        grid: list[list] = []
        for place, cells_ in zip(pdf["row"], pdf["cells"], strict=True):
            grid.extend([] for _ in range(int(place) - len(grid)))
            grid.append(list(cells_) if cells_ is not None else [])
        out = []
        for no, t in enumerate(grid_to_tables(grid)):
            for row, values in t["rows"]:
                texts = [None if v is None or not str(v).strip() else str(v).strip() for v in values]
                out.append((pdf["sheet"].iloc[0], no, t["title"], t["notes"], t["names"], t["labels"], row, texts))
        names = [c.strip().split(" ")[0] for c in re.split(r",(?![^<]*>)", _TABLE_ROWS)]
        return pd.DataFrame(out, columns=names)

    return cells.groupBy("sheet").applyInPandas(run, _TABLE_ROWS)


def one_table(rows: DataFrame, sheet: str, table_no: int = 0) -> DataFrame:
    """The table with its columns spread out, as text, with _is_total and _row."""
    mine = rows.filter((F.col("sheet") == sheet) & (F.col("table_no") == table_no))
    names = mine.select("names").first()[0]
    return mine.select(
        *[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)],
        T.is_total_label(F.get("cells", F.lit(0))).alias("_is_total"),
        "_row",
    )


def block_ids(rows: DataFrame, key: str, order: str, blank: Column) -> DataFrame:
    """Gaps and islands: rows between blank ones share a block number."""
    w = Window.partitionBy(key).orderBy(order)
    starts = (~blank & F.coalesce(F.lag(blank).over(w), F.lit(True))).cast("int")
    return rows.withColumn("block", F.sum(starts).over(w)).filter(~blank)


# -- types ---------------------------------------------------------------------------------------
def to_timestamp(value: Column) -> Column:
    tidy = F.regexp_replace(F.trim(value), r"\s*(?i:z|[+-]\d{2}:?\d{2})$", "")
    safe = F.when(F.trim(value).rlike(DATE), tidy)
    return F.coalesce(
        F.try_to_timestamp(safe).cast("timestamp_ntz"),
        *[F.try_to_timestamp(safe, F.lit(f)).cast("timestamp_ntz") for f in DATE_FORMATS],
    )


def column_kinds(df: DataFrame, names: list[str]) -> dict[str, str]:
    """Type of each text column, from one aggregate pass: long, double, timestamp_ntz or string."""
    if not names:
        return {}
    figures = []
    for n in names:
        c = F.col(f"`{n}`")
        full = ~is_empty(c)
        num = T.parse_number(c)
        figures.append(
            F.struct(
                F.count_if(full).alias("filled"),
                F.count_if(full & num.isNotNull()).alias("num"),
                F.count_if(full & num.isNotNull() & (num != F.floor(num))).alias("broken"),
                F.count_if(full & F.trim(c).rlike(DATE)).alias("shaped"),
                F.count_if(full & to_timestamp(c).isNotNull()).alias("dates"),
            ).alias(n)
        )
    row = df.agg(*figures).first()
    kinds = {}
    for n in names:
        f = row[n]
        if f.filled and f.num >= NUMERIC_SHARE * f.filled:
            kinds[n] = "double" if f.broken else "bigint"
        elif f.filled and f.shaped == f.filled and f.dates >= NUMERIC_SHARE * f.filled:
            kinds[n] = "timestamp_ntz"
        else:
            kinds[n] = "string"
    return kinds


def coerce(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Text columns to the types they hold, by one aggregate and one projection."""
    names = names or [n for n, t in df.dtypes if t == "string" and not n.startswith("_")]
    made = {}
    for n, kind in column_kinds(df, names).items():
        c = F.col(f"`{n}`")
        if kind in ("bigint", "double"):
            made[n] = T.parse_number(c).cast(kind)
        elif kind == "timestamp_ntz":
            made[n] = to_timestamp(c)
        else:
            made[n] = F.when(~is_empty(c), F.trim(c))
    return df.withColumns(made)


def frame_to_table(df: DataFrame, row_col: str | None = None) -> DataFrame:
    """A delimited file's text rows: typed, with _is_total from the first column and _row from 2 on."""
    first = df.columns[0]
    total = T.is_total_label(F.col(f"`{first}`"))
    names = unique_names([sql_identifier(c) for c in df.columns if c != row_col])
    source = [c for c in df.columns if c != row_col]
    row = F.col(f"`{row_col}`") if row_col else F.monotonically_increasing_id()
    shaped = df.select(
        *[F.col(f"`{c}`").cast("string").alias(n) for c, n in zip(source, names, strict=True)],
        total.alias("_is_total"),
        (row + 2).cast("long").alias("_row"),
    )
    return coerce(shaped, names)


# -- profiles ------------------------------------------------------------------------------------
def profile(df: DataFrame, total_col: str | None = "_is_total") -> DataFrame:
    """One row a column, totals left out: nulls, distinct values, least, greatest, mean."""
    rows = df.filter(~F.col(total_col)) if total_col and total_col in df.columns else df
    names = [c for c in df.columns if not c.startswith("_")]
    kinds = dict(df.dtypes)
    number = ("bigint", "int", "double", "float", "smallint")
    figures = []
    for n in names:
        c = F.col(f"`{n}`")
        mean = F.round(F.avg(c), 2) if kinds[n] in number else F.lit(None).cast("double")
        ends = [f(c).cast("string") if kinds[n] != "string" else F.lit(None).cast("string") for f in (F.min, F.max)]
        figures.append(
            F.struct(
                F.lit(n).alias("name"),
                F.lit(kinds[n]).alias("type"),
                F.count_if(c.isNull()).alias("nulls"),
                F.count_distinct(c).alias("distinct"),
                ends[0].alias("min"),
                ends[1].alias("max"),
                mean.alias("mean"),
            ).alias(n)
        )
    return rows.agg(*figures).select(F.inline(F.array(*[F.col(f"`{n}`") for n in names])))


def top_values(df: DataFrame, names: list[str], k: int = 6, total_col: str | None = None) -> DataFrame:
    """``(name, value, n, place)``: the k most frequent values of each column, ties by value."""
    rows = df.filter(~F.col(total_col)) if total_col else df
    long = rows.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").cast("string").alias("value")) for n in names])))
    counted = long.filter("value IS NOT NULL").groupBy("name", "value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("name").orderBy(F.col("n").desc(), "value")
    return counted.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def _shown(value) -> str:
    if value is None or (isinstance(value, float) and value != value):
        return ""
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    if hasattr(value, "hour") and not (value.hour or value.minute or value.second):
        return str(value)[:10]
    return str(value).replace("|", "\\|").replace("\n", " ")


def markdown(rows: list[list], header: list[str]) -> str:
    """A pipe table of a few rows."""
    line = lambda cells: "| " + " | ".join(_shown(c) for c in cells) + " |"
    return "\n".join([line(header), "|" + "---|" * len(header), *(line(r) for r in rows)])


def table_card(df: DataFrame, name: str, file_name: str, title: str | None = None, notes: tuple[str, ...] = ()) -> str:
    """Description of a table for retrieval: columns with types and ranges, and its first rows (all
    of them up to twelve, else three)."""
    n = df.count()
    words = {"bigint": "integer", "double": "number", "timestamp_ntz": "date"}
    lines = [f"Table `{name}` from {file_name}: {n} rows"]
    lines += [f"Title: {title}"] if title else []
    lines += [f"Note: {x}" for x in notes]
    tops: dict[str, list[str]] = {}
    texts = [c for c, t in df.dtypes if t == "string" and not c.startswith("_")]
    if texts:
        for r in top_values(df, texts).orderBy("name", "place").collect():  # six rows a column
            tops.setdefault(r.name, []).append(r.value)
    for p in profile(df).collect():  # one row a column
        span = f", {p.min} to {p.max}" if p.min is not None else ""
        if p.type == "timestamp_ntz" and p.min:
            span = f", {p.min[:10]} to {p.max[:10]}"
        kind = "values" if p.distinct <= 6 else "examples"
        seen = f", {kind}: {', '.join(tops[p.name])}" if p.name in tops else ""
        lines.append(f"- {p.name} ({words.get(p.type, 'text')}{span}{seen})")
    shown = [c for c in df.columns if not c.startswith("_")]
    head = df.select(*[f"`{c}`" for c in shown]).limit(12 if n <= 12 else 3).collect()  # twelve rows at most
    return "\n".join([*lines, markdown([list(r) for r in head], shown)])
