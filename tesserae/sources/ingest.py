"""Files to elements, symbols and sheets; failures are rows of their own."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators.catalog import new_documents
from tesserae.runtime import ship
from tesserae.sources import code, delimited, formats, office, prose

_PARSED = (
    "doc_id string, file_name string, format string, seq int, kind string, text string, heading_level int, page int, "
    "line_start int, line_end int, symbol string, table_rows string, error string"
)


def parse_one(file_name: str, content: bytes, fmt: str, plugins: dict | None = None) -> tuple[list[dict], list[dict], list[tuple[str, list[list]]]]:
    """Elements, symbols and sheets of one file; raises for what cannot be read. Registered parsers come
    first; where one fails the next is tried, then the reader of the format itself if it has one."""
    failed: Exception | None = None
    for plugged in (plugins or {}).get(fmt, []):
        try:
            return plugged(file_name, content), [], []
        except Exception as problem:
            failed = problem
    try:
        return _built_in(file_name, content, fmt)
    except NoReader as problem:
        raise failed or problem from None


class NoReader(ValueError):
    """No parser reads this format here."""


def _built_in(file_name: str, content: bytes, fmt: str) -> tuple[list[dict], list[dict], list[tuple[str, list[list]]]]:
    suffix = file_name.rsplit(".", 1)[-1].lower()
    if fmt == "docx":
        return office.parse_docx(content), [], []
    if fmt == "pptx":
        return office.parse_pptx(content), [], []
    if fmt == "tabular":
        if suffix in ("xlsx", "xlsm"):
            return [], [], office.workbook_grids(content)
        if suffix in ("csv", "tsv"):
            return [], [], [(file_name.rsplit(".", 1)[0], delimited.grid(prose.decode(content)))]
        raise NoReader(f"no reader for .{suffix}")
    if fmt in ("pdf", "image"):
        raise NoReader(f"no parser is registered for {fmt}")
    text = prose.decode(content)
    if fmt == "markdown":
        return prose.parse_markdown(text), [], []
    if fmt == "code":
        if suffix == "ipynb":
            return *code.parse_notebook(text, prose.parse_markdown), []
        return *code.parse_code(text, formats.LANGUAGES.get(suffix, "text"), file_name), []
    return prose.parse_text(text), [], []


def parse(files: DataFrame) -> DataFrame:
    """Rows of ``files`` (scan) to elements; symbols have kind ``symbol``, sheet rows ``sheet_row``
    (sheet in symbol, row in seq, cells as JSON in table_rows); a file that fails is one row with error."""
    ship(files.sparkSession)
    names, plugins = [c.split()[0] for c in _PARSED.split(", ")], formats.plugins()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for f in pdf.itertuples():
                base = {"doc_id": f.doc_id, "file_name": f.file_name, "format": f.format}
                try:
                    elements, symbols, sheets = parse_one(f.file_name, bytes(f.content), f.format, plugins)
                except Exception as problem:
                    out.append(base | {"seq": 0, "kind": "error", "error": f"{type(problem).__name__}: {problem}"[:500]})
                    continue
                for i, e in enumerate(elements):
                    rows = json.dumps(e["table_rows"]) if e.get("table_rows") else None
                    keep = {k: e.get(k) for k in ("kind", "text", "heading_level", "page", "line_start", "line_end", "symbol")}
                    out.append(base | keep | {"seq": i, "table_rows": rows})
                for i, s in enumerate(symbols):
                    out.append(base | {"seq": i, "kind": "symbol", "symbol": s["symbol"], "text": s["kind"], "line_start": s["line_start"], "line_end": s["line_end"]})
                for sheet, grid in sheets:
                    out += [base | {"seq": i, "kind": "sheet_row", "symbol": sheet, "table_rows": json.dumps(r)} for i, r in enumerate(grid)]
            made = pd.DataFrame(out, columns=names).astype(object)
            yield made.where(made.notna(), None)

    return files.select("doc_id", "file_name", "format", "content").mapInPandas(run, _PARSED)


def sheet_rows(parsed: DataFrame) -> DataFrame:
    """``(sheet, row, cells)`` for operators.tables; a sheet's name is prefixed by its document."""
    return parsed.filter("kind = 'sheet_row'").select(
        F.concat_ws(":", "doc_id", "symbol").alias("sheet"), F.col("seq").alias("row"), F.from_json("table_rows", "array<string>").alias("cells")
    )


def outcome(parsed: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The state of each file and the rows that may be indexed: a file with an error row is ``error`` with
    its message and leaves nothing behind; the others are ``ready`` with their counts, empty files too."""
    counted = parsed.groupBy("doc_id").agg(
        F.min("error").alias("error"),
        F.count_if(~F.col("kind").isin("error", "symbol", "sheet_row")).alias("elements"),
        F.count_if(F.col("kind") == "symbol").alias("symbols"),
        F.count_distinct(F.when(F.col("kind") == "sheet_row", F.col("symbol"))).alias("sheets"),
    )
    states = files.select("doc_id", "file_name", "format").join(counted, "doc_id", "left").withColumn(
        "status", F.when(F.col("error").isNotNull(), "error").otherwise("ready")
    )
    states = states.na.fill(0, ["elements", "symbols", "sheets"])
    bad = parsed.filter("error IS NOT NULL").select("doc_id").distinct()
    return states, parsed.join(bad, "doc_id", "left_anti")


def fresh(files: DataFrame, known: DataFrame, index_key: str) -> DataFrame:
    """Files whose content is not indexed under this version yet."""
    return new_documents(files.withColumn("index_key", F.lit(index_key)), known)
