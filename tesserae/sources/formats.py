"""File formats by extension, file scans, and plug-in points for parsers that need models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions of each format, and languages of code files.
EXTENSIONS = {
    "pdf": "pdf", "docx": "docx", "pptx": "pptx", "text": "txt log", "markdown": "md markdown",
    "tabular": "csv tsv xlsx xlsm xls", "image": "png jpg jpeg webp bmp tif tiff gif",
}
LANGUAGES = {
    "py": "python", "ipynb": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript",
    "java": "java", "cs": "csharp", "go": "go", "rs": "rust", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "rb": "ruby",
    "php": "php", "kt": "kotlin", "swift": "swift", "scala": "scala", "sql": "sql", "sh": "bash", "ps1": "powershell",
    "html": "html", "css": "css", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "xml": "xml",
}
FORMATS = {e: f for f, names in EXTENSIONS.items() for e in names.split()} | dict.fromkeys(LANGUAGES, "code")

Parser = Callable[[str, bytes], list[dict]]
_PLUGINS: dict[str, list[Parser]] = {}


def detect_format(path: Column | str) -> Column:
    """Format of a path, null for what is not supported."""
    table = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])
    path = F.col(path) if isinstance(path, str) else path
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"[^/\\]\.([^./\\]+)$", 1)))


def format_of(path: str) -> str | None:
    name = path.replace("\\", "/").rsplit("/", 1)[-1]
    return FORMATS.get(name.rsplit(".", 1)[-1].lower()) if "." in name[1:] else None


def scan(spark: SparkSession, root: str, recursive: bool = True, glob: str | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """``(path, file_name, format, content, doc_id)`` of the supported files under ``root``, without those
    named in ``exclude`` (a manifest, a large file that is not asked for). Spark's reader passes over files
    without a byte."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(root).withColumn("format", detect_format("path")).filter("format IS NOT NULL")
    files = files.filter(~F.regexp_extract("path", r"([^/]*)$", 1).isin(*exclude)) if exclude else files
    return files.select(
        "path",
        F.regexp_extract("path", r"([^/]*)$", 1).alias("file_name"),
        "format",
        "content",
        F.substring(F.sha2("content", 256), 1, 16).alias("doc_id"),
    )


def register(fmt: str, parser: Parser, first: bool = True) -> None:
    """A parser for a format that needs libraries or models (pdf, image): (file name, bytes) to elements.
    The one registered last is tried first, unless ``first`` is false; the next follows where one fails."""
    known = _PLUGINS.setdefault(fmt, [])
    known.insert(0 if first else len(known), parser)


def unregister(fmt: str) -> None:
    _PLUGINS.pop(fmt, None)


def plugins() -> dict[str, list[Parser]]:
    """The parsers registered so far; a plan carries them to the executors."""
    return {fmt: list(parsers) for fmt, parsers in _PLUGINS.items()}
