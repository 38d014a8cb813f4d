"""WARC archives compressed with Zstandard, one frame per record, and their reader.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary, raw or
itself compressed; every record follows as a frame of its own, so a reader needs no other index
and can start at any frame. The reader loads the dictionary from the leading frame, decodes one
record at a time and validates what it reads: frame magic, version line, header syntax, mandatory
headers, block length against Content-Length, the record's end, and payload digests of responses.

Archives are cut by size inside each partition, so memory is bounded by ``ARCHIVE_BYTES`` of
payload and one record; a task that is run again writes the same archive. They travel as rows
(archive bytes) through a table in the shared folder, since executors share no other storage.

Which record of equal payloads is the response is found by grouping on the SHA-1, with partial
aggregation before the shuffle; a payload that a third of all pages share is one group of one
running maximum.

Defined results: null html is an empty payload; payloads under ``REVISIT_BYTES`` are responses;
among rows with the same largest id and payload all are responses; a null id never is the largest
of a group that holds another; an empty table gives no records; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.runtime import discard, settle, ship

DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
ARCHIVE_BYTES, REVISIT_BYTES = 8 << 20, 1000
DICTIONARY_BYTES, DICTIONARY_SAMPLES, SAMPLE_BYTES = 32 << 10, 200, 1 << 20
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


class WarcError(ValueError):
    """The archive or record is malformed."""


def warc_digest(sha1_hex: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record_id(name: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, str(name))}>"


def format_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    for name, value in headers:
        if "\r" in value or "\n" in value:
            raise WarcError(f"line break in {name}")
    head = "".join([f"{name}: {value}\r\n" for name, value in [*headers, ("Content-Length", str(len(block)))]])
    return VERSION + b"\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record; raises WarcError."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] != VERSION:
        raise WarcError("no WARC record")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        try:
            name, colon, value = line.decode().partition(":")
        except UnicodeDecodeError as problem:
            raise WarcError(f"bad header line {line[:40]!r}") from problem
        if not colon or not name or name != name.strip():
            raise WarcError(f"bad header line {line[:40]!r}")
        if name.lower() in headers:
            raise WarcError(f"{name} stands twice")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise WarcError(f"no {name}")
    length = headers["content-length"]
    if not length.isascii() or not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError(f"block of {len(rest) - 4} bytes, Content-Length {length}")
    block = rest[:-4]
    if headers["warc-type"] == "response" and "warc-payload-digest" in headers:
        if warc_digest(hashlib.sha1(block).hexdigest()) != headers["warc-payload-digest"]:
            raise WarcError("payload digest differs")
    return headers, block


def write_archive(records: list[bytes]) -> bytes:
    """One archive: the dictionary frame and a frame for each record."""
    samples, size = [], 0
    for r in records[:: max(1, len(records) // DICTIONARY_SAMPLES)]:
        samples.append(r[:8192])
        size += len(samples[-1])
        if size >= SAMPLE_BYTES:
            break
    plain = b""
    try:
        plain = zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=3).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        pass  # too few or too uniform samples: an empty dictionary frame
    packed = zstandard.ZstdCompressor(level=9).compress(plain) if plain else b""
    parts = [DICTIONARY_MAGIC.to_bytes(4, "little"), len(packed).to_bytes(4, "little"), packed]
    known = zstandard.ZstdCompressionDict(plain) if plain else None
    packer = zstandard.ZstdCompressor(level=3, dict_data=known, write_checksum=True, write_content_size=True)
    parts += [packer.compress(r) for r in records]
    return b"".join(parts)


def read_archive(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive, one frame at a time; raises WarcError on anything malformed."""
    view, at = memoryview(raw), 0
    word = lambda i: int.from_bytes(view[i : i + 4], "little")
    known = None
    if len(view) >= 8 and word(0) == DICTIONARY_MAGIC:
        at = 8 + word(4)
        if at > len(view):
            raise WarcError("dictionary frame cut off")
        held = bytes(view[8:at])
        if held[:4] == FRAME_MAGIC.to_bytes(4, "little"):
            held = zstandard.ZstdDecompressor().decompress(held)
        known = zstandard.ZstdCompressionDict(held) if held else None
    unpacker = zstandard.ZstdDecompressor(dict_data=known)
    while at < len(view):
        magic = word(at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + word(at + 4)
            continue
        if magic != FRAME_MAGIC:
            raise WarcError(f"no frame at byte {at}")
        frame = unpacker.decompressobj()
        parts, step = [], 1 << 16
        while not frame.eof:
            if at >= len(view):
                raise WarcError("last frame cut off")
            piece = view[at : at + step]
            try:
                parts.append(frame.decompress(piece))
            except zstandard.ZstdError as problem:
                raise WarcError(str(problem)) from problem
            at += len(piece) - len(frame.unused_data)
        yield parse_record(b"".join(parts))


def _page_record(page, url, payload: bytes, digest: str, refers, place: str) -> bytes:
    """``place`` tells rows apart that have the same id, or none."""
    kind = "response" if refers is None else "revisit"
    headers = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(page) if page is not None and kind == "response" else record_id(f"{page} {kind} {place}")),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", "".join((url or "").split())),
        ("WARC-Payload-Digest", warc_digest(digest)),
        ("X-Page-Id", "" if page is None else str(page)),
        ("X-Payload-Bytes", str(len(payload))),
    ]
    if refers is not None:
        headers += [
            ("WARC-Profile", REVISIT_PROFILE),
            ("WARC-Refers-To", record_id(refers)),
            ("X-Refers-To-Page", str(refers)),
        ]
        payload = b""
    return format_record(headers, payload)


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size, part, n = [], 0, TaskContext.get().partitionId(), 0
    as_row = lambda x: pa.RecordBatch.from_arrays([pa.array([x], pa.binary())], ["archive"])
    for batch in batches:
        for page, url, payload, digest, refers in zip(*batch.columns, strict=True):
            body = (payload.as_py() or "").encode()
            n += 1
            held.append(_page_record(page.as_py(), url.as_py(), body, digest.as_py(), refers.as_py(), f"{part}-{n}"))
            size += len(held[-1])
            if size >= ARCHIVE_BYTES:
                yield as_row(write_archive(held))
                held, size = [], 0
    if held:
        yield as_row(write_archive(held))


_READ = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = [f.split()[0] for f in _READ.split(", ")]
        for batch in batches:
            for cell in batch.column(0):
                rows = []
                for h, block in read_archive(cell.as_py()):
                    number = lambda k: int(h[k]) if h.get(k) else None  # noqa: B023, E731
                    said = h["warc-payload-digest"].removeprefix("sha1:")
                    kind = h["warc-type"]
                    digest = hashlib.sha1(block).hexdigest() if kind == "response" else base64.b32decode(said).hex()
                    size = len(block) if kind == "response" else number("x-payload-bytes")
                    rows.append((number("x-page-id"), h["warc-target-uri"], block if with_payload else None, size, digest, kind, number("x-refers-to-page")))
                cols = list(zip(*rows, strict=True)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return run


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A table of archives (column ``archive``), in the shared folder."""
    ship(pages.sparkSession)
    body = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), body.alias("body"), F.sha1(body).alias("sha1")
    )
    large = F.octet_length("body") >= REVISIT_BYTES
    first = rows.filter(large).groupBy("sha1").agg(F.max("id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    # settled, so that the join is a stage of its own whose partitions Spark may split: a third of all pages may be one payload
    scratch: list[DataFrame] = []
    first = settle(first.select("sha1", "first"), "warc-first", scratch)
    told = rows.join(first, "sha1", "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    archives = told.select("id", "url", "body", "sha1", refers.alias("refers")).mapInArrow(_write, "archive binary")
    held = settle(archives, "warc-archives")
    discard(scratch)
    return held


def read(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of a table of archives."""
    ship(archives.sparkSession)
    return archives.select("archive").mapInArrow(_read(with_payload), _READ)


def digest(pages: DataFrame) -> DataFrame:
    """The contract's columns, after a round trip through archives."""
    return read(write(pages), with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


#: The same result in DuckDB's SQL.
SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS d, strlen(coalesce(html, '')) AS n FROM pages
), f AS (SELECT d, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY d HAVING count(*) > 1)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN NULL ELSE first END AS refers_to
FROM p LEFT JOIN f USING (d)
"""
