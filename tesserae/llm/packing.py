"""Packing token streams into fixed windows: concatenate and cut.

Pass one encodes every document once, writes its ids with the running token total inside its
partition to a table in the shared folder. Prefix sums over the partition totals (one row a
partition) give each partition's global offset. Pass two cuts every document at the multiples of
the window; a document that crosses a window boundary leaves one piece on each side of it, also
where the window spans two partitions. Nothing moves between tasks but the partition totals, so no
key can be hot; every window but the last is full.

Encoding keeps the ids of chunks (a space and what follows it up to the next space) in a bounded
cache per Python worker. A chunk's ids stand for themselves because the split pattern never joins
across a space that stands before a character other than white space; a text with any other space
is encoded whole.

Defined results: a null text is empty and still gives its closing id; a text of any length is encoded
whole and cut at every window; repeated rows are packed each by itself; there are no ties, since
documents follow each other in the order of the table's partitions; an empty table gives no pieces; input columns other than id and text are ignored.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tesserae.llm.bpe import byte_symbols, grouped
from tesserae.runtime import settle, ship

CACHE = 300_000
_ODD_SPACE = re.compile(r" (?=\s|$)")
#: Fixed value: the split pattern of byte-level vocabularies of this kind.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteEncoder:
    """Ids of the tokenizer in a JSON file, as little-endian u16 (u32 for large vocabularies) bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        back = {c: b for b, c in enumerate(byte_symbols())}
        ranks = {bytes([back[c] for c in s]): i for s, i in spec["model"]["vocab"].items()}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.coder = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        top = max([*ranks.values(), *(t["id"] for t in spec["added_tokens"])])
        self.kind = "<u2" if top < 1 << 16 else "<u4"
        self.known: dict[str, bytes] = {}

    def _raw(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self._raw(self.whole.encode(text, add_special_tokens=False).ids)
        plain = self.coder.encode_ordinary
        if _ODD_SPACE.search(text):
            return self._raw(plain(text))
        first, *rest = text.split(" ")
        known = self.known
        try:
            return self._raw(plain(first)) + b"".join([known[c] for c in rest])
        except KeyError:
            if len(known) > CACHE:
                known.clear()
            for c in rest:
                if c not in known:
                    known[c] = self._raw(plain(" " + c))
            return self._raw(plain(first)) + b"".join([known[c] for c in rest])


@functools.lru_cache(maxsize=2)
def byte_encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


def tokens(docs: DataFrame, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(part, ahead, id, n, ids)`` per row: ids with ``end_id`` appended, and how many ids the
    rows before it in the same partition have."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, ahead = byte_encoder(path), TaskContext.get().partitionId(), 0
        end, width = np.array([end_id], coder.kind).tobytes(), np.dtype(coder.kind).itemsize
        for batch in batches:
            for first, texts in grouped(batch.column(1)):
                ids = [coder.encode(t) + end for t in texts]
                sizes = np.array([len(x) // width for x in ids], np.int64)
                totals = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(ids), part, np.int32)),
                        pa.array(ahead + totals - sizes),
                        batch.column(0).slice(first, len(ids)),
                        pa.array(sizes),
                        pa.array(ids, pa.binary()),
                    ],
                    ["part", "ahead", "id", "n", "ids"],
                )
                ahead += int(totals[-1])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, "part int, ahead long, id long, n long, ids binary"
    )


_PIECES = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(
    docs: DataFrame,
    path: str,
    window: int = 1024,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: its document, place there, place in its sequence, checksum and (unless
    ``with_ids`` is false) its ids as little-endian u32 bytes."""
    held = settle(tokens(docs, path, end_id, id_col, text_col), "packing-tokens")
    totals = held.groupBy("part").agg(F.max(F.col("ahead") + F.col("n")).alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    # one row a partition of the scan: a number and a sum, whatever the partitions hold
    placed = held.join(F.broadcast(bases), "part").select("id", (F.col("base") + F.col("ahead")).alias("at"), "n", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, at, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4").tobytes()
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, window)
                    length = min(window - offset, n - start)
                    piece = ids[4 * start : 4 * (start + length)]
                    row = (doc, start, length, zlib.crc32(piece), n, sequence, offset)
                    out.append((*row, piece) if with_ids else row)
                    start += length
            kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids
            cols = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                [f.split()[0] for f in _PIECES.split(", ")] + ["ids"] * with_ids,
            )

    return placed.mapInArrow(cut, _PIECES + ", ids binary" * with_ids)


def digest(docs: DataFrame, path: str) -> DataFrame:
    """The contract's columns, one row per piece."""
    return pack(docs, path, with_ids=False).withColumnRenamed("id", "doc_id")
