"""BPE encoding and decoding by a pair occurrence index.

Each group of rows of a partition yields its distinct new words. Their symbols stand in flat
linked arrays; an index maps the rank of every mergeable pair to all positions where the pair
stands. A heap holds the active ranks. The lowest is taken, the merge is applied at all its
positions from left to right, and only the lists of the pairs that touch a changed position are
updated. One pass merges all words together, so a word's cost is paid once per group, however
often it occurs.

Text rules are those of the vocabulary file: special tokens are cut out of the raw text, the rest
is NFC-normalised and lower-cased a character at a time, split into words, and the words' bytes
start as symbols, the last with the end-of-word suffix. Without a decoder in the file, decoding
joins the tokens with single spaces.

Defined results: null and blank texts encode to nothing and decode to the empty string; rows are
independent of each other, so repeated rows repeat their result and an empty table stays empty;
input columns other than id and text are ignored. Memory: words are cached per Python worker up to
``CACHE`` entries, rows are worked on in groups of about ``GROUP_CHARS`` characters.
"""

from __future__ import annotations

import functools
import gc
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.runtime import ship

CACHE, GROUP_CHARS = 300_000, 4_000_000
_UNICODE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACES = regex.compile(f"[{_UNICODE_SPACE}]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")  # white space for str.split, not for the vocabulary's pattern


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, spare = [""] * 256, 256
    for b in range(256):
        if b in shown:
            table[b] = chr(b)
        else:
            table[b], spare = chr(spare), spare + 1
    return table


class Vocabulary:
    """A byte-level BPE vocabulary with word ends, read from a tokenizer JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: s for s, i in [*self.ids.items(), *self.special.items()]}
        end = model["end_of_word_suffix"] or ""
        inner = byte_symbols()
        self.first = [self.ids[c] for c in inner]
        self.last = [self.ids[c + end] for c in inner]
        self.rules: list[tuple[int, int, int]] = []
        self.rank: dict[tuple[int, int], int] = {}
        for merge in model["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pair = (self.ids[a], self.ids[b])
            self.rank.setdefault(pair, len(self.rules))
            self.rules.append((*pair, self.ids[a + b]))
        self.starts = np.array(self.first + self.last)
        self.start_ranks = np.array([[self.rank.get((a, b), -1) for b in self.starts.tolist()] for a in self.first + self.last])
        self.raw = {i: i.to_bytes(4, "little") for i in self.names}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")

    def merge(self, words: Iterable[str]) -> list[list[int]]:
        """The ids of each word, all words merged together over one pair occurrence index."""
        raws = [word.encode() for word in words]
        if not raws:
            return []
        sizes = np.array([len(raw) for raw in raws])
        ends = sizes.cumsum()
        codes = np.frombuffer(b"".join(raws), np.uint8).astype(np.int64)
        codes[ends - 1] += 256  # the last byte of a word
        symbol: list[int] = self.starts[codes].tolist()
        after, before = np.arange(1, len(codes) + 1), np.arange(-1, len(codes) - 1)
        after[ends - 1] = before[ends - sizes] = -1
        ranks = self.start_ranks[codes[:-1], codes[1:]]
        ranks[ends[:-1] - 1] = -1  # pairs across words
        found = (ranks >= 0).nonzero()[0]
        found = found[ranks[found].argsort(kind="stable")]
        kinds, cuts = np.unique(ranks[found], return_index=True)
        rank, after, before = self.rank, after.tolist(), before.tolist()
        where = {r: places.tolist() for r, places in zip(kinds.tolist(), np.split(found, cuts[1:]), strict=False)}
        active = list(where)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            left, right, made = self.rules[r]
            for i in sorted(where.pop(r)):
                j = after[i]
                if symbol[i] != left or j < 0 or symbol[j] != right:
                    continue  # an earlier merge took one of the two
                k, h = after[j], before[i]
                symbol[i], symbol[j], after[i] = made, -1, k
                if k >= 0:
                    before[k] = i
                    new = rank.get((made, symbol[k]))
                    if new is not None:
                        if new not in where:
                            where[new] = []
                            heapq.heappush(active, new)
                        where[new].append(i)
                if h >= 0:
                    new = rank.get((symbol[h], made))
                    if new is not None:
                        if new not in where:
                            where[new] = []
                            heapq.heappush(active, new)
                        where[new].append(h)
        left_over = np.array(symbol)
        stay = left_over >= 0
        ids, upto = left_over[stay].tolist(), stay.cumsum()[ends - 1].tolist()
        return [ids[a:b] for a, b in zip([0, *upto], upto, strict=False)]


class Encoder:
    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.known: dict[str, tuple[int, bytes, str]] = {}  # chunk between white space -> its tokens
        self.merged: dict[str, list[int]] = {}

    def _entry(self, ids: list[int]) -> tuple[int, bytes, str]:
        names, raw = self.vocabulary.names, self.vocabulary.raw
        return len(ids), b"".join([raw[i] for i in ids]), " ".join([names[i] for i in ids])

    def _chunks(self, text: str) -> list[str]:
        return [c for c in _SPACES.split(text) if c] if _SEPARATORS.search(text) else text.split()

    def _learn(self, chunks: set[str]) -> None:
        split: dict[str, list[str]] = {}
        for chunk in chunks:
            plain = unicodedata.normalize("NFC", chunk)
            plain = "".join([c.lower() for c in plain]) if "Σ" in plain else plain.lower()
            split[chunk] = self.vocabulary.words(plain)
        new = list({w for words in split.values() for w in words if w not in self.merged})
        self.merged.update(zip(new, self.vocabulary.merge(new), strict=True))
        for chunk, words in split.items():
            self.known[chunk] = self._entry([i for w in words for i in self.merged[w]])

    def encode(self, texts: list[str]) -> list[tuple[int, bytes, str]]:
        """(number of tokens, ids as little-endian u32, decoded text) of each text."""
        collects = gc.isenabled()
        gc.disable()  # the many small lists and tuples hold no cycles
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[tuple[int, bytes, str]]:
        if len(self.known) > CACHE or len(self.merged) > CACHE:
            self.known.clear()
            self.merged.clear()
        special, rows = self.vocabulary.special, []
        for text in texts:
            if "<|" in text and self.vocabulary.cut.search(text):
                parts = self.vocabulary.cut.split(text)
                rows.append([c for p in parts for c in ([p] if p in special else self._chunks(p))])
                for p in parts:
                    if p in special:
                        self.known[p] = self._entry([special[p]])
            else:
                rows.append(self._chunks(text))
        self._learn({c for row in rows for c in row if c not in self.known})
        out = []
        for row in rows:
            found = [self.known[c] for c in row]
            out.append((sum([x[0] for x in found]), b"".join([x[1] for x in found]), " ".join([x[2] for x in found])))
        return out

    def decode(self, ids: bytes) -> str:
        return " ".join([self.vocabulary.names[i] for i in np.frombuffer(ids, "<u4").tolist()])


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker; tasks that a worker runs later find its words merged."""
    return Encoder(path)


def grouped(texts: pa.Array, most: int = GROUP_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Runs of rows of about ``most`` characters: (first row, texts); null is empty."""
    first, held, size = 0, [], 0
    for i, cell in enumerate(texts):
        text = cell.as_py() or ""
        held.append(text)
        size += len(text)
        if size >= most:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids, decoded)`` per row: ids as little-endian u32 bytes, decoded from them."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            for first, texts in grouped(batch.column(1)):
                counts, ids, decoded = zip(*coder.encode(texts), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(texts)),
                        pa.array(counts, pa.int64()),
                        pa.array(ids, pa.binary()),
                        pa.array(decoded, pa.string()),
                    ],
                    ["id", "n_tokens", "ids", "decoded"],
                )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, "id long, n_tokens long, ids binary, decoded string"
    )


def digest(docs: DataFrame, path: str) -> DataFrame:
    """The contract's columns: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encode(docs, path).select(
        F.col("id").alias("doc_id"),
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
