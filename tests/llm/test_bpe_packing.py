import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tesserae.llm import bpe, packing
from tesserae.llm.queries import tokenizer_file

WORDS, BYTES = tokenizer_file("word_bpe_49k.json"), tokenizer_file("byte_bpe_50k.json")
HARD = [
    "", " ", "  lead", "trail ", "a \n b  c\t d \x0b", "<|endoftext|> x <|startoftext|>y", "don't 's 're  's IT'S", "x" * 3000,
    "ΣΣ σς İ ẞ ǅ", "é 가 　wide thin\x85\xa0", "x\x1cy \x1f z", "\U0001f600\U0001f468‍\U0001f469", "1234567 ३४",
    "aaaaaaaaaa!!!???", "\n\n\n", "a​b",
]


def fuzz(n, seed):
    rng = random.Random(seed)
    letters = [chr(c) for c in [*range(32, 600), *range(0x300, 0x330), 9, 10, 13, 0x85, 0xA0, 0x1C, 0x2009, 0x3000, 0x4E00, 0x1F600]]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("texts", [HARD, fuzz(400, 1)])
def test_words_equal_the_library(texts):
    lib, mine = Tokenizer.from_file(WORDS), bpe.Encoder(WORDS)
    for text, (n, ids, decoded) in zip(texts, mine.encode(texts), strict=True):
        want = lib.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want and n == len(want), text
        assert decoded == lib.decode(want, skip_special_tokens=False) == mine.decode(ids), text


@pytest.mark.parametrize("texts", [HARD, fuzz(400, 2)])
def test_bytes_equal_the_library(texts):
    lib, mine = Tokenizer.from_file(BYTES), packing.ByteEncoder(BYTES)
    for text in texts:
        assert np.frombuffer(mine.encode(text), "<u2").tolist() == lib.encode(text, add_special_tokens=False).ids, text


def test_cache_bound(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 5)
    monkeypatch.setattr(packing, "CACHE", 5)
    texts, e, p = fuzz(30, 3), bpe.Encoder(WORDS), packing.ByteEncoder(BYTES)
    assert [e.encode([t])[0] for t in texts] == bpe.Encoder(WORDS).encode(texts)
    assert [p.encode(t) for t in texts] == [packing.ByteEncoder(BYTES).encode(t) for t in texts]


def test_encode_query(docs, odd):
    lib = Tokenizer.from_file(WORDS)
    got = {r.doc_id: r for r in bpe.digest(docs(odd), WORDS).collect()}
    for i, text in odd:
        ids = lib.encode(text or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digest(docs(odd).filter("doc_id < 0"), WORDS).count() == 0


def test_packing(docs, odd):
    lib = Tokenizer.from_file(BYTES)
    pieces = packing.pack(docs(odd), BYTES).collect()
    total, sequences, seen = 0, {}, {}
    for p in pieces:
        ids = np.frombuffer(bytes(p.ids), "<u4")
        assert len(ids) == p.length and zlib.crc32(ids.tobytes()) == p.ids_crc32
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        seen.setdefault((p.id, p.doc_tokens), []).append((p.start, ids.tolist()))
        total += p.length
    for places in sequences.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
    assert sorted(sequences) == list(range(-(-total // 1024))) and all(sum(n for _, n in sequences[s]) == 1024 for s in sorted(sequences)[:-1])
    for i, text in odd:
        want = [*lib.encode(text or "", add_special_tokens=False).ids, 0]
        parts = sorted(seen[i, len(want)])
        copies = sum(a == (i, text) for a in odd)
        assert [x for k, (_, ids) in enumerate(parts) if k % copies == 0 for x in ids] == want
    assert packing.digest(docs(odd).filter("doc_id < 0"), BYTES).count() == 0


def test_the_index_starts_without_a_step_for_each_byte():
    """The pairs of bytes are ranked by a table; only pairs that a merge makes are looked up one by one."""

    class Counted(dict):
        n = 0

        def get(self, *key):
            Counted.n += 1
            return super().get(*key)

    vocabulary, words = bpe.Vocabulary(WORDS), [f"{a}{b}" for a in "qxzj" for b in range(10)] + ["q" * 3000, "1" * 3000]
    want = vocabulary.merge(words)
    vocabulary.rank = Counted(vocabulary.rank)
    assert vocabulary.merge(words) == want == [vocabulary.merge([w])[0] for w in words] and vocabulary.merge([]) == []
    Counted.n = 0
    vocabulary.merge(words)
    made = sum(len(w) for w in words) - sum(len(ids) for ids in want)
    assert Counted.n <= 2 * made
