import time
import zlib

import numpy as np
import pytest

from gradus.llm import token_files
from gradus.llm.packing import Bins, best_fit, crossed, evolved, pack
from gradus.llm.token_counts import spliced, token_counts
from gradus.llm.token_files import decode_segment, encode_segment, read_block, read_ids, write_ids
from gradus.llm.tokens import Encoder, library, public_path

TEXTS = [
    "", None, " ", "  a b  c ", "a\nb \n c", "a\x1cb \x1c c", "<|endoftext|> foo<|endoftext|>bar", "  \n ", "don't I'LL İs é́x",
    "日本語 テキスト 123 4567", "a \t b", "em  x", "x" * 3000, "é" * 100 + " " + "!" * 90, "foo,\nbar—, x,. é, ×, ÷,y 3.5 a,b\n", "\nx,", "—,a",
]


@pytest.mark.parametrize("name, byte_level", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_ids_are_the_librarys(name, byte_level, monkeypatch):
    path = public_path(name)
    own, whole = Encoder(path, byte_level), library(path)
    want = [whole.encode(t or "", add_special_tokens=False).ids for t in TEXTS]
    for _ in range(2):  # new words, then known ones
        ids, counts = own.batch(TEXTS)
        assert counts.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]
    monkeypatch.setattr("gradus.llm.tokens.KEPT", 3)
    for k, text in enumerate(TEXTS):
        assert own.batch([text])[0].tolist() == want[k]


def test_splicing_resynchronises():
    tokenizer = library(public_path("word_bpe_49k.json"))
    for text in ("un deux trois " * 300, "x" * 900 + " y " + "z" * 700, "a b <|endoftext|> c" * 80, " " * 700 + "x", "é ü " * 200 + "q" * 300):
        for chunk, overlap in ((400, 20), (257, 1)):
            ids, ranges = spliced(text, tokenizer, chunk, overlap)
            assert ids == tokenizer.encode(text, add_special_tokens=False).ids
            assert ranges[0][0] == 0 and ranges[-1][1] == len(text)


def test_splicing_needs_no_white_space():
    """Japanese with wide punctuation: words end at every mark, and work stays near the library's own."""
    chance = np.random.default_rng(2)
    tokenizer = library(public_path("word_bpe_49k.json"))
    parts = ["日本語の文章", "を書く", "、", "。", "テスト", "１２", "！", "éa", "don't", "<|endoftext|>", "が", "か\u3099"]
    for chunk, overlap in ((300, 40), (97, 20), (1000, 1)):
        text = "".join(chance.choice(parts, 4000))
        ids, ranges = spliced(text, tokenizer, chunk, overlap)
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids
        assert len(ranges) > 0.3 * len(text) / (chunk + overlap) and [b for _, b in ranges][:-1] == [a for a, _ in ranges][1:]
    for text in ("".join(chance.choice(parts[:5], 300_000)), "日" * 200_000):
        start = time.process_time()
        want = tokenizer.encode(text, add_special_tokens=False).ids
        own = time.process_time() - start
        start = time.process_time()
        assert spliced(text, tokenizer)[0] == want
        assert time.process_time() - start < 4 * own + 1


def test_token_counts(odd_docs, no_docs):
    path = public_path("word_bpe_49k.json")
    rows = token_counts(odd_docs, path, keep=["doc_id", "source"], limit=100, chunk=2000, overlap=16).collect()
    texts = [r.text for r in odd_docs.collect()]
    whole = library(path)
    want = [len(whole.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert [r.n_tokens for r in rows] == want
    assert [r.n_bytes for r in rows] == [len((t or "").encode()) for t in texts]
    assert [r.over_limit for r in rows] == [n > 100 for n in want]
    assert token_counts(no_docs, path).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5, 1023, 1024, 1025, 5000])
def test_segments_round_trip(n):
    chance = np.random.default_rng(n)
    for high in (1, 300, 49408, 2**32 - 1):
        ids = chance.integers(0, high, n).astype(np.uint32)
        ids[::17] = high
        data = encode_segment(ids)
        assert (decode_segment(data) == ids).all()
        for block in range(-(-n // token_files.BLOCK)):
            assert (read_block(data, block) == ids[block * 1024 : (block + 1) * 1024]).all()


def test_token_files(llm, odd_docs, no_docs, tmp_path):
    path = public_path("word_bpe_49k.json")
    write_ids(odd_docs, str(tmp_path / "ids"), path, False, 1)
    rows = sorted(read_ids(llm, str(tmp_path / "ids"), ids=True).collect(), key=lambda r: r.start)
    whole = library(path)
    have = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in odd_docs.collect())
    assert [-1 if r.doc_id is None else r.doc_id for r in rows] == [k for k, _ in have]
    at = 0
    for row, (_, text) in zip(rows, have):
        ids = [*whole.encode(text, add_special_tokens=False).ids, 1]
        assert (row.start, row.n_tokens, row.ids) == (at, len(ids), ids)
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    write_ids(no_docs, str(tmp_path / "none"), path, False, 1)
    assert read_ids(llm, str(tmp_path / "none")).count() == 0


def test_packing(odd_docs, no_docs):
    path = public_path("byte_bpe_50k.json")
    rows = pack(odd_docs, path, keep=["doc_id", "source", "length"] if "length" in odd_docs.columns else ["doc_id", "source"], size=256, shard=4).collect()
    whole = library(path)
    lengths = sum(len(whole.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in odd_docs.collect())
    assert sum(r.length for r in rows) == lengths
    # Every piece by brute force: places in the document and checksums of its ids.
    want = []
    for d in odd_docs.collect():
        ids = [*whole.encode(d.text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 256 or 256
        cuts = [0, *range(first, len(ids) + 1, 256)] if len(ids) > 256 else [0, len(ids)]
        want += [(-1 if d.doc_id is None else d.doc_id, d.source or "", n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.source or "", r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for held in by.values():
        held.sort(key=lambda r: r.offset)
        assert sum(r.length for r in held) <= 256
        assert [r.offset for r in held] == [sum(x.length for x in held[:k]) for k in range(len(held))]
    assert pack(no_docs, path).count() == 0


def test_crossover_keeps_every_item_once():
    import random

    chance = random.Random(3)
    lengths = [chance.randint(1, 99) for _ in range(300)]
    falling = sorted(range(300), key=lambda i: -lengths[i])
    one, two = best_fit(lengths, falling, 100), best_fit(lengths, list(range(300)), 100)
    child = crossed(one.bins, two.bins, lengths, 100, chance)
    assert sorted(i for b in child.bins for i in b) == list(range(300))
    assert all(sum(lengths[i] for i in b) == 100 - r for b, r in zip(child.bins, child.room))
    best = evolved(lengths, [], 100, 1, 20, 4)[0]
    assert -(-sum(lengths) // 100) <= len(best) <= len(two.bins)
    assert isinstance(child, Bins)
