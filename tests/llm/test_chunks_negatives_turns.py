import hashlib
import random
import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.llm import hard_negatives, turns
from gradus.llm.chunk_bpe import ChunkCoder, content_cuts, digests, encode_and_decode
from gradus.llm.tokens import library, public_path

PATH = public_path("byte_bpe_50k.json")
PARTS = ["a", "é", "日", "本", " ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "<|endoftext|>", "<|", "endoftext", "|>", "23", ".", "…", "　", "x" * 20, "the ", "😀", "\r\n"]


def test_chunks_are_cut_by_content():
    raw = "".join(random.Random(2).choices(PARTS, k=3000)).encode()
    cuts = content_cuts(raw, 32, 300, 5)
    assert cuts[0] == 0 and cuts[-1] == len(raw) and all(0 < b - a <= 300 for a, b in zip(cuts, cuts[1:]))
    assert all(c == len(raw) or raw[c] & 0xC0 != 0x80 for c in cuts)
    moved = content_cuts("some words before. ".encode() + raw, 32, 300, 5)
    assert len({c - 19 for c in moved} & set(cuts)) > 0.9 * len(cuts)
    assert content_cuts(b"", 32, 300, 5) == [0, 0]


@pytest.mark.parametrize("least, most, bits, store", [(1, 20, 1, 1000), (4, 50, 3, 1 << 20), (16, 200, 5, 1 << 20), (256, 8192, 10, 1 << 25)])
def test_joins_are_repaired(least, most, bits, store):
    chance = random.Random(least)
    whole = library(PATH)
    for trial in range(12):
        texts = ["".join(chance.choice(PARTS[: chance.choice([6, 24])]) for _ in range(chance.choice([0, 1, 50, 1500]))) for _ in range(5)]
        texts += ["x" * 3000, " " * 2000 + "a", "<|endoftext|>" * 100, "'" * 500] if trial == 0 else []
        coder = ChunkCoder(PATH, least, most, bits, store)
        for text, ids in zip(texts, coder.encode([t.encode() for t in texts])):
            assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids
            assert coder.decode(ids) == text == whole.decode(ids.tolist(), skip_special_tokens=False)


def test_shared_chunks_are_encoded_once():
    chance = random.Random(4)
    passage = " ".join("".join(chance.choice("etaoinshr") for _ in range(6)) for _ in range(3000))
    coder = ChunkCoder(PATH)
    coder.encode([passage.encode()])
    before = coder.encoded
    coder.encode([f"Some other start {k}. {passage}".encode() for k in range(20)])
    assert coder.encoded - before < 20 * 5 < 20 * before / 4


def test_a_word_without_end_takes_linear_work():
    text = "日本語" * 100_000
    coder = ChunkCoder(PATH)
    assert coder.encode([text.encode()])[0].tolist() == library(PATH).encode(text, add_special_tokens=False).ids
    assert coder.encoded < 2000


def test_encode_and_decode(odd_docs, no_docs):
    whole = library(PATH)
    coded = encode_and_decode(odd_docs.withColumn("ids", F.lit(1)), PATH, keep=["doc_id", "source", "ids"])
    assert coded.columns == ["doc_id", "source", "ids", "decoded"]
    for row, own in zip(coded.collect(), odd_docs.collect()):
        ids = whole.encode(own.text or "", add_special_tokens=False).ids
        assert np.frombuffer(row.ids, "<u4").tolist() == ids and row.decoded == (own.text or "")
    for row, own in zip(digests(coded).collect(), odd_docs.collect()):
        ids = whole.encode(own.text or "", add_special_tokens=False).ids
        assert (row.doc_id, row.n_tokens) == (own.doc_id, len(ids))
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((own.text or "").encode()).hexdigest()
    assert digests(encode_and_decode(no_docs, PATH)).count() == 0


def test_fields_hold_whole_scores():
    chance = np.random.default_rng(3)
    for high in (1, 200, 1 << 20, 1 << 40, 1 << 90):
        points = np.array([[int(v * high) for v in row] for row in chance.uniform(-1, 1, (40, 7))], object if high > 1 << 62 else np.int64)
        anchors = [[int(v * high) for v in row] for row in chance.uniform(-1, 1, (5, 7))]
        packed = hard_negatives.Packed.pack(points, 2 * high + 2)
        for anchor in anchors:
            want = [sum(int(a) * int(c) for a, c in zip(anchor, row)) for row in points]
            got = packed.scores(anchor, max(0, -min(anchor)))
            assert got.tolist() == [max(-hard_negatives.LONG, min(hard_negatives.LONG, w)) for w in want]


def mined(rows, anchors, positives=5, negatives=10, scale=256):
    """Brute force over (id, label, vector), of rows with one id the least."""
    use = {}
    for i, label, v in sorted((r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[2])), key=lambda r: (r[0], r[1], r[2])):
        use.setdefault(i, (label, [int(x * scale // 1) if abs(x) < 1e15 else int(x) * scale for x in v]))
    out = []
    long = hard_negatives.LONG
    dot = lambda a, b: max(-long, min(long, sum(x * y for x, y in zip(a, b))))
    for a in sorted(i for i in use if i in anchors):
        label, v = use[a]
        others = [(-dot(v, w), i, m) for i, (m, w) in use.items() if i != a and len(w) == len(v)]
        for p, i, _ in sorted(o for o in others if o[2] == label)[:positives]:
            band = sorted(o for o in others if o[2] != label and 30 * -p <= 100 * -o[0] <= 90 * -p)[:negatives]
            out += [(a, i, k, o[1], -p, -o[0]) for k, o in enumerate(band, 1)]
    return sorted(out)


@pytest.mark.parametrize("block, some", [(4096, 256), (7, 3)])
def test_hard_negatives(llm, monkeypatch, block, some):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "ANCHORS", some)
    monkeypatch.setattr(hard_negatives, "MEETING", 2)
    chance = np.random.default_rng(block)
    rows = [(k, int(chance.integers(0, 3)), [float(np.float32(x)) for x in chance.normal(0, 0.3, 6)]) for k in range(150)]
    rows += [(k, 1, [0.5, 0.25, 0.0, 0.0, 0.5, 0.0]) for k in range(200, 230)]  # ties
    rows += [(200, 1, [0.5, 0.25, 0.0, 0.0, 0.5, 0.0]), (201, 0, [0.1] * 6), (None, 1, [0.1] * 6), (300, None, [0.1] * 6), (301, 1, None)]
    rows += [(302, 1, [0.1, None, 0.1, 0.1, 0.1, 0.1]), (303, 1, [float("nan")] * 6), (304, 2, [float("inf")] * 6), (305, 1, [0.5, 0.5]), (310, 2, [0.4, 0.4]), (306, 1, [1.0, 0.5]), (307, 0, []), (320, 0, []), (321, 2, [])]
    table = llm.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id long, label int, embedding array<float>, score string, rank double")
    got = hard_negatives.hard_negatives(table, F.col("vec_id") % 10 == 0, F.col("label"))
    assert sorted(tuple(r) for r in got.collect()) == mined(rows, {k for k in range(0, 400, 10)})
    rows += [(330, 1, [1e30, 0.0, 0.0, 0.0, 0.0, 0.0]), (331, 1, [float(1 << 40)] * 6), (332, 0, [float(1 << 38)] * 6), (340, 1, [1e20, -1e20, 0.0, 0.0, 0.0, 0.0])]
    table = llm.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = hard_negatives.hard_negatives(table, F.col("vec_id") % 10 == 0, F.col("label"))
    assert sorted(tuple(r) for r in got.collect()) == mined(rows, {k for k in range(0, 400, 10)})
    assert hard_negatives.hard_negatives(table.limit(0), F.col("vec_id") % 10 == 0, F.col("label")).count() == 0
    assert hard_negatives.hard_negatives(table, F.lit(None).cast("boolean"), F.col("label")).count() == 0


def cheapest(codes):
    """(cost, audit) by trying everything: least cost, then ASCII-least, over (row, state) forward."""
    best = {0: (0, "")}

    def insertions():
        for _ in range(4):
            for s, (c, a) in list(best.items()):
                to, new = turns.NEXT[s], (c + 5, a + "I")
                if to not in best or new < best[to]:
                    best[to] = new

    insertions()
    for code in codes:
        initial, fault = turns.LETTERS.index(code) % 4, turns.LETTERS.index(code) // 4
        after = {}
        for s, (c, a) in best.items():
            options = [(s, c + 2, "D")]
            if fault < 2:
                legal = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (3, 1): 2, (2, 2): 3}.get((s, initial))
                options += [(legal, c + 5 * fault, "K")] if legal else []
                options.append((turns.NEXT[s], c + 1 + 5 * fault, "R"))
            for to, cost, edit in options:
                if to not in after or (cost, a + edit) < after[to]:
                    after[to] = (cost, a + edit)
        best = after
        insertions()
    return min(best[s] for s in (0, 3) if s in best)


def test_repairs_are_cheapest_and_least():
    for n in range(4):
        for codes in product("abcdefghil", repeat=n):
            assert turns.repaired("".join(codes)) == cheapest(codes)
    chance = random.Random(1)
    for _ in range(300):
        codes = "".join(chance.choice(turns.LETTERS) for _ in range(chance.randint(4, 60)))
        assert turns.repaired(codes) == cheapest(codes)


def table_repaired(rows, hashes):
    """Brute force over (conv_id, turn, role, text), none of them null but turn and conv_id; ties go by hash."""
    space = " \t\n\x0b\x0c\r"
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashes[r[2]]))
        codes, seen, faults = "", set(), []
        for turn, role, text in own:
            last = text.rstrip(space)[-1:]
            fault = 3 if not last else 2 if (role, text) in seen else 1 if last not in ".!?" else 0
            seen.add((role, text))
            faults.append(fault)
            codes += turns.LETTERS[max("sua".find(role[:1]) if role else -1, -1) % 4 + 4 * fault]
        cost, audit = cheapest(codes)
        said, state, at = [], 0, iter(own)
        for edit in audit:
            if edit == "I":
                state = turns.NEXT[state]
                said.append(("", "system", "user", "assistant")[state] + ":")
                continue
            _, role, text = next(at)
            if edit == "K":
                state = {"s": 1, "u": 2, "a": 3}[role[0]]
                said.append(f"{role}:{text}")
            elif edit == "R":
                state = turns.NEXT[state]
                said.append(("", "system", "user", "assistant")[state] + ":" + text)
        known = [r[0] for r in own if r[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        pairs = [(a[1][:1] + b[1][:1]) for a, b in zip(own, own[1:])]
        out[conv] = (gaps, faults.count(3), faults.count(2), faults.count(1), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


@pytest.mark.parametrize("piece", [1, 3, 1024])
def test_conversations(llm, piece):
    chance = random.Random(piece)
    roles, texts = ["system", "user", "assistant", "tool", "", " ", "sage"], ["Yes.", "No", "", " \n", "Really?", "long " * 300, "é!", "x . ", "\x0b"]
    rows = [(1, t, chance.choice(roles[:3]), chance.choice(texts) + str(chance.randint(0, 30)) + chance.choice(["", "."])) for t in range(120)]  # most rows
    rows += [(c, chance.choice([None, *range(9)]), chance.choice(roles), chance.choice(texts)) for c in (2, 3, 4, None) for _ in range(8)]
    rows += [(5, None, "user", "Hello."), (6, 4, "system", "Be kind."), (6, 4, "system", "Be kind.")]
    held = llm.createDataFrame([(*r, 1.0, "k") for r in rows], "conv_id long, turn long, role string, text string, cost double, k string")
    report, said = turns.repair(held, piece=piece)
    want = table_repaired(rows, {r.text: r.h for r in held.select("text", F.xxhash64("text").alias("h")).collect()})
    got = {r.conv_id: tuple(r)[1:] for r in report.collect()}
    assert got == want
    assert said.count() == sum(len([e for e in w[6] if e in "IKR"]) for w in want.values())


def test_damage_and_missing_conversations(llm):
    chance = random.Random(7)
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Said {c} {t}. Yes!") for c in range(60) for t in range(chance.randint(1, 6))]
    rows += [(None, None, None, None), (70, None, "user", None), (71, 1, None, "x.")]
    held = llm.createDataFrame([(*r, 1, "t") for r in rows], "conv_id long, turn long, role string, text string, copy int, name string")
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else text.translate({46: None, 33: None, 63: None}) if kind == 2 else text
        want += [(c, t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    bad = turns.damaged(held)
    key = lambda r: [(x is not None, x or 0) for x in r[:2]] + list(r[2:])
    assert sorted(map(tuple, bad.collect()), key=key) == sorted(want, key=key)
    report = {r.conv_id: tuple(r)[1:] for r in turns.repair(bad, held)[0].collect()}
    hashes = {r.text: r.h for r in bad.select("text", F.xxhash64("text").alias("h")).collect()}
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert report == {r[0]: none for r in rows} | table_repaired(want, hashes)
    report, said = turns.repair(turns.damaged(held.limit(0)))
    assert report.count() == 0 and said.count() == 0


def test_turns_too_far_apart(llm):
    rows = llm.createDataFrame([(1, -(1 << 63), "user", "a."), (1, (1 << 63) - 1, "assistant", "b.")], "conv_id long, turn long, role string, text string")
    row = turns.repair(rows)[0].first()
    assert (row.gaps, row.audit) == (None, "KK")
