import random
import zlib

import numpy as np

import corpus_pipeline
from gradus.llm.queries import QUERIES, SQL
from gradus.llm.tokens import library, public_path

SMALL = "/root/testdata/sf0.001"


def test_every_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES if n != "pipeline")
    assert numbers == list(range(1, 14)) and set(SQL) <= set(QUERIES)


def test_masks():
    assert corpus_pipeline.masked("abcdef", [{"start": 0, "end": 2}, {"start": 1, "end": 3}, {"start": 4, "end": 5}]) == "[secret]d[secret]f"
    assert corpus_pipeline.masked(None, []) is None and corpus_pipeline.masked("", []) == ""


def test_stages_keep_the_columns(llm, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(llm, docs, SMALL)
            assert out.columns == docs.columns and out.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](llm, docs, SMALL).count() >= docs.count()


def pieces(text, size=2048):
    """(start, length, crc32) of a document's pieces by the library: a shorter first one, then whole ones."""
    ids = [*library(public_path("byte_bpe_50k.json")).encode(text or "", add_special_tokens=False).ids, 0]
    first = len(ids) % size or size
    cuts = [0, *range(first, len(ids) + 1, size)] if len(ids) > size else [0, len(ids)]
    return [(a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for a, b in zip(cuts, cuts[1:])]


def test_planted_rows_through_the_whole_pipeline(llm, tmp_path):
    """run() against plain Python: what is planted goes or is masked, everything else is packed as the library has it."""
    chance = random.Random(5)
    vocabulary = ["".join(chance.choice("abcdefghilmnoprstu") for _ in range(chance.randint(3, 9))) for _ in range(500)]
    prose = lambda n: " ".join(chance.choices(vocabulary, k=n)) + "."
    docs = {k: prose(chance.randint(40, 80)) for k in range(600)}
    toxic = {k for k in docs if k % 6 == 0}
    for k in toxic:
        docs[k] = f"{prose(20)} you wretchkin {prose(20)}"
    labels = [(k, 1, int(k in toxic)) for k in docs if k % 3 == 0 or k % 2]
    long = prose(2500)
    docs |= {1000 + k: docs[1] for k in range(6)}  # exact copies
    near = long.split()
    near[700] = "another"
    docs |= {1100: long, 1101: " ".join(near), 1102: long + " One more sentence here."}
    item = prose(14)
    docs |= {1200: f"{prose(30)} {item.upper()} {prose(30)}", 1201: f"{prose(30)} {' '.join(item.split()[:6])} {prose(30)}"}
    docs |= {1300: f"{prose(10)} password = hunter2hunter2 {prose(10)}", 1301: None, 1302: ""}
    llm.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    llm.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    llm.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = corpus_pipeline.run(llm, str(tmp_path)).collect()
    made: dict = {}
    for r in rows:
        made.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    groups = [{1, *range(1000, 1006)}, {1100, 1101, 1102}]
    assert all(len(g & made.keys()) == 1 for g in groups)
    empty = {1301, 1302}
    gone = toxic | {1200} | set().union(*groups) | empty
    assert made.keys() - set().union(*groups) - empty == docs.keys() - gone
    text = docs | {1300: docs[1300].replace("password = hunter2hunter2", "[secret]")}
    for k, own in made.items():
        whole = [(n, *p) for n, p in enumerate(pieces(text[k]))]
        if k == 1300:  # the mask covers what the operator finds, at least the secret itself
            assert sum(p[2] for p in own) < sum(p[1] for p in pieces(docs[k]))
        else:
            assert sorted(own) == whole
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in by.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))] and sum(n for _, n in held) <= 2048
    assert len(by) <= -(-sum(r.length for r in rows) // 2048) + 1
