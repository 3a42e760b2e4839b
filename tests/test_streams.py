"""Upserts over many batches: versions, resumption, conflicts and eviction."""

import json
import random
from pathlib import Path

import pytest

from gradus.session import new_folder
from gradus.sources.commit import names
from gradus.streaming import incremental as X

SCHEMA = "k long, at string, v long"


def latest(rows):
    out = {}
    for k in {r["k"] for r in rows}:
        own = [r for r in rows if r["k"] == k]
        newest = max(r["at"] for r in own)
        held = {r["v"] for r in own if r["at"] == newest}
        out[k] = (newest, held)
    return out


def same(found, rows):
    want = latest(rows)
    assert {r.k for r in found} == want.keys()
    for r in found:
        newest, held = want[r.k]
        assert r.at == newest and r.v in held and r.conflict == (len(held) > 1)


def drop(folder, number, rows):
    Path(folder).mkdir(parents=True, exist_ok=True)
    Path(folder, f"f{number:03}.json").write_text("\n".join(json.dumps(r) for r in rows))


def test_fifty_batches_leave_one_version(spark):
    root, chance = new_folder(spark, "upsert"), random.Random(4)
    source = root.replace("file://", "") + "/in"
    rows = []
    for n in range(50):
        own = [{"k": chance.randint(0, 40), "at": f"2024-01-{chance.randint(1, 28):02}", "v": chance.randint(0, 3)} for _ in range(20)]
        rows += own
        drop(source, n, own)
        if n == 33:  # stopped and resumed in between
            X.upsert_latest(spark, source, SCHEMA, root, ["k"], "at", files=1)
            same(X.current(spark, root, ["k"]).collect(), rows)
    X.upsert_latest(spark, source, SCHEMA, root, ["k"], "at", files=1)
    assert X._versions(spark, root) == [39, 49]
    assert len(names(spark, f"{root}/data")) == 2 and all(int(c.split("=")[1]) > 39 for c in names(spark, f"{root}/changes"))
    read = {f.split("/data/")[1].split("/")[0] for f in X.current(spark, root, ["k"]).inputFiles()}
    assert read == {X._version(spark, root, 49)["attempt"]}
    found = X.current(spark, root, ["k"]).collect()
    same(found, rows)
    assert any(r.conflict for r in found) and not all(r.conflict for r in found)
    X.compact(spark, root, ["k"], 49)  # again: nothing to do
    assert X._versions(spark, root) == [39, 49]


def test_old_keys_are_evicted_by_event_time(spark):
    root = new_folder(spark, "evict")
    source = root.replace("file://", "") + "/in"
    drop(source, 0, [{"k": 1, "at": "2024-01-01", "v": 1}, {"k": 2, "at": "2024-03-01", "v": 1}])
    drop(source, 1, [{"k": 3, "at": "2024-03-20", "v": 1}])
    X.upsert_latest(spark, source, SCHEMA, root, ["k"], "at", every=2, horizon="30 days", files=1)
    assert {r.k for r in X.current(spark, root, ["k"]).collect()} == {2, 3}
    with pytest.raises(ValueError):
        X.current(spark, new_folder(spark, "empty"), ["k"])
