"""Benchmark passages in documents: a prefix-filtered join of word shingles, verified over item-sized windows.

A window of an item is ``window`` consecutive words; a document that holds it holds each of its shingles (word
pairs; the word itself in a window of one). So one necessary shingle per window is enough to find it: the rarest
by its count over all documents. A shingle met in a document fixes where the window would have to lie; the
window must fit into the document there (length and position), and then every word is compared.

The index of a block of items is broadcast: blocks are made so that their texts stay below ``BLOCK_BYTES``, one
text per set of equal items, and each block makes its own pass; one block's index is held at a time. Words are compared by 64-bit keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, map_rows, named, written
from .words import LETTERS, MIX, Packed, mixed

BLOCK_BYTES = 2 << 20


class Windows(NamedTuple):
    """Distinct windows of a block of items, and the shingles to find them by."""

    words: np.ndarray  # window x word; 0 beyond its length
    length: np.ndarray
    items: list[list[int]]  # per window the positions in ``ids``
    ids: list[list[str]]  # per set of equal items their ids as text
    shingle: np.ndarray  # sorted distinct shingles of all windows
    prefix: np.ndarray  # window x shingle: its number, -1 beyond its length


class Index(NamedTuple):
    """Windows by their rarest shingle."""

    windows: Windows
    key: np.ndarray  # sorted necessary shingles
    first: np.ndarray  # of each, where its windows begin in the next two
    window: np.ndarray
    place: np.ndarray  # of the shingle within the window


def pairs(keys: np.ndarray) -> np.ndarray:
    """Shingles of two following words."""
    return mixed(keys[:-1] * MIX + keys[1:])


def windows_of(texts: list[str], ids: list[list[str]], window: int) -> Windows:
    packed = Packed(texts, lower=True)
    start, end = packed.runs(LETTERS)
    keys = packed.keys(start, end)
    found: dict[bytes, list[int]] = {}
    low = 0
    for item, n in enumerate(packed.counts(start).tolist()):
        own = keys[low : low + n]
        low += n
        for at in range(max(1, n - window + 1) if n else 0):
            held = found.setdefault(own[at : at + window].tobytes(), [])
            if not held or held[-1] != item:
                held.append(item)
    words = np.zeros((len(found), window), np.uint64)
    for row, raw in enumerate(found):
        words[row, : len(raw) // 8] = np.frombuffer(raw, np.uint64)
    length = np.fromiter((len(raw) // 8 for raw in found), np.int64, len(found))
    shingles = np.zeros((len(found), max(1, window - 1)), np.uint64)
    if window > 1:
        shingles[:] = mixed(words[:, :-1] * MIX + words[:, 1:])
        shingles[np.arange(window - 1) >= (length - 1)[:, None]] = 0
    one = length == 1
    shingles[one, 0] = words[one, 0]
    distinct = np.unique(shingles[shingles != 0])
    prefix = np.where(shingles != 0, np.searchsorted(distinct, shingles), -1)
    return Windows(words, length, list(found.values()), ids, distinct, prefix)


def rarest(windows: Windows, counts: np.ndarray) -> Index:
    """Each window filed under its rarest shingle (ties: the smaller shingle, then the earlier place)."""
    cost = np.where(windows.prefix >= 0, counts[windows.prefix], np.iinfo(np.int64).max)
    least = cost.min(axis=1, initial=np.iinfo(np.int64).max)
    number = np.where(cost == least[:, None], windows.prefix, len(windows.shingle)).min(axis=1, initial=len(windows.shingle))
    place = (windows.prefix == number[:, None]).argmax(axis=1) if len(number) else number
    by = np.argsort(number, kind="stable")
    key, first = np.unique(number[by], return_index=True)
    return Index(windows, windows.shingle[key], np.append(first, len(by)), by, place[by])


def _sorted_find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``keys`` of those found, and their ranks. Most are screened out by a few of their bits."""
    if not len(sorted_keys) or not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    screen = np.zeros(1 << 20, bool)
    screen[sorted_keys >> np.uint64(44)] = True
    near = np.flatnonzero(screen[keys >> np.uint64(44)])
    rank = np.minimum(np.searchsorted(sorted_keys, keys[near]), len(sorted_keys) - 1)
    hit = sorted_keys[rank] == keys[near]
    return near[hit], rank[hit]


def _document_words(texts: list) -> tuple[np.ndarray, np.ndarray]:
    packed = Packed(texts, lower=True)
    start, end = packed.runs(LETTERS)
    return packed.keys(start, end), packed.counts(start)


def shingle_counts(docs: DataFrame, text: str, windows) -> DataFrame:
    """How often each shingle of the windows occurs in all documents: (number, count), added up per task first."""

    def work(batches):
        shingle = windows.value.shingle
        total = np.zeros(len(shingle), np.int64)
        single = bool((windows.value.length == 1).any())
        for (texts,) in batches:
            keys, _ = _document_words(texts.to_pylist())
            for own in (pairs(keys), keys) if single else (pairs(keys),):
                total += np.bincount(_sorted_find(shingle, own)[1], minlength=len(total))
        some = np.flatnonzero(total)
        yield {"number": some, "n": total[some]}

    made = map_rows(docs, [text], "number long, n long", work)
    return made.groupBy("number").agg(F.sum("n").alias("n"))


def _matches(index: Index, keys: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified occurrences: where each begins among all words of the batch, and its window."""
    windows = index.windows
    single = bool((windows.length == 1).any())
    at, rank = _sorted_find(index.key, pairs(keys))
    if single:
        more, ranks = _sorted_find(index.key, keys)
        at, rank = np.concatenate([at, more]), np.concatenate([rank, ranks])
    size = index.first[rank + 1] - index.first[rank]
    entry = np.repeat(index.first[rank] - np.cumsum(size) + size, size) + np.arange(size.sum())
    window = index.window[entry]
    begin = np.repeat(at, size) - index.place[entry]
    # Position and length: the window must lie within the document that holds the shingle.
    doc = np.searchsorted(ends, np.repeat(at, size), side="right")
    low = np.where(doc > 0, ends[np.maximum(doc, 1) - 1], 0) if len(ends) else doc
    fits = (begin >= low) & (begin + windows.length[window] <= ends[np.minimum(doc, len(ends) - 1)]) if len(ends) else doc > 0
    window, begin = window[fits], begin[fits]
    for k in range(windows.words.shape[1]):
        part = k < windows.length[window]
        same = ~part | (keys[np.minimum(begin + k, len(keys) - 1)] == windows.words[window, k])
        window, begin = window[same], begin[same]
    return begin, window


def _hits(docs: DataFrame, keep: Sequence[str], text: str, index) -> DataFrame:
    def work(texts):
        own: Index = index.value
        keys, counts = _document_words(texts.to_pylist())
        ends = np.cumsum(counts)
        spans: list[list] = [[] for _ in counts]
        items: list[list[str]] = [[] for _ in counts]
        if len(keys):
            begin, window = _matches(own, keys, ends)
            order = np.argsort(begin, kind="stable")
            begin, window = begin[order], window[order]
            doc = np.searchsorted(ends, begin, side="right")
            for k in np.unique(doc).tolist():
                a, b = np.searchsorted(doc, [k, k + 1])
                base = int(ends[k] - counts[k])
                reach = own.windows.length[window[a:b]]
                merged: list = []
                for x, n in zip((begin[a:b] - base).tolist(), reach.tolist()):
                    if merged and x <= merged[-1]["b"]:
                        merged[-1]["b"] = max(merged[-1]["b"], x + n)
                    else:
                        merged.append({"a": x, "b": x + n})
                spans[k] = merged
                sets = {i for w in set(window[a:b].tolist()) for i in own.windows.items[w]}
                items[k] = [i for s in sorted(sets) for i in own.windows.ids[s]]
        return counts, spans, items

    return map_columns(docs, keep, [text], "n_words long, spans array<struct<a long, b long>>, items array<string>", work)


def _covered(spans):
    """Words covered by spans that may overlap."""
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(s["b"] - F.greatest(acc["to"], s["a"]), F.lit(0))).cast("long").alias("n"),
        F.greatest(acc["to"], s["b"]).cast("long").alias("to"),
    )
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    return F.aggregate(F.array_sort(spans), start, step)["n"]


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    keep: Sequence[str] = ("doc_id",),
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``keep``, n_words, n_hit, n_items, items_sha256, contaminated, and the hit ``spans`` and ``items``.

    One row per document row. Null, empty and wordless texts have no words and no hits; items without words have
    no windows; an item of fewer words than ``window`` is one window; items without id are left out of the list.
    Equal items each count. Without items nothing is hit. One block of items needs no shuffle of documents.
    """
    spark = docs.sparkSession
    made = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "items")
    keep = [c for c in dict.fromkeys(keep) if c not in made]
    known = items.select(named(item_id).cast("string").alias("id"), named(item_text).alias("t")).where("t IS NOT NULL")
    size = known.select("t").distinct().agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    if blocks > 1:
        docs = written(docs.select(*[named(c) for c in dict.fromkeys([*keep, text])], F.monotonically_increasing_id().alias("__row")), "decontamination")
    parts = []
    for block in range(blocks):
        own = known.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == block)
        rows = own.groupBy("t").agg(F.array_sort(F.collect_list("id")).alias("ids")).collect()
        rows.sort(key=lambda r: r.t)
        windows = windows_of([r.t for r in rows], [r.ids for r in rows], window)
        sent = spark.sparkContext.broadcast(windows)
        counts = np.zeros(len(windows.shingle), np.int64)
        if len(counts):
            for r in shingle_counts(docs, text, sent).collect():  # a row per shingle of this block at most
                counts[r.number] = r.n
        index = spark.sparkContext.broadcast(rarest(windows, counts))
        if blocks == 1:
            parts.append(_hits(docs, keep, text, index))
        else:  # a block's hits are written, and what was sent for it is given up before the next one
            parts.append(written(_hits(docs, ["__row"], text, index), "decontamination-block"))
            index.destroy()
            sent.destroy()
            del windows, counts, rows
    if blocks == 1:
        found = parts[0]
    else:
        every = reduce(DataFrame.unionByName, parts)
        some = every.groupBy("__row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
        found = docs.select(*[named(c) for c in keep], "__row").join(some, "__row").drop("__row")
    return found.select(
        *[named(c) for c in keep],
        "n_words",
        _covered(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        "spans",
        "items",
    )
