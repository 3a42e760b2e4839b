"""Byte-level BPE ids of whole texts from content-defined chunks, repaired at every join, and the texts back from ids.

A rolling hash over the bytes cuts a text where its content says so, so texts that share passages share chunks. A
chunk is encoded the first time a worker meets it; copies in other texts take the ids from the worker's store.

A chunk's own ids are wrong near its ends, where a cut may have split a word, a run of spaces or a special string.
Each join is therefore encoded anew from the last piece that the text before it proves, over a window that reaches
into the next chunk. The join is repaired once window and chunk begin a piece at the same byte: from there on the
splitting pattern sees the same text in both, so all later ids agree. Without such a byte the window is doubled.

What is proven: the pattern matches from left to right and never looks back, and it looks ahead by one contraction at
most. So a piece that begins at a true boundary is true if it ends a margin before the end of what was encoded, the
margin being as long as the longest special string and a contraction.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns
from .tokens import _SIGNS, Encoder, by_chars, library

#: Least and greatest bytes of a chunk; a place is a cut with a chance of 1 / 2^BITS.
LEAST, MOST, BITS = 256, 8192, 10
#: Bytes the rolling hash sees.
SEEN = 16
#: Bytes of chunks and their ids a worker keeps, in two generations.
STORE = 96 << 20
#: Bytes after a join that the first window takes in.
REACH = 64
#: Ids that are turned into bytes at once.
DECODED = 1 << 18

_GEAR = np.random.default_rng(71).integers(0, 1 << 32, 256, dtype=np.uint32)


class Chunk(NamedTuple):
    """Ids, the number of each piece's first id, and the byte at which each piece begins: a piece is a run of words that
    the tokenizer must split off."""

    ids: np.ndarray
    first: np.ndarray
    begin: np.ndarray

    def between(self, low: int, high: int | None) -> np.ndarray:
        """Ids of the pieces that begin in ``low:high``."""
        a = int(np.searchsorted(self.begin, low))
        b = len(self.begin) if high is None else int(np.searchsorted(self.begin, high))
        if a >= b:
            return self.ids[:0]
        return self.ids[int(self.first[a]) : int(self.first[b]) if b < len(self.first) else len(self.ids)]


def content_cuts(raw: bytes, least: int = LEAST, most: int = MOST, bits: int = BITS) -> list[int]:
    """Starts of the chunks of ``raw`` and its length; no cut falls within a character."""
    n = len(raw)
    if n <= least:
        return [0, n]
    data = np.frombuffer(raw, np.uint8)
    rolled = _GEAR[data]
    width = 1
    while width < SEEN:  # the hash of the last 2, 4, 8, 16 bytes
        rolled[width:] += rolled[:-width] << np.uint32(width)
        width *= 2
    begins = (data & 0xC0) != 0x80
    places = np.flatnonzero(((rolled[:-1] >> np.uint32(32 - bits)) == 0) & begins[1:]) + 1
    cuts = [0]
    for place in [*places.tolist(), n]:
        while place - cuts[-1] > most:
            at = cuts[-1] + most
            while not begins[at]:
                at -= 1
            cuts.append(at)
        if place - cuts[-1] >= least and place < n:
            cuts.append(place)
    return [*cuts, n]


class ChunkCoder:
    """Ids of texts by the tokenizer of a byte-level vocabulary file, and texts from ids."""

    def __init__(self, path: str, least: int = LEAST, most: int = MOST, bits: int = BITS, store: int = STORE):
        self.library = library(path)
        self.encoder = Encoder(path, byte_level=True)
        self.sizes = least, most, bits
        self.store = store
        self.young: dict[bytes, Chunk] = {}
        self.old: dict[bytes, Chunk] = {}
        self.kept = 0
        self.encoded = 0
        own = {sign: byte for byte, sign in enumerate(_SIGNS)}
        added = {i: t.content for i, t in self.library.get_added_tokens_decoder().items()}
        words = [b""] * self.library.get_vocab_size()
        for sign, i in self.library.get_vocab().items():
            words[i] = added[i].encode() if i in added else bytes(own[s] for s in sign)
        self.length = np.array([len(w) for w in words], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(words), np.uint8)
        self.margin = max((len(a.encode()) for a in added.values()), default=0) + 8

    def chunks(self, parts: list[bytes]) -> list[Chunk]:
        """Ids of each part by itself; parts in the store are not encoded again."""
        new = [p for p in dict.fromkeys(parts) if p not in self.young and p not in self.old]
        made: dict[bytes, Chunk] = {}
        for low, high in by_chars(new):
            ids, counts, begin, pieces = self.encoder.pieces([p.decode() for p in new[low:high]])
            ends = np.append(0, np.cumsum(counts))
            cuts = np.append(0, np.cumsum(pieces))
            bounds = zip(cuts.tolist(), cuts[1:].tolist(), ends[cuts].tolist(), ends[cuts[1:]].tolist())
            for raw, (a, b, first, last) in zip(new[low:high], bounds):
                made[raw] = Chunk(ids[first:last].copy(), ends[a:b] - first, begin[a:b].copy())
        self.encoded += len(new)
        out = []
        for part in parts:
            chunk = made.get(part) or self.young.get(part) or self.old[part]
            if part not in self.young:  # new, or moved from the old generation
                self.young[part] = chunk
                self.kept += len(part) + sum(a.nbytes for a in chunk)
            out.append(chunk)
        if self.kept > self.store // 2:
            self.old, self.young, self.kept = self.young, {}, 0
        return out

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of whole texts."""
        cuts = [content_cuts(t, *self.sizes) for t in texts]
        flat = self.chunks([t[a:b] for t, c in zip(texts, cuts) for a, b in zip(c, c[1:])])
        held, at = [], 0
        for c in cuts:
            held.append(flat[at : at + len(c) - 1])
            at += len(c) - 1
        # The windows that repair most joins, all in one call.
        guesses = [[self._window(len(t), c, own, k) for k in range(len(own) - 1)] for t, c, own in zip(texts, cuts, held)]
        made = iter(self.chunks([t[a:b] for t, spans in zip(texts, guesses) for a, b in spans]))
        return [self._joined(t, c, own, {s: next(made) for s in spans}) for t, c, own, spans in zip(texts, cuts, held, guesses)]

    def _proven(self, cuts: list[int], chunk: Chunk, k: int) -> int:
        """Where the last piece of chunk ``k`` begins that lies a margin before the chunk's end; its start if none does."""
        at = int(np.searchsorted(chunk.begin, cuts[k + 1] - cuts[k] - self.margin, side="right")) - 1
        return cuts[k] + (int(chunk.begin[at]) if at >= 0 else 0)

    def _window(self, n: int, cuts: list[int], held: list[Chunk], k: int) -> tuple[int, int]:
        """From the last proven piece before join ``k`` to a piece's start some way beyond it."""
        after = held[k + 1].begin
        at = int(np.searchsorted(after, REACH + self.margin))
        return self._proven(cuts, held[k], k), cuts[k + 1] + int(after[at]) if at < len(after) else cuts[k + 2]

    def _joined(self, raw: bytes, cuts: list[int], held: list[Chunk], windows: dict[tuple[int, int], Chunk]) -> np.ndarray:
        guesses = {a: (b, w) for (a, b), w in windows.items()}
        parts, k, at, n = [], 0, 0, len(raw)  # all ids before byte ``at`` are taken; it lies in chunk k
        while k + 1 < len(held):
            begin = max(at, self._proven(cuts, held[k], k))
            parts.append(held[k].between(at - cuts[k], begin - cuts[k]))
            end, window = guesses.get(begin, (0, None))
            reach = REACH + self.margin
            while True:
                if window is None:
                    end = min(n, max(cuts[k + 1], begin) + reach)
                    while end < n and raw[end] & 0xC0 == 0x80:
                        end += 1
                    window = self.chunks([raw[begin:end]])[0]
                agreed = self._agreed(cuts, held, k, begin, end, window, n)
                if agreed is not None:
                    break
                if end == n:
                    return np.concatenate([*parts, window.ids])
                reach, window = 2 * max(reach, end - begin), None
            parts.append(window.between(0, agreed[1] - begin))
            k, at = agreed
        parts.append(held[k].between(at - cuts[k], None))
        return np.concatenate(parts)

    def _agreed(self, cuts: list[int], held: list[Chunk], k: int, begin: int, end: int, window: Chunk, n: int) -> tuple[int, int] | None:
        """The first byte after join ``k``, and its chunk, at which both the window and that chunk begin a piece."""
        starts = window.begin.astype(np.int64) + begin
        starts = starts[(starts >= cuts[k + 1]) & (starts <= (n if end == n else end - self.margin))]
        for j in range(k + 1, len(held)):
            own = starts[(starts >= cuts[j]) & (starts < cuts[j + 1])] - cuts[j]
            if len(own):
                there = held[j].begin
                place = np.minimum(np.searchsorted(there, own), len(there) - 1)
                both = np.flatnonzero(there[place] == own)
                if len(both):
                    return j, cuts[j] + int(own[both[0]])
            if cuts[j + 1] >= end:
                break
        return None

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are not UTF-8 are replaced, as the library does."""
        parts = []
        for low in range(0, len(ids), DECODED):
            own = ids[low : low + DECODED]
            size = self.length[own]
            at = np.repeat(self.start[own] - (np.cumsum(size) - size), size)
            at += np.arange(len(at))
            parts.append(self.flat[at].tobytes())
        return b"".join(parts).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def coder(path: str) -> ChunkCoder:
    """One coder, with its store, per worker process and vocabulary."""
    return ChunkCoder(path)


def encode_and_decode(docs: DataFrame, path: str, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep``, ids (little-endian unsigned 32-bit, one after another) and the text decoded from them.

    One row per row, repeated rows included; a null or empty text has no ids and decodes to the empty text. Special
    strings within texts become special ids, as the library has it by default. A kept column named like a result
    gives way to it. No shuffle; a worker holds a batch, its store and the text at hand.
    """

    def work(texts):
        raw = [(t or "").encode() for t in texts.to_pylist()]
        ids, back = [], []
        for low, high in by_chars(raw):
            for own in coder(path).encode(raw[low:high]):
                ids.append(own.astype("<u4").tobytes())
                back.append(coder(path).decode(own))
        return pa.array(ids, pa.binary()), pa.array(back, pa.string())

    return map_columns(docs, keep, [text], "ids binary, decoded string", work)


def digests(coded: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Token counts and checksums of what ``encode_and_decode`` returns."""
    return coded.select(
        *keep,
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
