"""Token ids of whole texts by a public tokenizer, with the ids of repeated words kept per worker.

A text is cut only where the tokenizer itself must cut it, so the ids of the parts are the ids of the whole:

* byte-level vocabulary: before a single space between two characters that are not white space. Every
  alternative of its pattern ends before white space, and the space opens the next match.
* word vocabulary: at ASCII white space, which its pattern drops and over which no normalisation reaches.
* both: between a Latin letter or digit and a mark of ``.,!?;:``, and around a line end between printed
  ASCII characters, where a match must end.

Special strings hold no white space, so a cut never falls inside one. Words met before are found by a 64-bit
key; new ones go through the tokenizers library. A worker keeps at most ``KEPT`` words of at most ``LONG``
bytes; others are encoded anew in each batch, with the same result.
"""

from __future__ import annotations

import gc
import os
import re
from contextlib import contextmanager
from functools import lru_cache

import numpy as np

from .words import VISIBLE, Packed, Table

KEPT = 600_000
LONG = 64
#: Texts of one call to the library, in characters: bounds what the library holds at once.
CALL_CHARS = 4_000_000

#: Words that both patterns split alike and that no normalisation but lower case changes.
_LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
_PLAIN = re.compile(f"( ?[{_LETTERS}]+)([.,!?;:]+)?(?:(\n)([{_LETTERS}]+)([.,!?;:]+)?)?")
#: First bytes of the characters among which all white space beyond ASCII lies.
_WIDE_SPACE = np.array([0xC2, 0xE1, 0xE2, 0xE3], np.uint8)


_MARK = np.zeros(256, bool)
_MARK[list(b".,!?;:")] = True
_PRINTED = np.zeros(256, bool)
_PRINTED[33:127] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def _byte_signs() -> list[str]:
    """The sign that stands for each byte in byte-level vocabularies: itself if printable, else one past 255."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    signs, more = [""] * 256, 256
    for byte in range(256):
        if byte in own:
            signs[byte] = chr(byte)
        else:
            signs[byte], more = chr(more), more + 1
    return signs


_SIGNS = _byte_signs()


@lru_cache(maxsize=None)
def library(path: str):
    """The tokenizer of a vocabulary file; one thread, as Spark already uses every core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts. ``byte_level`` says by which of the two rules above a text may be cut."""

    def __init__(self, path: str, byte_level: bool):
        self.library = library(path)
        self.byte_level = byte_level
        self.kind = np.uint16 if self.library.get_vocab_size() <= 65536 else np.uint32
        self._new()

    def _new(self) -> None:
        self.table = Table()
        self.start = np.zeros(1024, np.int64)
        self.count = np.zeros(1024, np.int64)
        self.ids = np.zeros(8192, self.kind)
        self.used = 0

    def _spans(self, packed: Packed) -> tuple[np.ndarray, np.ndarray]:
        data = packed.data
        marks = np.flatnonzero(_MARK[data[1:]]) + 1
        before = data[marks - 1]
        latin = (data[marks - 2] == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7) & (marks > 1)
        marks = marks[_ALNUM[before] | latin]
        if not self.byte_level:
            start, end = packed.runs(VISIBLE)
            return np.sort(np.concatenate([start, marks])), np.sort(np.concatenate([end, marks]))
        visible = np.zeros(len(data) + 2, bool)
        visible[1:-1] = VISIBLE[data] & ((data < 0x1C) | (data > 0x1F))
        space = np.flatnonzero((data == 32) & visible[:-2] & visible[2:])
        # Beyond ASCII, characters that begin or end like white space are taken for it.
        after = data[space + 1]
        wide = np.isin(after, _WIDE_SPACE)
        near = np.flatnonzero(data[space - 1] >= 0x80)
        at = space[near]
        wide[near] |= (data[at - 2] == 0xC2) | np.isin(data[np.maximum(at - 3, 0)], _WIDE_SPACE[1:])
        inner = data == 10
        inner[packed.end[:-1]] = False
        line = np.flatnonzero(inner[1:-1]) + 1
        line = line[_PRINTED[data[line - 1]] & _PRINTED[data[line + 1]]]
        full = packed.end > packed.start
        start = np.sort(np.concatenate([space[~wide], marks, line, line + 1, packed.start[full]]))
        end = np.empty_like(start)
        end[:-1] = start[1:]
        if len(end):
            last = np.searchsorted(start, packed.end[full], side="left") - 1
            end[last] = packed.end[full]
        return start, end

    def _grow(self, name: str, need: int) -> np.ndarray:
        old = getattr(self, name)
        if need > len(old):
            new = np.zeros(max(need, 2 * len(old)), old.dtype)
            new[: len(old)] = old
            setattr(self, name, new)
            return new
        return old

    def _through_library(self, words: list[str]) -> list[list[int]]:
        every: list[list[int]] = []
        low = size = 0
        for high in range(1, len(words) + 1):
            size += len(words[high - 1])
            if size >= CALL_CHARS or high - low >= 1000 or high == len(words):
                every += [e.ids for e in self.library.encode_batch_fast(words[low:high], add_special_tokens=False)]
                low, size = high, 0
        return every

    def _new_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words: plain ones by their letters and marks, each through the library's model."""
        model, byte_level = self.library.model.tokenize, self.byte_level
        known: dict[str, list[int]] = {}

        def piece(text: str) -> list[int]:
            got = known.get(text)
            if got is None:
                own = text if byte_level else text.lower()
                if own.isascii() and own != "\n":
                    own = own.replace(" ", _SIGNS[32])
                else:
                    own = "".join([_SIGNS[b] for b in own.encode()])
                got = known[text] = [t.id for t in model(own)]
            return got

        every: list = []
        other = []
        for word in words:
            letters = word[1:] if word[:1] == " " else word
            if letters.isascii() and letters.isalpha():
                every.append(piece(word))
                continue
            found = _PLAIN.fullmatch(word)
            if found is None:
                other.append(len(every))
                every.append(None)
            else:
                every.append([i for p in found.groups() if p and (byte_level or p != "\n") for i in piece(p)])
        for at, ids in zip(other, self._through_library([words[k] for k in other])):
            every[at] = ids
        counts = np.fromiter(map(len, every), np.int64, len(every))
        return np.fromiter((i for ids in every for i in ids), np.int64, int(counts.sum())), counts

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        ids, counts = self._new_ids(words)
        low, high = self.table.size, self.table.size + len(words)
        self._grow("ids", self.used + len(ids))[self.used : self.used + len(ids)] = ids
        self._grow("start", high)[low:high] = self.used + np.cumsum(counts) - counts
        self._grow("count", high)[low:high] = counts
        self.table.add(keys)
        self.used += len(ids)

    def _found(self, texts: list):
        """The texts, where their words begin, and of each word's ids the number and the place in a store."""
        if self.table.size > KEPT or self.used > 16 * KEPT:
            self._new()
        packed = Packed(texts)
        start, end = self._spans(packed)
        long = np.flatnonzero(end - start > LONG)
        keys = packed.keys(start, end)
        keys[long] = 0
        slots = self.table.find(keys)
        miss = np.flatnonzero((slots < 0) & (keys != 0))
        if len(miss):
            new, first = np.unique(keys[miss], return_index=True)
            own = miss[first]
            raw = packed.bytes
            self._learn(new, [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(start[own].tolist(), end[own].tolist())])
            slots[miss] = self.table.find(keys[miss])
        counts = self.count[slots]
        begin = self.start[slots]
        store = self.ids
        if len(long):
            raw = packed.bytes
            more, sizes = self._new_ids([raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(start[long].tolist(), end[long].tolist())])
            counts[long] = sizes
            begin[long] = self.used + np.cumsum(sizes) - sizes
            store = np.concatenate([store[: self.used], more.astype(self.kind)])
        return packed, start, counts, begin, store

    def batch(self, texts: list, ids: bool = True) -> tuple[np.ndarray | None, np.ndarray]:
        """Ids of all texts after one another (None if not asked for) and the number of ids of each."""
        with _no_collector():
            packed, start, counts, begin, store = self._found(texts)
            ends = np.concatenate([[0], np.cumsum(counts)])
            lengths = np.diff(ends[np.concatenate([[0], np.cumsum(packed.counts(start))])])
            if not ids:
                return None, lengths
            at = np.repeat(begin - ends[:-1], counts)
            at += np.arange(ends[-1])
            return store[at], lengths

    def pieces(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts after one another; of each piece that the tokenizer must split off the number of ids and the
        byte of its text at which it begins; and the number of pieces of each text."""
        with _no_collector():
            packed, start, counts, begin, store = self._found(texts)
            of_text = packed.counts(start)
            at = np.repeat(begin - (np.cumsum(counts) - counts), counts)
            at += np.arange(len(at))
            return store[at], counts, start - np.repeat(packed.start, of_text), of_text


@contextmanager
def _no_collector():
    """What is done here makes no cycles, and the collector would walk all new words."""
    collecting = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if collecting:
            gc.enable()


@lru_cache(maxsize=4)
def encoder(path: str, byte_level: bool) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(path, byte_level)


def by_chars(texts: list, most: int = 1_000_000):
    """Index ranges whose texts together have at most ``most`` characters, or hold one text."""
    low = size = 0
    for at, text in enumerate(texts):
        more = len(text) if text else 0
        if at > low and size + more > most:
            yield low, at
            low, size = at, 0
        size += more
    if low < len(texts):
        yield low, len(texts)
