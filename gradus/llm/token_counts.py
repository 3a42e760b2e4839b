"""Token counts of whole texts; huge documents by overlapping chunks that resynchronise."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import map_columns
from .tokens import by_chars, encoder, library

#: Characters above which a document is encoded in chunks, and how far two chunks overlap at first.
CHUNK = 32_768
OVERLAP = 256


@lru_cache(maxsize=4)
def _margin(tokenizer) -> int:
    """How far beyond a word's start text can matter to it: a special string that begins there, or a contraction."""
    return max((len(t.content) for t in tokenizer.get_added_tokens_decoder().values()), default=0) + 3


def _stands(text: str, place: int) -> bool:
    """Whether normalisation leaves what lies before a character and what begins with it to themselves: the character is
    no mark, which may be moved, and does not combine with the one before it."""
    before, own = text[place - 1], text[place]
    join = unicodedata.normalize
    return not unicodedata.combining(own) and join("NFC", before + own) == join("NFC", before) + join("NFC", own)


class Part:
    """A chunk's ids, and of every word the character where it begins and its first token."""

    def __init__(self, tokenizer, text: str, low: int, high: int):
        made = tokenizer.encode(text[low:high], add_special_tokens=False)
        words = np.array(made.word_ids, np.int64)
        self.ids = made.ids
        self.first = np.flatnonzero(np.diff(words, prepend=-1))
        begin = np.array([o[0] for o in made.offsets], np.int64)
        self.begin = low + (begin[self.first] if len(begin) else begin)

    def token(self, place: int) -> int:
        """The first token of the word that begins at ``place``."""
        at = int(np.searchsorted(self.begin, place))
        return int(self.first[at]) if at < len(self.first) else len(self.ids)


def spliced(text: str, tokenizer, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[list[int], list[tuple[int, int]]]:
    """Ids of a long text and the character ranges each chunk gave them.

    The pattern that splits words matches from left to right and looks ahead no further than a contraction or a
    special string, and normalisation does not reach over places between characters that stand alone. So a word's start that the earlier chunk finds is proven if it lies that far before the chunk's
    end, and from a proven start on, a chunk that begins a word there too has the ids of the whole text. Neighbouring
    chunks share ``overlap`` characters and are spliced at the first proven start they have in common, be there white
    space around it or not. Without one the overlap is widened to the last proven start, which the later chunk then
    begins at. A chunk without any, one word without end, is encoded anew with as much text again, so that work stays
    in proportion.
    """
    ids: list[int] = []
    ranges: list[tuple[int, int]] = []
    at, skip = 0, 0  # from where on nothing is taken yet, and its token in the current chunk
    high = min(len(text), chunk)
    now = Part(tokenizer, text, 0, high)
    while high < len(text):
        proven = now.begin[(now.begin > at) & (now.begin <= high - _margin(tokenizer))]
        end = min(len(text), high + (chunk if high - at <= 2 * (chunk + overlap) else high - at))
        begin, place, later = high - overlap, None, None
        shared = proven[proven > begin]
        if len(shared):
            later = Part(tokenizer, text, begin, end)
            common = np.intersect1d(shared, later.begin[1:]).tolist()
            place = next((c for c in common if _stands(text, c)), None)
        if place is None:
            place = next((c for c in proven[::-1].tolist() if _stands(text, c)), at)
            later = Part(tokenizer, text, place, end)
        if place > at:
            ids += now.ids[skip : now.token(place)]
            ranges.append((at, place))
        # What lies before the first word of the text is no word's.
        skip = later.token(place) if place > 0 else 0
        at, high, now = place, end, later
    ids += now.ids[skip:]
    ranges.append((at, len(text)))
    return ids, ranges


def token_counts(
    docs: DataFrame,
    path: str,
    keep: Sequence[str] = ("doc_id",),
    text: str = "text",
    limit: int = 2048,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """UTF-8 bytes and tokens of each whole text by a word vocabulary, and whether they pass ``limit``.

    One row per row, repeated rows included; null and empty texts have 0 bytes and 0 tokens. Special strings are
    counted as the library counts them by default. A kept column named like a result gives way to it. No
    shuffle; a worker holds one batch of texts and the chunk at hand.
    """

    def work(texts):
        texts = texts.to_pylist()
        size = np.fromiter((len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts), np.int64, len(texts))
        count = np.zeros(len(texts), np.int64)
        short = [k for k, t in enumerate(texts) if t is None or len(t) <= chunk]
        for low, high in by_chars([texts[k] for k in short]):
            own = short[low:high]
            count[own] = encoder(path, False).batch([texts[k] for k in own], ids=False)[1]
        for k in set(range(len(texts))).difference(short):
            count[k] = len(spliced(texts[k], library(path), chunk, overlap)[0])
        return size, count, count > limit

    return map_columns(docs, keep, [text], "n_bytes long, n_tokens long, over_limit boolean", work)
