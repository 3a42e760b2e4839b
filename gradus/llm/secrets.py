"""Secrets by rules whose regular expressions are screened through a trigram index.

Each rule's expression is read once and turned into a Boolean query over trigrams that every match must hold.
Each batch of texts gets an inverted index of the trigrams any rule asks for; intersecting and uniting its
postings leaves the candidate texts, and only those are searched. A rule without mandatory trigrams searches
every text. A batch is the unit of the index, so it never has to be shuffled and its size is bounded.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import map_columns
from .words import LOWER

try:  # the standard library's reader of expressions moved in 3.11
    from re import _constants as K
    from re import _parser as reader
except ImportError:
    import sre_constants as K
    import sre_parse as reader


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds spans; ``least`` is the length that ``group`` of a match must have."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False


#: The three base kinds, in the order that breaks ties of spans.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 32),
)
#: Kinds that are found beside them.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("repo_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^/\s:@]+:[^/\s:@]+@"),
)

# ---- Boolean trigram queries: True (no demand), or ("and" | "or", parts), or one trigram ----


def _all(parts: Sequence) -> object:
    parts = [p for p in parts if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(dict.fromkeys(parts)))


def _any(parts: Sequence) -> object:
    if any(p is True for p in parts):
        return True
    parts = list(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: frozenset[str]) -> object:
    """What any text must hold that holds one of the strings."""
    return _any([_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


#: Most strings a part of an expression is spelled out to.
SPELLED = 64


def trigram_query(pattern: str) -> object:
    """The trigrams, joined by "and" and "or", that a text with a match holds (letters in lower case)."""
    query, strings = _read(reader.parse(pattern))
    return _all([query, _of_strings(strings)] if strings is not None else [query])


def _read(items) -> tuple[object, frozenset[str] | None]:
    """The demand of a sequence, and the strings it can be if it is spelled out entirely."""
    demands: list = []
    run: frozenset[str] | None = frozenset([""])
    whole = True
    for op, value in items:
        if op is K.LITERAL:
            own = frozenset([chr(value).lower()]) if value < 128 else None
        elif op is K.SUBPATTERN:
            demand, own = _read(value[3])
            demands.append(demand)
        elif op is K.BRANCH:
            read = [_read(v) for v in value[1]]
            if all(s is not None for _, s in read):
                own = frozenset().union(*(s for _, s in read))
            else:
                own = None
                demands.append(_any([_all([d, _of_strings(s)] if s is not None else [d]) for d, s in read]))
        elif op is K.IN and all(o is K.LITERAL and v < 128 for o, v in value):
            own = frozenset(chr(v).lower() for _, v in value)
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
            low, high, inner = value
            demand, strings = _read(inner)
            own = None
            if low >= 1:
                demands.append(_all([demand, _of_strings(strings)] if strings is not None else [demand]))
            elif high == 1 and strings is not None:
                own = strings | {""}
        elif op is K.AT:
            continue
        else:
            own = None
        joined = frozenset(a + b for a in run for b in own) if own is not None and len(run) * len(own) <= SPELLED else None
        if joined is not None:
            run = joined
        else:
            demands.append(_of_strings(run))
            whole = False
            run = own if own is not None and len(own) <= SPELLED else frozenset([""])
    if whole:
        return _all(demands), run
    demands.append(_of_strings(run))
    return _all(demands), None


def trigrams_of(query: object) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*(trigrams_of(p) for p in query[1]))


class Postings:
    """An inverted index of a batch: for each wanted trigram the texts that hold it, in ascending order."""

    def __init__(self, texts: list[str], wanted: Sequence[str]):
        self.size = len(texts)
        wanted = sorted(wanted)
        codes = np.array([_code(t) for t in wanted], np.int64)
        order = np.argsort(codes)
        self.at = {wanted[k]: r for r, k in enumerate(order)}
        self.lists = [np.empty(0, np.int64)] * len(wanted)
        if not len(codes) or not texts:
            return
        parts = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = LOWER[np.frombuffer(b"\n".join(parts), np.uint8)]
        ends = np.cumsum(np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts)))
        if len(data) < 3:
            return
        sign = np.zeros(1 << 16, bool)
        sign[codes[order] >> 8] = True
        # Two bytes screen first; the third is compared where they fit.
        pair = (data[:-2].astype(np.uint16) << np.uint16(8)) | data[1:-1]
        near = np.flatnonzero(sign[pair])
        found = (pair[near].astype(np.int64) << 8) | data[near + 2]
        rank = np.minimum(np.searchsorted(codes[order], found), len(codes) - 1)
        hit = codes[order][rank] == found
        rank, text = rank[hit], np.searchsorted(ends, near[hit], side="right")
        both = np.unique(rank * np.int64(self.size) + text)
        rank, text = both // self.size, both % self.size
        cuts = np.searchsorted(rank, np.arange(len(codes) + 1))
        self.lists = [text[a:b] for a, b in zip(cuts, cuts[1:])]

    def candidates(self, query: object) -> np.ndarray:
        if query is True:
            return np.arange(self.size)
        if isinstance(query, str):
            return self.lists[self.at[query]]
        parts = [self.candidates(p) for p in query[1]]
        if query[0] == "or":
            return np.unique(np.concatenate(parts))
        parts.sort(key=len)
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True)
        return out


def _code(trigram: str) -> int:
    a, b, c = trigram.encode("utf-8")[:3]
    return a << 16 | b << 8 | c


@lru_cache(maxsize=8)
def compiled(rules: tuple[Rule, ...]) -> tuple[list, list, list[str]]:
    """Expressions, trigram queries and the trigrams asked for. Letters match in ASCII only."""
    expressions = [re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.any_case else 0)) for r in rules]
    queries = [trigram_query(r.pattern) for r in rules]
    return expressions, queries, sorted(set().union(*map(trigrams_of, queries)))


def spans(texts: list[str], rules: tuple[Rule, ...]) -> list[list[tuple[int, int, int]]]:
    """For each text (start, number of the rule, end) of every match, in ascending order.

    A rule's matches are leftmost and do not overlap; those too short are dropped afterwards.
    """
    expressions, queries, wanted = compiled(rules)
    index = Postings(texts, wanted)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for number, (rule, expression, query) in enumerate(zip(rules, expressions, queries)):
        if rule.group == 0 and rule.least and rule.pattern.endswith("]+"):
            # The longest run of a class: a shorter one is dropped, so only the long ones are looked for.
            head, _, tail = rule.pattern.rpartition("[")
            if not head:
                expression = _compile_run(rule.pattern[:-1], rule.least)
        for k in index.candidates(query):
            for m in expression.finditer(texts[k]):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    found[k].append((m.start(), number, m.end()))
    for own in found:
        own.sort()
    return found


@lru_cache(maxsize=8)
def _compile_run(of: str, least: int):
    return re.compile(f"{of}{{{least},}}", re.ASCII)


def find_secrets(
    docs: DataFrame,
    keep: Sequence[str] = ("doc_id",),
    text: str = "text",
    base: tuple[Rule, ...] = BASE,
    more: tuple[Rule, ...] = MORE,
) -> DataFrame:
    """``found``: the spans of every kind in each whole text, by start and then kind; code points, end exclusive.

    One row per row, repeated rows too; null and empty texts have no spans. No shuffle; a worker holds a batch.
    """
    rules = (*base, *more)

    def work(texts):
        every = spans([t or "" for t in texts.to_pylist()], rules)
        return ([[{"kind": rules[n].kind, "start": a, "end": b} for a, n, b in own] for own in every],)

    return map_columns(docs, keep, [text], "found array<struct<kind string, start long, end long>>", work)


def digests(found: DataFrame, keep: Sequence[str] = ("doc_id",), base: tuple[Rule, ...] = BASE) -> DataFrame:
    """Counts of the base kinds, the digest of their spans and all spans as text."""
    from pyspark.sql import functions as F

    kinds = [r.kind for r in base]
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        *keep,
        *[count(k).alias(f"n_{k}") for k in kinds],
        F.sha2(joined(F.filter("found", lambda s: s["kind"].isin(kinds))), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )


def digest_of(spans: Sequence[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
