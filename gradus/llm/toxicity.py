"""Toxicity by a support vector machine over a gap-weighted subsequence kernel with Nystroem landmarks.

A sentence's kernel looks at its words: two words are alike by their common subsequences of three letters, each
weighted by ``DECAY`` to the power of the letters it spans, up to ``SPAN``. Gaps cost weight but do not break a
match, so inserted characters, swapped endings and letters set apart still meet the landmark they stand for.
Characters that are no letters are passed over and runs of single letters are read as one word.

The machine is trained on labelled sentences as bags of words (multiple instances): a toxic text must hold one
word on the positive side, a clean text none. Counts of words by label cover the labelled training rows, of
each label at most ``SAMPLE``; from them and from the words that decide each text in the rounds that follow come bounded lists of weighted examples
(``POSITIVE``, ``NEGATIVE``). A logistic curve of a text's two worst margins, fitted to
all training texts, is its score.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, map_rows, named, remainder, written
from .words import VISIBLE, Packed, Table

DECAY = 0.6
SPAN = 6
#: Letters of a word looked at together; longer words are read in windows that overlap by half.
LETTERS = 24
LANDMARKS = 320
POSITIVE = 600
#: Words whose counts may decide a text in the first round.
TELLING = 20_000
NEGATIVE = 6000
ROUNDS = 2
#: Words of a text that become examples, and how much likelier in toxic texts a positive one must be.
TOP = 3
LEAN = 3.0
KEPT = 600_000
#: Words whose subsequences are held together.
WORDS = 10_000
#: Most labelled rows of each label that are learnt from.
SAMPLE = 20_000

_CODES = 1 << 18
_STEPS = [(j, k) for j in range(1, SPAN) for k in range(j + 1, SPAN)]


class Model(NamedTuple):
    weight: np.ndarray  # by code of three letters
    bias: float
    curve: tuple[float, float, float]  # of the worst margin, of the one after it, and the shift


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes 1 to 63 of all words after one another, and how many each word has."""
    points = np.frombuffer("\n".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    small = points < 128
    code = np.where(small, 0, 27 + points % 37).astype(np.int64)
    plain = small & ((points | 32) >= 97) & ((points | 32) <= 122)
    code[plain] = (points[plain] | 32) - 96
    word = np.cumsum(points == 10)
    keep = code > 0
    return code[keep], np.bincount(word[keep], minlength=len(words))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Subsequences of each word's windows: window, code and weight (norm 1 in each window), and each window's word."""
    code, counts = _letters([w.replace("\n", " ") for w in words])
    ends = np.cumsum(counts)
    step = LETTERS // 2
    windows = np.maximum(1, -(-(counts - step) // step))
    of = np.repeat(np.arange(len(words)), windows)
    number = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    low = (ends - counts)[of] + number * step
    high = np.minimum(low + LETTERS, ends[of])
    size = np.maximum(high - low, 0)
    at = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
    window = np.repeat(np.arange(len(of)), size)
    limit = high[window]
    keys, weights = [], []
    for j, k in _STEPS:
        fits = at + k < limit
        first = at[fits]
        keys.append((window[fits] << 18) | (code[first] << 12) | (code[first + j] << 6) | code[first + k])
        weights.append(np.full(len(first), DECAY ** (k + 1), np.float32))
    key, weight = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(key)
    key, weight = key[order], weight[order]
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    weight = np.add.reduceat(weight, new) if len(new) else weight
    key = key[new]
    window, code = key >> 18, key & (_CODES - 1)
    norm = np.sqrt(np.bincount(window, weight.astype(np.float64) ** 2, len(of)))
    return window, code, weight / norm[window], of


def windowed(word: str) -> list[str]:
    """The parts of a word that its windows look at: the word itself if it has one window."""
    if len(word) <= LETTERS:
        return [word]
    point = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)
    small = point < 128
    at = np.flatnonzero(~small | (((point | 32) >= 97) & ((point | 32) <= 122)))
    if len(at) <= LETTERS:
        return [word]
    step = LETTERS // 2
    starts = range(0, max(1, len(at) - step), step)
    return [word[int(at[k]) : int(at[min(k + LETTERS, len(at)) - 1]) + 1] for k in starts]


def kernel(left: list[str], right: list[str]) -> np.ndarray:
    """Kernel values between words of one window each."""
    out = np.zeros((len(left), len(right)))
    rw, rc, rv, ro = features(right)
    rw = ro[rw]
    lw, lc, lv, lo = features(left)
    lw = lo[lw]
    codes = np.unique(rc)
    dense = np.zeros((len(codes), len(right)))
    np.add.at(dense, (np.searchsorted(codes, rc), rw), rv)
    place = np.minimum(np.searchsorted(codes, lc), max(len(codes) - 1, 0))
    hit = codes[place] == lc if len(codes) else np.zeros(len(lc), bool)
    lw, place, lv = lw[hit], place[hit], lv[hit]
    cuts = np.searchsorted(lw, np.arange(len(left) + 1))
    for k in range(len(left)):
        a, b = cuts[k], cuts[k + 1]
        out[k] = lv[a:b] @ dense[place[a:b]]
    return out


def margins(words: list[str], weight: np.ndarray, bias: float) -> np.ndarray:
    """The margin of each word: that of its worst window. A word of fewer than three letters has the bias."""
    out = np.full(len(words), bias)
    for low in range(0, len(words), WORDS):
        part = words[low : low + WORDS]
        window, code, value, of = features(part)
        sums = np.bincount(window, weight[code] * value, len(of)) + bias
        np.maximum.at(out[low : low + len(part)], of, sums) if (len(of) > len(part)) else np.copyto(out[low : low + len(part)], sums)
    return out


def landmarks(positive: list[str], negative: list[str], most: int = LANDMARKS) -> list[str]:
    """Positive words, then negative ones, in their order; one too like an earlier one is passed over."""
    out: list[str] = []
    for words, many, near in ((positive, most * 3 // 4, 0.9), (negative, most // 4, 0.6)):
        words = words[: 8 * many]
        like = kernel(words, words) if words else np.zeros((0, 0))
        taken: list[int] = []
        for k in range(len(words)):
            if len(taken) < many and (not taken or like[k][taken].max() < near) and like[k, k] > 0:
                taken.append(k)
        out += [words[k] for k in taken]
    return list(dict.fromkeys(out))


def fit(positive: dict[str, float], negative: dict[str, float], cost: float = 30000.0) -> tuple[np.ndarray, float]:
    """Weights by letter code and the bias of a squared-hinge machine over Nystroem features, by Newton steps."""
    marks = landmarks(sorted(positive, key=lambda w: (-positive[w], w)), sorted(negative, key=lambda w: (-negative[w], w)))
    words = [*positive, *negative]
    sign = np.append(np.ones(len(positive)), -np.ones(len(negative)))
    share = np.append(np.array([*positive.values()]) ** 0.5, np.array([*negative.values()]) ** 0.5)
    # A text has one deciding word among hundreds of others, so the clean side weighs more.
    share[sign > 0] *= 0.2 / share[sign > 0].sum()
    share[sign < 0] *= 0.8 / share[sign < 0].sum()
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    root = vectors / np.sqrt(np.maximum(values, 1e-6))
    x = np.hstack([kernel(words, marks) @ root, np.ones((len(words), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w)) / cost
    ridge[-1, -1] = 1e-6
    for _ in range(50):
        inside = sign * (x @ w) < 1
        xs = x[inside] * share[inside, None]
        new = np.linalg.solve(ridge + xs.T @ x[inside], xs.T @ sign[inside])
        if np.abs(new - w).max() < 1e-9:
            break
        w = 0.5 * w + 0.5 * new if _ > 25 else new
    beta = root @ w[:-1]
    window, code, value, of = features(marks)
    weight = np.bincount(code, value * beta[of[window]], _CODES)
    return weight, float(w[-1])


class Scorer:
    """Margins of texts; those of words are kept per worker, at most ``KEPT``."""

    def __init__(self, weight: np.ndarray | None, bias: float, fixed: dict[str, float] | None = None):
        self.weight, self.bias, self.fixed = weight, bias, fixed
        self._new()

    def _margins(self, words: list[str]) -> np.ndarray:
        if self.fixed is not None:
            return np.array([max(self.fixed.get(p, self.bias) for p in windowed(w)) for w in words])
        return margins(words, self.weight, self.bias)

    def _new(self) -> None:
        self.table, self.margin = Table(), np.empty(1024)

    def worst_window(self, word: str) -> str:
        """The part of a word that decides its margin."""
        parts = windowed(word)
        return parts[int(self._margins(parts).argmax())] if len(parts) > 1 else word

    def worst(self, texts: list, top: int = 0) -> tuple[np.ndarray, list[list[tuple[str, float]]]]:
        """The margins of each text's two worst words, and its ``top`` distinct words of the greatest margins."""
        if self.table.size > KEPT:
            self._new()
        packed = Packed(texts, lower=True)
        start, end = packed.runs(VISIBLE)
        raw = packed.data.tobytes()
        word = lambda k: raw[start[k] : end[k]].decode("utf-8", "surrogatepass")
        keys = packed.keys(start, end)
        slots = self.table.find(keys)
        miss = np.flatnonzero(slots < 0)
        if len(miss):
            new, first = np.unique(keys[miss], return_index=True)
            made = self._margins([word(k) for k in miss[first]])
            if self.table.size + len(new) > len(self.margin):
                self.margin = np.resize(self.margin, 2 * (self.table.size + len(new)))
            self.margin[self.table.size : self.table.size + len(new)] = made
            self.table.add(new)
            slots[miss] = self.table.find(keys[miss])
        value = self.margin[slots]
        out = np.full((len(texts), 2), self.bias)
        names: list[list[tuple[str, float]]] = [[] for _ in texts]
        ends = np.cumsum(packed.counts(start))
        some = np.flatnonzero(np.diff(np.append(0, ends)))
        if len(some):
            lows = np.append(0, ends)[some]
            out[some, 0] = np.maximum.reduceat(value, lows)
            text = np.repeat(np.arange(len(texts)), np.diff(np.append(0, ends)))
            peaks = np.flatnonzero(value == out[text, 0])
            value[peaks[np.append(True, np.diff(text[peaks]) != 0)]] = -np.inf  # one word of the greatest margin
            out[some, 1] = np.maximum(np.maximum.reduceat(value, lows), self.bias)
            for k, low in zip(some.tolist(), lows.tolist()) if top else ():
                distinct, first = np.unique(slots[low : ends[k]], return_index=True)
                best = np.argsort(-self.margin[distinct], kind="stable")[:top]
                names[k] = [(self.worst_window(word(low + int(first[b]))), float(self.margin[distinct[b]])) for b in best]
        for k, spelled in self._spaced(packed, start, end, ends, raw):
            own = float(self._margins([spelled])[0])
            if own > out[k, 1]:
                out[k] = sorted([own, out[k, 0]], reverse=True)
                if top:
                    names[k] = [(self.worst_window(spelled), own), *names[k]][:top]
        return out, names

    @staticmethod
    def _spaced(packed: Packed, start: np.ndarray, end: np.ndarray, ends: np.ndarray, raw: bytes):
        """Words spelled with spaces: runs of four or more single letters within a text."""
        single = np.append(np.append(False, (end - start == 1) & (packed.data[start] >= 97) & (packed.data[start] <= 122)), False)
        edge = np.flatnonzero(single[1:] != single[:-1])
        for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist()):
            cuts = [a, *ends[np.searchsorted(ends, a, side="right") : np.searchsorted(ends, b)].tolist(), b]
            for x, y in zip(cuts, cuts[1:]):
                if y - x >= 4:
                    yield int(np.searchsorted(ends, x, side="right")), "".join(chr(raw[start[k]]) for k in range(x, y))


def _counts(rows: DataFrame, text: str, label: str) -> DataFrame:
    """(word, positive, negative): texts of each label that hold a word, over all rows; a long word by each of its
    windows."""

    def work(batches):
        for texts, labels in batches:
            packed = Packed(texts.to_pylist(), lower=True)
            start, end = packed.runs(VISIBLE)
            raw = packed.data.tobytes()
            text = np.repeat(np.arange(len(texts)), packed.counts(start))
            parts: dict[str, list[int]] = {}
            long = end - start > LETTERS
            held = {(int(text[k]), p) for k in np.flatnonzero(long) for p in windowed(raw[start[k] : end[k]].decode("utf-8", "replace"))}
            marks = labels.to_pylist()
            for own, part in held:
                parts.setdefault(part, [0, 0])[0 if marks[own] == 1 else 1] += 1
            if parts:
                yield {"word": list(parts), "positive": [n[0] for n in parts.values()], "negative": [n[1] for n in parts.values()]}
            start, end, text = start[~long], end[~long], text[~long]
            keys = packed.keys(start, end)
            order = np.lexsort((keys, text))
            new = np.append(True, (np.diff(text[order]) != 0) | (keys[order][1:] != keys[order][:-1])) if len(keys) else np.empty(0, bool)
            at = order[new]  # each word of a text once
            toxic = labels.to_numpy(zero_copy_only=False)[text[at]] == 1
            distinct, first, back = np.unique(keys[at], return_index=True, return_inverse=True)
            own = at[first]
            yield {
                "word": [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[own].tolist(), end[own].tolist())],
                "positive": np.bincount(back, toxic, len(distinct)).astype(np.int64),
                "negative": np.bincount(back, ~toxic, len(distinct)).astype(np.int64),
            }

    made = map_rows(rows, [text, label], "word string, positive long, negative long", work)
    return made.groupBy("word").agg(F.sum("positive").alias("positive"), F.sum("negative").alias("negative"))


def train(rows: DataFrame, worth: dict[int, float], text: str = "text", label: str = "toxic", rounds: int = ROUNDS) -> Model | None:
    """A model from rows labelled 0 or 1, each ``worth`` so many; None if a label is missing. Bounded lists reach
    the driver."""
    totals = {r[label]: r.n for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}
    some, none = totals.get(1, 0), totals.get(0, 0)
    if not some or not none:
        return None
    counted = written(_counts(rows, text, label), "toxicity")
    share = F.col("positive") / F.lit(float(some)) - F.col("negative") / F.lit(float(none))
    spread = F.sqrt((F.col("positive") + F.col("negative") + 1.0) / F.lit(float(some + none)) / F.lit(float(min(some, none))))
    found = counted.where(F.col("positive") >= 2).withColumn("z", share / spread).where("z > 2")
    telling = {r.word: float(r.z) for r in found.orderBy(F.desc("z"), "word").limit(TELLING).collect()}
    clean = counted.where((F.col("negative") > 0) & (share <= 0))
    often = clean.orderBy(F.desc("negative"), "word").limit(NEGATIVE // 2).collect()
    mixed = clean.orderBy(F.xxhash64("word"), "word").limit(NEGATIVE // 2).collect()
    base = {r.word: 1.0 for r in [*often, *mixed]}
    if not telling or not base:
        return None
    weight, bias = None, 0.0
    for turn in range(rounds + 1):
        words = _deciding(rows, text, label, weight, bias, telling if turn == 0 else None)
        words = written(words.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "toxicity")
        # A word that is among the worst in texts of both labels counts for the label of the larger share.
        leaning = F.col("toxic") * F.lit(float(none)) - F.col("clean") * F.lit(float(some) * LEAN)
        own = {r.word: float(r.toxic) for r in words.where(leaning > 0).orderBy(F.desc("toxic"), "word").limit(POSITIVE).collect()}
        other = {r.word: float(r.clean) for r in words.where(leaning <= 0).orderBy(F.desc("clean"), "word").limit(NEGATIVE).collect()}
        if not own:
            break
        positive, negative = own, {w: n for w, n in (base | other).items() if w not in own}
        weight, bias = fit(positive, negative)
    if weight is None:
        return None
    binned = _text_margins(rows, text, label, weight, bias).collect()
    both = np.array([[r.worst, r.next] for r in binned])
    stands = np.array([r.n * worth.get(r[label], 1.0) for r in binned])
    return Model(weight, bias, _logistic(both, np.array([r[label] == 1 for r in binned]), stands))


def _deciding(rows: DataFrame, text: str, label: str, weight: np.ndarray | None, bias: float, fixed: dict | None = None) -> DataFrame:
    """(word, toxic, clean): texts of each label among whose ``TOP`` worst words it is, on the positive side if
    the text is toxic; counted per batch."""
    sent = rows.sparkSession.sparkContext.broadcast((weight, bias, fixed))

    def work(batches):
        scorer = Scorer(*sent.value)
        for texts, labels in batches:
            found: dict[str, list[int]] = {}
            _, names = scorer.worst(texts.to_pylist(), TOP)
            for toxic, own in zip(labels.to_pylist(), names):
                for place, (word, margin) in enumerate(own):
                    if not toxic or margin > 0 or (place == 0 and fixed is None):
                        found.setdefault(word, [0, 0])[0 if toxic else 1] += 1
            yield {"word": list(found), "toxic": [n[0] for n in found.values()], "clean": [n[1] for n in found.values()]}

    return map_rows(rows, [text, label], "word string, toxic long, clean long", work)


def _text_margins(rows: DataFrame, text: str, label: str, weight: np.ndarray, bias: float) -> DataFrame:
    """(label, worst, next, n): the two worst margins of all texts, in steps of a twentieth within -3 to 3."""
    sent = rows.sparkSession.sparkContext.broadcast((weight, bias))

    def work(batches):
        scorer = Scorer(*sent.value)
        for texts, labels in batches:
            both = np.clip(np.round(scorer.worst(texts.to_pylist())[0] * 20) / 20, -3, 3)
            yield {label: labels, "worst": both[:, 0].copy(), "next": both[:, 1].copy()}

    out = f"`{label}` {rows.schema[label].dataType.simpleString()}, worst double, next double"
    return map_rows(rows, [text, label], out, work).groupBy(label, "worst", "next").agg(F.count("*").alias("n"))


def _logistic(margin: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> tuple[float, float, float]:
    """Slopes and shift of the likeliest logistic curve, slightly smoothed; neither slope is below 0."""
    some, none = n[toxic].sum(), n[~toxic].sum()
    want = np.where(toxic, (some + 1) / (some + 2), 1 / (none + 2))
    use = [0, 1, 2]
    x = np.hstack([margin, np.ones((len(margin), 1))])
    while True:
        w = np.zeros(len(use))
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(x[:, use] @ w, -30, 30)))
            slope = x[:, use].T @ (n * (p - want)) + 1e-3 * w
            curve = (x[:, use] * (n * p * (1 - p) + 1e-9)[:, None]).T @ x[:, use] + 1e-3 * np.eye(len(use))
            step = np.linalg.solve(curve, slope)
            w -= step / max(1.0, np.abs(step).max())
            if np.abs(step).max() < 1e-8:
                break
        below = [k for k, v in zip(use[:-1], w) if v < 0]
        if not below:
            out = dict(zip(use, w.tolist()))
            return out.get(0, 0.0), out.get(1, 0.0), out[2]
        use = [k for k in use if k not in below]


def labelled(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most: int = SAMPLE) -> tuple[DataFrame, dict[int, float]]:
    """Texts and labels of training rows (crc32(doc_id as text) mod 5 is not 0), and what a row of each label
    stands for: at most ``most`` labelled ids of each label, the first by their hash, are learnt from. Their list is
    small enough to be sent to every task, so texts are never shuffled. Of several labels the greatest holds."""
    known = labels.where(named(label).isin(0, 1) & (remainder(doc_id, 5) != 0)).groupBy(named(doc_id).alias("__id")).agg(F.max(named(label)).alias(label))
    here = docs.where(remainder(doc_id, 5) != 0)
    known = written(known.join(here.select(named(doc_id).alias("__id")).distinct(), "__id"), "toxicity-labels")
    totals = {r[label]: r.n for r in known.groupBy(label).agg(F.count("*").alias("n")).collect()}
    parts = [known.where(named(label) == v).orderBy(F.xxhash64("__id"), "__id").limit(most) for v in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # at most 2 * most ids
    rows = here.select(named(doc_id).alias("__doc"), named(text).alias(text)).join(chosen, F.col("__doc") == F.col("__id")).select(text, label)
    return written(rows, "toxicity-rows"), {v: max(1.0, n / most) for v, n in totals.items()}


def score(docs: DataFrame, model: Model | None, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` with ``score`` (0 to 1) and ``predicted`` of each whole text, from the text alone.

    Null and empty texts score as a text without words. Without a model every score is 0.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    state: dict = {}

    def work(texts):
        own = sent.value
        if own is None:
            return np.zeros(len(texts)), np.zeros(len(texts), np.int32)
        if state.get("model") is not own:
            state["model"], state["scorer"] = own, Scorer(own.weight, own.bias)
        margin, _ = state["scorer"].worst(texts.to_pylist())
        made = 1 / (1 + np.exp(-np.clip(margin @ np.array(own.curve[:2]) + own.curve[2], -60, 60)))
        return made, (made >= 0.5).astype(np.int32)

    return map_columns(docs, keep, [text], "score double, predicted int", work)


def toxicity(docs: DataFrame, labels: DataFrame, keep: Sequence[str] = ("doc_id",), doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """Train on the labelled training rows of ``docs`` and score all of them; see ``score``."""
    rows, worth = labelled(docs, labels, doc_id, text, label)
    return score(docs, train(rows, worth, text, label), keep, text)
