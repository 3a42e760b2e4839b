"""Document likelihoods by a gated recurrent network with a class-factored softmax, beside a unigram base.

Counts of all words of all training rows are one distributed aggregate. The commonest ``HEAD`` words (a fixed number)
are broadcast and are the network's vocabulary, by rank in groups and classes of groups balanced by frequency: a word's
probability is that of its class, times that of its group in the class, times that of the word in its group, all given
the state. All other words form one more class, within which counts with add-one smoothing decide; they meet their
counts in a join, so nothing that grows with the vocabulary is sent to every task.

The network learns by truncated backpropagation: tasks train on their own part of the training rows, each row in one
of ``ROUNDS`` rounds, and their weights are averaged between rounds. Scoring carries the state across windows, so a
document of any length is scored whole. Words are told apart by 64-bit keys.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, named, remainder, written
from .words import VISIBLE, Packed, Table

HEAD = 1 << 18
HIDDEN = 16
ROUNDS = 2
#: Slices of the training rows, one a round: with as many rounds, every row is learnt from once.
TRAIN = ROUNDS
LANES = 2048
WINDOW = 32
TRAIN_LANES = 1024
TRAIN_WINDOW = 20
#: Tokens that are scored together, so that lanes of different length fill up.
POOL = 2_000_000
#: Words a task counts before it sends them on.
COUNTED = 1_000_000
#: Tokens a task learns from before it sends its weights, which are large, and numbers in a block of word logits.
LEARNT = 6_000_000
BLOCK = 1 << 17
RATE = 0.3
#: Groups of words, in square roots of the vocabulary.
GROUPS = 1
#: Larger logits count as this, and smaller sums of chances: far beyond what is learnt, they keep numbers finite.
REACH = np.float32(60)
TINY = np.float32(1e-30)


def word_keys(texts: list) -> tuple[np.ndarray, np.ndarray]:
    packed = Packed(texts, lower=True)
    start, end = packed.runs(VISIBLE)
    return packed.keys(start, end), packed.counts(start)


def word_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(key, c) over all rows; each task adds up its words before they are shuffled."""

    def work(batches: Iterator[list]) -> Iterator[dict]:
        table, total, names = Table(), np.zeros(1024, np.int64), []

        def flush() -> dict:
            keys = np.concatenate(names) if names else np.empty(0, np.uint64)
            return {"key": keys.view(np.int64), "c": total[: table.size]}

        for (column,) in batches:
            keys, n = np.unique(word_keys(column.to_pylist())[0], return_counts=True)
            slots = table.find(keys)
            new = keys[slots < 0]
            if table.size + len(new) > len(total):
                total = np.append(total, np.zeros(max(len(total), len(new)), np.int64))
            table.add(new)
            names.append(new)
            slots[slots < 0] = np.arange(table.size - len(new), table.size)
            total[slots] += n
            if table.size > COUNTED:
                yield flush()
                table, total, names = Table(), np.zeros(1024, np.int64), []
        yield flush()

    return map_rows(texts, [text], "key long, c long", work).groupBy("key").agg(F.sum("c").alias("c"))


class Vocabulary:
    """The broadcast head: word keys by falling count. Number 0 is the end of a document."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, ends: int, tokens: int, distinct: int):
        self.keys, self.counts, self.ends, self.tokens, self.distinct = keys, counts, ends, tokens, distinct
        self.words = len(keys) + 1  # of the network, with the end
        inside = ends + int(counts[: self.words - 1].sum())
        self.rest_total = (tokens - inside) + (distinct - self.words) + 1
        self.table: Table | None = None

    def __getstate__(self):
        return self.__dict__ | {"table": None}

    def number(self, keys: np.ndarray) -> np.ndarray:
        """1, 2, ... by falling count; -1 beyond the head."""
        if self.table is None:
            self.table = Table(len(self.keys))
            self.table.add(self.keys)
        found = self.table.find(keys).astype(np.int64)
        return np.where(found >= 0, found + 1, -1)

    def frequencies(self) -> np.ndarray:
        """Of the network's words, and of all others together."""
        own = np.append(float(self.ends), self.counts[: self.words - 1].astype(float))
        return np.append(own, max(self.tokens - own.sum(), 0.0)) + 1.0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def class_cuts(frequencies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of about ``GROUPS * sqrt(V)`` groups of neighbouring words (and V), and first groups of classes of
    neighbouring groups (and their number), balanced so that for words as frequent as 1 / rank the classes, the
    groups met in them and the words met in those are fewest together."""

    def bounds(weights: np.ndarray, parts: int) -> np.ndarray:
        before = np.cumsum(weights) - weights
        number = np.floor(before * (max(1, parts) / weights.sum()))
        return np.append(np.flatnonzero(np.diff(number, prepend=-1.0)), len(weights))

    words = bounds(np.cbrt(frequencies), int(GROUPS * len(frequencies) ** 0.5))
    groups = np.add.reduceat(frequencies, words[:-1])
    return words, bounds(np.sqrt(groups), int(len(groups) ** 0.5))


class Network:
    """Weights by name. A word's ``embed`` goes through ``input`` into the update, the reset and the candidate, beside
    the state through ``back``. ``classes``, ``groups`` and ``words`` hold a row of state weights and a bias for each
    child of the root, of a class and of a group; words from the last cut on are of the rest, the root's last child."""

    NAMES = ("embed", "input", "back", "bias", "classes", "groups", "words")

    def __init__(self, weights: dict[str, np.ndarray], cuts: tuple[np.ndarray, np.ndarray]):
        self.w, self.cuts = weights, cuts
        self.words = len(weights["words"])
        self.root = np.array([0, len(weights["classes"])])

    def __getstate__(self):
        """Sent with the large tables at half precision, their biases (the last column) whole."""
        sent = {n: (w[:, :-1].astype("<f2"), w[:, -1].copy()) if n in ("classes", "groups", "words") else w.astype("<f2") if n == "embed" else w for n, w in self.w.items()}
        return {"w": sent, "cuts": self.cuts}

    def __setstate__(self, state: dict):
        whole = lambda w: np.concatenate([w[0].astype(np.float32), w[1][:, None]], axis=1) if isinstance(w, tuple) else w.astype(np.float32)
        self.__init__({n: whole(w) for n, w in state["w"].items()}, state["cuts"])

    @staticmethod
    def start(frequencies: np.ndarray, hidden: int = HIDDEN) -> "Network":
        """Small random inputs; the biases alone already give the unigram model."""
        chance = np.random.default_rng(11)
        cuts = class_cuts(frequencies[:-1])
        by_group = np.add.reduceat(frequencies[:-1], cuts[0][:-1])
        by_class = np.append(np.add.reduceat(by_group, cuts[1][:-1]), frequencies[-1])
        small = lambda *shape, by=0.1: (chance.standard_normal(shape, np.float32) * np.float32(by))

        def table(counts: np.ndarray) -> np.ndarray:
            return np.concatenate([small(len(counts), hidden), np.log(counts / counts.sum()).astype(np.float32)[:, None]], axis=1)

        return Network({
            "embed": small(len(frequencies), hidden, by=0.3),
            "input": small(hidden, 3 * hidden, by=0.3),
            "back": small(hidden, 3 * hidden, by=0.3),
            "bias": np.zeros(3 * hidden, np.float32),
            "classes": table(by_class),
            "groups": table(by_group),
            "words": table(frequencies[:-1]),
        }, cuts)

    def memory(self) -> dict[str, np.ndarray]:
        """What learning remembers of past gradients: a number for each row of the large tables, for each weight else."""
        return {n: np.full(len(w) if n in ("embed", "classes", "groups", "words") else w.shape, 0.1, np.float32) for n, w in self.w.items()}

    def change(self, since: "Network") -> bytes:
        """What was learnt since, at half precision."""
        return b"".join((self.w[n] - since.w[n]).astype("<f2").tobytes() for n in self.NAMES)

    def changed(self, by: np.ndarray) -> "Network":
        """This network after a change, in place."""
        at = 0
        for n in self.NAMES:
            size = self.w[n].size
            self.w[n] += by[at : at + size].reshape(self.w[n].shape)
            at += size
        return self

    def forward(self, tokens: np.ndarray, h: np.ndarray, keep: bool = False):
        """States before each token of a window (time x lane), the state after it, and what learning needs."""
        w, size = self.w, h.shape[1]
        steps, lanes = tokens.shape
        states = np.empty((steps, lanes, size), w["back"].dtype)
        into = (w["embed"][tokens.reshape(-1)] @ w["input"] + w["bias"]).reshape(steps, lanes, 3 * size)
        back, memory = w["back"], []
        for t in range(steps):
            states[t] = h
            x, y = into[t], h @ back
            both = _sigmoid(x[:, : 2 * size] + y[:, : 2 * size])
            z, r = both[:, :size], both[:, size:]
            new = np.tanh(x[:, 2 * size :] + r * y[:, 2 * size :])
            after = new + z * (h - new)
            after[tokens[t] == 0] = 0  # a new document begins
            if keep:
                memory.append((z, r, new, y[:, 2 * size :]))
            h = after
        return states, h, memory

    def _level(self, name: str, states: np.ndarray, parent: np.ndarray | None, child: np.ndarray, cuts: np.ndarray, grad: dict | None):
        """Natural log probabilities of children given their parents; all sorted by child. The children of parent k
        are ``cuts[k]:cuts[k + 1]``. With ``grad`` also the gradient by the states, and the rows of the table that were
        met with theirs."""
        table = self.w[name]
        n = len(child)
        firsts = np.array([0]) if parent is None else np.flatnonzero(np.diff(parent, prepend=-1))
        met = np.zeros(1, np.int64) if parent is None else parent[firsts]
        low, high = cuts[met], cuts[met + 1]
        total = np.empty(n, states.dtype)
        at = np.append(0, np.cumsum(high - low))
        whole = 2 * int(at[-1]) > len(table)  # most rows were met: the rest takes part with a gradient of zero
        if grad is not None and whole:
            by_row = np.zeros((len(table), states.shape[1]), states.dtype)
            by_state = np.empty((n, states.shape[1]), states.dtype)
            at = low
        elif grad is not None:
            crowded = bool(((np.append(firsts[1:], n) - firsts) * (high - low) > BLOCK).any())
            by_row = (np.zeros if crowded else np.empty)((int(at[-1]), states.shape[1]), states.dtype)
            by_state = np.empty((n, states.shape[1]), states.dtype)
        spans = zip(firsts.tolist(), [*firsts[1:].tolist(), n], low.tolist(), high.tolist(), at.tolist())
        for start, end, first, last, place in spans:
            rows = table[first:last]
            step = max(1, BLOCK // (last - first))
            for a in range(start, end, step):
                b = min(a + step, end)
                held = states[a:b]
                chance = held @ rows.T
                np.minimum(chance, REACH, out=chance)
                np.exp(chance, out=chance)
                own = np.add.reduce(chance, axis=1, out=total[a:b])
                np.maximum(own, TINY, out=own)
                if grad is not None:
                    part = by_row[place : place + last - first]
                    if b - a == end - start:  # all of the span at once
                        np.matmul(chance.T, held / -own[:, None], out=part)
                    else:
                        part -= chance.T @ (held / own[:, None])
                    np.matmul(chance, rows, out=by_state[a:b])
        chosen = table[child]
        logit = np.einsum("td,td->t", chosen, states)
        np.minimum(logit, REACH, out=logit)
        out = logit - np.log(total)
        if grad is None:
            return out, None
        starts = np.flatnonzero(np.diff(child, prepend=-1))
        seen = child[starts]
        span = np.searchsorted(low, seen, side="right") - 1
        by_row[at[span] + seen - low[span]] += np.add.reduceat(states, starts)
        by_state /= -total[:, None]
        by_state += chosen
        grad[name] = (None, None, by_row) if whole else (low, high, by_row)
        return out, by_state[:, :-1]

    def log_likelihood(self, states: np.ndarray, targets: np.ndarray, grad: dict | None = None):
        """Natural log probabilities of the targets given the states: of the class, times that of the group in the class,
        times that of the word in the group. With ``grad`` also the gradient of their sum by the states."""
        order = np.argsort(targets, kind="stable")
        sorted_ = targets[order]
        held = np.empty((len(order), states.shape[1] + 1), states.dtype)
        held[:, :-1], held[:, -1] = states[order], 1
        inside = int(np.searchsorted(sorted_, self.words))  # the rest comes last
        group = np.searchsorted(self.cuts[0], sorted_[:inside], side="right") - 1
        kind = np.full(len(order), self.root[1] - 1)
        kind[:inside] = np.searchsorted(self.cuts[1], group, side="right") - 1
        made, by_state = self._level("classes", held, None, kind, self.root, grad)
        if inside:
            for name, parent, child, cuts in (("groups", kind[:inside], group, self.cuts[1]), ("words", group, sorted_[:inside], self.cuts[0])):
                more, by_more = self._level(name, held[:inside], parent, child, cuts, grad)
                made[:inside] += more
                if grad is not None:
                    by_state[:inside] += by_more
        out = np.empty_like(made)
        out[order] = made
        if grad is None:
            return out, None
        back = np.empty_like(by_state)
        back[order] = by_state
        return out, back

    def learn(self, tokens: np.ndarray, h: np.ndarray, memory: dict) -> np.ndarray:
        """One step of truncated backpropagation through a window; the state after it."""
        w, size = self.w, h.shape[1]
        steps, lanes = tokens.shape
        states, after, past = self.forward(tokens, h, keep=True)
        grad: dict = {}
        _, by_state = self.log_likelihood(states.reshape(-1, size), tokens.reshape(-1), grad)
        by_state = by_state.reshape(steps, lanes, size)
        by_gate = np.empty((steps, lanes, 3 * size), states.dtype)
        by_back = np.empty((steps, lanes, 3 * size), states.dtype)
        carried = np.zeros((lanes, size), states.dtype)
        for t in range(steps - 1, -1, -1):
            z, r, new, y = past[t]
            own = states[t]
            d = carried * (tokens[t] != 0)[:, None]
            d_new = d * (1 - z) * (1 - new**2)
            by_gate[t, :, :size] = d * (own - new) * z * (1 - z)
            by_gate[t, :, size : 2 * size] = d_new * y * r * (1 - r)
            by_gate[t, :, 2 * size :] = d_new
            by_back[t, :, : 2 * size] = by_gate[t, :, : 2 * size]
            np.multiply(d_new, r, out=by_back[t, :, 2 * size :])
            carried = d * z + by_back[t] @ w["back"].T + by_state[t]
        flat, ids = by_gate.reshape(-1, 3 * size), tokens.reshape(-1)
        order = np.argsort(ids, kind="stable")
        sorted_ = ids[order]
        starts = np.flatnonzero(np.diff(sorted_, prepend=-1))
        dense = {
            "input": w["embed"][ids].T @ flat,
            "back": states.reshape(-1, size).T @ by_back.reshape(-1, 3 * size),
            "bias": flat.sum(axis=0),
        }
        by_embed = np.add.reduceat((flat @ w["input"].T)[order], starts)
        scale = np.array(1.0 / tokens.size**0.5, states.dtype)
        for n, g in dense.items():
            g *= scale
            np.clip(g, -5, 5, out=g)
            memory[n] += g * g
            w[n] += g * RATE / np.sqrt(memory[n] + 1e-6)
        self._descend("embed", memory, sorted_[starts], by_embed, scale)
        for name, (low, high, by_row) in grad.items():
            if low is None:
                rows = slice(None)
            else:
                width = high - low
                rows = np.repeat(low - (np.cumsum(width) - width), width) + np.arange(len(by_row))
            self._descend(name, memory, rows, by_row, scale)
        return after

    def _descend(self, name: str, memory: dict, rows, by_row: np.ndarray, scale: np.ndarray) -> None:
        """Move rows of a large table along their gradient, at a rate that falls with the row's past gradients."""
        by_row *= scale
        past = memory[name][rows] + np.einsum("rd,rd->r", by_row, by_row) / by_row.shape[1]
        memory[name][rows] = past
        by_row *= (RATE / np.sqrt(past + 1e-6))[:, None]
        self.w[name][rows] += by_row


def lanes_of(lengths: np.ndarray, lanes: int) -> tuple[list[list[int]], np.ndarray]:
    """Documents dealt to lanes, the longest first and each to the shortest lane; lanes by falling length."""
    heap = [(0, k) for k in range(min(lanes, len(lengths)))]
    held: list[list[int]] = [[] for _ in heap]
    for doc in np.argsort(-lengths, kind="stable").tolist():
        load, k = heapq.heappop(heap)
        held[k].append(doc)
        heapq.heappush(heap, (load + int(lengths[doc]), k))
    load = np.zeros(len(held), np.int64)
    for n, k in heap:
        load[k] = n
    order = np.argsort(-load, kind="stable")
    return [held[k] for k in order.tolist()], load[order]


def windows(lengths: np.ndarray, lanes: int, window: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of tokens window by window (time x lane; the first lanes only, as the others end), and whether
    each is real: a lane that ends within the window is filled up with its last place."""
    held, load = lanes_of(lengths, lanes)
    begin = np.cumsum(lengths) - lengths
    streams = [np.concatenate([np.arange(begin[d], begin[d] + lengths[d]) for d in docs]) for docs in held]
    for t in range(0, int(load[0]) if len(load) else 0, window):
        some = int(np.searchsorted(-load, -t, side="left"))
        at = np.empty((window, some), np.int64)
        real = np.ones((window, some), bool)
        for k in range(some):
            part = streams[k][t : t + window]
            at[: len(part), k] = part
            if len(part) < window:
                at[len(part) :, k] = streams[k][-1]
                real[len(part) :, k] = False
        yield at, real


def train(network: Network, tokens: np.ndarray, lengths: np.ndarray) -> None:
    """One pass over documents in mixed order, as one stream that is cut into lanes of equal length."""
    begin = np.cumsum(lengths) - lengths
    order = np.random.default_rng(5).permutation(len(lengths))
    stream = np.concatenate([tokens[begin[d] : begin[d] + lengths[d]] for d in order])
    lanes = max(1, min(TRAIN_LANES, len(stream) // TRAIN_WINDOW))
    steps = len(stream) // lanes
    held = stream[: lanes * steps].reshape(lanes, steps).T
    memory = network.memory()
    h = np.zeros((lanes, network.w["back"].shape[0]), np.float32)
    for t in range(0, steps, TRAIN_WINDOW):
        h = network.learn(held[t : t + TRAIN_WINDOW], h, memory)


def score(network: Network, tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Natural log probability of each token's class and word, states carried across windows."""
    out = np.empty(len(tokens), np.float32)
    h = np.zeros((LANES, network.w["back"].shape[0]), np.float32)
    for at, real in windows(lengths, LANES, WINDOW):
        own = tokens[at]
        states, h, _ = network.forward(own, h[: at.shape[1]])
        made, _ = network.log_likelihood(states[real], own[real])
        out[at[real]] = made
    return out


def _numbered(vocabulary: Vocabulary, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all tokens with an end after each document, their keys (0 for an end), and tokens a document."""
    keys, counts = word_keys(texts)
    ends = np.cumsum(counts + 1) - 1
    number = np.zeros(len(keys) + len(counts), np.int64)
    inside = np.ones(len(number), bool)
    inside[ends] = False
    number[inside] = vocabulary.number(keys)
    every = np.zeros(len(number), np.uint64)
    every[inside] = keys
    return number, every, counts + 1


def _for_network(vocabulary: Vocabulary, number: np.ndarray) -> np.ndarray:
    return np.where((number >= 0) & (number < vocabulary.words), number, vocabulary.words)


def trained(texts: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS, share: int = TRAIN) -> Network:
    """Weights averaged over tasks after each round; each round takes another ``1 / share`` of the rows.

    Rows, not texts, are dealt to slices, so copies of a text are spread; the slices are written, so rounds agree.
    """
    spark = texts.sparkSession
    sliced = written(texts.select("text", F.pmod(F.monotonically_increasing_id(), F.lit(share)).alias("slice")), "lm-slices")
    network = Network.start(vocabulary.frequencies())
    words = spark.sparkContext.broadcast(vocabulary)
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast(network)
        own = sliced.where(F.col("slice") == turn % share).coalesce(max(1, -(-vocabulary.tokens // (share * LEARNT))))

        def work(batches: Iterator[list]) -> Iterator[dict]:
            held = network_of(sent.value)
            tokens, lengths, seen = [], [], 0

            def fit() -> None:
                train(held, np.concatenate(tokens), np.concatenate(lengths))
                tokens.clear(), lengths.clear()

            waiting = 0
            for (column,) in batches:
                number, _, n = _numbered(words.value, column.to_pylist())
                tokens.append(_for_network(words.value, number))
                lengths.append(n)
                seen, waiting = seen + len(number), waiting + len(number)
                if waiting > POOL // 4:
                    fit()
                    waiting = 0
            if waiting:
                fit()
            if seen:
                yield {"weights": [held.change(sent.value)], "n": [seen]}

        network = _averaged(map_rows(own, ["text"], "weights binary, n long", work), network)
        sent.destroy()
    return network


def network_of(sent: Network) -> Network:
    return Network({n: v.copy() for n, v in sent.w.items()}, sent.cuts)


def _averaged(rows: DataFrame, network: Network) -> Network:
    """The network changed by the weighted mean of changes, added up in tasks until one is left."""

    def work(batches: Iterator[list]) -> Iterator[dict]:
        total, seen = None, 0
        for weights, n in batches:
            for raw, k in zip(weights.to_pylist(), n.to_pylist()):
                part = np.frombuffer(raw, "<f2").astype(np.float32)
                part *= k
                total, seen = part if total is None else np.add(total, part, out=total), seen + k
        if seen:
            yield {"weights": [(total / seen).astype("<f2").tobytes()], "n": [seen]}

    rows = written(rows, "network")
    left = rows.count()
    while left > 1:
        rows = written(map_rows(rows.repartition(-(-left // 8)), ["weights", "n"], "weights binary, n long", work), "network")
        left = min(-(-left // 8), rows.count())
    last = rows.first()
    return network if last is None else network.changed(np.frombuffer(last.weights, "<f2"))


def _commonest(counts: DataFrame, most: int) -> DataFrame:
    """The ``most`` words (key, c) of the greatest counts, ties by key.

    How often each count occurs, a short table, tells the count that the last of them has; only words that reach it are
    ordered, so the task that merges them reads about as many as it returns, however many words there are."""
    often = counts.groupBy("c").agg(F.count("*").alias("n"))
    down = Window.orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, 0)
    least = often.withColumn("so_far", F.sum("n").over(down)).where(F.col("so_far") >= most).agg(F.max("c")).first()[0]
    return counts.where(F.col("c") >= (least or 0)).orderBy(F.desc("c"), "key").limit(most)


def lm_scores(
    docs: DataFrame,
    keep: Sequence[str] = ("doc_id",),
    doc_id: str = "doc_id",
    text: str = "text",
    modulus: int = 7,
    held: int = 2,
    rounds: int = ROUNDS,
    share: int = TRAIN,
) -> DataFrame:
    """``keep``, held_out, n_tokens, n_known, train_tokens, base_score and score of every row's whole text.

    Rows with crc32(id as text) mod ``modulus`` equal to ``held`` are not learnt from. A null text is empty and
    has its end alone; a null id counts as the empty text. Scores are log10 probabilities. Without training rows
    only the add-one terms are left. Kept columns named like a result give way to it.
    """
    made = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    keep = [c for c in dict.fromkeys(keep) if c not in made]
    spark = docs.sparkSession
    out_of_training = remainder(doc_id, modulus) == held
    learnt = docs.where(~out_of_training).select(F.coalesce(named(text), F.lit("")).alias("text"))
    counts = written(word_counts(learnt), "lm-counts")
    ends = learnt.select(F.lit(1)).count()
    words, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    tokens, distinct = words + ends, distinct + (1 if ends else 0)
    head = _commonest(counts, HEAD).toArrow()
    vocabulary = Vocabulary(
        head["key"].to_numpy().astype(np.int64).view(np.uint64), head["c"].to_numpy().astype(np.int64), ends, tokens, max(distinct, 1)
    )
    network = trained(learnt, vocabulary, rounds, share)
    rows = docs.select(*[named(c).alias(f"k{i}") for i, c in enumerate(keep)], out_of_training.alias("held_out"), F.monotonically_increasing_id().alias("row"), F.coalesce(named(text), F.lit("")).alias("text"))
    scored = written(_scored(rows, vocabulary, network), "lm-scored")

    # Words beyond the head meet their counts; a row's are added up per task before they are shuffled.
    known = scored.where(F.size("tail") > 0).select("row", F.explode("tail").alias("key")).groupBy("row", "key").agg(F.count("*").alias("n"))
    found = known.join(counts, "key", "left").groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(1.0))).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known")
    )
    joined = scored.drop("tail", "text").join(found, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return joined.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("model") + more).alias("score"),
    )


def _scored(rows: DataFrame, vocabulary: Vocabulary, network: Network) -> DataFrame:
    """``rows`` with token counts, the sums over words of the head, and the keys of the others in ``tail``."""
    from pyspark.sql.types import StructType

    sc = rows.sparkSession.sparkContext
    words, sent = sc.broadcast(vocabulary), sc.broadcast(network)
    kept = [f for f in rows.schema.fields if f.name != "text"]
    added = StructType.fromDDL("n_tokens long, n_known long, base double, model double, tail array<long>")
    schema = StructType(kept + added.fields)
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool: list = []
        size = 0
        for batch in batches:
            if batch.num_rows:
                number, keys, n = _numbered(words.value, batch.column(len(kept)).to_pylist())
                pool.append((batch.columns[: len(kept)], number, keys, n))
                size += len(number)
                if size > POOL:
                    yield finish(pool)
                    pool, size = [], 0
        if pool:
            yield finish(pool)

    def finish(pool: list) -> pa.RecordBatch:
        own: Vocabulary = words.value
        number = np.concatenate([p[1] for p in pool])
        keys = np.concatenate([p[2] for p in pool])
        n = np.concatenate([p[3] for p in pool])
        low = np.cumsum(n) - n
        c = np.zeros(len(number))
        c[number == 0] = own.ends
        in_head = number > 0
        c[in_head] = own.counts[number[in_head] - 1]
        tail = number < 0
        log_c = np.log10(c + 1)
        base = np.add.reduceat(log_c, low) - n * np.log10(own.tokens + own.distinct + 1)
        inner = _for_network(own, number)
        made = score(sent.value, inner, n).astype(np.float64) / np.log(10)
        made += np.where(inner == own.words, log_c - np.log10(max(own.rest_total, 1)), 0.0)
        known = np.add.reduceat((c > 0).astype(np.int64), low)
        tails = np.add.reduceat(tail.astype(np.int64), low)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(tails)), pa.int32()), pa.array(keys[tail].view(np.int64)))
        columns = [pa.concat_arrays([p[0][k] for p in pool]) for k in range(len(kept))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(n), pa.array(known), pa.array(base), pa.array(np.add.reduceat(made, low)), lists], names)

    return rows.mapInArrow(run, schema)
