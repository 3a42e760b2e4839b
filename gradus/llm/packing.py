"""Best-fit packing of token sequences, improved by a grouping genetic algorithm on islands.

Documents longer than a sequence are cut into whole sequences and one shorter first piece; only the shorter
pieces, one per document at most, have to be packed. They are dealt into shards of about ``SHARD`` documents by
their row's hash, whatever their source or text, so no shard is hot. In each shard several islands evolve a few
packings: a crossover injects the well-filled bins of one parent whole, drops the bins of the other that hold a
document twice, and puts the displaced documents back by best fit. Between epochs each island takes in the elite
of its neighbour. A shard leaves one bin or two unfilled at most.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_columns, map_rows, named, written
from .tokens import by_chars, encoder

SHARD = 8192
ISLANDS = 2
EPOCHS = 2
BREEDINGS = 6
POPULATION = 4
TASKS = 4096


class Bins:
    """Bins being filled by best fit: the least room that suffices wins, found by the lowest set bit."""

    def __init__(self, size: int):
        self.size = size
        self.bins: list[list[int]] = []
        self.room: list[int] = []
        self.by_room: dict[int, list[int]] = {}
        self.rooms = 0  # bit r: some open bin has room r

    def open(self, items: list[int], room: int) -> None:
        self.bins.append(items)
        self.room.append(room)
        self._file(len(self.bins) - 1, room)

    def _file(self, at: int, room: int) -> None:
        if room:
            self.by_room.setdefault(room, []).append(at)
            self.rooms |= 1 << room

    def put(self, item: int, length: int) -> None:
        fits = self.rooms >> length
        if not fits:
            self.open([item], self.size - length)
            return
        room = length + (fits & -fits).bit_length() - 1
        held = self.by_room[room]
        at = held.pop()
        if not held:
            self.rooms &= ~(1 << room)
        self.bins[at].append(item)
        self.room[at] = room - length
        self._file(at, room - length)


def best_fit(lengths: list[int], order: list[int], size: int, bins: Bins | None = None) -> Bins:
    bins = bins or Bins(size)
    for item in order:
        bins.put(item, lengths[item])
    return bins


def fitness(bins: Bins) -> tuple[int, float]:
    """Fewer bins first; then bins that are very full beside some that are nearly empty."""
    return -len(bins.bins), sum((bins.size - r) ** 2 for r in bins.room)


def crossed(mother: list[list[int]], father: list[list[int]], lengths: list[int], size: int, chance: random.Random) -> Bins:
    """The mother's packing with some well-filled bins of the father injected whole."""
    filled = [b for b in father if sum(lengths[i] for i in b) >= 0.98 * size]
    chosen = [b for b in filled if chance.random() < 0.5]
    injected = {i for b in chosen for i in b}
    child, displaced = Bins(size), []
    for b in chosen:
        child.open(list(b), size - sum(lengths[i] for i in b))
    for b in mother:
        if injected.isdisjoint(b):
            fill = sum(lengths[i] for i in b)
            if fill >= 0.98 * size or chance.random() < 0.5:
                child.open(list(b), size - fill)
                continue
        displaced += [i for i in b if i not in injected]
    displaced.sort(key=lambda i: -lengths[i])
    return best_fit(lengths, displaced, size, child)


def evolved(lengths: list[int], population: list[list[list[int]]], size: int, seed: int, breedings: int, most: int) -> list[list[list[int]]]:
    """The population after some breedings, best first."""
    chance = random.Random(seed)
    falling = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    made = [best_fit(lengths, falling, size)] if not population else []
    for items in population:
        bins = Bins(size)
        for b in items:
            bins.open(list(b), size - sum(lengths[i] for i in b))
        made.append(bins)
    while len(made) < most:
        # Nearly falling: what is close in length may change places.
        order = sorted(falling, key=lambda i: -lengths[i] * (1 + 0.1 * chance.random()))
        made.append(best_fit(lengths, order, size))
    bound = -(-sum(lengths) // size)
    ranked = sorted(made, key=fitness, reverse=True)
    for _ in range(breedings):
        if len(ranked[0].bins) == bound:
            break
        mother, father = chance.sample(ranked, 2) if len(ranked) > 1 else ranked * 2
        ranked = sorted([*ranked, crossed(mother.bins, father.bins, lengths, size, chance)], key=fitness, reverse=True)[:most]
    return [b.bins for b in ranked]


def _flat(population: list[list[list[int]]], n: int) -> list[list[int]]:
    """Each packing as the bin of every item."""
    out = []
    for bins in population:
        at = [0] * n
        for k, items in enumerate(bins):
            for i in items:
                at[i] = k
        out.append(at)
    return out


def _grouped(at: Sequence[int]) -> list[list[int]]:
    bins: list[list[int]] = [[] for _ in range(max(at, default=-1) + 1)]
    for i, k in enumerate(at):
        bins[k].append(i)
    return [b for b in bins if b]


def encoded(docs: DataFrame, path: str, keep: Sequence[str], text: str, end_id: int, size: int) -> DataFrame:
    """Rows with a number each, their token count and the checksum of each piece, written once."""

    def work(texts):
        texts = texts.to_pylist()
        lengths, checks = np.zeros(len(texts), np.int64), []
        for low, high in by_chars(texts):
            ids, counts = encoder(path, True).batch(texts[low:high])
            ids, ends = ids.astype("<u4"), np.cumsum(counts)
            lengths[low:high] = counts + 1
            for a, b in zip(ends - counts, ends):
                own = np.append(ids[a:b], np.uint32(end_id))
                first = len(own) % size or size
                cuts = [0, *range(first, len(own) + 1, size)] if len(own) > first else [0, first]
                checks.append([zlib.crc32(own[x:y].tobytes()) for x, y in zip(cuts, cuts[1:])])
        return lengths, checks

    numbered = docs.select(*[named(c) for c in dict.fromkeys([*keep, text])], F.monotonically_increasing_id().alias("__row"))
    return written(map_columns(numbered, [*keep, "__row"], [text], "__tokens long, __checks array<long>", work), "packing")


def pack(
    docs: DataFrame,
    path: str,
    keep: Sequence[str] = ("doc_id",),
    text: str = "text",
    end_id: int = 0,
    size: int = 2048,
    shard: int = SHARD,
    islands: int = ISLANDS,
    epochs: int = EPOCHS,
    breedings: int = BREEDINGS,
    population: int = POPULATION,
) -> DataFrame:
    """One row per piece: ``keep``, piece, start, length, ids_crc32, sequence_id and offset.

    Every row is packed, repeated ones too; a null or empty text is its end id alone. A document of more than
    ``size`` ids is cut into pieces of ``size``, of which the first may be shorter; no other is cut. Kept columns
    named like a result are left out. An empty table gives no rows.
    """
    out = ("piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    keep = [c for c in keep if c not in out]
    rows = encoded(docs, path, keep, text, end_id, size)
    shards = max(1, -(-rows.count() // shard))
    dealt = (
        rows.select(F.pmod(F.xxhash64("__row"), F.lit(shards)).alias("shard"), F.struct("__row", "__tokens").alias("doc"))
        .groupBy("shard")
        .agg(F.array_sort(F.collect_list("doc")).alias("docs"))
        .select("shard", F.col("docs.__row").alias("rows"), F.col("docs.__tokens").alias("tokens"))
    )
    dealt = written(dealt, "packing-shards")
    state = dealt.select(
        "shard",
        F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"),
        F.transform("tokens", lambda n: n % size).alias("lengths"),
        F.lit(None).cast("array<array<int>>").alias("packings"),
    )
    for epoch in range(epochs):
        # Few bytes, much work: one island a task, up to a fixed number of tasks.
        spread = state.repartition(min(shards * islands, TASKS), "shard", "island")
        state = written(_epoch(spread, epoch, size, breedings, population), "packing-epoch")
        # The elite of the neighbouring island takes the place of the worst.
        ring = Window.partitionBy("shard").orderBy("island")
        around = Window.partitionBy("shard")
        elite = F.coalesce(F.lag(F.element_at("packings", 1)).over(ring), F.max_by(F.element_at("packings", 1), "island").over(around))
        state = state.withColumn("packings", F.concat(F.array(elite), F.slice("packings", 1, max(1, population - 1))))
    best = state.groupBy("shard").agg(F.max_by("packings", F.struct("bins", "filled")).alias("packings"))
    final = _placed(dealt.join(best, "shard"), size)
    pieces = (
        rows.join(final, "__row")
        .withColumn("__first", F.when(F.col("__tokens") % size == 0, size).otherwise(F.col("__tokens") % size))
        .select(*[named(c) for c in keep], "__tokens", "__first", "bin", "place", "whole", F.posexplode("__checks").alias("piece", "ids_crc32"))
    )
    start = F.when(F.col("piece") == 0, F.lit(0)).otherwise(F.col("__first") + (F.col("piece") - 1) * size).cast("long")
    packed = (F.col("piece") == 0) & (F.col("__first") < size)
    return pieces.select(
        *[named(c) for c in keep],
        F.col("piece"),
        start.alias("start"),
        F.when(F.col("piece") == 0, F.col("__first")).otherwise(F.lit(size)).cast("long").alias("length"),
        "ids_crc32",
        F.when(packed, F.col("bin")).otherwise(F.col("whole") + F.col("piece")).alias("sequence_id"),
        F.when(packed, F.col("place")).otherwise(F.lit(0)).cast("long").alias("offset"),
    )


def _epoch(state: DataFrame, epoch: int, size: int, breedings: int, population: int) -> DataFrame:
    def work(batches):
        for shards, isles, lengths, packings in batches:
            for k in range(len(shards)):
                own, found = lengths[k].as_py(), packings[k].as_py()
                packed = [i for i, n in enumerate(own) if n]  # documents of whole sequences have nothing to pack
                short = [own[i] for i in packed]
                seed = (shards[k].as_py() * 1009 + isles[k].as_py()) * 1009 + epoch
                made = evolved(short, [_grouped(p) for p in found or []], size, seed, breedings, population)
                fill = fitness(best_fit(short, [], size, _bins(made[0], short, size)))
                yield {
                    "shard": [shards[k].as_py()],
                    "island": [isles[k].as_py()],
                    "lengths": [own],
                    "packings": [_flat(made, len(short))],
                    "bins": [fill[0]],
                    "filled": [int(fill[1])],
                }

    out = "shard long, island int, lengths array<long>, packings array<array<int>>, bins long, filled long"
    return map_rows(state, ["shard", "island", "lengths", "packings"], out, work)


def _bins(items: list[list[int]], lengths: list[int], size: int) -> Bins:
    bins = Bins(size)
    for b in items:
        bins.open(list(b), size - sum(lengths[i] for i in b))
    return bins


def _placed(best: DataFrame, size: int) -> DataFrame:
    """Each row's bin and place in it, and the number before its first whole sequence's."""

    def work(batches):
        for shards, rows, tokens, packings in batches:
            for k in range(len(shards)):
                base = shards[k].as_py() << 32
                own, counts, bins = rows[k].as_py(), tokens[k].as_py(), packings[k].as_py()
                choices = [_grouped(p) for p in bins]
                short = [i for i, n in enumerate(counts) if n % size]
                lengths = [counts[i] % size for i in short]
                items = max((_bins(c, lengths, size) for c in choices), key=fitness).bins
                at, place = [0] * len(own), [0] * len(own)
                for number, members in enumerate(items):
                    fill = 0
                    for i in sorted(members):
                        at[short[i]], place[short[i]] = base + number, fill
                        fill += lengths[i]
                whole, following = [], base + len(items)
                for n in counts:
                    # The shorter first piece is number 0, so whole ones count from 1; without one, from 0.
                    whole.append(following - (1 if n % size else 0))
                    following += n // size
                yield {"__row": own, "bin": at, "place": place, "whole": whole}

    return map_rows(best, ["shard", "rows", "tokens", "packings"], "__row long, bin long, place long, whole long", work)
