"""Exact largest inner products by a dual-tree search over cover trees.

Vectors are dealt to shards, and queries to blocks, by their nearest pivot; pivots come from a bounded sample and
decide nothing but where a vector lies. A crowded pivot is split by hash, so no shard grows with a hot vector.
Every shard and block holds a cover tree: a node knows its centre and the radius that covers its points.

A pair of nodes is pruned if the greatest inner product its radii allow is below the worst k-th score of the
queries in its node. Each block first searches its most promising shards; the k-th scores found there prune
whole shards before anything is sent to them, and node pairs within the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_columns, map_rows, named, written
from .hard_negatives import best_products

SHARD = 4096
BLOCK = 1024
LEAF = 128
#: Most pivots, a sample of the vectors by their id's hash.
PIVOTS = 1024
#: Shards each block searches first.
FIRST = 2
GROUP = 256
#: Blocks that meet a shard in one task.
MEETING = 64
#: Largest component: scores then stay exact in 64 bits.
LARGEST = 1 << 24


class Tree(NamedTuple):
    """Nodes in depth-first order over points that are sorted likewise: node k has the points low[k]:high[k]."""

    centre: np.ndarray
    radius: np.ndarray
    low: np.ndarray
    high: np.ndarray
    children: list[list[int]]


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, Tree]:
    """An order of the points and the tree over them. Each level covers a node's points by balls of at most half
    its radius around points of its own, greedily the farthest first."""
    order = np.arange(len(points))
    centre: list[np.ndarray] = []
    radius: list[float] = []
    low: list[int] = []
    high: list[int] = []
    children: list[list[int]] = []
    work = [(0, len(points), -1)]
    while work:
        a, b, parent = work.pop()
        own = order[a:b]
        x = points[own].astype(np.float64)
        middle = x.mean(axis=0)
        gap = np.sqrt(((x - middle) ** 2).sum(axis=1))
        reach = float(gap.max(initial=0.0))
        node = len(centre)
        centre.append(middle)
        radius.append(reach * (1 + 1e-9) + 1e-9)
        low.append(a)
        high.append(b)
        children.append([])
        if parent >= 0:
            children[parent].append(node)
        if b - a <= leaf or reach <= 1e-9:
            continue
        chosen = [int(gap.argmax())]
        near = np.sqrt(((x - x[chosen[0]]) ** 2).sum(axis=1))
        nearest = np.zeros(len(x), np.int64)
        # Balls of half the radius, as long as they are worth a node of their own.
        while near.max() > reach / 2 and len(chosen) < max(2, 2 * (b - a) // leaf):
            pick = int(near.argmax())
            gap = np.sqrt(((x - x[pick]) ** 2).sum(axis=1))
            closer = gap < near
            nearest[closer], near[closer] = len(chosen), gap[closer]
            chosen.append(pick)
        if len(chosen) == 1:
            nearest[: len(x) // 2], chosen = 1, [0, 1]
        by = np.argsort(nearest, kind="stable")
        order[a:b] = own[by]
        cuts = a + np.append(0, np.cumsum(np.bincount(nearest, minlength=len(chosen))))
        work += [(int(p), int(q), node) for p, q in zip(cuts[:-1], cuts[1:]) if q > p][::-1]
    return order, Tree(np.array(centre), np.array(radius), np.array(low), np.array(high), children)


def tree_bytes(tree: Tree) -> dict[str, list[bytes]]:
    """A tree in columns; a node's parent stands for the lists of children."""
    parent = np.full(len(tree.low), -1, np.int64)
    for node, own in enumerate(tree.children):
        parent[own] = node
    return {"nodes": [tree.centre.astype(np.float64).tobytes()], "reach": [tree.radius.astype(np.float64).tobytes()], "span": [np.stack([tree.low, tree.high, parent]).astype(np.int64).tobytes()]}


def tree_of(nodes: bytes, reach: bytes, span: bytes, width: int) -> Tree:
    radius = np.frombuffer(reach, np.float64)
    low, high, parent = np.frombuffer(span, np.int64).reshape(3, len(radius))
    children: list[list[int]] = [[] for _ in radius]
    for node, above in enumerate(parent.tolist()):
        if above >= 0:
            children[above].append(node)
    return Tree(np.frombuffer(nodes, np.float64).reshape(len(radius), width), radius, low, high, children)


class Best:
    """The k best of each query so far: greater scores first, then smaller ids."""

    def __init__(self, queries: int, k: int, least: np.ndarray | None = None):
        self.k = k
        self.score = np.full((queries, k), -(1 << 62))
        self.id = np.full((queries, k), np.iinfo(np.int64).max)
        self.worst = np.full(queries, -np.inf) if least is None else least.astype(np.float64).copy()

    def offer(self, rows: slice, ids: np.ndarray, scores: np.ndarray, own: np.ndarray) -> None:
        """Scores of some queries by candidates; a query never takes itself (``own`` are the queries' ids)."""
        good = (scores >= self.worst[rows, None]) & (own[rows, None] != ids[None, :])
        for at in np.flatnonzero(good.any(axis=1)).tolist():
            q = rows.start + at
            hit = good[at]
            score = np.append(self.score[q], scores[at, hit].astype(np.int64))
            number = np.append(self.id[q], ids[hit])
            if len(score) > 4 * self.k:  # the k best by score and whatever ties with the last
                keep = score >= np.partition(score, -self.k)[-self.k]
                score, number = score[keep], number[keep]
            top = np.lexsort((number, -score))[: self.k]
            self.score[q], self.id[q] = score[top], number[top]
            if self.id[q, -1] != np.iinfo(np.int64).max:
                self.worst[q] = max(self.worst[q], float(self.score[q, -1]))


def upper(centre: np.ndarray, radius: float, other: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """The greatest inner product of points within the radii of two centres."""
    size = np.sqrt((other**2).sum(axis=-1))
    bound = other @ centre + radius * size + reach * np.sqrt((centre**2).sum()) + radius * reach
    return bound + 1e-9 * np.abs(bound) + 1e-6


def dual_search(queries: np.ndarray, own: np.ndarray, left: Tree, points: np.ndarray, ids: np.ndarray, right: Tree, best: Best) -> int:
    """Offer all points to all queries but for pruned node pairs; the number of scores that were computed."""
    limit = float(np.abs(queries).max(initial=0)) * float(np.abs(points).max(initial=0)) * queries.shape[1]
    kind = np.float32 if limit < 2**24 else np.float64 if limit < 2**53 else np.int64
    x, y = queries.astype(kind), points.astype(kind)
    done = 0
    work = [(0, 0, np.inf)]
    while work:
        q, r, bound = work.pop()
        rows = slice(int(left.low[q]), int(left.high[q]))
        if bound < best.worst[rows].min():
            continue
        if not left.children[q] and not right.children[r]:
            span = slice(int(right.low[r]), int(right.high[r]))
            best.offer(rows, ids[span], x[rows] @ y[span].T, own)
            done += (rows.stop - rows.start) * (span.stop - span.start)
            continue
        if not left.children[q] or (right.children[r] and right.radius[r] >= left.radius[q]):
            nodes = np.array(right.children[r])
            bounds = upper(left.centre[q], left.radius[q], right.centre[nodes], right.radius[nodes])
            at = np.argsort(bounds)  # the most promising is taken from the stack first
            work += [(q, int(nodes[k]), float(bounds[k])) for k in at]
        else:
            nodes = np.array(left.children[q])
            bounds = upper(right.centre[r], right.radius[r], left.centre[nodes], left.radius[nodes])
            at = np.argsort(bounds)
            work += [(int(nodes[k]), r, float(bounds[k])) for k in at]
    return done


def _narrow(values: np.ndarray) -> np.ndarray:
    most = np.abs(values).max(initial=0)
    return values.astype(np.int8 if most < 128 else np.int16 if most < 32768 else np.int32)


def _dealt(rows: DataFrame, pivots, size: int) -> DataFrame:
    """(group, id, vector): vectors by nearest pivot, crowded pivots split by hash."""

    def work(vectors):
        known: dict[int, np.ndarray] = pivots.value
        out = np.zeros(len(vectors), np.int64)
        lengths = vectors.value_lengths().to_numpy()
        flat = vectors.flatten().to_numpy().astype(np.float64)
        ends = np.cumsum(lengths)
        for n in np.unique(lengths):
            own = np.flatnonzero(lengths == n)
            if n and int(n) in known:
                p = known[int(n)]
                x = flat[(ends[own] - n)[:, None] + np.arange(n)]
                out[own] = ((p**2).sum(axis=1) - 2 * x @ p.T).argmin(axis=1)
        return (out,)

    near = written(map_columns(rows, ["id", "vector"], ["vector"], "pivot long", work), "topk-near")
    sizes = near.groupBy(F.size("vector").alias("width"), "pivot").agg(F.count("*").alias("n"))
    near = near.withColumn("width", F.size("vector")).join(sizes, ["width", "pivot"])
    salt = F.pmod(F.xxhash64("id", F.lit(3)), F.ceil(F.col("n") / size))
    return near.select(F.concat_ws("-", "width", "pivot", salt).alias("part"), "id", "vector", "width")


def _packed(rows: DataFrame, pivots, size: int, tasks: int) -> DataFrame:
    """A row per group: (part, width, n, ids, points, centre, radius) and its tree, in the order of which its points lie."""

    def work(batches: Iterator[list]) -> Iterator[dict]:
        for part, parts in _runs(batches):
            ids = np.concatenate([p[1].to_numpy() for p in parts])
            width = parts[0][2][0].as_py()
            points = np.concatenate([p[3].flatten().to_numpy().reshape(len(p[1]), width) for p in parts])
            by = np.argsort(ids, kind="stable")
            ids, points = ids[by], points[by]
            order, tree = cover_tree(points)
            ids, points = ids[order], points[order]
            middle = points.astype(np.float64).mean(axis=0)
            reach = np.sqrt(((points - middle) ** 2).sum(axis=1)).max(initial=0.0)
            held = _narrow(points)
            yield {"part": [part], "width": [width], "n": [len(ids)], "ids": [ids.tobytes()], "points": [held.tobytes()], "bytes": [held.itemsize], "centre": [middle.tolist()], "radius": [float(reach) * (1 + 1e-9) + 1e-9]} | tree_bytes(tree)

    out = "part string, width int, n long, ids binary, points binary, bytes int, centre array<double>, radius double, nodes binary, reach binary, span binary"
    together = _dealt(rows, pivots, size).repartition(tasks, "part").sortWithinPartitions("part")
    return map_rows(together, ["part", "id", "width", "vector"], out, work)


def _runs(batches: Iterator[list]) -> Iterator[tuple[object, list]]:
    """Whole groups of following rows with one value in the first column."""
    held, parts = None, []
    for columns in batches:
        names = columns[0].to_pylist()
        cuts = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1]), len(names)]
        for a, b in zip(cuts, cuts[1:]):
            if parts and names[a] != held:
                yield held, parts
                parts = []
            held = names[a]
            parts.append([c.slice(a, b - a) for c in columns])
    if parts:
        yield held, parts


def _points(raw: bytes, size: int, width: int, n: int) -> np.ndarray:
    return np.frombuffer(raw, {1: np.int8, 2: np.int16, 4: np.int32}[size]).reshape(n, width)


def _searched(blocks: DataFrame, shards: DataFrame, pairs: DataFrame, k: int, number: int) -> DataFrame:
    """(query, id, score, block): what the pairs (block, shard) find, in ``number`` tasks, which are alike by their rows but
    not by their work. A shard meets its blocks one at a time."""
    meeting = F.col("turn")
    held = ["width", "n", "ids", "points", "bytes", "nodes", "reach", "span"]
    sent = pairs.join(blocks, pairs["block"] == blocks["part"]).select(F.concat_ws("|", "shard", meeting).alias("task"), F.lit(1).alias("kind"), "block", *held, "least")
    tasks = pairs.select("shard", meeting.alias("turn")).distinct()
    first = tasks.join(shards, tasks["shard"] == shards["part"]).select(
        F.concat_ws("|", "shard", "turn").alias("task"), F.lit(0).alias("kind"), F.lit("").alias("block"), *held, F.lit(None).cast("array<double>").alias("least")
    )
    together = first.unionByName(sent).repartition(number, "task").sortWithinPartitions("task", "kind")

    def work(batches: Iterator[list]) -> Iterator[dict]:
        points = ids = tree = None
        for task, kind, block, width, n, number, raw, size, nodes, reach, span, least in batches:
            for at in range(len(task)):
                x = _points(raw[at].as_py(), size[at].as_py(), width[at].as_py(), n[at].as_py())
                own = np.frombuffer(number[at].as_py(), np.int64)
                grown = tree_of(nodes[at].as_py(), reach[at].as_py(), span[at].as_py(), width[at].as_py())
                if kind[at].as_py() == 0:
                    points, ids, tree = x, own, grown
                    continue
                known = least[at].as_py()
                best = Best(len(own), k, None if known is None else np.array(known))
                if points.shape[1]:
                    dual_search(x, own, grown, points, ids, tree, best)
                else:
                    best.offer(slice(0, len(own)), ids, np.zeros((len(own), len(ids))), own)
                q, j = np.nonzero(best.id != np.iinfo(np.int64).max)
                yield {"query": own[q], "id": best.id[q, j], "score": best.score[q, j], "block": [block[at].as_py()] * len(q)}

    return map_rows(together, ["task", "kind", "block", *held, "least"], "query long, id long, score long, block string", work)


def _promising(blocks: DataFrame, groups: DataFrame, count: int, first: int | None) -> DataFrame:
    """(block, shard): the ``first`` most promising of each group, or all that can reach the block's worst k-th score."""
    asked = blocks.select("part", "width", "centre", "radius", "worst").withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(max(count - 1, 0)))))
    met = asked.join(groups, "group")

    def work(batches):
        for part, width, centre, radius, worst, shards in batches:
            for at in range(len(part)):
                own = [s for s in shards[at].as_py() if s["width"] == width[at].as_py()]
                if not own:
                    continue
                if width[at].as_py():
                    bound = upper(np.array(centre[at].as_py()), radius[at].as_py(), np.array([s["centre"] for s in own]), np.array([s["radius"] for s in own]))
                else:
                    bound = np.zeros(len(own))
                if first is not None:
                    use = np.argsort(-bound, kind="stable")[:first]
                else:
                    use = np.flatnonzero(bound >= worst[at].as_py())
                yield {"block": [part[at].as_py()] * len(use), "shard": [own[u]["part"] for u in use], "bound": bound[use]}

    return map_rows(met, ["part", "width", "centre", "radius", "worst", "shards"], "block string, shard string, bound double", work)


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its ``k`` greatest inner products with other rows.

    Components become floor(scale * x). Rows whose vector is null or holds a null or non-finite component, and
    rows without id, take no part; vectors of another length are no candidates. Ties go to the smaller id; fewer
    rows are returned where there are fewer candidates. Rows with the query's own id are never its candidates; of rows
    with one id the first by vector counts. Vectors with a component of 2^24 or more, as queries and as candidates,
    are scored apart with integers of any size; a score beyond 64 bits counts as its nearest end.
    """
    spark = vectors.sparkSession
    own = named(vector)
    whole = own.isNotNull() & F.forall(own, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    floors = F.transform(own, lambda x: F.floor(x.cast("double") * scale))
    fit = F.forall(floors, lambda x: F.abs(x) < LARGEST)
    whole = vectors.where(whole & named(vec_id).isNotNull()).select(
        named(vec_id).cast("long").alias("id"), F.transform(own, lambda x: x.cast("double")).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")
    )
    whole = whole.groupBy("id").agg(F.min(F.struct("vector", "asks")).alias("r")).select("id", "r.*")
    floors = F.transform("vector", lambda x: F.floor(x * scale))
    fits = F.forall("vector", lambda x: F.abs(x) < (LARGEST - 1) / scale)
    whole = written(whole.withColumn("large", ~fits).withColumn("floors", F.when(fits, F.transform(floors, lambda x: x.cast("int")))), "topk")
    rows = whole.where("NOT large").select("id", F.col("floors").alias("vector"), "asks")
    every, asking, large = whole.agg(F.expr("count_if(NOT large)"), F.expr("count_if(asks AND NOT large)"), F.count_if("large")).first()
    out = "query_id long, rank int, vec_id long, score long"
    apart = None
    if large:
        whole = whole.drop("floors")
        apart = best_products(whole.where("asks AND large"), whole, k, scale).unionByName(best_products(whole.where("asks AND NOT large"), whole.where("large"), k, scale))
    if not asking:
        return spark.createDataFrame([], out) if apart is None else _ranked(apart, k)

    def pivots(df: DataFrame, n: int, size: int):
        many = int(min(PIVOTS, max(1, -(-n // size))))
        chosen: dict[int, list] = {}
        for r in df.orderBy(F.xxhash64("id"), "id").limit(many).collect():
            chosen.setdefault(len(r.vector), []).append(r.vector)
        return spark.sparkContext.broadcast({n: np.array(v, np.float64) for n, v in chosen.items()})

    shards = written(_packed(rows, pivots(rows, every, SHARD), SHARD, 2 * -(-every // SHARD)), "topk-shards")
    queries = rows.where("asks")
    blocks = written(_packed(queries, pivots(queries, asking, BLOCK), BLOCK, 2 * -(-asking // BLOCK)), "topk-blocks")
    held, met = shards.count(), blocks.count()
    count = -(-held // GROUP)
    meetings = -(-met // MEETING)
    turn = F.pmod(F.xxhash64("block"), F.lit(meetings))
    summary = shards.select("part", "width", "centre", "radius", F.pmod(F.xxhash64("part"), F.lit(count)).cast("int").alias("group"))
    groups = written(summary.groupBy("group").agg(F.collect_list(F.struct("part", "width", "centre", "radius")).alias("shards")), "topk-groups")

    start = blocks.withColumn("worst", F.lit(float("-inf")))
    ranked = _promising(start, groups, count, FIRST).groupBy("block").agg(F.slice(F.sort_array(F.collect_list(F.struct("bound", "shard")), asc=False), 1, FIRST).alias("s"))
    begun = written(ranked.select("block", F.explode("s").alias("s")).select("block", "s.shard").withColumn("turn", turn), "topk-first")
    none = blocks.withColumn("least", F.lit(None).cast("array<double>"))
    found = written(_searched(none, shards, begun, k, 2 * min(held * meetings, FIRST * met)), "topk-found")

    # Each query's k-th score so far, where it has k; the worst of a block's queries prunes whole shards.
    kth = found.groupBy("block", "query").agg(F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, k).alias("scores"))
    kth = kth.select("block", "query", F.when(F.size("scores") >= k, F.element_at("scores", -1).cast("double")).otherwise(F.lit(float("-inf"))).alias("least"))
    listed = kth.groupBy("block").agg(F.collect_list(F.struct("query", "least")).alias("known"))

    def limits(ids, known):
        made, worst = [], []
        for raw, have in zip(ids.to_pylist(), known.to_pylist()):
            by = {h["query"]: h["least"] for h in have or []}
            own = [by.get(i, float("-inf")) for i in np.frombuffer(raw, np.int64).tolist()]
            made.append(own)
            worst.append(min(own))
        return made, worst

    known = blocks.join(listed, blocks["part"] == listed["block"], "left").drop("block")
    known = written(map_columns(known, blocks.columns, ["ids", "known"], "least array<double>, worst double", limits), "topk-known")
    rest = _promising(known, groups, count, None).join(begun, ["block", "shard"], "left_anti").select("block", "shard").withColumn("turn", turn)
    more = _searched(known, shards, written(rest, "topk-rest"), k, 2 * held * meetings)
    both = found.select("query", "id", "score").union(more.select("query", "id", "score"))
    return _ranked(both if apart is None else both.unionByName(apart), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return best.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")
