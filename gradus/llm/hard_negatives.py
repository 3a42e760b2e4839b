"""Hard negatives by exact integer scores, many candidates to a multiplication.

Candidates lie in blocks. A block keeps one wide integer per component: every candidate's component, biased to be
non-negative, in a field of its own, wide enough that a whole inner product fits. One multiplication by an anchor's
(biased) component then multiplies all candidates of the block, and the sum over components holds one score per
field; what the biases added is taken off after unpacking. Fields grow with the components, so scores are exact at
any size.

Rows are dealt to blocks by label first: an anchor looks for its positives only where its label lies, and for its
negatives, in a band that its positives' scores set, in every block. Crowded labels are split by hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, named, written

#: Candidates and anchors of a block, and anchor blocks that meet a candidate block in one task.
BLOCK = 4096
ANCHORS = 256
MEETING = 16
LONG = (1 << 63) - 1


def integers(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x): 64-bit where all fit, else Python's integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * scale)
    if len(values) == 0 or np.abs(scaled).max() < 2.0**62:
        return scaled.astype(np.int64)
    return np.array([int(s) if np.isfinite(s) else int(v) * int(scale) for s, v in zip(scaled.tolist(), values.tolist())], object)


def field_bytes(width: int, reach: int, other: int) -> int:
    """Bytes of a field that holds a sum of ``width`` products of numbers up to ``reach`` and ``other``."""
    need = (width * reach * other).bit_length()
    return 4 if need <= 32 else 8 if need <= 63 else -(-need // 8)


class Packed:
    """A block of candidates: ``words[j]`` holds component j of all of them."""

    def __init__(self, words: list[int], count: int, size: int, bias: int):
        self.words, self.count, self.size, self.bias = words, count, size, bias
        self.sums = self._unpacked(sum(words))

    @staticmethod
    def pack(points: np.ndarray, reach: int) -> "Packed":
        """``points`` (candidate x component) for anchors whose biased components are at most ``reach``."""
        count, width = points.shape
        bias = max(0, -int(points.min())) if points.size else 0
        biased = points + bias
        size = field_bytes(width, reach, int(biased.max()) if points.size else 0)
        if size <= 8:
            kind = np.dtype("<u4" if size == 4 else "<u8")
            raws = [np.ascontiguousarray(biased[:, j]).astype(kind).tobytes() for j in range(width)]
        else:
            raws = [b"".join(int(c).to_bytes(size, "little") for c in biased[:, j]) for j in range(width)]
        return Packed([int.from_bytes(raw, "little") for raw in raws], count, size, bias)

    def _unpacked(self, total: int) -> np.ndarray:
        raw = total.to_bytes(self.count * self.size, "little")
        if self.size <= 8:
            return np.frombuffer(raw, "<u4" if self.size == 4 else "<u8").astype(np.int64)
        return np.array([int.from_bytes(raw[k : k + self.size], "little") for k in range(0, len(raw), self.size)], object)

    def scores(self, anchor: list[int], bias: int) -> np.ndarray:
        """The anchor's inner product with every candidate; sum (a + b)(c + d) = sum ac + b sum (c + d) + d sum a."""
        total = 0
        for a, word in zip(anchor, self.words):
            total += (a + bias) * word
        out = self._unpacked(total)
        out = out - bias * self.sums - self.bias * sum(anchor)
        return out if out.dtype != object else np.array([max(-LONG, min(LONG, s)) for s in out.tolist()], np.int64)


def _dealt(rows: DataFrame, groups: int, size: int) -> DataFrame:
    """Rows with their block: by label, and by the id's hash within crowded labels."""
    rows = rows.withColumn("width", F.size("vector")).withColumn("group", F.pmod(F.xxhash64("label"), F.lit(groups)))
    sizes = rows.groupBy("width", "group").agg(F.count("*").alias("n"))
    salt = F.pmod(F.xxhash64("id", F.lit(5)), F.ceil(F.col("n") / size))
    return rows.join(sizes, ["width", "group"]).withColumn("part", F.concat_ws("-", "width", "group", salt)).drop("n")


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


def _joined(parts: list, at: int, kind=np.int64) -> np.ndarray:
    return np.concatenate([p[at].to_numpy(zero_copy_only=False) for p in parts]).astype(kind)


def _vectors(parts: list, at: int, width: int) -> np.ndarray:
    return np.concatenate([p[at].flatten().to_numpy(zero_copy_only=False).astype(np.float64) for p in parts]).reshape(sum(len(p[at]) for p in parts), width)


def _blocks(rows: DataFrame, many: int, reach: int, scale: float) -> DataFrame:
    """A row per candidate block: (part, width, group, ids, labels, words, size, bias)."""

    def work(batches: Iterator[list]) -> Iterator[dict]:
        for part, parts in _runs(batches):
            width, group = parts[0][1][0].as_py(), parts[0][2][0].as_py()
            x = _vectors(parts, 5, width)
            packed = Packed.pack(integers(x.reshape(-1), scale).reshape(x.shape), reach)
            words = [w.to_bytes(packed.count * packed.size, "little") for w in packed.words]
            yield {
                "part": [part], "width": [width], "group": [group], "ids": [_joined(parts, 3).tobytes()], "labels": [_joined(parts, 4).tobytes()],
                "words": [words], "size": [packed.size], "bias": [str(packed.bias)],
            }

    out = "part string, width int, group long, ids binary, labels binary, words array<binary>, size int, bias string"
    return map_rows(rows.repartition(many, "part").sortWithinPartitions("part", "id"), ["part", "width", "group", "id", "label", "vector"], out, work)


def _asked(rows: DataFrame, many: int) -> DataFrame:
    """A row per anchor block: (part, width, group, ids, labels, points, bands), a band being a positive and its score."""

    def work(batches: Iterator[list]) -> Iterator[dict]:
        for part, parts in _runs(batches):
            width, group = parts[0][1][0].as_py(), parts[0][2][0].as_py()
            bands = [b for p in parts for b in p[6].to_pylist()]
            yield {
                "part": [part], "width": [width], "group": [group], "ids": [_joined(parts, 3).tobytes()], "labels": [_joined(parts, 4).tobytes()],
                "points": [_vectors(parts, 5, width).tobytes()], "bands": [bands],
            }

    out = "part string, width int, group long, ids binary, labels binary, points binary, bands array<array<struct<id:long,score:long>>>"
    return map_rows(rows.repartition(many, "part").sortWithinPartitions("part", "id"), ["part", "width", "group", "id", "label", "vector", "bands"], out, work)


def _met(blocks: DataFrame, asked: DataFrame, pairs: DataFrame, meetings: int, tasks: int, scale: float, find) -> DataFrame:
    """What ``find(scores, ids, labels, own id, own label, bands)`` yields for every anchor of every pair (anchors, block).

    A task loads a block and meets its anchor blocks one after another; ``meetings`` tasks share a block's."""
    turn = F.pmod(F.xxhash64("anchors"), F.lit(meetings))
    pairs = pairs.select("anchors", "block", F.concat_ws("|", "block", turn).alias("task"))
    held = pairs.select("block", "task").distinct().join(blocks.withColumnRenamed("part", "block"), "block")
    sent = pairs.join(asked.withColumnRenamed("part", "anchors"), "anchors")
    none = F.lit(None)
    columns = ["task", "kind", "width", "ids", "labels", "words", "size", "bias", "points", "bands"]
    held = held.select("task", F.lit(0).alias("kind"), "width", "ids", "labels", "words", "size", "bias", none.cast("binary").alias("points"), none.cast("array<array<struct<id:long,score:long>>>").alias("bands"))
    sent = sent.select("task", F.lit(1).alias("kind"), "width", "ids", "labels", none.cast("array<binary>").alias("words"), none.cast("int").alias("size"), none.cast("string").alias("bias"), "points", "bands")

    def work(batches: Iterator[list]) -> Iterator[dict]:
        block = ids = labels = None
        for batch in batches:
            for at in range(len(batch[0])):
                _, kind, width, raw, marks, words, size, bias, points, bands = (c[at].as_py() for c in batch)
                own, own_labels = np.frombuffer(raw, np.int64), np.frombuffer(marks, np.int64)
                if kind == 0:
                    ids, labels = own, own_labels
                    block = Packed([int.from_bytes(w, "little") for w in words], len(ids), size, int(bias))
                    continue
                x = np.frombuffer(points, np.float64)
                x = integers(x, scale).reshape(len(own), width)
                low = max(0, -int(x.min())) if x.size else 0
                found: dict[str, list] = {"anchor": [], "positive": [], "positive_score": [], "id": [], "score": []}
                for k in range(len(own)):
                    scores = block.scores([int(a) for a in x[k].tolist()], low) if width else np.zeros(len(ids), np.int64)
                    for band, chosen in find(scores, ids, labels, int(own[k]), int(own_labels[k]), bands[k]):
                        found["anchor"] += [int(own[k])] * len(chosen)
                        found["positive"] += [band[0]] * len(chosen)
                        found["positive_score"] += [band[1]] * len(chosen)
                        found["id"] += ids[chosen].tolist()
                        found["score"] += scores[chosen].tolist()
                if found["id"]:
                    yield found

    together = held.unionByName(sent).repartition(tasks, "task").sortWithinPartitions("task", "kind")
    return map_rows(together, columns, "anchor long, positive long, positive_score long, id long, score long", work)


def _reach(rows: DataFrame, scale: float) -> int:
    """More than any biased component of ``vector``."""
    greatest = rows.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x))))).first()[0] or 0.0
    return 2 * (int(greatest) + 1) * int(np.ceil(scale)) + 2


def best_products(queries: DataFrame, candidates: DataFrame, k: int, scale: float) -> DataFrame:
    """(query, id, score): for each query at least its ``k`` best candidates of another id, whatever the components'
    size; ties go to the smaller id. Both have id and vector (finite doubles), ids being distinct."""
    out = "query long, id long, score long"
    many, asking = candidates.count(), queries.count()
    if not many or not asking:
        return candidates.sparkSession.createDataFrame([], out)
    plain = lambda rows: rows.select("id", F.xxhash64("id").alias("label"), "vector")
    groups, crowd = -(-many // BLOCK), -(-asking // ANCHORS)
    blocks = written(_blocks(_dealt(plain(candidates), groups, BLOCK), groups, _reach(queries, scale), scale), "products-blocks")
    none = F.array().cast("array<struct<id:long,score:long>>")
    asked = written(_asked(_dealt(plain(queries), crowd, ANCHORS).withColumn("bands", none), crowd), "products-asked")

    def best(scores, ids, labels, own_id, own_label, bands):
        at = np.flatnonzero(ids != own_id)
        if len(at) > k:
            at = at[scores[at] >= np.partition(scores[at], -k)[-k]]
        yield (None, None), at[np.lexsort((ids[at], -scores[at]))][:k]

    held, meetings = blocks.count(), max(1, -(-asked.count() // MEETING))
    found = _met(blocks, asked, _all_pairs(blocks, asked, held), meetings, 2 * held * meetings, scale, best)
    return found.select(F.col("anchor").alias("query"), "id", "score")


def _all_pairs(blocks: DataFrame, asked: DataFrame, held: int) -> DataFrame:
    """(anchors, block): every block of queries with every block of candidates of its width."""
    many = -(-held // 64)
    each = asked.select(F.col("part").alias("anchors"), "width").withColumn("some", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
    every = blocks.select(F.col("part").alias("block"), "width", F.pmod(F.xxhash64("part"), F.lit(many)).cast("int").alias("some"))
    return each.join(every, ["width", "some"])


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column,
    positives: int = 5,
    negatives: int = 10,
    least: int = 30,
    most: int = 90,
    scale: float = 256.0,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), scores of floor(scale * x).

    An anchor's positives are its best other rows of its label; for each, the best rows of other labels whose score
    is between ``least`` and ``most`` hundredths of the positive's. Ties go to the smaller id; fewer rows come back
    where there are fewer. Rows without id or label (an integer), and rows whose vector is null or holds a null or
    non-finite component, take no part; vectors of another length are no candidates, and vectors without components
    score 0. Of rows with one id, the first by label and vector counts. A score beyond a 64-bit integer counts as its
    nearest end. An empty table, or one without anchors, gives no rows.
    """
    spark = vectors.sparkSession
    own = named(vector)
    whole = own.isNotNull() & F.forall(own, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    rows = vectors.where(whole).select(named(vec_id).cast("long").alias("id"), label.cast("long").alias("label"), F.transform(own, lambda x: x.cast("double")).alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL").groupBy("id").agg(F.min(F.struct("label", "vector", "asks")).alias("r")).select("id", "r.*")
    rows = written(rows, "negatives")
    every, asking = rows.agg(F.count("*"), F.count_if("asks")).first()
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not asking:
        return spark.createDataFrame([], out)
    groups = -(-every // BLOCK)
    blocks = written(_blocks(_dealt(rows, groups, BLOCK), groups, _reach(rows.where("asks"), scale), scale), "negatives-blocks")
    anchors = written(_dealt(rows.where("asks"), groups, ANCHORS).drop("asks"), "negatives-anchors")
    crowd = -(-asking // ANCHORS)

    def best(scores, ids, labels, own_id, own_label, bands):
        at = np.flatnonzero((labels == own_label) & (ids != own_id))
        if len(at) > positives:
            at = at[scores[at] >= np.partition(scores[at], -positives)[-positives]]
        yield (None, None), at[np.lexsort((ids[at], -scores[at]))][:positives]

    none = F.array().cast("array<struct<id:long,score:long>>")
    asked = written(_asked(anchors.withColumn("bands", none), crowd), "negatives-asked")
    held = blocks.count()
    meetings = max(1, -(-asked.count() // MEETING))
    near = asked.select(F.col("part").alias("anchors"), "width", "group").join(blocks.select(F.col("part").alias("block"), "width", "group"), ["width", "group"])
    found = _met(blocks, asked, near, meetings, 2 * held, scale, best)
    by = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    chosen = written(found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= positives).select("anchor", "id", "score"), "negatives-positives")

    def in_band(scores, ids, labels, own_id, own_label, bands):
        other = np.flatnonzero(labels != own_label)  # ids ascend within a block
        order = other[np.argsort(-scores[other], kind="stable")]
        falling = -scores[order]
        for band in bands:
            low, high = -((-least * band["score"]) // 100), (most * band["score"]) // 100
            a = int(np.searchsorted(falling, max(-LONG, -high), "left"))
            b = int(np.searchsorted(falling, min(LONG, -low), "right"))
            if a < min(b, a + negatives):
                yield (band["id"], band["score"]), order[a : min(b, a + negatives)]

    bands = chosen.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("id", "score"))).alias("bands"))
    asked = written(_asked(anchors.join(bands, anchors["id"] == bands["anchor"]).drop("anchor"), crowd), "negatives-banded")
    found = _met(blocks, asked, _all_pairs(blocks, asked, held), meetings, 2 * held * meetings, scale, in_band)
    by = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= negatives)
    return ranked.select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
