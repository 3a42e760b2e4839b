"""Near duplicates by a MinHash-banded join on word n-grams, verified on the full n-gram sets.

1. Each text becomes a set of n-gram keys, a digest of the set and ``bands`` band hashes. Rows with equal sets
   form one class; from here on only one row per class takes part.
2. Band hashes are counted; those of one class alone go. Per class the shared ones make a short list.
3. Classes meet in buckets (one per band hash). A pair is looked at in its first common bucket only, which the
   lists tell without its n-grams, so most buckets need no n-grams of most members.
4. The texts of the classes that are needed are read again, and each bucket verifies its pairs on whole sets.
   It returns links per class and the edges of a spanning forest, not the pairs.

Buckets of more than ``CHUNK`` classes are dealt as pairs of chunks, so no task holds more than two chunks. What
each task sends out is bounded by what it read. Components are found from the forest edges.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, map_rows, named, written
from .words import LETTERS, MIX, Packed, mixed

CHUNK = 1024


class Banding(NamedTuple):
    bands: int
    rows: int


def choose_banding(similarity: float, recall: float, least_rows: int = 4, most: int = 64) -> Banding:
    """The fewest hashes of at least ``least_rows`` a band that find a pair at ``similarity`` with ``recall``."""
    found = []
    for rows in range(least_rows, 9):
        for bands in range(1, most + 1):
            if 1 - (1 - similarity**rows) ** bands >= recall:
                found.append((bands * rows, bands, rows))
                break
    if not found:
        raise ValueError("no banding reaches this recall")
    return Banding(*min(found)[1:])


def shingles(texts: list, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each text's word n-grams, ascending within each text, and how many each text has.

    A text of fewer than ``n`` words, but not none, has its whole word sequence as its only one.
    """
    packed = Packed(texts, lower=True)
    start, end = packed.runs(LETTERS)
    words, counts = packed.keys(start, end), packed.counts(start)
    if not len(words):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    ends = np.cumsum(counts)
    text = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(words)) - (ends - counts)[text]
    left = counts[text] - place
    begins = (left >= n) | (place == 0)
    keys = np.zeros(len(words), np.uint64)
    for k in range(n):
        shifted = np.zeros_like(words)
        shifted[: len(words) - k] = words[k:]
        shifted[left <= k] = np.uint64(k + 1)
        keys = mixed(keys * MIX + shifted)
    keys, text = keys[begins], text[begins]
    order = np.lexsort((keys, text))
    keys, text = keys[order], text[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
    return keys[new], np.bincount(text[new], minlength=len(texts)).astype(np.int64)


def band_hashes(keys: np.ndarray, counts: np.ndarray, banding: Banding) -> np.ndarray:
    """Row per text with n-grams: a hash per band of the smallest values under ``bands * rows`` hash functions."""
    starts = (np.cumsum(counts) - counts)[counts > 0]
    hashes = np.random.default_rng(7).integers(1, 2**63, (banding.bands * banding.rows, 2), dtype=np.uint64)
    out = np.zeros((len(starts), banding.bands), np.uint64)
    for band in range(banding.bands):
        for a, b in hashes[band * banding.rows : (band + 1) * banding.rows]:
            value = (keys ^ b) * (a | np.uint64(1))
            value ^= value >> np.uint64(32)
            least = np.minimum.reduceat(value, starts)
            out[:, band] = mixed(out[:, band] * MIX + least)
    # The band's number in the low bits keeps bands apart.
    return (out & ~np.uint64(63)) | np.arange(banding.bands, dtype=np.uint64)


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def signatures(docs: DataFrame, keep: Sequence[str], text: str, n: int, banding: Banding) -> DataFrame:
    def work(texts):
        keys, counts = shingles(texts.to_pylist(), n)
        ends = np.cumsum(counts)
        first = np.zeros(len(counts), np.uint64)
        second = np.zeros(len(counts), np.uint64)
        bands: list = [[]] * len(counts)
        some = np.flatnonzero(counts)
        if len(some):
            starts = (ends - counts)[some]
            first[some] = np.add.reduceat(mixed(keys * np.uint64(0xA24BAED4963EE407)), starts)
            second[some] = np.add.reduceat(mixed(keys ^ np.uint64(0x9FB21C651E98DF25)), starts)
            rows = _signed(band_hashes(keys, counts, banding))
            for k, row in zip(some.tolist(), rows.tolist()):
                bands[k] = row
        return counts, _signed(first), _signed(second), bands

    return map_columns(docs, keep, [text], "size long, first long, second long, bands array<long>", work)


def _runs(batches: Iterator[list], columns: int) -> Iterator[list]:
    """Groups of following rows that agree in the first two columns, whole, as lists of Arrow arrays' values."""
    held: list | None = None
    for batch in batches:
        keys = np.stack([batch[0].to_numpy(zero_copy_only=False), batch[1].to_numpy(zero_copy_only=False)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), keys.shape[1]]
        for a, b in zip(cuts, cuts[1:]):
            part = [batch[c].slice(a, b - a) for c in range(columns)]
            if held is not None and (held[0][0][0].as_py(), held[1][0][0].as_py()) == (part[0][0].as_py(), part[1][0].as_py()):
                for own, more in zip(held, part):
                    own.append(more)
            else:
                if held is not None:
                    yield held
                held = [[p] for p in part]
    if held is not None:
        yield held


def _values(parts: list) -> list:
    return [v for p in parts for v in p.to_pylist()]


def _unequal(lists: list[list[int]], bucket: int, side: np.ndarray) -> np.ndarray:
    """Pairs (as a matrix above the diagonal) whose first common bucket is this one."""
    n = len(lists)
    pair = np.triu(np.ones((n, n), bool), 1)
    if (side != side[0]).any():
        pair &= side[:, None] != side[None, :]
    band = bucket & 63
    earlier: dict[int, list[int]] = {}
    for k, own in enumerate(lists):
        for key in own:
            if key & 63 < band:
                earlier.setdefault(key, []).append(k)
    for members in earlier.values():
        if len(members) > 1:
            pair[np.ix_(members, members)] = False
    return pair


def _needed(active: DataFrame) -> DataFrame:
    """(bucket, block, side, row, keys) of the classes with a pair whose first common bucket it is."""

    def work(batches):
        for bucket, block, side, row, keys in _runs(batches, 5):
            sides, rows, lists = np.array(_values(side)), _values(row), _values(keys)
            if len(rows) < 2:
                continue
            key = bucket[0][0].as_py()
            pair = _unequal(lists, key, sides)
            use = np.flatnonzero(pair.any(axis=0) | pair.any(axis=1))
            if len(use):
                n = len(use)
                yield {"bucket": [key] * n, "block": [block[0][0].as_py()] * n, "side": sides[use], "row": [rows[k] for k in use], "keys": [lists[k] for k in use]}

    return map_rows(active, ["bucket", "block", "side", "row", "keys"], "bucket long, block long, side int, row binary, keys array<long>", work)


def _links(members: DataFrame, similarity: float) -> DataFrame:
    """(row, links, edges): verified links of each class in a bucket, counted in rows, and forest edges."""

    def work(batches):
        for bucket, _, side, row, keys, copies, sets in _runs(batches, 7):
            rows = _values(row)
            if len(rows) < 2:
                continue
            pair = _unequal(_values(keys), bucket[0][0].as_py(), np.array(_values(side)))
            found = verified([np.frombuffer(s, np.uint64) for s in _values(sets)], pair, similarity)
            if not len(found):
                continue
            weight = np.array(_values(copies), np.int64)
            links = np.bincount(found[:, 0], weight[found[:, 1]], len(rows)) + np.bincount(found[:, 1], weight[found[:, 0]], len(rows))
            edges: list[list] = [[] for _ in rows]
            for a, b in forest(found, len(rows)):
                edges[a].append(rows[b])
            use = np.flatnonzero(links)
            yield {"row": [rows[k] for k in use], "links": links[use].astype(np.int64), "edges": [edges[k] for k in use]}

    use = ["bucket", "block", "side", "row", "keys", "copies", "sets"]
    return map_rows(members, use, "row binary, links long, edges array<binary>", work)


def verified(sets: list[np.ndarray], pair: np.ndarray, similarity: float) -> np.ndarray:
    """Those of the marked pairs whose sets have at least this Jaccard similarity, as rows (i, j)."""
    n = len(sets)
    size = np.fromiter(map(len, sets), np.int64, n)
    if n == 2:
        if not pair[0, 1]:
            return np.empty((0, 2), np.int64)
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        good = common >= similarity * (size.sum() - common) - 1e-9
        return np.array([[0, 1]]) if good else np.empty((0, 2), np.int64)
    keys = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    number = np.cumsum(fresh) - 1
    first = np.append(np.flatnonzero(fresh), len(keys))
    several = np.diff(first)[number] > 1  # an n-gram of one set alone adds nothing
    by_set = np.argsort(owner[several], kind="stable")
    mine = number[several][by_set]
    cuts = np.searchsorted(owner[several][by_set], np.arange(n + 1))
    found = []
    for i in np.flatnonzero(pair.any(axis=1)).tolist():
        own = mine[cuts[i] : cuts[i + 1]]
        if not len(own):
            continue
        length = first[own + 1] - first[own]
        at = np.repeat(first[own] - np.cumsum(length) + length, length) + np.arange(length.sum())
        common = np.bincount(owner[at], minlength=n)
        good = pair[i] & (common >= similarity * (size[i] + size - common) - 1e-9) & (common > 0)
        partners = np.flatnonzero(good)
        found.append(np.stack([np.full(len(partners), i), partners], axis=1))
    return np.concatenate(found) if found else np.empty((0, 2), np.int64)


def forest(pairs: np.ndarray, n: int) -> list[tuple[int, int]]:
    """As many of the pairs as connect what all of them connect."""
    up = list(range(n))

    def root(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    out = []
    for a, b in pairs.tolist():
        x, y = root(a), root(b)
        if x != y:
            up[y] = x
            out.append((a, b))
    return out


def components(edges: DataFrame) -> DataFrame:
    """(row, top): the smallest row of each row's component; ``edges`` has columns a and b.

    Each round sends every row to the smallest row near it and replaces the edges by those to it, first for the
    larger neighbours, then for the smaller ones; stars are left at last. Rounds grow with the logarithm of a
    component's size. A hub's edges are only aggregated, never gathered.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    seen = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = written(small.where("a <> b").distinct(), "components")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("a").alias("row"), F.col("b").alias("top"))
        seen = now


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    n: int = 5,
    similarity: float = 0.8,
    recall: float = 0.9995,
    chunk: int = CHUNK,
) -> DataFrame:
    """One row per document row: its id, ``class_id``, ``links``, and ``row``, ``top`` and ``first``.

    ``links`` counts the other rows with a similarity of at least ``similarity``, copies included; ``class_id`` is
    the smallest id of the rows that links connect, null if none has one. ``row`` digests a row's id and text,
    ``top`` is the component's and ``first`` tells whether the row is the one of its component that stays. Null,
    empty and wordless texts have no n-grams and no links and are classes of their own. Repeated rows count as
    copies. Every pair that shares a band is verified; ``recall`` is the chance that a pair just at the
    threshold shares one.
    """
    banding = choose_banding(similarity, recall)
    known = F.coalesce(named(doc_id).cast("string"), F.lit(""))
    row = F.unhex(F.md5(F.concat_ws("\x01", known, F.coalesce(named(text), F.lit("")))))
    keyed = docs.select(named(doc_id).alias("__id"), named(text).alias("__text"), row.alias("__row"))
    signed = written(signatures(keyed, ["__id", "__row"], "__text", n, banding), "jaccard")

    # One row per set of n-grams.
    classes = written(
        signed.where("size > 0").groupBy("first", "second", "size").agg(F.count("*").alias("copies"), F.min("__row").alias("row"), F.first("bands").alias("bands")),
        "jaccard-classes",
    )
    entries = classes.select("row", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    lists = entries.join(shared, "bucket").groupBy("row").agg(F.collect_list(F.struct("bucket", "m")).alias("shared"))
    lists = written(lists, "jaccard-shared")

    # Buckets of several chunks are dealt as pairs of chunks; every chunk also meets itself.
    chunks = F.ceil(F.col("m") / chunk).cast("int")
    dealt = lists.select("row", F.transform("shared", lambda s: s["bucket"]).alias("keys"), F.explode("shared").alias("s")).select("row", "keys", "s.bucket", "s.m")
    dealt = dealt.withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("row", "bucket"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    block = F.least("own", "other").cast("long") * (1 << 31) + F.greatest("own", "other")
    met = dealt.select("bucket", block.alias("block"), F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"), "row", "keys")
    needed = written(_needed(_together(met)), "jaccard-needed")

    # N-grams of the needed rows only, from their texts.
    where = needed.groupBy("row").agg(F.collect_list(F.struct("bucket", "block", "side")).alias("places"), F.first("keys").alias("keys"))
    wanted = where.join(classes.select("row", "copies"), "row")
    texts = keyed.select("__row", "__text").join(wanted.select(F.col("row").alias("__row")), "__row", "left_semi").groupBy("__row").agg(F.any_value("__text").alias("__text"))

    def sets(texts):
        keys, counts = shingles(texts.to_pylist(), n)
        ends = np.cumsum(counts)
        return ([keys[a:b].tobytes() for a, b in zip(ends - counts, ends)],)

    grams = map_columns(texts, ["__row"], ["__text"], "sets binary", sets)
    members = grams.join(wanted, grams["__row"] == wanted["row"]).select("row", "keys", "copies", "sets", F.explode("places").alias("p"))
    members = members.select("p.bucket", "p.block", "p.side", "row", "keys", "copies", "sets")
    linked = written(_links(_together(members), similarity), "jaccard-links")

    tops = components(linked.select(F.col("row").alias("a"), F.explode("edges").alias("b")))
    links = linked.groupBy("row").agg(F.sum("links").alias("links"))
    about = classes.select("first", "second", "size", "row", "copies").join(links, "row", "left").join(tops, "row", "left")
    about = about.select("first", "second", "size", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("top", "row").alias("top"))
    joined = signed.select("__id", "__row", "first", "second", "size").join(about, ["first", "second", "size"], "left")
    joined = joined.select(
        "__id",
        F.col("__row").alias("row"),
        F.when(F.col("size") > 0, F.col("top")).alias("top"),
        F.when(F.col("size") > 0, F.col("links") + F.col("copies") - 1).otherwise(F.lit(0)).alias("links"),
        (F.col("size") > 0).alias("some"),
    )
    joined = written(joined, "jaccard-joined")
    firsts = joined.where("some").groupBy("top").agg(F.min("__id").alias("class_id"), F.min("row").alias("stays"))
    out = joined.join(firsts, "top", "left")
    return out.select(
        F.col("__id").alias(doc_id),
        F.when(F.col("some"), F.col("class_id")).otherwise(F.col("__id")).alias("class_id"),
        "links",
        "row",
        "top",
        F.when(F.col("some"), F.col("row") == F.col("stays")).otherwise(F.lit(True)).alias("first"),
    )


def _together(df: DataFrame) -> DataFrame:
    return df.repartition("bucket", "block").sortWithinPartitions("bucket", "block")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The documents without near duplicates: one row of each component, all columns as they were."""
    found = near_duplicates(docs, doc_id, text, **settings)
    stay = found.where("first AND top IS NOT NULL").select("row").distinct()
    known = F.coalesce(named(doc_id).cast("string"), F.lit(""))
    row = F.unhex(F.md5(F.concat_ws("\x01", known, F.coalesce(named(text), F.lit("")))))
    # Documents travel as one column, so that none of theirs can clash.
    keyed = docs.select(F.struct(*[named(c) for c in docs.columns]).alias("doc"), named(text).alias("text"), row.alias("own"))
    marked = map_columns(keyed, ["doc", "own"], ["text"], "some boolean", lambda texts: (shingles(texts.to_pylist(), 1)[1] > 0,))
    kept = marked.where("some").join(stay, marked["own"] == stay["row"], "left_semi").dropDuplicates(["own"])
    return kept.unionByName(marked.where("NOT some")).select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
