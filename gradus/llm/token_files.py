"""Token ids of a corpus in patched frame-of-reference blocks: a compact binary file format and its reader.

A table of segments in ascending key order. A segment holds the ids of whole documents after one another:

    header   '<4sIIQ': b"PFR1", ids a block, blocks, ids
    index    '<Q' for each block: where it starts, from the segment's first byte
    block    '<IHHBxxx': smallest id, ids, exceptions, width; then the packed differences, then the places
             ('<H') and the differences ('<I') of the exceptions

Differences from the block's smallest id are packed at the width that holds ``PERCENT`` percent of them; those
that need more bits are kept apart. Beside its bytes a segment's row names its documents and their lengths.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, named
from .tokens import by_chars, encoder

BLOCK = 1024
PERCENT = 95
#: A segment ends with the document that fills it.
SEGMENT = 1 << 18

_HEAD = struct.Struct("<4sIIQ")
_BLOCK = struct.Struct("<IHHBxxx")


def packed_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values, each packed at ``width`` bits, least significant bit first."""
    n, size = values.shape
    bits = np.unpackbits(values.astype("<u4").view(np.uint8), axis=1, bitorder="little").reshape(n, size, 32)
    return np.packbits(bits[:, :, :width].reshape(n, -1), axis=1, bitorder="little")


def unpacked_bits(rows: np.ndarray, width: int, n: int) -> np.ndarray:
    bits = np.unpackbits(rows, axis=1, count=n * width, bitorder="little").reshape(len(rows), n, width)
    padded = np.zeros((len(rows), n, 32), np.uint8)
    padded[:, :, :width] = bits
    return np.packbits(padded.reshape(len(rows), -1), axis=1, bitorder="little").view("<u4")


def encode_segment(ids: np.ndarray, block: int = BLOCK, percent: float = PERCENT) -> bytes:
    ids = np.asarray(ids, np.uint32)
    count = -(-len(ids) // block)
    grid = np.empty(count * block, np.uint32)
    grid[: len(ids)] = ids
    if count:
        grid[len(ids) :] = ids[-1]  # fills the last block without widening it
    grid = grid.reshape(count, block)
    least = grid.min(axis=1) if count else np.empty(0, np.uint32)
    over = grid - least[:, None]
    rank = min(block - 1, int(np.ceil(block * percent / 100)) - 1)
    usual = np.partition(over, rank, axis=1)[:, rank] if count else least
    widths = np.ceil(np.log2(usual.astype(np.float64) + 1)).astype(np.int64)
    bodies: list[bytes] = [b""] * count
    for width in np.unique(widths):
        own = np.flatnonzero(widths == width)
        limit = np.uint64(1) << np.uint64(width)
        outside = over[own].astype(np.uint64) >= limit
        body = packed_bits(np.where(outside, 0, over[own]).astype(np.uint32), int(width)) if width else np.empty((len(own), 0), np.uint8)
        for row, k in enumerate(own):
            places = np.flatnonzero(outside[row])
            n = min(block, len(ids) - k * block)
            places = places[places < n]
            head = _BLOCK.pack(int(least[k]), n, len(places), int(width))
            used = body[row, : -(-n * int(width) // 8)].tobytes()
            bodies[k] = head + used + places.astype("<u2").tobytes() + over[k][places].astype("<u4").tobytes()
    sizes = np.fromiter(map(len, bodies), np.int64, count)
    first = _HEAD.size + 8 * count
    index = first + np.cumsum(sizes) - sizes
    return b"".join([_HEAD.pack(b"PFR1", block, count, len(ids)), index.astype("<u8").tobytes(), *bodies])


def decode_segment(data: bytes) -> np.ndarray:
    magic, block, count, total = _HEAD.unpack_from(data, 0)
    if magic != b"PFR1":
        raise ValueError("not a segment of token ids")
    out = np.empty((count, block), np.uint32)
    index = np.frombuffer(data, "<u8", count, _HEAD.size)
    heads = [_BLOCK.unpack_from(data, int(at)) for at in index]
    raw = np.frombuffer(data, np.uint8)
    by_width: dict[int, list[int]] = {}
    for k, (_, _, _, width) in enumerate(heads):
        by_width.setdefault(width, []).append(k)
    for width, own in by_width.items():
        if width:
            size = -(-block * width // 8)
            rows = np.zeros((len(own), size), np.uint8)
            for row, k in enumerate(own):
                at, n = int(index[k]) + _BLOCK.size, -(-heads[k][1] * width // 8)
                rows[row, :n] = raw[at : at + n]
            out[own] = unpacked_bits(rows, width, block)[:, :block]
        else:
            out[own] = 0
    for k, (least, n, odd, width) in enumerate(heads):
        if odd:
            at = int(index[k]) + _BLOCK.size + -(-n * width // 8)
            places = np.frombuffer(data, "<u2", odd, at)
            out[k][places] = np.frombuffer(data, "<u4", odd, at + 2 * odd)
        out[k] += np.uint32(least)
    return out.reshape(-1)[:total]


def read_block(data: bytes, number: int) -> np.ndarray:
    """One block's ids, found through the index alone."""
    _, block, _, _ = _HEAD.unpack_from(data, 0)
    (at,) = struct.unpack_from("<Q", data, _HEAD.size + 8 * number)
    least, n, odd, width = _BLOCK.unpack_from(data, at)
    size = -(-n * width // 8)
    body = np.frombuffer(data, np.uint8, size, at + _BLOCK.size)
    ids = np.zeros(n, np.uint32)
    if width:
        full = np.zeros((1, -(-block * width // 8)), np.uint8)
        full[0, :size] = body
        ids = unpacked_bits(full, width, block)[0, :n].copy()
    at += _BLOCK.size + size
    ids[np.frombuffer(data, "<u2", odd, at)] = np.frombuffer(data, "<u4", odd, at + 2 * odd)
    return ids + np.uint32(least)


def write_ids(docs: DataFrame, folder: str, path: str, byte_level: bool, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Write the ids of all texts, each with ``end_id`` after it, in ascending order of ``key``.

    One shuffle deals the texts by key ranges; ids never cross it. Equal keys and repeated rows lie side by side,
    ordered by their text's hash; null keys come first; a null or empty text is its end id alone. An empty table
    writes an empty table. A worker holds one batch and one segment, or one document where that is larger.
    """
    kind = docs.schema[key].dataType.simpleString()
    out = f"part int, seq int, keys array<{kind}>, lengths array<long>, first long, ids long, data binary"

    def work(batches: Iterator[list]) -> Iterator[dict]:
        from pyspark import TaskContext

        part, state = TaskContext.get().partitionId(), {"seq": 0, "first": 0}
        keys, lengths, ids = [], [], []

        def segment() -> dict:
            whole = np.concatenate(ids)
            row = {"part": [part], "seq": [state["seq"]], "keys": [list(keys)], "lengths": [list(lengths)], "first": [state["first"]], "ids": [len(whole)], "data": [encode_segment(whole)]}
            state["seq"] += 1
            state["first"] += len(whole)
            keys.clear(), lengths.clear(), ids.clear()
            return row

        held = 0
        for own_keys, texts in batches:
            texts, own_keys = texts.to_pylist(), own_keys.to_pylist()
            for low, high in by_chars(texts):
                made, counts = encoder(path, byte_level).batch(texts[low:high])
                ends = np.cumsum(counts)
                for key_, a, b in zip(own_keys[low:high], (ends - counts).tolist(), ends.tolist()):
                    keys.append(key_)
                    lengths.append(b - a + 1)
                    ids.append(np.append(made[a:b].astype(np.uint32), np.uint32(end_id)))
                    held += b - a + 1
                    if held >= SEGMENT:
                        yield segment()
                        held = 0
        if keys:
            yield segment()

    ordered = (
        docs.select(named(key).alias("k"), named(text).alias("t"))
        .withColumn("h", F.xxhash64("t"))
        .repartitionByRange(F.col("k").asc_nulls_first(), F.col("h"))
        .sortWithinPartitions(F.col("k").asc_nulls_first(), F.col("h"))
    )
    map_rows(ordered, ["k", "t"], out, work).write.option("compression", "zstd").parquet(folder)


def read_ids(spark: SparkSession, folder: str, key: str = "doc_id", ids: bool = False) -> DataFrame:
    """One row per document from the written segments: key, start, n_tokens, ids_crc32, and the ids if asked for.

    Starts count all ids of earlier documents: a segment knows its place in its part, and the sizes of the
    parts, one number per part, are summed up here.
    """
    segments = spark.read.parquet(folder)
    sizes = sorted((r.part, r.n) for r in segments.groupBy("part").agg(F.sum("ids").alias("n")).collect())
    base, total = [], 0
    for part, n in sizes:
        base.append((part, total))
        total += n
    bases = F.broadcast(spark.createDataFrame(base, "part int, base long"))  # a row per written part
    kind = segments.schema["keys"].dataType.elementType.simpleString()

    def work(batches: Iterator[list]) -> Iterator[dict]:
        for keys, lengths, first, data in batches:
            for k in range(len(data)):
                whole = decode_segment(data[k].as_py()).astype("<u4")
                counts = np.array(lengths[k].as_py(), np.int64)
                ends = np.cumsum(counts)
                if len(whole) != ends[-1]:
                    raise ValueError("a segment's ids and lengths differ")
                spans = list(zip((ends - counts).tolist(), ends.tolist()))
                row = {"key": keys[k].as_py(), "start": first[k].as_py() + ends - counts, "n_tokens": counts, "ids_crc32": [zlib.crc32(whole[a:b].tobytes()) for a, b in spans]}
                yield row | ({"ids": [whole[a:b].tolist() for a, b in spans]} if ids else {})

    placed = segments.join(bases, "part").withColumn("first", F.col("first") + F.col("base"))
    out = f"key {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids
    return map_rows(placed, ["keys", "lengths", "first", "data"], out, work).withColumnRenamed("key", key)
