"""SimHash near-duplicates: fingerprints, and all pairs within a Hamming distance by anchor covering.

Anchors are the codewords of a covering code: two copies of the binary Golay [23, 12] code over bits
0-22 and 23-45 of the fingerprint. That code is perfect with covering radius 3, so every 23-bit word
lies within 3 of exactly one codeword, its home. A fingerprint at most ``t`` bits from another one
lies within 3 + e1 and 3 + e2 of the other's two homes for some e1 + e2 <= t. Every fingerprint is
therefore replicated to each anchor within the covering radius plus its share of the threshold and
compared there with the fingerprints at home: every link is found, and each in one place.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce
from itertools import combinations
from operator import xor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumentrail.llm import words as W
from lumentrail.llm.components import components
from lumentrail.llm.shared import checkpoint, maybe_broadcast, shielded, text_batches

GENERATOR, N, CHECKS, RADIUS = 0b101011100011, 23, 11, 3


def fingerprints_of(data: np.ndarray, off: np.ndarray, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """The 64-bit SimHash of each text, over the XXH64 of all its word shingles, repeats included.

    A bit is 1 if set in over half of the hashes. Fewer words than a shingle make one shorter shingle;
    a text without words has fingerprint zero.
    """
    out = np.zeros(len(off) - 1, np.uint64)
    for i, j, part, at in W.blocks(data, off):
        norm, starts, ends, first = W.normalized(part, at)
        count = np.diff(first)
        shingles = np.where(count == 0, 0, np.maximum(count - shingle + 1, 1))
        if not (total := int(shingles.sum())):
            continue
        begin = np.cumsum(shingles) - shingles
        head = np.arange(total) - np.repeat(begin, shingles) + np.repeat(first[:-1], shingles)
        tail = np.minimum(head + shingle, np.repeat(first[1:], shingles)) - 1
        h = W.xxh64(norm, starts[head], ends[tail] - starts[head], seed)
        rows = np.flatnonzero(shingles)
        ones = np.zeros((len(rows), 64), np.int64)
        step = 1 << 16
        for lo in range(0, total, step):
            bits = np.unpackbits(h[lo : lo + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            a, b = np.searchsorted(begin[rows], lo, "right") - 1, np.searchsorted(begin[rows], lo + len(bits), "left")
            ones[a:b] += np.add.reduceat(bits, np.maximum(begin[rows][a:b] - lo, 0), axis=0, dtype=np.int32)
        set_ = 2 * ones > shingles[rows][:, None]
        out[i + rows] = np.packbits(set_, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, also: list[str] | None = None) -> DataFrame:
    """``(doc_id, fp)`` with the fingerprint as a signed 64-bit integer, and after them any columns ``also`` (long)."""
    also = also or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = fingerprints_of(*W.utf8(b.column(1)), shingle=shingle)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), *b.columns[2:]], ["doc_id", "fp", *also])

    src = text_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *also)
    return src.mapInArrow(run, ", ".join(["doc_id long", "fp long", *(f"{c} long" for c in also)]))


@cache
def _golay() -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The syndrome of each 12- and 11-bit half, and per excess 0, 1, 2 the error patterns by syndrome.

    Patterns come as one array ordered by syndrome and the offsets of each syndrome in it.
    """
    power = []
    for i in range(N):
        r = 1 << i
        for b in range(N - 1, CHECKS - 1, -1):
            if r >> b & 1:
                r ^= GENERATOR << (b - CHECKS)
        power.append(r)
    half = np.zeros((2, 1 << 12), np.int64)
    for i in range(N):
        side, bit = divmod(i, 12)
        half[side] ^= np.where(np.arange(1 << 12) >> bit & 1, power[i], 0)
    by: list[tuple[np.ndarray, np.ndarray]] = []
    for weights in (range(RADIUS + 1), [RADIUS + 1], [RADIUS + 2]):
        found = sorted((reduce(xor, (power[i] for i in c), 0), sum(1 << i for i in c)) for w in weights for c in combinations(range(N), w))
        syn = np.array([s for s, _ in found])
        by.append((np.array([p for _, p in found], np.int64), np.searchsorted(syn, np.arange((1 << CHECKS) + 1))))
    return half, by


def _syndrome(x: np.ndarray) -> np.ndarray:
    half, _ = _golay()
    return half[0][x & 0xFFF] ^ half[1][x >> 12]


def anchors(fp: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of arrays: index of the fingerprint, and an anchor that it is replicated to (the home first)."""
    _, by = _golay()
    parts = [(fp & np.uint64(0x7FFFFF)).astype(np.int64), ((fp >> np.uint64(23)) & np.uint64(0x7FFFFF)).astype(np.int64)]
    syn = [_syndrome(x) for x in parts]
    for e1 in range(threshold + 1):
        for e2 in range(threshold + 1 - e1):
            (p1, o1), (p2, o2) = by[e1], by[e2]
            n1, n2 = o1[syn[0] + 1] - o1[syn[0]], o2[syn[1] + 1] - o2[syn[1]]
            times = n1 * n2
            idx = np.repeat(np.arange(len(fp)), times)
            k = np.arange(len(idx)) - np.repeat(np.cumsum(times) - times, times)
            a, b = np.divmod(k, n2[idx])
            one = parts[0][idx] ^ p1[o1[syn[0][idx]] + a]
            two = parts[1][idx] ^ p2[o2[syn[1][idx]] + b]
            yield idx, one | (two << 23)


def links(fps: DataFrame, threshold: int = 2) -> DataFrame:
    """``(u, v)``: all pairs of different fingerprints of ``fps(fp)``, distinct, within ``threshold`` <= 2 bits."""
    if not 0 <= threshold <= 2:
        raise ValueError("threshold must be 0, 1 or 2")

    def spread(only_home: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                fp = b.column(0).to_numpy(zero_copy_only=False)
                for lo in range(0, len(fp), 1024):
                    part = fp[lo : lo + 1024]
                    for idx, anchor in anchors(part.view(np.uint64), 0 if only_home else threshold):
                        yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[idx])], ["anchor", "fp"])

        return run

    home = fps.mapInArrow(spread(True), "anchor long, fp long").select("anchor", F.col("fp").alias("u"))
    near = fps.mapInArrow(spread(False), "anchor long, fp long").select("anchor", F.col("fp").alias("v"))
    return home.join(near, "anchor").where((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= threshold)).select("u", "v")


def _grouped(fps: DataFrame, threshold: int) -> DataFrame:
    """``(fp, root)`` of each different fingerprint; the root is the least fingerprint reachable."""
    classes = checkpoint(fps.select("fp").distinct())
    roots = components(links(classes, threshold)).withColumnRenamed("node", "fp")
    return checkpoint(classes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, threshold: int = 2) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    ``fingerprint`` is 16 lower-case hex digits; ``component_id`` is the smallest doc_id reachable over
    links of at most ``threshold`` differing bits. Equal fingerprints are first merged by a combining
    aggregation, so a group of copies of any size is one node, and no pair of copies is emitted.

    Null or blank texts have fingerprint zero and link like others. Repeated rows are returned as often
    as they come. A null doc_id is returned with its component and is never a component's id, unless
    the component has no other (then null). An empty table gives an empty result.
    """
    fps = checkpoint(fingerprint(docs, id_col, text_col, shingle))
    rooted = _grouped(fps, threshold)
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = least.join(rooted, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.join(named, "root").select("fp", "component_id")
    return fps.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, threshold: int = 2) -> DataFrame:
    """The rows of ``docs``, all columns, of which one is left from each component: that of the least doc_id.

    Null ids come last, and of rows that share an id that with the least hash of its text is left. Of rows
    equal in both one stays. What goes is joined, and broadcast while it is small, so that texts don't move.
    """
    columns = docs.columns
    docs, (id_col, text_col) = shielded(docs, id_col, text_col)
    keyed = docs.select(F.col(id_col).cast("long").alias("__id"), F.xxhash64(F.col(text_col).cast("string")).alias("__th"), F.col(text_col).cast("string").alias("text"))
    fps = checkpoint(fingerprint(keyed, "__id", "text", shingle, ["__th"]).withColumnRenamed("doc_id", "__id"))
    rooted = _grouped(fps, threshold)
    # one row per different document; the first of a component is found in steps of combining aggregations
    rows = checkpoint(fps.groupBy("fp", "__id", "__th").agg(F.count("*").alias("n")).join(rooted, "fp"))
    id_of = rows.groupBy("root").agg(F.min("__id").alias("id0"))
    first = rows.join(id_of, "root").where(F.col("__id").eqNullSafe(F.col("id0"))).groupBy("root", "id0").agg(F.min("__th").alias("th0"))
    marked = checkpoint(rows.join(first, "root").select("__id", "__th", "n", (F.col("__id").eqNullSafe(F.col("id0")) & (F.col("__th") == F.col("th0"))).alias("stays")))
    gone = marked.where("not stays").select(F.col("__id").alias("__gid"), F.col("__th").alias("__gth"))
    key, th = F.col(id_col).cast("long").alias("__id"), F.xxhash64(F.col(text_col).cast("string")).alias("__th")
    left = docs.select("*", key, th).join(maybe_broadcast(gone, 16 * gone.count()), (F.col("__th") == F.col("__gth")) & F.col("__id").eqNullSafe(F.col("__gid")), "left_anti")
    if not marked.where("stays and n > 1").isEmpty():
        left = left.dropDuplicates(["__id", "__th"])
    return left.select(*docs.columns).toDF(*columns)
