"""Removal of repeated passages by winnowing.

Texts are sequences of words. Every run of ``NOISE`` words is hashed, and of each ``WINDOW``
consecutive hashes the least is kept as a fingerprint: two texts that share ``NOISE + WINDOW - 1``
words anywhere share a fingerprint (Schleimer, Wilkerson, Aiken 2003). Fingerprints are joined with
their first occurrence in (doc_id, position) order, those close together make a run, both ends of a run
are extended word by word as far as the texts agree, and the later run is deleted.

The unit is the word and not the physical line: passages begin and end inside lines, and a line that
holds a copied passage rarely equals another line as a whole, so hashes of whole lines miss most of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lumentrail.llm import words as W
from lumentrail.llm.shared import checkpoint, maybe_broadcast, scratch, shielded, text_batches

#: No repeated run below NOISE words is touched; every one of NOISE + WINDOW - 1 = 51 words or more goes.
NOISE, WINDOW = 32, 20
#: Stands for a null id, so that those come first.
NULL_ID = -(1 << 63)


def _slide(x: np.ndarray, w: int, op) -> np.ndarray:
    """``op`` over each window of ``w`` consecutive values, by doubling."""
    done = 1
    while done < w:
        step = min(done, w - done)
        x = op(x[:-step], x[step:])
        done += step
    return x


def winnow(hashes: np.ndarray, first: np.ndarray, noise: int = NOISE, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in all words) and values of the fingerprints of several texts laid end to end.

    ``first``: number of each text's first word, and of the end. A text of ``noise`` words or more has at
    least one fingerprint; all equal least values of a window are kept.
    """
    grams = W.gram_hashes(hashes, noise)
    if not len(grams):
        return np.zeros(0, np.int64), grams
    size = np.maximum(np.diff(first) - noise + 1, 0)
    valid = np.zeros(len(grams), bool)
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[:-1], size)
    valid[at] = True
    # windows run over the valid grams of each text; shorter texts are one window
    value = grams[at]
    row = np.repeat(np.arange(len(size)), size)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    gap = window - 1
    pos = np.arange(len(at)) + gap * (row + 1)
    padded = np.full(len(at) + gap * (len(size) + 1), top)
    padded[pos] = value
    least = _slide(padded, window, np.minimum)
    # a window counts if it is whole, or is the whole of a short text
    start = np.arange(len(least))
    filled = np.zeros(len(padded) + 1, np.int64)
    here = np.zeros(len(padded), bool)
    here[pos] = True
    np.cumsum(here, out=filled[1:])
    whole = filled[start + window] - filled[start]
    short = np.zeros(len(padded), np.int64)
    short[pos] = np.minimum(np.repeat(size, size), window)
    need = np.maximum.reduce([_slide(short, window, np.maximum)])
    least = np.where((whole > 0) & (whole >= need), least, np.uint64(0))
    back = _slide(np.concatenate([np.zeros(gap, np.uint64), least, np.zeros(gap, np.uint64)]), window, np.maximum)
    chosen = (back[: len(padded)][pos] == value) & (value != 0)
    return at[chosen], value[chosen]


def _key(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("__id"), F.xxhash64(F.col(text_col).cast("string")).alias("__th"), F.col(text_col).cast("string").alias("__text")]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = NOISE, window: int = WINDOW) -> DataFrame:
    """``(h, id, th, pos)``: fingerprint, document (its id and the hash of its text), number of its first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in W.blocks(*W.utf8(b.column(2))):
                starts, ends, first = W.spans(data, off)
                at, value = winnow(W.word_hashes(data, starts, ends), first, noise, window)
                row = np.searchsorted(first, at, "right") - 1
                take = pa.array(row + i)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), b.column(0).take(take), b.column(1).take(take), pa.array((at - first[row]).astype(np.int32))], ["h", "id", "th", "pos"])

    return docs.select(*_key(docs, id_col, text_col)).mapInArrow(run, "h long, id long, th long, pos int")


def _edges(prints: DataFrame, noise: int) -> DataFrame:
    """``(id, th, run, left, at, id0, th0, at0)``: both ends of each repeated run, before extension.

    A run is a stretch of a document that is covered by repeated fingerprints other than their first
    occurrences; ``at`` is the number of its first word, or of the word after it, and ``at0`` the same place
    at the first occurrence of the fingerprint at that end. Each fingerprint is counted and given its least
    document by a combining aggregation; only repeated ones go on.
    """
    seen = prints.groupBy("h").agg(F.count("*").alias("n"), F.min("id").alias("id0")).where("n > 1").drop("n")
    some = checkpoint(prints.join(seen, "h"))
    # of documents with the same id, the one with the least text hash; in it, the least position
    head = some.where("id = id0").groupBy("h").agg(F.min("th").alias("th0"))
    head = some.where("id = id0").join(head, "h").where("th = th0").groupBy("h", "th0").agg(F.min("pos").alias("pos0"))
    later = some.join(head, "h").where("id <> id0 or th <> th0 or pos <> pos0").drop("h")
    line = Window.partitionBy("id", "th").orderBy("pos", "id0", "pos0")
    later = later.withColumn("left", F.coalesce(F.col("pos") - F.lag("pos").over(line) > noise, F.lit(True))).withColumn("right", F.coalesce(F.lead("pos").over(line) - F.col("pos") > noise, F.lit(True)))
    later = later.withColumn("run", F.sum(F.col("left").cast("int")).over(line)).where("left or right")
    ends = F.array(F.when(F.col("left"), F.struct(F.lit(True).alias("left"), F.col("pos").alias("at"), F.col("pos0").alias("at0"))), F.when(F.col("right"), F.struct(F.lit(False).alias("left"), (F.col("pos") + noise).alias("at"), (F.col("pos0") + noise).alias("at0"))))
    return later.select("id", "th", "run", "id0", "th0", F.explode(ends).alias("e")).where("e is not null").select("id", "th", "run", "e.left", "e.at", "id0", "th0", "e.at0")


def _context(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, size: int, window: int) -> DataFrame:
    """For the places ``wanted(id, th, at)``: hashes of the ``window`` words before and after them.

    ``before`` is nearest first; words past either end of the text are missing. ``size`` bounds the broadcast.
    """
    by = checkpoint(wanted.groupBy("id", "th").agg(F.collect_set("at").alias("spots")))
    src = docs.select(*_key(docs, id_col, text_col))
    both = src.join(maybe_broadcast(by, size), (F.col("__th") == F.col("th")) & (F.col("__id") == F.col("id"))).select("__id", "__th", "__text", "spots")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, th, spots = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3)
            out: list[list] = [[], [], [], [], []]
            for i, j, data, off in W.blocks(*W.utf8(b.column(2))):
                starts, ends, first = W.spans(data, off)
                h = W.word_hashes(data, starts, ends).astype(np.uint32).view(np.int32)
                for r in range(i, j):
                    own = h[first[r - i] : first[r - i + 1]]
                    for at in spots[r].as_py():
                        for x, v in zip(out, (ids[r], th[r], at, own[max(0, at - window) : at][::-1].tolist(), own[at : at + window].tolist()), strict=True):
                            x.append(v)
            types = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], ["id", "th", "at", "before", "after"])

    return both.mapInArrow(run, "id long, th long, at int, before array<int>, after array<int>").dropDuplicates(["id", "th", "at"])


def _agree(a: str, b: str) -> Column:
    """In how many elements from the first on two arrays agree."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when(differ == 0, F.size(a)).otherwise(differ - 1).cast("int")


def _extended(edges: DataFrame, around: DataFrame) -> DataFrame:
    """``(id, th, start, end)``: the runs, extended as far as the words around them and their first occurrence agree."""
    first = around.select(F.col("id").alias("id0"), F.col("th").alias("th0"), F.col("at").alias("at0"), F.col("before").alias("before0"), F.col("after").alias("after0"))
    both = edges.join(around, ["id", "th", "at"]).join(first, ["id0", "th0", "at0"])
    return both.groupBy("id", "th", "run").agg(F.min(F.when(F.col("left"), F.col("at") - _agree("before", "before0"))).alias("start"), F.max(F.when(~F.col("left"), F.col("at") + _agree("after", "after0"))).alias("end"))


def _cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> bytes:
    """The text without the words marked in ``gone``.

    A deleted stretch goes with the white space on one side of it: that after it, unless only that holds a
    line feed, so that lines that stay are never joined. At either end of the text both go.
    """
    n = len(starts)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    parts, at, text = [], 0, data.tobytes()
    for a, b in edge.reshape(-1, 2):
        left = int(ends[a - 1]) if a else 0
        right = int(starts[b]) if b < n else len(text)
        parts.append(text[at:left])
        if a and b < n:
            before, after = text[left : int(starts[a])], text[int(ends[b - 1]) : right]
            parts.append(before if b"\n" in before or b"\n" not in after else after)
        at = right
    parts.append(text[at:])
    return b"".join(parts)


def delete_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = NOISE, window: int = WINDOW, removed_col: str | None = None) -> DataFrame:
    """The rows and columns of ``docs`` with later repeats of a passage deleted from the text.

    Of any passage of ``noise + window - 1`` words or more that occurs several times, across documents or
    within one, only the first occurrence in (doc_id, position) order stays; no repeat of fewer than ``noise``
    words is touched, and a document without a repeat keeps its text byte for byte. Up to ``window - 1`` words
    at either end of a passage go if they agree with where the fingerprint at that end first occurred. With ``removed_col`` the number of deleted words is added.
    Null texts stay null, a document that is a repeat as a whole keeps its row with an empty text. Null
    ids come first in the order. Rows equal in id and text count as one document and are treated alike.
    """
    columns = docs.columns
    docs, (id_col, text_col) = shielded(text_batches(docs), id_col, text_col)
    prints_at = scratch(docs.sparkSession, "prints")
    fingerprints(docs, id_col, text_col, noise, window).write.parquet(prints_at)
    edges = checkpoint(_edges(docs.sparkSession.read.schema("h long, id long, th long, pos int").parquet(prints_at), noise))
    size = 16 * edges.count()
    places = edges.select("id", "th", "at").union(edges.select("id0", "th0", "at0"))
    around = checkpoint(_context(docs, id_col, text_col, places, size, window))
    by = _extended(edges, around).groupBy("id", "th").agg(F.collect_set(F.struct("start", "end")).alias("__runs"))
    by = checkpoint(by.withColumnRenamed("id", "__rid").withColumnRenamed("th", "__rth"))
    key, th, _ = _key(docs, id_col, text_col)
    both = docs.select("*", key, th).join(maybe_broadcast(by, size), (F.col("__th") == F.col("__rth")) & (F.col("__id") == F.col("__rid")), "left").select(*docs.columns, "__runs")
    at, removed = docs.columns.index(text_col), removed_col is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marked = batch.column(batch.num_columns - 1)
            rows = np.flatnonzero(np.asarray(marked.is_valid()))
            counts = np.zeros(batch.num_rows, np.int64)
            columns = list(batch.columns[:-1])
            if len(rows):
                col = columns[at]
                texts = col.to_pylist()
                for i, _, data, off in W.blocks(*W.utf8(col.take(pa.array(rows))), limit=1):
                    starts, ends, _ = W.spans(data, off)
                    gone = np.zeros(len(starts), bool)
                    for r in marked[int(rows[i])].as_py():
                        gone[r["start"] : r["end"]] = True
                    counts[rows[i]] = int(gone.sum())
                    texts[rows[i]] = _cut(data, starts, ends, gone).decode("utf-8", "replace")
                columns[at] = pa.array(texts, col.type)
            if removed:
                columns.append(pa.array(counts))
            yield pa.RecordBatch.from_arrays(columns, names)

    names = [*docs.columns, "removed"] if removed else docs.columns
    schema = StructType([*docs.schema.fields, *([StructField("removed", LongType())] if removed else [])])
    return both.mapInArrow(run, schema).toDF(*columns, *([removed_col] if removed else []))
