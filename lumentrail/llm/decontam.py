"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may be met with at most k = floor(rate * m) edits. Cut into k + 1 pieces,
at least one piece survives k edits unchanged, so every match holds an exact piece hit where the piece
belongs. One automaton over all pieces finds the hits in a single pass over each whole text; the place
around each hit is verified with Myers' bit-parallel distance, kept in one wide integer per column.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumentrail.llm.shared import text_batches

#: Edits allowed per character of an item. Within this, pieces keep about 12 characters.
RATE = 0.08
#: Items below this length must occur unchanged, between white space.
SHORT = 24
#: Characters of items that one pass over the documents searches for; more items make more passes.
PASS_CHARS = 1_000_000


def normalize(text: str | None) -> str:
    """Lower case, with white space runs as one space; null is empty."""
    return " ".join(text.lower().split()) if text else ""


def distance_within(masks: dict[str, int], m: int, text: str) -> int:
    """The least edit distance between an item and any part of ``text`` (Myers 1999, search variant)."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    get = masks.get
    for c in text:
        eq = get(c, 0)
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = (mv | ~(xh | pv)) & full
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best = score
                if not best:
                    break
        ph = (ph << 1) & full
        pv = ((mh << 1) | ~(eq | mv | ph)) & full
        mv = ph & (eq | mv)
    return best


class Matcher:
    """Finds items within their error budget in normalized texts. ``items``: id and text pairs."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        self.ids, self.texts, self.budget = [], [], []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            text = normalize(text)
            if not text:
                continue
            k = int(rate * len(text)) if len(text) >= SHORT else 0
            cut = [round(j * len(text) / (k + 1)) for j in range(k + 2)]
            for a, b in zip(cut, cut[1:], strict=False):
                pieces.setdefault(text[a:b], []).append((len(self.ids), a))
            self.ids.append(item_id)
            self.texts.append(text)
            self.budget.append(k)
        self.masks: list[dict[str, int] | None] = [None] * len(self.ids)
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()

    def _mask(self, i: int) -> dict[str, int]:
        if self.masks[i] is None:
            masks: dict[str, int] = {}
            for j, c in enumerate(self.texts[i]):
                masks[c] = masks.get(c, 0) | 1 << j
            self.masks[i] = masks
        return self.masks[i]

    def find(self, text: str | None) -> dict[int, int]:
        """Item id -> least distance, for the items that occur within their budget anywhere in the text."""
        text = normalize(text)
        if not text or not self.ids:
            return {}
        starts: dict[int, set[int]] = {}
        for end, (length, places) in self.automaton.iter(text):
            for i, offset in places:
                starts.setdefault(i, set()).add(end + 1 - length - offset)
        out: dict[int, int] = {}
        for i, at in starts.items():
            m, k = len(self.texts[i]), self.budget[i]
            best = k + 1
            if m < SHORT:
                if f" {self.texts[i]} " in f" {text} ":
                    best = 0
            else:
                lo = hi = None
                for s in sorted(at):  # places whose windows overlap are verified together
                    if hi is not None and s - k <= hi:
                        hi = s + m + k
                        continue
                    if hi is not None:
                        best = min(best, distance_within(self._mask(i), m, text[lo:hi]))
                    lo, hi = max(0, s - k), s + m + k
                best = min(best, distance_within(self._mask(i), m, text[lo:hi]))
            if best <= k:
                out[self.ids[i]] = min(best, out.get(self.ids[i], best))
        return out


def _passes(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items in lists of bounded size. Their number grows with the benchmark, never with the corpus."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct()
    n = -(-int(items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]) // PASS_CHARS)
    for i in range(n):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).sort("item_id", "text").collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE) -> DataFrame:
    """``(doc_id, item_id, distance)``: each pair of a document and an item found in it, with the least distance.

    Null or blank texts and items match nothing. Repeated items with one id give one row per document,
    repeated documents give their rows again, and a null doc_id is carried. No text is cut short.
    """
    src = text_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, item_id long, distance int"
    out = docs.sparkSession.createDataFrame([], schema)
    for items in _passes(benchmark, item_col, item_text_col):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items, rate)
            for b in batches:
                rows = [(d, i, n) for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) for i, n in matcher.find(t.as_py()).items()]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], type_) for j, type_ in enumerate((pa.int64(), pa.int64(), pa.int32()))], ["doc_id", "item_id", "distance"])

        out = out.union(src.mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item of the benchmark within its error budget."""
    for items in _passes(benchmark, item_col, item_text_col):
        at = docs.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch], items=items, at=at) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items, rate)
            for b in batches:
                yield b.filter(pa.array(np.array([not matcher.find(t.as_py()) for t in b.column(at)], dtype=bool)))

        docs = text_batches(docs).mapInArrow(run, docs.schema)
    return docs
