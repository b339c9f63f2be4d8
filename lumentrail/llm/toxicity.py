"""Toxicity: a convolutional text classifier trained in numpy.

A word's embedding is the sum of hashed embeddings of the word and of its beginnings. Filters of widths
1 to 3 slide over the words, the largest response of each filter in the whole text is kept, and a
logistic layer scores these maxima. Words are found and hashed in numpy, on the code points of many texts laid end
to end, and no table of words is kept: most words of a large corpus are rare, so that looking them up costs more
than their products with the filters.

Training takes every labelled document. They lie in shards by hash of the id; in each round every shard makes
passes over its documents from the same parameters, and the changes are averaged, those of a row of embeddings by
how often each shard touched it, so a word that few shards know learns as fast as in one.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumentrail.llm import words as W
from lumentrail.llm.shared import checkpoint, text_batches

LETTERS = re.compile(r"[^\W\d_]+")
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 15, 16, (1, 2, 3), 6
BEGINNINGS = (3, 4, 5, 6)
#: There is a shard for so many labelled documents, but at most MOST_SHARDS, which grow. One of several reads so many
#: documents, or so many words, at a time.
SHARD, MOST_SHARDS, WORDS = 10_000, 64, 4_000_000
FOLDS, SEED = 5, 7
#: Over several shards, changes are averaged after so many passes. Rows of embeddings are summed in so many blocks.
PASSES, BLOCKS = 2, 16
#: Texts are hashed in groups of so many characters; a longer text is alone. Of its words, so many are in hand at a time.
CHARS, STEP = 100_000, 50_000


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


@lru_cache(1)
def letters() -> np.ndarray:
    """By code point, whether LETTERS takes it."""
    out = np.zeros(0x110000, bool)
    for m in LETTERS.finditer(np.arange(len(out), dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")):
        out[m.start() : m.end()] = True
    return out


def groups(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """The texts in lower case, as many at a time as make up some CHARS characters."""
    group: list[str] = []
    size = 0
    for t in texts:
        low = t.lower() if t else ""
        if group and size + len(low) > CHARS:
            yield group
            group, size = [], 0
        group.append(low)
        size += len(low)
    if group:
        yield group


def hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word of lower-cased texts and of its beginnings, and by text the number of its first word (and the end).

    The words are those of ``words_of``. Unused places point at the row of zeros.
    """
    code = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    edge = np.flatnonzero(np.diff(letters().take(code, mode="clip"), prepend=False))
    starts, ends = edge[::2], edge[1::2]
    first = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    pieces = np.empty((1 + len(BEGINNINGS), len(starts)), np.uint16)
    for lo in range(0, len(starts), STEP):
        a, b = (x[lo : lo + STEP] - starts[lo] for x in (starts, ends))
        upto = [b, *(np.minimum(a + n, b) for n in BEGINNINGS)]
        h = W.word_hashes(code[starts[lo] : starts[lo] + b[-1]], np.tile(a, len(upto)), np.concatenate(upto)).reshape(len(upto), -1)
        h[0] >>= np.uint64(32)  # other bits than those of a beginning that is the whole word
        part = pieces[:, lo : lo + STEP]
        part[:] = h & np.uint64(BUCKETS - 1)
        for row, n in zip(part[1:], BEGINNINGS, strict=True):
            row[b - a < n] = BUCKETS
    return pieces.T, first


def summed(embedding: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """A row per word: the sum of its pieces' embeddings."""
    out = embedding.take(pieces[:, 0], axis=0, mode="clip")
    for i in range(1, pieces.shape[1]):
        out += embedding.take(pieces[:, i], axis=0, mode="clip")
    return out


PRODUCTS = sum(WIDTHS) * FILTERS


def _rows() -> list[list[int]]:
    """Per filter, the rows of the table of products for its offsets."""
    out, at = [], 0
    for w in WIDTHS:
        out += [[at + o * FILTERS + f for o in range(w)] for f in range(FILTERS)]
        at += w * FILTERS
    return out


ROWS = _rows()
FILTER_OF = np.array([f for _, f in sorted((row, f) for f, rows in enumerate(ROWS) for row in rows)])
OFFSET_OF = np.array([o for _, o in sorted((row, o) for rows in ROWS for o, row in enumerate(rows))])
#: After each text stand so many words without any response. Windows that begin at the first of them hold nothing
#: else; those that begin later might reach the next text and don't count.
GAP = max(WIDTHS)


@dataclass
class Model:
    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    prior: float
    thresholds: dict[str | None, float] = field(default_factory=dict)


def lay_out(parts: list, blank: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts, each followed by GAP blanks, and where each text begins (and the end)."""
    first = np.cumsum([0, *(len(x) + GAP for x in parts)])
    ids = np.full(first[-1], blank, np.int64)
    for x, at in zip(parts, first, strict=False):
        ids[at : at + len(x)] = x
    return ids, first


def pool(products: np.ndarray, ids: np.ndarray | None, first: np.ndarray, bias: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Per text and filter the largest response, at least 0, and, if asked for, where it is.

    The blanks after a text respond with zeros, so a text without words responds with the bias. Without ``ids`` the
    columns of ``products`` are the words in their order.
    """
    n = np.diff(first)
    out = np.empty((len(n), len(ROWS)), np.float32)
    where = np.empty((len(n), len(ROWS)), np.int64) if places else None
    text = np.repeat(np.arange(len(n)), n) if places else None
    after = [slice(o, None) if ids is None else ids[o:] for o in range(GAP)]
    late = (first[1:, None] - np.arange(1, GAP)).ravel()
    for f, rows in enumerate(ROWS):
        r = products[rows[0]].copy() if ids is None else products[rows[0]].take(ids, mode="clip")
        for o, row in enumerate(rows[1:], 1):
            r[:-o] += products[row][after[o]] if ids is None else products[row].take(after[o], mode="clip")
        r[late] = -np.inf
        best = np.maximum.reduceat(r, first[:-1])
        out[:, f] = best
        if places:
            at = np.flatnonzero(r == best.repeat(n))[::-1]
            where[text[at], f] = at
    return np.maximum(out + bias, 0), where


def respond(model: Model, pieces: np.ndarray, first: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """``pool`` over the words with these buckets, with the products of some STEP words at a time."""
    out: list[np.ndarray] = []
    where: list[np.ndarray] = []
    t = 0
    while t < len(first) - 1:
        u = max(t + 1, int(np.searchsorted(first, first[t] + STEP, side="right")) - 1)
        for lo in range(first[t], first[u] - GAP + 1, STEP):  # a longer text goes in parts, which overlap by what a window holds
            hi = min(lo + STEP + GAP - 1, first[u])
            best, at = pool(model.filters.T @ summed(model.embedding, pieces[lo:hi]).T, None, np.clip(first[t : u + 1] - lo, 0, hi - lo), model.bias, places)
            if lo == first[t]:
                out.append(best)
                where += [at + lo] if places else []
            else:
                if places:
                    where[-1] = np.where(best > out[-1], at + lo, where[-1])
                out[-1] = np.maximum(best, out[-1])
        t = u
    return np.concatenate(out), np.concatenate(where) if places else None


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Learner:
    """A model in training by minibatch Adagrad on the weighted log loss.

    Only the word under a maximum gets its gradient. Each occurrence of a word is dropped with probability 0.3, so
    that a text with several telling words teaches all of them. With fewer than two classes among its ``n``
    documents the score is the share of label 1 and nothing is trained.
    """

    def __init__(self, n: int, positive: int):
        rng = np.random.default_rng(SEED)
        share = (positive + 0.5) / (n + 1)
        self.model = m = Model(
            np.vstack([rng.normal(0, 0.1, (BUCKETS, DIM)), np.zeros((1, DIM))]).astype(np.float32),
            rng.normal(0, DIM**-0.5, (DIM, PRODUCTS)).astype(np.float32),
            np.full(len(WIDTHS) * FILTERS, -0.05, np.float32),
            rng.uniform(0.5, 1.0, len(WIDTHS) * FILTERS).astype(np.float32) * np.tile(np.where(np.arange(FILTERS) % 3, 1, -1), len(WIDTHS)).astype(np.float32),
            float(np.log(share / (1 - share))),
        )
        self.squares = [np.full_like(x, 1e-4) for x in (m.embedding[:, :1], m.filters, m.bias, m.out)]
        self.prior_sq = 1e-4
        self.touches, self.docs = np.zeros(BUCKETS + 1, np.float32), 0
        self.trains = 0 < positive < n
        if self.trains:
            m.prior = -2.0
            self.weights = np.array([n / (2 * (n - positive)), n / (2 * positive)], np.float32)
        else:
            m.out[:] = 0
        self.epochs = max(6, min(40, 12_000 // max(n, 1))) if self.trains else 0

    def learn(self, ids: list[range], y: np.ndarray, pieces: np.ndarray, rng: np.random.Generator, epoch: int) -> None:
        """One pass over texts that are ranges of rows of ``pieces``, which has the buckets of each word and, last, of the blank."""
        m, squares, blank = self.model, self.squares, len(pieces) - 1
        step = 0.08 * (1 - 0.8 * epoch / self.epochs)
        order = rng.permutation(len(y))
        self.docs += len(y)
        for lo in range(0, len(y), 32):
            batch = order[lo : lo + 32]
            flat, first = lay_out([np.flatnonzero(rng.random(len(x)) > 0.3) + x.start for x in (ids[i] for i in batch)], blank)
            pooled, where = respond(m, pieces[flat], first, places=True)
            p = sigmoid(pooled @ m.out + m.prior)
            g = ((p - y[batch]) * self.weights[y[batch]] / len(batch)).astype(np.float32)
            d_out = g @ pooled + 1e-4 * m.out
            d_pool = g[:, None] * m.out[None, :] * (pooled > 0)
            d_rows = d_pool[:, FILTER_OF]
            live = np.nonzero(d_rows)
            hot, at = np.unique(np.minimum(where[:, FILTER_OF] + OFFSET_OF, len(flat) - 1)[live], return_inverse=True)
            d_prod = np.bincount(live[1] * len(hot) + at, d_rows[live], PRODUCTS * len(hot)).reshape(PRODUCTS, -1).astype(np.float32)
            d_filters = summed(m.embedding, pieces[flat[hot]]).T @ d_prod.T + 1e-5 * m.filters
            d_emb = d_prod.T @ m.filters.T
            flat = pieces[flat[hot]].ravel().astype(np.int64)
            by = np.argsort(flat, kind="stable")
            begins = np.flatnonzero(np.diff(flat[by], prepend=-1))
            touched = flat[by[begins]]
            d_rows = np.add.reduceat(d_emb[by // pieces.shape[1]], begins, axis=0) if len(by) else np.zeros((0, DIM), np.float32)
            d_rows[touched == BUCKETS] = 0
            squares[0][touched, 0] += (d_rows**2).mean(axis=1)
            m.embedding[touched] -= step * d_rows / np.sqrt(squares[0][touched])
            self.touches[touched] += 1
            for x, d, sq in ((m.filters, d_filters, squares[1]), (m.bias, d_pool.sum(axis=0), squares[2]), (m.out, d_out, squares[3])):
                sq += d * d
                x -= step * 0.5 * d / np.sqrt(sq)
            self.prior_sq += float(g.sum()) ** 2
            m.prior -= step * 0.5 * float(g.sum()) / self.prior_sq**0.5

    def state(self) -> tuple[np.ndarray, np.ndarray]:
        """The rows of embeddings with their squares, and all other parameters with theirs, as doubles."""
        m = self.model
        dense = [m.filters, m.bias, m.out, np.array([m.prior]), *self.squares[1:], np.array([self.prior_sq])]
        return np.hstack([m.embedding, self.squares[0]]).astype(float), np.concatenate([x.ravel() for x in dense]).astype(float)

    def change(self, rows: np.ndarray, dense: np.ndarray) -> None:
        """Adds to the parameters what ``state`` would differ by."""
        m = self.model
        m.embedding += rows[:, :DIM].astype(np.float32)
        self.squares[0] += rows[:, DIM:].astype(np.float32)
        at = 0
        for x in (m.filters, m.bias, m.out, None, *self.squares[1:], None):
            n = 1 if x is None else x.size
            if x is not None:
                x += dense[at : at + n].reshape(x.shape).astype(np.float32)
            at += n
        m.prior += float(dense[m.filters.size + m.bias.size + m.out.size])
        self.prior_sq += float(dense[-1])


class Scorer:
    """Scores batches of texts."""

    def __init__(self, model: Model):
        self.model = model

    def score(self, texts: Iterable[str | None]) -> np.ndarray:
        return np.concatenate([np.zeros(0), *map(self._score, groups(texts))])

    def _score(self, texts: list[str]) -> np.ndarray:
        m = self.model
        found, first = hashed(texts)
        pieces = np.full((len(found) + GAP * len(texts), found.shape[1]), BUCKETS, np.uint16)
        pieces[np.arange(len(found)) + GAP * np.repeat(np.arange(len(texts)), np.diff(first))] = found
        pooled, _ = respond(m, pieces, first + GAP * np.arange(len(first)))
        return sigmoid((pooled @ m.out).astype(np.float64) + m.prior)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves no remainder by 5. False for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("long").cast("string")) % FOLDS == 0, F.lit(False))


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, label_col: str) -> tuple[DataFrame, int]:
    """``(fold, y, lang, words)`` of each labelled document that isn't held out, a partition per shard, and their number.

    ``words`` is compressed. The order within a shard is that of a hash of the id, whose last bit is the fold.
    """
    ids = labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("__y")).where("__id is not null and __y in (0, 1)").where(~held_out("__id")).groupBy("__id").agg(F.max("__y").alias("__y"))
    shards = max(1, min(MOST_SHARDS, -(-ids.count() // SHARD)))
    texts = text_batches(docs).select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__t"), F.col(lang_col).cast("string").alias("__l")).where("__id is not null").where(~held_out("__id"))
    found = texts.join(ids, "__id").groupBy("__id").agg(F.max("__y").alias("y"), F.min(F.struct("__t", "__l")).alias("d"))
    found = found.select("__id", F.crc32(F.concat(F.col("__id").cast("string"), F.lit("."))).alias("h"), "y", F.col("d.__l").alias("lang"), F.col("d.__t").alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [zlib.compress("\n".join(words_of(t)).encode(), 1) for t in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(words, pa.binary())], ["id", "h", "y", "lang", "words"])

    packed = found.mapInArrow(pack, "id long, h long, y int, lang string, words binary")
    packed = packed.repartition(shards, "id").sortWithinPartitions("h", "id")
    return checkpoint(packed.select((F.col("h") % 2).cast("int").alias("fold"), "y", "lang", "words")), shards


def _chunks(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[tuple[np.ndarray, np.ndarray, list[range], np.ndarray]]:
    """Folds, labels, ranges of words and their buckets of so many documents at a time, or of all."""

    def chunk():
        pieces = np.concatenate([*parts, np.full((1, 1 + len(BEGINNINGS)), BUCKETS, np.uint16)])
        parts.clear()
        at = np.cumsum([0, *sizes])
        return np.array(fold), np.array(y), [range(a, b) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pieces

    fold, y, sizes, parts = [], [], [], []
    for b in batches:
        lo, folds, labels = 0, b.column(0).to_pylist(), b.column(1).to_pylist()
        for group in groups(zlib.decompress(x).decode() for x in b.column(3).to_pylist()):
            pieces, first = hashed(group)
            fold += folds[lo : lo + len(group)]
            y += labels[lo : lo + len(group)]
            sizes += np.diff(first).tolist()
            parts.append(pieces)
            lo += len(group)
            if not whole and (len(y) >= SHARD or sum(map(len, parts)) >= WORDS):
                yield chunk()
                fold, y, sizes, parts = [], [], [], []
    if y:
        yield chunk()


def _round(data: DataFrame, learners: list[Learner], epochs: list[range], whole: bool) -> None:
    """Passes over all documents in all shards, and changes the learners by the averages.

    Learner k leaves out fold k. ``epochs`` says which passes each makes, one after the other over what is read at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        before = [x.state() for x in learners]
        for x in learners:
            x.touches[:], x.docs = 0, 0
        rng = np.random.default_rng((SEED, shard, epochs[-1].start))
        for fold, y, ids, pieces in _chunks(batches, whole):
            for k, x in enumerate(learners):
                at = np.flatnonzero(fold != k)
                for epoch in epochs[k] if len(at) else ():
                    x.learn([ids[i] for i in at], y[at], pieces, rng, epoch)
        out = []
        for k, (x, (rows, dense)) in enumerate(zip(learners, before, strict=True)):
            if not x.docs:
                continue
            now_rows, now_dense = x.state()
            weighted = np.hstack([(now_rows - rows) * x.touches[:, None], x.touches[:, None]])
            out += [(k, j, shard, part.astype(np.float32).tobytes()) for j, part in enumerate(np.array_split(weighted, BLOCKS))]
            out.append((k, BLOCKS, shard, (np.append(now_dense - dense, 1) * x.docs).astype(np.float32).tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["k", "block", "shard", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for k, j, _, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                sums[k, j] = sums.get((k, j), 0) + np.frombuffer(part, np.float32).astype(float)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in sums], pa.int32()), pa.array([j for _, j in sums], pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["k", "block", "sums"])

    parts = data.mapInArrow(run, "k int, block int, shard int, sums binary")
    parts = parts.repartition("k", "block").sortWithinPartitions("k", "block", "shard").mapInArrow(add, "k int, block int, sums binary")
    found = {(r.k, r.block): np.frombuffer(r.sums) for r in parts.collect()}
    for k, x in enumerate(learners):
        if (k, BLOCKS) in found:
            rows = np.concatenate([found[k, j] for j in range(BLOCKS)]).reshape(BUCKETS + 1, -1)
            dense = found[k, BLOCKS]
            x.change(rows[:, :-1] / np.maximum(rows[:, -1:], 1), dense[:-1] / dense[-1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic") -> Model:
    """Fits the classifier, and calibrates a threshold for each language, on all labelled documents that aren't held out.

    Labels other than 0 and 1 are ignored; of repeated labels the larger counts. Two more models are fitted
    without either half of the documents and score that half: by these scores each language gets the threshold,
    in the middle of its best range, that gets most of both classes right (0.5 for languages with under 20 such
    rows or one class).
    """
    data, shards = _labelled(docs, labels, id_col, text_col, lang_col, label_col)
    counts = {r.fold: (r.n, r.p) for r in data.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p")).collect()}
    learners = [Learner(*(sum(x[i] for f, x in counts.items() if f != k) for i in (0, 1))) for k in (0, 1, 2)]
    most = max(x.epochs for x in learners)
    passes = most if shards == 1 else PASSES
    for first in range(0, most, max(1, passes)):
        _round(data, learners, [range(first, min(first + passes, x.epochs)) for x in learners], shards == 1)
    model = learners[2].model
    if all(x.trains for x in learners):
        model.thresholds = _thresholds(data, [x.model for x in learners[:2]])
    return model


def _thresholds(data: DataFrame, models: list[Model]) -> dict[str | None, float]:
    """By language, from the scores that each fold gets from the model without it."""
    grid = np.linspace(0.05, 0.95, 91)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [Scorer(m) for m in models]
        for b in batches:
            fold, packed = b.column(0).to_numpy(), b.column(3).to_pylist()
            reached = np.zeros(len(packed), np.int32)
            for k, scorer in enumerate(scorers):
                at = np.flatnonzero(fold == k)
                reached[at] = np.searchsorted(grid, scorer.score(zlib.decompress(packed[i]).decode() for i in at), side="right")
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(1), pa.array(reached)], ["lang", "y", "reached"])

    by: dict[str | None, np.ndarray] = {}
    for r in data.mapInArrow(run, "lang string, y int, reached int").groupBy("lang", "y", "reached").count().collect():
        by.setdefault(r.lang, np.zeros((2, len(grid) + 1)))[r.y, r.reached] += r["count"]
    thresholds: dict[str | None, float] = {}
    for lang, n in by.items():
        total = n.sum(axis=1)
        if total.sum() >= 20 and total.all():
            below = n.cumsum(axis=1)[:, :-1]  # by grid value, how many stay below it
            good = (total[1] - below[1]) / total[1] + below[0] / total[0]
            best = grid[good >= good.max() - 1e-12]
            thresholds[lang] = float(best[np.argmin(abs(best - 0.5))])
    return thresholds


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(doc_id, held_out, score, predicted, rejected)`` for every row; only the text enters the score.

    ``predicted`` is 1 from a score of 0.5; ``rejected`` holds the score against the threshold of the row's
    language (0.5 where there is none). Null and empty texts score as a text without words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(scorer.score(b.column(1).to_pylist()))], ["doc_id", "lang", "score"])

    scored = text_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).mapInArrow(run, "doc_id long, lang string, score double")
    least = F.lit(0.5)
    for lang, t in sorted(model.thresholds.items(), key=str):
        least = F.when(F.col("lang").eqNullSafe(F.lit(lang)), t).otherwise(least)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), (F.col("score") >= least).alias("rejected"))


def accepted(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, all columns, whose score stays below their language's threshold."""
    at, lang = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            least = np.array([model.thresholds.get(x, 0.5) for x in b.column(lang).to_pylist()])
            yield b.filter(pa.array(scorer.score(b.column(at).to_pylist()) < least))

    return text_batches(docs).mapInArrow(run, docs.schema)
