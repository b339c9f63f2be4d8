"""Approximate nearest neighbours by score-aware quantisation.

Nearest in Euclidean distance is largest in ``q.x - |x|^2 / 2``, an inner product and a stored number. Vectors
are product-quantised with 16 centres per two dimensions, so that a code takes four bits. Codes and centres are
fitted to an anisotropic loss: an error parallel to the vector changes its large inner products and is
penalised more than one across it (Guo et al. 2020). A scan sums one table entry per pair of codes, keeps
the best of each block, and ranks those by exact distance.

There is no coarse partition: on data without clusters one must probe about half of all cells for a
recall of 0.9, so all codes are scanned. Candidates never move: they stay in their partitions while
blocks of queries of bounded size are sent to them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumentrail.llm.shared import checkpoint

#: The codebooks are fitted on at most so many vectors, least hash of the id first. All vectors are indexed.
SAMPLE = 20_000
CENTRES, SUB = 16, 2
#: Inner products above this share of the largest possible count in the loss; sets the parallel penalty.
THRESHOLD = 0.25
#: Queries of one pass over the index, in bytes of their vectors.
PASS_BYTES = 8 << 20
#: Of each block of so many candidates, so many are ranked exactly for each query.
BLOCK, RERANK = 8192, 160
TABLE_QUERIES = 64


@dataclass
class Codebook:
    centres: np.ndarray  # subspace, centre, SUB
    penalty: float

    def _parts(self, x: np.ndarray) -> np.ndarray:
        m = len(self.centres)
        out = np.zeros((len(x), m * SUB))
        out[:, : x.shape[1]] = x
        return out.reshape(len(x), m, SUB)

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """The centre of each subspace, by coordinate descent on the anisotropic loss."""
        parts = self._parts(x)
        norm = np.linalg.norm(x, axis=1)
        unit = parts / np.where(norm == 0, 1, norm)[:, None, None]
        plain = np.stack([((parts[:, m, None, :] - c[None]) ** 2).sum(-1) for m, c in enumerate(self.centres)], axis=1)
        along = np.stack([((parts[:, m, None, :] - c[None]) * unit[:, m, None, :]).sum(-1) for m, c in enumerate(self.centres)], axis=1)
        code = plain.argmin(axis=2)
        rows = np.arange(len(x))
        total = along[rows[:, None], np.arange(len(self.centres))[None, :], code].sum(axis=1)
        for _ in range(sweeps):
            for m in range(len(self.centres)):
                other = total - along[rows, m, code[:, m]]
                code[:, m] = (plain[:, m] + (self.penalty - 1) * (other[:, None] + along[:, m]) ** 2).argmin(axis=1)
                total = other + along[rows, m, code[:, m]]
        return code.astype(np.uint8)

    def refit(self, x: np.ndarray, code: np.ndarray) -> None:
        """The best centres for given codes, one subspace after the other: a 2 x 2 system for each centre."""
        parts = self._parts(x)
        norm = np.linalg.norm(x, axis=1)
        unit = parts / np.where(norm == 0, 1, norm)[:, None, None]
        rest = np.stack([parts[:, m] - c[code[:, m]] for m, c in enumerate(self.centres)], axis=1)
        total = (rest * unit).sum(axis=(1, 2))
        w = self.penalty - 1
        for m in range(len(self.centres)):
            mine = (rest[:, m] * unit[:, m]).sum(axis=1)
            other = total - mine
            for c in range(CENTRES):
                i = np.flatnonzero(code[:, m] == c)
                if len(i):
                    u, p = unit[i, m], parts[i, m]
                    left = np.eye(SUB) * len(i) + w * u.T @ u
                    right = p.sum(axis=0) + w * (u * (other[i] + (p * u).sum(axis=1))[:, None]).sum(axis=0)
                    self.centres[m, c] = np.linalg.solve(left, right)
            rest[:, m] = parts[:, m] - self.centres[m][code[:, m]]
            total = other + (rest[:, m] * unit[:, m]).sum(axis=1)


def fit(x: np.ndarray, rounds: int = 6, seed: int = 7) -> Codebook:
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    m = -(-d // SUB)
    penalty = max(1.0, (d - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
    book = Codebook(np.zeros((m, CENTRES, SUB)), penalty)
    parts = book._parts(x)
    for j in range(m):
        book.centres[j] = parts[rng.choice(len(x), CENTRES, replace=len(x) < CENTRES), j]
    plain = Codebook(book.centres, 1.0)
    for r in range(rounds):
        now = plain if r < rounds // 2 else book
        now.refit(x, now.encode(x))
    return book


def packed(code: np.ndarray) -> np.ndarray:
    """Two four-bit codes to a byte."""
    if code.shape[1] % 2:
        code = np.hstack([code, np.zeros((len(code), 1), np.uint8)])
    return code[:, ::2] | code[:, 1::2] << 4


def _tables(book: Codebook, queries: np.ndarray) -> np.ndarray:
    """Per byte of a packed code and value of it: its part of the inner product with each query."""
    m = len(book.centres)
    q = np.zeros((len(queries), m * SUB))
    q[:, : queries.shape[1]] = queries
    one = np.einsum("mcs,qms->mcq", book.centres, q.reshape(len(q), m, SUB))
    if m % 2:
        one = np.concatenate([one, np.zeros((1, *one.shape[1:]))])
    return (one[1::2, :, None] + one[::2, None, :]).reshape(len(one) // 2, 256, len(q)).astype(np.float32)


def _matrix(col: pa.Array, d: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), d)


class Best:
    """The k nearest so far of each query, in distance and then id; an id counts once, at its least distance."""

    def __init__(self, ids: np.ndarray, k: int):
        self.own, self.k = ids, k
        self.score = np.full((len(ids), k), np.inf)
        self.id = np.full((len(ids), k), np.iinfo(np.int64).max)

    def offer(self, rows: slice, score: np.ndarray, ids: np.ndarray) -> None:
        score = np.hstack([self.score[rows], np.where(ids == self.own[rows][:, None], np.inf, score)])
        ids = np.hstack([self.id[rows], ids])
        ids = np.where(np.isinf(score), np.iinfo(np.int64).max, ids)
        by_id = np.lexsort((score, ids), axis=1)
        score, ids = np.take_along_axis(score, by_id, 1), np.take_along_axis(ids, by_id, 1)
        again = ids[:, 1:] == ids[:, :-1]  # the same id once more, no nearer
        score[:, 1:][again], ids[:, 1:][again] = np.inf, np.iinfo(np.int64).max
        order = np.lexsort((ids, score), axis=1)[:, : self.k]
        self.score[rows], self.id[rows] = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


def scan(best: Best, queries: np.ndarray, book: Codebook, ids: np.ndarray, x: np.ndarray, code: np.ndarray, rerank: int = RERANK) -> None:
    """Offers each query the nearest of one block of candidates. Equal vectors are scanned once, for all their ids."""
    raw = np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel()
    _, first, group = np.unique(raw, return_index=True, return_inverse=True)
    order = np.lexsort((ids, group))
    begin = np.searchsorted(group[order], np.arange(len(first) + 1))
    copies = min(best.k + 1, int(np.diff(begin).max()))  # no more than k + 1 of equal vectors can count, those of least id
    spread = np.minimum(begin[:-1, None] + np.arange(copies), len(ids) - 1)
    real = begin[:-1, None] + np.arange(copies) < begin[1:, None]
    member = np.where(real, ids[order][spread], -1)
    x, code = x[first], code[first]
    half = ((x * x).sum(axis=1) / 2).astype(np.float32)
    for lo in range(0, len(queries), TABLE_QUERIES):
        rows = slice(lo, min(lo + TABLE_QUERIES, len(queries)))
        table = _tables(book, queries[rows])
        score = np.repeat(-half[:, None], rows.stop - lo, axis=1)
        for b in range(code.shape[1]):
            score += table[b][code[:, b]]
        n = min(rerank, len(x))
        top = np.argpartition(-score.T, n - 1, axis=1)[:, :n] if n < len(x) else np.tile(np.arange(n), (rows.stop - lo, 1))
        exact = np.sqrt(((x[top] - queries[rows][:, None, :]) ** 2).sum(axis=-1))
        if copies == 1:
            best.offer(rows, exact, member[top, 0])
        else:
            found = member[top]
            best.offer(rows, np.where(real[top], exact[:, :, None], np.inf).reshape(len(top), -1), found.reshape(len(top), -1))


def valid(vec_col: str, d: int) -> Column:
    """Vectors that take part: of the dimension, no null or non-finite component, not zero."""
    v = F.col(vec_col)
    bad = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return F.coalesce((F.size(v) == d) & ~bad & F.exists(v, lambda e: e != 0), F.lit(False))


def index(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE) -> tuple[DataFrame, Codebook | None, int]:
    """``(vec_id, v, code)`` for all rows that take part, the codebook, and the dimension (the commonest length).

    Rows with a null id take no part. Equal rows are one.
    """
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    sizes = src.where("size(v) > 0").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = sizes.d if sizes else 0
    src = src.where(valid("v", d)).distinct()
    some = src.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow() if d else None
    if not some:
        return src.withColumn("code", F.lit(None).cast("binary")), None, d
    book = fit(_matrix(some.column("v").combine_chunks(), d))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                part = b.slice(lo, BLOCK)
                code = packed(book.encode(_matrix(part.column(1), d)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([c.tobytes() for c in code], pa.binary())], ["vec_id", "v", "code"])

    return checkpoint(src.mapInArrow(run, "vec_id long, v array<double>, code binary")), book, d


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE, rerank: int = RERANK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row that ``is_query`` (of ``vec_id``), the k nearest other rows found.

    The score is the Euclidean distance in double precision; ties go to the smaller vec_id. A row never finds a
    row of its own id. Of query rows that repeat an id the least vector asks. With fewer than k candidates
    all are returned. An empty table gives an empty result.
    """
    indexed, book, d = index(vectors, id_col, vec_col, sample)
    spark = vectors.sparkSession
    schema = "query_id long, vec_id long, score double"
    found = spark.createDataFrame([], schema)
    asked = indexed.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    passes = -(-asked.count() * 8 * d // PASS_BYTES) if book else 0
    for p in range(passes):
        block = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == p).sort("vec_id").toArrow()
        if not block.num_rows:
            continue
        ids, queries = block.column("vec_id").to_numpy(), _matrix(block.column("v").combine_chunks(), d)

        def run(batches: Iterator[pa.RecordBatch], ids=ids, queries=queries) -> Iterator[pa.RecordBatch]:
            best = Best(ids, k)
            for b in batches:
                for lo in range(0, b.num_rows, BLOCK):
                    part = b.slice(lo, BLOCK)
                    x = _matrix(part.column(1), d)
                    code = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(len(x), -1)
                    scan(best, queries, book, part.column(0).to_numpy(), x, code, rerank)
            row, col = np.nonzero(np.isfinite(best.score))
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(best.id[row, col]), pa.array(best.score[row, col])], ["query_id", "vec_id", "score"])

        found = found.union(indexed.mapInArrow(run, schema))
    # the k best of all partitions: a sort within each query, of k rows per partition; ids that repeat count once
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    top = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("top"))
    return top.select("query_id", F.posexplode("top").alias("at", "n")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("n.vec_id").alias("vec_id"), F.col("n.score").alias("score"))
