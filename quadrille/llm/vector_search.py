"""Approximate nearest neighbours by additive quantisation.

Codebooks over all dimensions are learned on residuals; a vector is encoded by a beam search over them, and beside the
codes its length and the length of what they leave over are stored. A query scores all codes by look-up tables (one
inner product for each codeword). A row is ranked again by its exact inner product, in double precision, where its
rough score lies within ``SIGMAS`` standard deviations of the ``k``-th best or above it. The deviation is that of the
leftover's product with the query, were its direction random. So what is ranked again depends on scores alone, never
on how rows are batched, and near-equal vectors, with equal codes, are all ranked again or none.

The index has every row. Equal vectors are one class with its members' ids: a class shows at most ``k`` + 1 of its
smallest distinct ids in any result, so only those are kept in the search table, without loss. Queries are a table in
the shared folder too, with the score each must beat at the start: its ``k``-th best among the sample of the codebooks.
Each task holds a bounded number of rows and reads the queries past them block by block; it sends its ``k`` best for
each query. Neither the driver nor a broadcast holds queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from quadrille.llm.storage import bounded_sample, materialise, read_batches

BOOKS, WORDS, BEAM = 16, 256, 4
#: The codebooks are learned from this many vectors at most, those whose hash is smallest.
SAMPLE = 8192
SIGMAS = 3.0
#: Rows that a task holds at once, and of those and of queries as many as it scores at once.
HELD_ROWS, ROW_BLOCK, QUERY_BLOCK = 131_072, 4096, 256


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


@dataclass
class Codebooks:
    """Codewords (books, words, dimensions) for unit vectors, with their inner products with each other."""

    words: np.ndarray

    @staticmethod
    def fit(sample: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 8, seed: int = 5) -> Codebooks:
        """Learn a book on what the books before it leave over, by k-means from ``sample`` (unit rows)."""
        r = np.random.default_rng(seed)
        left, out = sample.astype(np.float32), []
        for _ in range(books):
            centres = left[r.permutation(len(left))[: min(words, len(left))]].copy()
            for _ in range(rounds):
                near = np.argmax(left @ centres.T - 0.5 * (centres**2).sum(axis=1), axis=1)
                counts = np.bincount(near, minlength=len(centres))
                order = np.argsort(near, kind="stable")
                has = np.flatnonzero(counts)
                centres[has] = np.add.reduceat(left[order], (np.cumsum(counts) - counts)[has]) / counts[has, None]
            near = np.argmax(left @ centres.T - 0.5 * (centres**2).sum(axis=1), axis=1)
            left = left - centres[near]
            out.append(np.pad(centres, ((0, words - len(centres)), (0, 0)), mode="edge"))
        return Codebooks(np.stack(out))

    def encode(self, unit: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows, books) found by a beam search for the smallest squared error, and what they leave over.

        A state is a partial sum of codewords, kept as the residual it leaves. Adding a word changes the squared error
        by the word's squared length minus twice its product with that residual.
        """
        books, words, dims = self.words.shape
        n = len(unit)
        rows = np.arange(n)
        left, codes, error = unit[:, None, :].astype(np.float32), np.zeros((n, 1, 0), np.int64), np.zeros((n, 1), np.float32)
        for b in range(books):
            step = left.reshape(-1, dims) @ (-2 * self.words[b].T)
            step += (self.words[b] ** 2).sum(axis=1)
            step = step.reshape(n, -1, words)
            step += error[:, :, None]
            whole = step.reshape(n, -1)
            keep = min(beam if b < books - 1 else 1, whole.shape[1])
            best, least = np.empty((n, keep), np.int64), np.empty((n, keep), np.float32)
            for i in range(keep):  # a few passes for the least are faster than a partial sort
                at = whole.argmin(axis=1)
                best[:, i], least[:, i] = at, whole[rows, at]
                whole[rows, at] = np.inf
            parent, word, error = best // words, best % words, least
            left = left[rows[:, None], parent] - self.words[b][word]
            codes = np.concatenate((codes[rows[:, None], parent], word[:, :, None]), axis=2)
        return codes[:, 0].astype(np.uint8 if words <= 256 else np.uint16), left[:, 0]

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of each query with each codeword: (queries, books, words)."""
        return np.einsum("qd,bwd->qbw", queries.astype(np.float32), self.words, optimize=True)


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(n, -1)


def build(vectors: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE) -> tuple[DataFrame, Codebooks | None, tuple[np.ndarray, np.ndarray]]:
    """The search table (vec_id, vector, norm, rest, codes), written in the shared folder, the codebooks, and the ids and
    vectors of the sample they were learned from. ``rest`` is the length of what the codes leave over.

    Every usable row is indexed. Vectors of a length other than the most usual one take no part in the codebooks nor
    in the search. Ranking equal vectors' ids is pre-limited by each map task, so a hot vector is a few rows there.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).where(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    usual = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not usual:
        return rows.withColumns({"norm": F.lit(0.0), "rest": F.lit(0.0), "codes": F.lit(b"")}), None, (np.zeros(0, np.int64), np.zeros((0, 0)))
    rows = rows.where(F.size("vector") == usual[0]["d"])
    picked = bounded_sample(rows, "vec_id", sample).toArrow()
    known = picked["vec_id"].to_numpy(), np.asarray(picked["vector"].combine_chunks().flatten(), np.float64).reshape(picked.num_rows, -1)
    books = Codebooks.fit(known[1] / np.linalg.norm(known[1], axis=1, keepdims=True))
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    rows = rows.distinct()  # an aggregate that drops repeats in the map tasks, so the ranks below count ids
    first = rows.withColumn("__at", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).where(F.col("__at") <= k + 1).drop("__at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                x = _matrix(part.column(1), part.num_rows)
                norm = np.linalg.norm(x, axis=1)
                codes, left = shared.value.encode((x / norm[:, None]).astype(np.float32))
                rest = norm * np.linalg.norm(left, axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(norm), pa.array(rest), pa.array([c.tobytes() for c in codes], pa.binary())], names=["vec_id", "vector", "norm", "rest", "codes"])

    return materialise(first.mapInArrow(run, "vec_id long, vector array<double>, norm double, rest double, codes binary"), "ann-index"), books, known


def least_scores(ids: np.ndarray, queries: np.ndarray, known: tuple[np.ndarray, np.ndarray], k: int) -> np.ndarray:
    """For each query a bound below its ``k``-th best score over all rows: that over the distinct ids of the sample."""
    at, x = known
    at, first = np.unique(at, return_index=True)
    x = x[first]
    out = np.full(len(ids), -np.inf)
    if len(at) > k:
        for i in range(0, len(ids), 512):
            score = queries[i : i + 512] @ x.T
            score[ids[i : i + 512, None] == at[None, :]] = -np.inf
            best = np.partition(score, -k, axis=1)[:, -k]
            out[i : i + 512] = best - 1e-9 * np.abs(best)
    return out


@dataclass
class Rows:
    """Rows of the search table that a task holds, in blocks."""

    ids: np.ndarray
    x: np.ndarray
    norm: np.ndarray
    rest: np.ndarray
    codes: np.ndarray

    def near(self, books: Codebooks, ids: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int, sigmas: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The ``k`` best rows for each query of a block: positions of queries, ids, scores, and how many products were
        exact."""
        lut = np.ascontiguousarray(books.tables(queries).transpose(1, 2, 0))
        length = np.linalg.norm(queries, axis=1)
        slack = (length * sigmas / np.sqrt(queries.shape[1])).astype(np.float32)
        q, at, score, exact = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 0
        least = least.copy()
        for i in range(0, len(self.ids), ROW_BLOCK):
            part = slice(i, i + ROW_BLOCK)
            codes = self.codes[part]
            rough = lut[0][codes[:, 0]]
            for b in range(1, codes.shape[1]):
                rough += lut[b][codes[:, b]]
            rough *= self.norm[part, None]
            rough += self.rest[part, None] * slack
            rough += self.norm[part, None] * (1e-5 * length.astype(np.float32))  # single precision of the tables
            row, col = np.nonzero(rough >= least.astype(np.float32))
            other = self.ids[i + row] != ids[col]
            row, col = row[other], col[other]
            exact += len(row)
            fresh = np.concatenate([(self.x[i + row[j : j + 65536]] * queries[col[j : j + 65536]]).sum(axis=1) for j in range(0, len(row), 65536)] or [np.zeros(0)])
            better = fresh >= least[col]
            q, at, score = np.concatenate((q, col[better])), np.concatenate((at, self.ids[i + row[better]])), np.concatenate((score, fresh[better]))
            order = np.lexsort((at, -score, q))
            q, at, score = q[order], at[order], score[order]
            _, once = np.unique(np.stack((q, at), axis=1), axis=0, return_index=True)  # an id's best score only
            once.sort()
            q, at, score = q[once], at[once], score[once]
            count = np.bincount(q, minlength=len(ids))
            start = np.cumsum(count) - count
            keep = np.arange(len(q)) - start[q] < k
            q, at, score = q[keep], at[keep], score[keep]
            full = np.flatnonzero(count >= k)
            least[full] = np.maximum(least[full], score[(np.cumsum(np.minimum(count, k)) - 1)[full]])
        return q, at, score, exact


def _held(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[Rows]:
    def rows(parts: list[pa.RecordBatch]) -> Rows:
        t = pa.Table.from_batches(parts).combine_chunks()
        n = t.num_rows
        codes = np.frombuffer(b"".join(t["codes"].to_pylist()), np.uint8).reshape(n, -1)
        return Rows(t["vec_id"].to_numpy(), np.asarray(t["vector"].combine_chunks().flatten(), np.float64).reshape(n, -1), t["norm"].to_numpy().astype(np.float32), t["rest"].to_numpy().astype(np.float32), codes)

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= most:
            yield rows(held)
            held, n = [], 0
    if held:
        yield rows(held)


def search(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", sigmas: float = SIGMAS, counted: bool = False) -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` by inner product for each row of ``queries``: query_id, rank, vec_id, score.

    Both have columns ``id_col`` and ``vector_col``. A query's own id is no candidate. Vectors that are null, zero, or
    hold null or non-finite components take no part on either side, nor do rows with a null id, nor vectors of another
    length than the most usual one, with which they have no inner product. An id that repeats counts once, with its
    best score. An empty side gives an empty result. Other columns are not read. With ``counted`` the result is the
    number of exact products instead: exact.
    """
    spark = vectors.sparkSession
    table, books, known = build(vectors, k, id_col, vector_col)
    if books is None:
        return spark.createDataFrame([], "exact long" if counted else "query_id long, rank int, vec_id long, score double")
    dims = books.words.shape[2]
    asked = queries.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    asked = asked.where(usable(F.col("vector")) & F.col("vec_id").isNotNull() & (F.size("vector") == dims)).distinct()
    shared = spark.sparkContext.broadcast((books, known))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = least_scores(np.asarray(batch.column(0)), _matrix(batch.column(1), batch.num_rows), shared.value[1], k)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(least)], names=["vec_id", "vector", "least"])

    path = materialise(asked.mapInArrow(begin, "vec_id long, vector array<double>, least double"), "ann-queries")._quadrille_path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _held(batches, HELD_ROWS):
            for block in read_batches(path, QUERY_BLOCK):
                ids, q = np.asarray(block.column(0)), _matrix(block.column(1), block.num_rows)
                col, at, score, exact = rows.near(shared.value[0], ids, q, np.asarray(block.column(2)), k, sigmas)
                if counted:
                    yield pa.RecordBatch.from_arrays([pa.array([exact])], names=["exact"])
                elif len(col):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[col]), pa.array(at), pa.array(score)], names=["query_id", "vec_id", "score"])

    if counted:
        return table.mapInArrow(run, "exact long").agg(F.sum("exact").alias("exact"))
    out = table.mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = out.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
