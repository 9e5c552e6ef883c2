"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words. Each passage is encoded from its bytes (frequencies of bytes
and of pairs of byte classes, and the share of words that repeat a word just before) by a learned layer. Gated attention, learned from document labels alone, weighs the
passages, and the weighted sum is scored. All passages of a text take part; long texts are pooled in slices with a
running softmax, so memory does not grow with a text's passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quadrille.llm.storage import bounded_sample

PASSAGE_WORDS = 50
#: The fit uses this many labelled documents at most (those of smallest hash), with all their passages.
SAMPLE_DOCS = 3000
HIDDEN, GATE, EPOCHS, BATCH, RATE, SEED = 24, 12, 25, 64, 0.01, 7
THRESHOLD = 0.3
SLICE = 2048

_CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r\t\x0b\x0c", ".", ",;:", "'\"`()", "-_/\\", "!?", "|<>{}[]", "%&$*#@^~+="]
_KINDS = np.full(256, len(_CLASSES), np.int64)  # control and non-ASCII bytes: the last class
for _i, _chars in enumerate(_CLASSES):
    _KINDS[[ord(c) for c in _chars]] = _i
_N_KINDS = len(_CLASSES) + 1
_BYTES = np.minimum(np.arange(256), 128 + (np.arange(256) - 128) // 16)  # ASCII bytes alone, others 16 at a time
_N_BYTES = 136
_LAGS = (1, 2, 3)
FEATURES = _N_BYTES + _N_KINDS * _N_KINDS + len(_LAGS)
_MIX = np.random.default_rng(1).integers(1, 1 << 62, 256, np.uint64)
_POWER = np.random.default_rng(2).integers(1, 1 << 62, 64, np.uint64) | np.uint64(1)
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def slices(text: str | None, words: int = PASSAGE_WORDS) -> Iterator[np.ndarray]:
    """Passage features of one text, at most ``SLICE`` passages at a time; an empty text is one passage of zeros.

    A feature is the square root of a frequency, so each of the two blocks has unit length.
    """
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        yield np.zeros((1, FEATURES), np.float32)
        return
    space = _SPACE[raw]
    heads = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    repeats = _repeats(raw, space, heads, words)
    starts = heads[::words].copy()
    if len(starts):
        starts[0] = 0
    else:
        starts = np.zeros(1, np.int64)
    for i in range(0, len(starts), SLICE):
        cut = starts[i : i + SLICE]
        end = starts[i + SLICE] if i + SLICE < len(starts) else len(raw)
        part, n = raw[cut[0] : end], len(cut)
        passage = np.repeat(np.arange(n), np.diff(np.append(cut, end)))
        kinds = _KINDS[part]
        single = np.bincount(passage * _N_BYTES + _BYTES[part], minlength=n * _N_BYTES).reshape(n, -1)
        before = np.append(_KINDS[raw[cut[0] - 1]], kinds[:-1]) if i else kinds[:-1]  # a slice goes on from the one before
        pairs = np.bincount((passage * _N_KINDS**2 + kinds)[-len(before) :] + before * _N_KINDS, minlength=n * _N_KINDS**2).reshape(n, -1) if len(before) else np.zeros((n, _N_KINDS**2))
        both = [np.sqrt(x / np.maximum(x.sum(axis=1, keepdims=True), 1)) for x in (single, pairs)]
        yield np.hstack([*both, repeats[i : i + n]]).astype(np.float32)


def _repeats(raw: np.ndarray, space: np.ndarray, heads: np.ndarray, words: int) -> np.ndarray:
    """For each passage the shares of words equal (by hash) to the word 1, 2 and 3 places before."""
    if not len(heads):
        return np.zeros((1, len(_LAGS)))
    place = np.arange(heads[0], len(raw)) - np.repeat(heads, np.diff(np.append(heads, len(raw))))
    letters = np.where(space[heads[0] :], np.uint64(0), _MIX[raw[heads[0] :]] * _POWER[place % 64])
    h = np.add.reduceat(letters, heads - heads[0])
    passage = np.arange(len(h)) // words
    size = np.bincount(passage)
    same = [np.bincount(passage[lag:][h[lag:] == h[:-lag]], minlength=len(size)) / size for lag in _LAGS]
    return np.sqrt(np.stack(same, axis=1))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Encoder, gated attention and scorer; ``fit`` learns all of them together from bags and their labels."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        draw = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {
            "W": draw(FEATURES, HIDDEN) * 3, "b": np.zeros(HIDDEN, np.float32),
            "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "w": draw(GATE, 1),
            "c": draw(HIDDEN, 1), "d": np.zeros(1, np.float32),
        }

    def _forward(self, x: np.ndarray):
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        return h, t, g, ((t * g) @ p["w"])[:, 0]

    def score(self, parts: Iterator[np.ndarray]) -> float:
        """The score of a bag that comes in slices."""
        top, total, pooled = -np.inf, 0.0, np.zeros(HIDDEN)
        for x in parts:
            h, _, _, e = self._forward(x)
            new = max(top, float(e.max()))
            a, keep = np.exp(e - new), np.exp(top - new)
            total, pooled, top = total * keep + float(a.sum()), pooled * keep + a @ h, new
        z = pooled / total
        return float(_sigmoid(z @ self.p["c"][:, 0] + self.p["d"][0]))

    def _gradient(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, sizes = self.p, np.diff(np.append(first, len(x)))
        h, t, g, e = self._forward(x)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), sizes))
        a = e / np.repeat(np.add.reduceat(e, first), sizes)
        z = np.add.reduceat(a[:, None] * h, first)
        s = _sigmoid((z @ p["c"])[:, 0] + p["d"][0])
        ds = ((s - y) / len(y))[:, None].astype(np.float32)
        dz = np.repeat(ds @ p["c"].T, sizes, axis=0)
        da = (dz * h).sum(axis=1)
        de = (a * (da - np.repeat(np.add.reduceat(a * da, first), sizes)))[:, None]
        dt, dg = de @ p["w"].T * g * (1 - t * t), de @ p["w"].T * t * g * (1 - g)
        dh = (a[:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ ds, "d": ds.sum(axis=0)}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> Model:
        r = np.random.default_rng(SEED)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = r.permutation(len(bags))
            for i in range(0, len(order), BATCH):
                pick = order[i : i + BATCH]
                sizes = np.array([len(bags[j]) for j in pick])
                first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                grad = self._gradient(np.concatenate([bags[j] for j in pick]), first, labels[pick])
                step += 1
                rate = RATE * (1 - epoch / epochs)
                for k, d in grad.items():
                    d = d + 1e-4 * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.999 * v[k] + 0.001 * d * d
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """A model from a bounded sample of labelled documents outside the held-out fifth; None if none is labelled.

    Of several labels of one document the largest counts, and of several rows with its id the smallest text (null:
    empty). The sample's ids are at most ``sample_docs`` rows and are broadcast; one scan of ``docs`` finds their texts,
    at most one for each id leaves a task, and the driver gets one bag of all its passages for each id.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sample = bounded_sample(known.groupBy(F.col("doc_id").alias("__id")).agg(F.max("quality").cast("int").alias("__y")), "__id", sample_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [np.concatenate(list(slices(text.as_py()))).astype(np.float16).tobytes() for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(bags, pa.binary())], names=["id", "y", "bag"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(sample), F.col("id") == F.col("__id"))
    once = rows.groupBy("id", F.col("__y").alias("y")).agg(F.min("text").alias("text")).select("id", "text", "y")
    found = once.mapInArrow(run, f"id {once.schema['id'].dataType.simpleString()}, y int, bag binary").toArrow().sort_by("id")
    if not found.num_rows:
        return None
    bags = [np.frombuffer(bag.as_py(), np.float16).astype(np.float32).reshape(-1, FEATURES) for bag in found["bag"]]
    return Model().fit(bags, found["y"].to_numpy().astype(np.float32))


def _scorer(docs: DataFrame, model: Model | None):
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return lambda text: 0.5 if shared.value is None else shared.value.score(slices(text))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted (1 where score >= ``threshold``).

    Only texts are inputs of the score. Null and empty texts score as one passage of zeros, repeated rows alike; a
    null id is not held out; without usable labels every score is 0.5. Other columns are not read.
    """
    rate = _scorer(docs, fit(docs, labels, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [rate(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score, as ``score`` gives it, reaches ``threshold``, with all their columns.

    Null and empty texts are judged by their score like any other, repeated rows stay or go together, null ids play no
    part, an empty table stays empty, and without usable labels every row stays. Nothing is shuffled.
    """
    rate = _scorer(docs, fit(docs, labels, id_col, text_col))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([rate(text.as_py()) >= threshold for text in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
