"""Best-fit packing of documents into token sequences of several permitted lengths.

Texts become token ids by a byte-level BPE; a text's ids are cut into segments of the largest permitted length at most.
Segments go by falling length into the open bin that they fill best. Where none fits, the bin size with the least cost
per token that it can expect to hold is opened; sizes are weighed together, with each single size as an alternative
preference, and the cheapest plan of a group is taken. At last each bin shrinks to the smallest permitted length that
holds its contents, and its sequence is written out. A group is a stretch of the rows that one task reads, of bounded
size whatever ids or lengths repeat.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quadrille.llm.token_counts import VOCABULARY, read_ranks

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: A group is full with so many segments or tokens.
GROUP_ITEMS, GROUP_TOKENS = 50_000, 1 << 23
#: Fixed value: how the vocabulary's BPE cuts a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Cost of a sequence in token units: a fixed overhead, its length, and attention that grows with its square.
OVERHEAD, SQUARE_AT = 64.0, 65536.0


def cost(capacity: int) -> float:
    return OVERHEAD + capacity + capacity * capacity / SQUARE_AT


def _fill(lengths: list[int], capacities: Sequence[int], least: int | None) -> tuple[list[int], list[int], list[int]]:
    """Best fit over falling ``lengths``: bin of each item, and size and contents of each bin. New bins have size
    ``least`` or the next that fits; None weighs cost against the tokens that are still to come."""
    largest = capacities[-1]
    price = {c: cost(c) for c in capacities}
    waiting: list[list[int]] = [[] for _ in range(largest + 1)]  # open bins by room left
    rooms = 0  # bit r: a bin with room r is open
    where, size, used = [], [], []
    left = sum(lengths)
    for n in lengths:
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = waiting[room].pop()
            if not waiting[room]:
                rooms &= ~(1 << room)
        else:
            b = len(size)
            able = [c for c in capacities if c >= n]
            if least is None:
                c = min(able, key=lambda c: (price[c] / min(c, left), -c))
            else:
                c = next((c for c in able if c >= least), able[-1])
            size.append(c)
            used.append(0)
            room = c
        where.append(b)
        used[b] += n
        left -= n
        room -= n
        if room:
            waiting[room].append(b)
            rooms |= 1 << room
    return where, size, used


def pack_group(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES) -> tuple[list[int], list[int], list[int]]:
    """Bin of each item (in the given order, all lengths from 1 to the largest capacity), and of each bin its final
    capacity and its contents. Ties go by position, so the plan is a function of the sequence alone."""
    capacities = sorted(capacities)
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    falling = [int(lengths[i]) for i in order]
    best = None
    for least in (None, *capacities):
        where, _, used = _fill(falling, capacities, least)
        final = [next(c for c in capacities if c >= u) for u in used]  # downsized to the contents
        total = sum(map(cost, final))
        if best is None or total < best[0]:
            best = total, where, final, used
    bins = [0] * len(lengths)
    for i, b in zip(order, best[1], strict=True):
        bins[i] = b
    return bins, best[2], best[3]


@dataclass(frozen=True)
class Tokenizer:
    """A byte-level BPE, which loses nothing: decoding all ids of a text gives the text. Built once in each worker."""

    ranks: tuple[bytes, ...]
    pattern: str = PATTERN

    def encoding(self):
        key = hash((self.ranks, self.pattern))
        if key not in _built:
            import tiktoken

            _built[key] = tiktoken.Encoding("packing", pat_str=self.pattern, mergeable_ranks={b: i for i, b in enumerate(self.ranks)}, special_tokens={})
        return _built[key]

    def decode(self, ids) -> str:
        return self.encoding().decode_bytes(list(ids)).decode("utf-8", "surrogatepass")


_built: dict[int, object] = {}


def tokenizer(vocabulary: str = VOCABULARY) -> Tokenizer:
    """The tokenizer of a vocabulary file, read on the driver."""
    return Tokenizer(tuple(read_ranks(vocabulary)))


class _Group:
    """The segments that a task has gathered, up to a number of them and of their tokens."""

    def __init__(self) -> None:
        self.docs: list[int] = []
        self.segment: list[int] = []
        self.ids: list[np.ndarray] = []
        self.empty: list[int] = []
        self.tokens = 0

    def add(self, doc: int, ids: np.ndarray, largest: int) -> None:
        if not len(ids):
            self.empty.append(doc)
        for n, i in enumerate(range(0, len(ids), largest)):
            self.docs.append(doc)
            self.segment.append(n)
            self.ids.append(ids[i : i + largest])
        self.tokens += len(ids)

    def bins(self, name: int, id_values: pa.Array, capacities: Sequence[int]) -> pa.RecordBatch:
        where, final, used = pack_group([len(x) for x in self.ids], capacities)
        order = sorted(range(len(where)), key=lambda i: where[i])  # stable: the order of arrival within a bin
        sizes = np.bincount(where, minlength=len(final)) if where else np.zeros(0, np.int64)
        bin_no, capacity, total = list(range(len(final))), list(final), list(used)
        docs = [self.docs[i] for i in order] + self.empty
        segment = np.array([self.segment[i] for i in order] + [0] * len(self.empty), np.int64)
        length = np.array([len(self.ids[i]) for i in order] + [0] * len(self.empty), np.int64)
        flat = np.concatenate([self.ids[i] for i in order] or [np.zeros(0, np.int32)])
        if self.empty:
            bin_no, capacity, total, sizes = [*bin_no, None], [*capacity, None], [*total, 0], np.append(sizes, len(self.empty))
        parts = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())

        def lists(values: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(parts, values)

        columns = [
            pa.array([name] * len(bin_no), pa.int64()), pa.array(bin_no, pa.int64()), pa.array(capacity, pa.int64()), pa.array(total, pa.int64()),
            pa.array([None if c is None else c - t for c, t in zip(capacity, total, strict=True)], pa.int64()),
            lists(id_values.take(pa.array(docs, pa.int64()))), lists(pa.array(segment)), lists(pa.array(segment * max(capacities))), lists(pa.array(length)),
            pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(total))), pa.int32()), pa.array(flat, pa.int32())),
        ]
        return pa.RecordBatch.from_arrays(columns, names=COLUMNS)


COLUMNS = ["pack_group", "bin", "bin_capacity", "n_tokens", "waste", "doc_ids", "segments", "starts", "lengths", "token_ids"]


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokens: Tokenizer | None = None,
    capacities: Sequence[int] = CAPACITIES,
    group_items: int = GROUP_ITEMS,
    group_tokens: int = GROUP_TOKENS,
) -> DataFrame:
    """Sequences that hold every token of every row: one row for each bin, named by (pack_group, bin).

    bin_capacity is the permitted length it has after downsizing, n_tokens what it holds, waste the rest of it, and
    token_ids its contents. The arrays doc_ids, segments, starts and lengths tell, in the order of the contents, the
    document of each segment, its number, the token of the document it begins with, and its tokens. A text with more
    tokens than the largest capacity becomes several segments.

    Null, empty texts have no tokens: their documents are listed, with length 0, in a row of their group whose bin is
    null. Repeated rows and null ids are placed like any other, an empty table gives no rows, and other columns are not
    read. Texts are tokenised whole and packed where they are read: a task fills a group until it has ``group_items``
    segments or ``group_tokens`` tokens, sends its bins and begins the next, so nothing is shuffled, memory is bounded
    but for the longest text, and a lost executor costs its own tasks.
    """
    capacities = sorted(capacities)
    shared = docs.sparkSession.sparkContext.broadcast(tokens or tokenizer())
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = shared.value.encoding().encode_ordinary
        where = TaskContext.get()
        first, made = (where.partitionId() if where else 0) << 32, 0
        group, ids = _Group(), []
        for batch in batches:
            ids.append(batch.column(0))
            base = sum(map(len, ids[:-1]))
            for i, text in enumerate(batch.column(1)):
                group.add(base + i, np.array(encode(text.as_py()), np.int32), capacities[-1])
                if len(group.ids) + len(group.empty) >= group_items or group.tokens >= group_tokens:
                    yield group.bins(first + made, pa.concat_arrays(ids), capacities)
                    made, group, ids, base = made + 1, _Group(), [batch.column(0)], 0
        if group.ids or group.empty:
            yield group.bins(first + made, pa.concat_arrays(ids), capacities)

    out = f"pack_group long, bin long, bin_capacity long, n_tokens long, waste long, doc_ids array<{kind}>, segments array<long>, starts array<long>, lengths array<long>, token_ids array<int>"
    return rows.mapInArrow(run, out)


def segments(packed: DataFrame) -> DataFrame:
    """One row per segment of ``pack``: doc_id, segment, start, n_tokens, pack_group, bin, bin_offset, token_ids."""
    at = F.aggregate("lengths", F.array(F.lit(0).cast("long")), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    rows = packed.withColumn("__at", F.slice(at, F.lit(1), F.size("lengths")))
    parts = F.arrays_zip(F.col("doc_ids").alias("doc_id"), F.col("segments").alias("segment"), F.col("starts").alias("start"), F.col("lengths").alias("n_tokens"), F.col("__at").alias("bin_offset"))
    one = rows.select("pack_group", "bin", "token_ids", F.explode(parts).alias("s"))
    return one.select("s.doc_id", "s.segment", "s.start", "s.n_tokens", "pack_group", "bin", "s.bin_offset", F.slice("token_ids", F.col("s.bin_offset").cast("int") + 1, F.col("s.n_tokens").cast("int")).alias("token_ids"))
