"""SimHash near-duplicates through an inverted index over the fingerprint's byte positions.

Two 64-bit fingerprints within three bits differ in three of their eight bytes at most, so they share five positional
bytes or more. Postings are keyed by four positional bytes at a time. The quads are the 14 planes of the binary space
of dimension 3 (four positions whose indices XOR to zero): any three positions lie in one plane, and the complement of
a plane is a plane, so each qualifying pair shares one whole quad and meets in that posting. Its shared positional
bytes are then tallied, pairs with fewer than five drop out, and the rest are verified by their differing bits.

A posting with more than ``most`` fingerprints is refined by the same scheme over the eight nibbles of its other 32
bits, then over the eight bit pairs of the 16 bits that are left after that. Then 56 bits are fixed and a posting has
256 distinct fingerprints at most: no group is unbounded and no pair is lost. From one posting only a spanning forest
of the verified links is emitted, never all pairs.

``similar`` and ``dedup`` find texts that are alike rather than all but equal: five-word shingles and a similarity of
0.8, for which 64 bits are too coarse. They take fingerprints of 64 bytes through the same kind of index, which such a
distance allows to miss pairs; the rest are found through the rarest shingles of each text (a prefix filter).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quadrille.llm.graph import components
from quadrille.llm.storage import bitmap, materialise, member, without

SEED = 42
SHINGLE = 3
MAX_BITS = 3
MIN_SHARED_BYTES = 8 - MAX_BITS
PLANES = [p for p in combinations(range(8), 4) if not p[0] ^ p[1] ^ p[2] ^ p[3]]
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: str | None, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle of a text, repeats included; of the whole sequence where it is shorter than a shingle."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()  # on exactly \x20 and \x09-\x0D
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - size + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    ends = (starts + lengths)[min(size, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[:n].tolist(), ends.tolist(), strict=True)
    return np.fromiter((digest(joined[s:e], seed) for s, e in pairs), np.uint64, n)


def simhash(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned fingerprint of one text; null and texts without words have fingerprint zero."""
    h = shingle_hashes(text, size, seed)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        octets = h[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > max(len(h), 1), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (the fingerprint as a signed long). Other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([simhash(t.as_py(), size, seed) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def _masks(bits: list[int]) -> list[tuple[int, list[int]]]:
    """For bit positions in eight equal chunks: (mask of four chunks, the other positions), one for each plane."""
    width = len(bits) // 8
    chunks = [bits[i * width : (i + 1) * width] for i in range(8)]
    return [(sum(1 << b for i in p for b in chunks[i]), [b for i in range(8) if i not in p for b in chunks[i]]) for p in PLANES]


def _levels() -> list[dict[int, list[int]]]:
    """For each level: mask that is fixed so far -> masks of the next finer postings."""
    levels, now = [], {0: list(range(64))}
    for _ in range(3):
        step, then = {}, {}
        for mask, rest in now.items():
            finer = [(mask | m, left) for m, left in _masks(rest)]
            step[mask] = [m for m, _ in finer]
            then.update(finer)
        levels.append(step)
        now = then
    return levels


LEVELS = _levels()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs share the guaranteed number of positional bytes and differ in few enough bits."""
    x = np.bitwise_xor(a, b)
    shared = (np.ascontiguousarray(x).view(np.uint8).reshape(*x.shape, 8) == 0).sum(axis=-1)
    ok = shared >= MIN_SHARED_BYTES
    ok[ok] = np.bitwise_count(x[ok]) <= MAX_BITS
    return ok


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints, by breadth-first search."""
    out, left = [], fps
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            f = queue.pop()
            hit = linked(np.full(len(left), f), left)
            if hit.any():
                out += [(f, x) for x in left[hit]]
                queue += list(left[hit])
                left = left[~hit]
    return out


def _scan(most: int):
    """Over rows sorted by (mask, key): links of each posting, and the rows of postings above ``most`` for refinement."""
    few = 8

    def batch(a, b, mask, hot):
        n = len(a)
        cols = [pa.array(np.asarray(x).view(np.int64)) for x in (a, b, mask)]
        return pa.RecordBatch.from_arrays([*cols, pa.array(np.full(n, hot))], names=["a", "b", "mask", "hot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.zeros(0, np.uint64)
        held, key, hot = empty, None, False  # the posting that may go on in the next batch

        def close():
            pairs = forest(held) if not hot and len(held) > 1 else []
            if pairs:
                yield batch(*(np.array(x, np.uint64) for x in zip(*pairs, strict=True)), np.zeros(len(pairs), np.uint64), False)

        for rows in batches:
            if not rows.num_rows:
                continue
            mask, k, fp = (np.asarray(rows.column(i)).view(np.uint64) for i in range(3))
            cut = np.flatnonzero((mask[1:] != mask[:-1]) | (k[1:] != k[:-1])) + 1
            first, last = np.concatenate(([0], cut)), np.concatenate((cut, [len(k)]))
            size = last - first
            whole = np.ones(len(first), bool)
            whole[[0, -1]] = False  # the outer postings may go beyond this batch
            small = whole & (size > 1) & (size <= few)
            for d in range(1, few):
                at = first[small & (size > d)]
                for o in range(few - d):
                    i = at[last[small & (size > d)] > at + o + d] + o
                    ok = linked(fp[i], fp[i + d])
                    if ok.any():
                        yield batch(fp[i][ok], fp[i + d][ok], np.zeros(ok.sum(), np.uint64), False)
            for r in [0, *np.flatnonzero(whole & (size > few)), *([len(first) - 1] if len(first) > 1 else [])]:
                here, part = (mask[first[r]], k[first[r]]), fp[first[r] : last[r]]
                if here != key:
                    yield from close()
                    held, key, hot = empty, here, False
                held = np.concatenate((held, part))
                if hot or len(held) > most:
                    hot = True
                    yield batch(held, held, np.full(len(held), here[0], np.uint64), True)
                    held = empty
        yield from close()

    return run


def links(nodes: DataFrame, most: int = 4096) -> DataFrame:
    """Links between distinct fingerprints (column fp): a, b. They connect exactly the fingerprints that chains of
    pairs within three bits connect; redundant links inside a posting are left out."""
    out, now = None, nodes.select("fp", F.lit(0).cast("long").alias("mask"))
    for depth, finer in enumerate(LEVELS):
        masks = F.lit(None).cast("array<long>")
        if depth == 0:
            masks = F.array(*[F.lit(_signed(m)) for m in finer[0]])
        else:
            now = now.join(_mask_table(nodes, finer), "mask")
            masks = F.col("finer")
        postings = now.select("fp", F.explode(masks).alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        if depth:  # one finer mask is reached from several coarser ones
            postings = postings.distinct()
        dealt = postings.repartition("mask", "key").sortWithinPartitions("mask", "key")
        bound = most if depth + 1 < len(LEVELS) else 1 << 8  # the last level leaves 8 bits open
        found = materialise(dealt.mapInArrow(_scan(bound), "a long, b long, mask long, hot boolean"), "simhash-links")
        pairs = found.where("not hot").select("a", "b")
        out = pairs if out is None else out.unionAll(pairs)
        now = found.where("hot").select(F.col("a").alias("fp"), "mask").distinct()
        if now.isEmpty():
            return out
    return out


def _mask_table(nodes: DataFrame, finer: dict[int, list[int]]) -> DataFrame:
    """At most 196 rows: mask, finer masks."""
    rows = [(_signed(m), [_signed(x) for x in to]) for m, to in finer.items()]
    return F.broadcast(nodes.sparkSession.createDataFrame(rows, "mask long, finer array<long>"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 4096) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Documents link where their fingerprints differ in three bits or fewer; component_id is the smallest doc_id that
    links reach, the document's own included. Null and empty texts have fingerprint zero and link like any other;
    repeated rows each get their row; a null doc_id takes part but is never a component_id unless all ids of the
    component are null. Equal fingerprints are one node, so copies are never expanded into pairs.
    """
    marked = materialise(fingerprints(docs, id_col, text_col), "simhash")
    nodes = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    found = components(links(nodes, most))
    label = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = label.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = label.join(smallest, "component").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Wide fingerprints: bytes, and the triples of positions that key their postings. The differences within a triple are
#: all distinct, so no two triples share two positions.
WIDE = 64
TRIPLES = np.array([(j, (j + a) % WIDE, (j + b) % WIDE) for a, b in ((11, 31), (5, 18)) for j in range(WIDE)])
SIMILAR_SHINGLE, SIMILARITY = 5, 0.8
#: Of 64 positional bytes, texts of similarity 0.8 share 17 on average, with a deviation of 3.5, and unrelated ones 0.25.
MIN_SHARED_WIDE = 6
#: Pairs of shingle sets down to this much below the similarity are all compared. At 0.8 the fingerprints of sets of
#: similarity 0.6 differ in 118 bits with a deviation of 10, so 77 are out of their reach (about 1 pair in 10^5).
MARGIN = 0.2
#: Texts, in expectation, that tell which shingles are frequent, and the most shingles that are told apart by it.
SAMPLE_TEXTS, MOST_FREQUENT = 8192, 1 << 16


def most_bits(similarity: float) -> int:
    """Differing bits of wide fingerprints at a Jaccard similarity of shingle sets: their cosine is 2 J / (1 + J), for
    sets of equal size, and a bit differs with the share of their angle in a half turn."""
    return int(8 * WIDE * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def wide_simhash(text: str | None, size: int = SIMILAR_SHINGLE, seed: int = SEED) -> np.ndarray:
    """The 64-byte fingerprint of the set of a text's shingles: a bit is 1 if set in over half of their hashes, each
    hash being eight words mixed from an XXH64. Zero where there are no words."""
    return _wide(np.unique(shingle_hashes(text, size, seed)))


def _wide(h: np.ndarray) -> np.ndarray:
    counts = np.zeros(8 * WIDE, np.int64)
    for i in range(0, len(h), 1 << 12):
        x = h[i : i + (1 << 12), None] * _MULTIPLIERS
        x ^= x >> np.uint64(29)
        x *= _MULTIPLIERS[::-1]
        x ^= x >> np.uint64(32)
        counts += np.unpackbits(x.view(np.uint8).reshape(-1, WIDE), axis=1).sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * counts > max(len(h), 1))


_MULTIPLIERS = np.random.default_rng(SEED).integers(1, 1 << 63, WIDE // 8, np.uint64) * np.uint64(2) + np.uint64(1)


def frequent(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIMILAR_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, of shingles that three or more texts of a sample hold, and in how many.

    They only order the shingles of a text, so that its rarest come first: any sample gives right results.
    """
    share = (SAMPLE_TEXTS << 20) // max(docs.count(), 1) + 1
    rows = docs.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < share).select(F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(text.as_py(), size)).view(np.int64))], names=["h"])

    counted = rows.mapInArrow(run, "h long").groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(MOST_FREQUENT).toArrow()
    hashes, counts = counted["h"].to_numpy().view(np.uint64), counted["count"].to_numpy()
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def rarest(h: np.ndarray, often: tuple[np.ndarray, np.ndarray], least: float) -> np.ndarray:
    """The first shingles of a set, in an order that all sets share: the fewest by which it meets every set of similarity
    ``least`` or more. Such a pair shares that part of either set at least, so its first common shingle is here in both."""
    n = len(h)
    hashes, counts = often
    if not n or not len(hashes):
        return np.sort(h)[: n - math.ceil(least * n - 1e-9) + 1]
    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
    return h[np.lexsort((h, np.where(hashes[at] == h, counts[at], 0)))][: n - math.ceil(least * n - 1e-9) + 1]


def _across(bits: int):
    """Over rows (key, component, fp) sorted by key: links between components, of all pairs of rows within a posting whose
    fingerprints differ in ``bits`` bits or fewer. Of each posting a spanning forest, with the posting's size as memory."""

    def joined(key: np.ndarray, part: np.ndarray, fp: np.ndarray) -> list[tuple[int, int]]:
        end = np.searchsorted(key, key, side="right")
        root, out = {}, []

        def top(x):
            while x in root:
                x = root[x]
            return x

        at, d = np.arange(len(key)), 0
        while len(at := at[at + d + 1 < end[at]]):
            d += 1
            new = at[part[at] != part[at + d]]
            new = new[np.bitwise_count(fp[new] ^ fp[new + d]).sum(axis=1, dtype=np.int64) <= bits]
            if len(new):
                for u, v in set(zip(part[new].tolist(), part[new + d].tolist(), strict=True)):
                    low, high = sorted((top(u), top(v)))
                    if low != high:
                        root[high] = low
                        out.append((low, high))
                ids, where = np.unique(part, return_inverse=True)
                part = np.array([top(x) for x in ids.tolist()], np.int64)[where]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, part, fp = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, WIDE // 8), np.uint64)
        for rows in batches:
            key, part = np.concatenate((key, np.asarray(rows.column(0)))), np.concatenate((part, np.asarray(rows.column(1))))
            fp = np.concatenate((fp, np.frombuffer(b"".join(rows.column(2).to_pylist()), np.uint64).reshape(-1, WIDE // 8)))
            if len(key):
                whole = np.searchsorted(key, key[-1])  # the last posting may go on in the next batch
                yield _edges(joined(key[:whole], part[:whole], fp[:whole]))
                key, part, fp = key[whole:], part[whole:], fp[whole:]
        yield _edges(joined(key, part, fp))

    return run


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = np.array(pairs, np.int64).reshape(-1, 2).T
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, component_id, by wide fingerprints.

    Rows link where their fingerprints differ in no more bits than ``similarity`` of their sets of ``size``-word
    shingles leads to; component_id is the smallest doc_id reachable. Postings are keyed by three positional bytes, 128
    of them for each row, and by its rarest shingles: as many as it takes to meet all sets down to ``MARGIN`` below the
    similarity. In each posting rows are paired with one of them, drawn by a hash of the posting, so that a posting of
    any size is a star. Each pair's shared positional bytes are tallied, pairs with fewer than ``MIN_SHARED_WIDE`` drop
    out, and the rest are verified by their differing bits. Then all pairs of rows that share a rare shingle and are not
    in one component yet are verified in their posting, so no link between sets that similar is lost, however large the
    posting. Pairs below that, whose fingerprints are close by chance, are left to the postings of positional bytes.

    Null and empty texts have fingerprint zero and link like any other, and so do texts of fewer words than ``size``,
    which are one shingle; repeated rows each get their row; a null doc_id takes part but is never a component_id unless
    all ids of the component are null. An empty table gives no rows; other columns are not read.
    """
    bits, often = most_bits(similarity), frequent(docs, id_col, text_col, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                sets = [np.unique(shingle_hashes(t.as_py(), size)) for t in part.column(1)]
                cols = [[_wide(h).tobytes() for h in sets], [rarest(h, often, similarity - MARGIN).tobytes() for h in sets]]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, pa.binary()) for c in cols]], names=["doc_id", "fp", "rare"])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                node, rare = np.asarray(part.column(0)), part.column(2).to_pylist()
                octets = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(-1, WIDE).astype(np.int64)
                key = np.arange(len(TRIPLES)) << 24 | octets[:, TRIPLES[:, 0]] << 16 | octets[:, TRIPLES[:, 1]] << 8 | octets[:, TRIPLES[:, 2]]
                keys = np.concatenate((key.ravel(), np.frombuffer(b"".join(rare), np.int64)))
                nodes = np.concatenate((np.repeat(node, len(TRIPLES)), np.repeat(node, [len(r) // 8 for r in rare])))
                word = np.arange(len(keys)) >= key.size
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(nodes), pa.array(word)], names=["key", "node", "word"])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, WIDE) for i in (2, 3))
            ok = (x == y).sum(axis=1) >= MIN_SHARED_WIDE
            ok[ok] = np.bitwise_count(x[ok] ^ y[ok]).sum(axis=1, dtype=np.int64) <= bits
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok))

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    prints = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp binary, rare binary")
    marked = materialise(prints.withColumn("row", F.monotonically_increasing_id()), "simhash-wide")
    nodes = materialise(marked.groupBy("fp", F.xxhash64("rare").alias("r")).agg(F.min("row").alias("node"), F.min("doc_id").alias("least")), "simhash-wide-nodes")
    again = marked.select(F.col("row").alias("__id")).join(nodes.select(F.col("node").alias("__id")), "__id", "left_anti")
    postings = without(marked.select("row", "fp", "rare"), materialise(again, "simhash-again"), "row").mapInArrow(expand, "key long, node long, word boolean")
    shares = bitmap(postings.groupBy("key").count().where("count > 1").select(F.xxhash64("key").alias("h")), "h")
    shared = materialise(member(postings, F.xxhash64("key"), shares, "more").where("more").drop("more"), "simhash-postings")
    centre = shared.groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "node").alias("h"), "node"))["node"].alias("centre"))
    stars = shared.join(centre, "key").where("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    both = stars.join(nodes.select(F.col("node").alias("a"), F.col("fp").alias("x")), "a").join(nodes.select(F.col("node").alias("b"), F.col("fp").alias("y")), "b")
    alike = materialise(both.select("a", "b", "x", "y").mapInArrow(tally, "a long, b long"), "simhash-wide-links")
    twins = nodes.groupBy("fp").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("fp", "a")  # of equal fingerprints
    found = components(alike.unionAll(nodes.join(twins, "fp").select("a", F.col("node").alias("b"))))
    label = materialise(nodes.join(found, "node", "left").select("node", "fp", "least", F.coalesce("component", "node").alias("component")), "simhash-wide-label")

    placed = shared.where("word").select("key", "node").join(label.select("node", "component"), "node")
    inside = [F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")]
    mixed = placed.groupBy("key").agg(*inside).where("low < high").groupBy("n", "x", "y").agg(F.min("key").alias("key"))  # one posting of those with the same rows
    open_ = placed.join(mixed.select("key"), "key").join(label.select("node", "fp"), "node").select("key", "component", "fp")
    links = open_.repartition("key").sortWithinPartitions("key").mapInArrow(_across(bits), "a long, b long")
    last = components(materialise(links, "simhash-wide-rest")).withColumnRenamed("component", "all")
    label = label.join(last, label["component"] == last["node"], "left").select("fp", "least", F.coalesce("all", "component").alias("component"))
    smallest = label.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = label.join(smallest, "component").select("fp", "component_id").distinct()
    return marked.select("doc_id", "fp").join(by_fp, "fp").select("doc_id", "component_id")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose doc_id is the smallest of their component by ``similar``. A
    null doc_id names no row, so such rows all stay, as do rows that repeat the smallest doc_id."""
    gone = similar(docs, id_col, text_col, size, similarity).where("doc_id <> component_id").select(F.col("doc_id").alias("__id")).distinct()
    return without(docs, materialise(gone, "simhash-gone"), id_col)
