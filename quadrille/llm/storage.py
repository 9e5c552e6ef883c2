"""Tables that operators write in the shared folder of the cluster, to cut lineage and reuse results."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quadrille.shared import materialise, new_path, release, shared_dir

__all__ = ["BITS", "bitmap", "bounded_sample", "filesystem", "fresh", "materialise", "member", "new_path", "read_batches", "release", "shared_dir", "without"]


def filesystem(uri: str):
    """File system and path for an executor's own reads and writes in the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def read_batches(path: str, rows: int) -> Iterator[pa.RecordBatch]:
    """The batches, of at most ``rows`` rows, of a table that ``materialise`` wrote; for use in a task."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, folder = filesystem(path)
    for info in sorted(system.get_file_info(fs.FileSelector(folder)), key=lambda f: f.path):
        if info.path.endswith(".parquet"):
            with system.open_input_file(info.path) as f:
                yield from pq.ParquetFile(f).iter_batches(batch_size=rows)


def bounded_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows with the smallest hash of ``key`` (all, if fewer): ordered by it, the same on every run.

    Where there are many more, a filter on the hash keeps about twice ``n`` first, so that no task ranks or sends more
    than it must; should that leave fewer than ``n``, the filter is dropped.
    """
    total = rows.count()
    h = F.xxhash64(key)
    if total > 4 * n:
        few = rows.where(F.pmod(h, F.lit(1 << 20)) < (2 * n * (1 << 20)) // total + 1)
        if few.count() >= n:
            rows = few
    return rows.orderBy(F.pmod(h, F.lit(1 << 20)), h, key).limit(n)


#: Bits of a ``bitmap``: a fixed bound of 16 MB for a broadcast, whatever the number of keys.
BITS = 1 << 27


def _place(hashed: Column) -> Column:
    return F.pmod(hashed, F.lit(BITS)) + F.lit(1).cast("long")


def bitmap(hashes: DataFrame, name: str) -> DataFrame:
    """A bitmap of the values in column ``name`` (long) of ``hashes``, in at most 4096 rows of 4 KB."""
    x = hashes.select(_place(F.col(name)).alias("x")).select(F.bitmap_bucket_number("x").alias("__bucket"), F.bitmap_bit_position("x").alias("p"))
    return x.repartition("__bucket").groupBy("__bucket").agg(F.bitmap_construct_agg("p").alias("__bits"))


def member(df: DataFrame, hashed: Column, bits: DataFrame, name: str) -> DataFrame:
    """``df`` with boolean column ``name``: whether ``hashed`` may be in the bitmap. False is certain; what is true by
    chance (a share that grows with the bits set) needs an exact check. The bitmap is broadcast, nothing is shuffled."""
    h, bucket, kept = fresh(df, "__h"), fresh(df, "__bucket"), fresh(df, "__bits")
    rows = df.withColumn(h, _place(hashed)).join(F.broadcast(bits.toDF(bucket + "_", kept)), F.bitmap_bucket_number(h) == F.col(bucket + "_"), "left")
    p = F.bitmap_bit_position(h)
    octet = F.conv(F.hex(F.substring(F.col(kept), F.floor(p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    test = F.call_function("shiftright", octet, (p % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(test, F.lit(False)).alias(name))


def without(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``docs`` whose id is not in column __id of ``gone`` (null ids compare like values).

    A bitmap of the gone ids splits the rows: most are surely not among them and stay where they are; only the rest, the
    gone ones and a few by chance, meet the ids themselves, so the texts that stay are not shuffled. ``docs`` is read
    twice.
    """
    bits = bitmap(gone.select(F.xxhash64("__id").alias("h")), "h")
    mark = fresh(docs, "__maybe")
    rows = member(docs, F.xxhash64(F.col(id_col)), bits, mark)
    doubt = rows.where(mark).drop(mark)
    return rows.where(~F.col(mark)).drop(mark).unionAll(doubt.join(gone, doubt[id_col].eqNullSafe(gone["__id"]), "left_anti"))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
