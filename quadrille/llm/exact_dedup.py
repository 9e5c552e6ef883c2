"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Rows are compared after each run of ASCII white space has become one space. A row whose length is unique leaves at
once, then one whose prefix hash is unique among rows of its length; only rows that share both are grouped by their
full hash. Each level counts narrow keys with map-side combining, so a hot key is one row per map task in its exchange,
and hands the keys that occur more than once to the next as a broadcast bitmap of fixed size: rows that leave are never
shuffled again, and those the bitmap keeps by chance are alone in their full-hash group. No step shuffles texts, but
for the rows that ``dedup`` has reason to drop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quadrille.llm.storage import bitmap, fresh, materialise, member

PREFIX_CHARS = 256
#: A single space stays as it is, so only longer runs and other white space need a replacement.
RUNS = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"


def normalised(text: Column) -> Column:
    """``text`` (null: empty) with each run of space, tab, LF, VT, FF or CR as one space; nothing is trimmed."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), RUNS, " ")


def _shapes(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int) -> DataFrame:
    """doc_id, normalised text, len, prefix."""
    norm = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("__norm"))
    return norm.select("doc_id", "__norm", F.octet_length("__norm").cast("long").alias("len"), F.xxhash64(F.substring("__norm", 1, prefix_chars)).alias("prefix"))


def _rid() -> Column:
    """Tells equal rows apart; only stable once the frame is written."""
    return F.monotonically_increasing_id()


def _sha() -> Column:
    return F.sha2(F.encode("__norm", "UTF-8"), 256)


KEY = ("len", "prefix", "text_sha256")


def survivors(narrow: DataFrame) -> DataFrame:
    """A bitmap of the (len, prefix) of rows that share both with another row."""
    by_len = narrow.groupBy("len").count().where("count > 1").select(F.xxhash64("len").alias("h"))
    same_length = member(narrow.select("len", "prefix"), F.xxhash64("len"), bitmap(by_len, "h"), "more").where("more")
    by_prefix = same_length.groupBy("len", "prefix").count().where("count > 1").select(F.xxhash64("len", "prefix").alias("h"))
    return bitmap(by_prefix, "h")


def groups(suspects: DataFrame) -> DataFrame:
    """Groups of two or more equal rows among those that reached the last level: len, prefix, text_sha256, keep, group_size."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__rid"))
    return suspects.groupBy(*KEY).agg(least.alias("keep"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")


def _marked(suspects: DataFrame) -> DataFrame:
    """``suspects`` with keep_id, group_size and kept."""
    return suspects.join(groups(suspects), list(KEY), "left").select(
        "doc_id",
        F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("keep.__rid") == F.col("__rid"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null and empty texts are equal. Of equal texts the smallest doc_id stays; a null doc_id counts as larger than any
    other; of repeated rows with the same doc_id exactly one has kept = true. An empty table gives an empty result,
    and further columns of ``docs`` are not read, whatever their names. As every row's digest is asked for, one scan
    gives all three keys; only rows that share length and prefix hash are dealt by the digest.
    """
    narrow = materialise(_shapes(docs, id_col, text_col, prefix_chars).select(_rid().alias("__rid"), "doc_id", "len", "prefix", _sha().alias("text_sha256")), "exact-dedup")
    rows = member(narrow, F.xxhash64("len", "prefix"), survivors(narrow), "__more")
    alone = rows.where("not __more").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return alone.unionAll(_marked(rows.where("__more").drop("__more")))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """The rows of ``docs`` that ``classes`` keeps, with all their columns and whole texts.

    A first scan takes lengths and prefix hashes; a second one hashes whole texts, of the rows that share both only.
    Rows whose id is among those with a dropped or repeated row are then checked by id and digest; all others stay in
    place, unshuffled.
    """
    shapes = materialise(_shapes(docs, id_col, text_col, prefix_chars).select("len", "prefix"), "exact-dedup-shapes")
    again = member(_shapes(docs, id_col, text_col, prefix_chars), F.xxhash64("len", "prefix"), survivors(shapes), "__more").where("__more")
    suspects = materialise(again.select(_rid().alias("__rid"), "doc_id", "len", "prefix", _sha().alias("text_sha256")), "exact-dedup-suspects")
    per_text = materialise(
        _marked(suspects).groupBy(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("not kept or n > 1"),
        "exact-dedup-gone",
    )
    gone = per_text.where("not kept").select("__id", "__sha")
    mark, own = fresh(docs, "__maybe"), fresh(docs, "__row_sha")
    rows = member(docs, F.xxhash64(F.col(id_col)), bitmap(per_text.select(F.xxhash64("__id").alias("h")), "h"), mark)
    doubt = rows.where(mark).drop(mark).withColumn(own, F.sha2(F.encode(normalised(F.col(text_col)), "UTF-8"), 256))
    left = doubt.join(gone, doubt[id_col].eqNullSafe(gone["__id"]) & (doubt[own] == gone["__sha"]), "left_anti").dropDuplicates([id_col, own]).drop(own)
    return rows.where(~F.col(mark)).drop(mark).unionAll(left)
