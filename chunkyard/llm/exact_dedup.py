"""Exact deduplication with a two-pass Bloom filter, in DataFrame functions only.

Pass one sets, for every row, bits that its text's hash names, and keeps the bits that more than one row has set: a
Bloom filter of the hashes that may occur again. Pass two probes it. Rows that it clears cannot have a twin and pass
straight through; only the others shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkyard.llm.common import written

#: Deleted before texts are compared: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
#: A bitmap of Spark's ``bitmap_*`` functions holds so many bits in 4 KiB.
BITMAP_BITS = 32768
#: A filter of at most so many bits (16 MiB) is sent to every task. A larger one stays a table, and light rows meet their
#: part of it by the number of its bitmap.
BROADCAST_BITS = 1 << 27
PROBES = 2

_KEY, _LEN, _SLOT = "__key", "__len", "__slot"


def normalised(text: Column) -> Column:
    """The text without the characters of :data:`WHITE`; null counts as empty."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), WHITE, F.coalesce(text, F.lit("")))


def _slots(key: Column, bits: int) -> list[Column]:
    """The bits of a key (hexadecimal SHA-256), one in each of :data:`PROBES` equal parts of the filter."""
    part = bits // PROBES
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(part)) + F.lit(i * part) for i in range(PROBES)]


def filter_bits(rows: int) -> int:
    """About 16 bits a row: a power of two from 2**20."""
    return max(1 << 20, 1 << (16 * max(rows, 1) - 1).bit_length())


def repeated_filter(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """Pass one: (bucket, bitmap) of the slots that two or more rows of ``keys`` set. At most bits / 32768 rows."""
    slot = F.col(_SLOT)
    return (
        keys.select(F.explode(F.array(*_slots(F.col(key), bits))).alias(_SLOT))
        .groupBy(_SLOT)
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .groupBy(F.bitmap_bucket_number(slot).alias("__bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("__bitmap"))
    )


def _bit(bitmap: Column, position: Column) -> Column:
    """Whether a bit is set; false where there is no bitmap."""
    byte = F.conv(F.hex(F.substring(bitmap, (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), position % 8).cast("int")) != 0, F.lit(False))


def possibly_repeated(df: DataFrame, key: str, bits: int) -> DataFrame:
    """Pass two: ``df`` with ``__again``, false only for rows whose key occurs once in ``df``.

    The filter is written first: both probes then read it, and pass one runs once.
    """
    maps = written(repeated_filter(df, key, bits), "bloom")
    if bits <= BROADCAST_BITS:
        maps = F.broadcast(maps)
    out, tests = df, []
    for i, slot in enumerate(_slots(F.col(key), bits)):
        side = maps.select(F.col("__bucket").alias(f"__bucket{i}"), F.col("__bitmap").alias(f"__bitmap{i}"))
        out = out.withColumn(f"__s{i}", slot)
        out = out.join(side, F.bitmap_bucket_number(F.col(f"__s{i}")) == F.col(f"__bucket{i}"), "left")
        tests.append(_bit(F.col(f"__bitmap{i}"), F.bitmap_bit_position(F.col(f"__s{i}"))))
    return out.select(*[F.col(c) for c in df.columns], reduce(lambda a, b: a & b, tests).alias("__again"))


def _order(length: Column, ident: Column) -> Column:
    """Sorts the row that stays first: most code points, then the smallest id, null ids last."""
    return F.struct((-length).alias("a"), ident.isNull().alias("b"), ident.alias("c"))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None) -> DataFrame:
    """One row per row of ``df``: id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Null texts count as empty and are equal to each other. Of equal texts the longest original stays, then the
    smallest id, null ids last. A row given twice with its id counts twice in group_size, and both copies carry the same
    decision. Whole texts are hashed, however long. No rows in, no rows out. Other columns are not read, whatever their names.
    """
    rows = df.select(
        F.col(id_col).alias("__id"),
        F.sha2(normalised(F.col(text_col)), 256).alias(_KEY),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias(_LEN),
    )
    rows = written(rows, "text-keys")  # whole texts are read and hashed once
    marked = possibly_repeated(rows, _KEY, bits or filter_bits(rows.count()))
    again = marked.where("__again")
    groups = again.groupBy(_KEY).agg(
        F.min(_order(F.col(_LEN), F.col("__id"))).alias("__first"), F.count(F.lit(1)).alias("group_size")
    )
    groups = written(groups, "groups")  # joined from a table, so that a hot key's rows can be split over tasks
    shuffled = again.join(groups, _KEY).select(
        "__id", F.col("__first.c").alias("keep_id"), "group_size", F.col(_KEY).alias("text_sha256")
    )
    alone = marked.where("NOT __again").select(
        "__id", F.col("__id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.col(_KEY).alias("text_sha256")
    )
    return alone.unionByName(shuffled).select(
        F.col("__id").alias(id_col), "keep_id", "group_size", F.col("__id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None) -> DataFrame:
    """The rows of ``df`` that stay, one of each group of equal texts, with all their columns.

    Cases are as in :func:`exact_groups`, except that of rows repeated with their id exactly one stays. Rows that the
    filter clears go straight to the result; the rest are aggregated by key, so a group meets pre-aggregated. Where the filter
    is too large for every task, light rows probe it, and texts meet the keys that occur again.
    """
    bits = bits or filter_bits(df.count())
    keyed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), F.sha2(normalised(F.col(text_col)), 256).alias(_KEY))
    if bits <= BROADCAST_BITS:
        marked = possibly_repeated(keyed, _KEY, bits)
    else:
        again = possibly_repeated(written(keyed.select(_KEY), "text-keys"), _KEY, bits).where("__again").select(_KEY).distinct()
        marked = keyed.join(written(again.withColumn("__again", F.lit(True)), "again"), _KEY, "left").withColumn("__again", F.coalesce("__again", F.lit(False)))
    rank = _order(F.length(F.coalesce(F.col(f"__row.{text_col}"), F.lit(""))), F.col(f"__row.{id_col}"))
    once = marked.where("__again").groupBy(_KEY).agg(F.min_by("__row", rank).alias("__row")).select("__row.*")
    return marked.where("NOT __again").select("__row.*").unionByName(once)
