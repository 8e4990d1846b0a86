"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ratewise.session import materialize, scratch_dir

__all__ = ["materialize", "scratch_dir", "table", "number_sorted", "perhaps_in", "bit_filter", "with_bit", "text_bytes", "WORD"]

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

_LOW33 = (1 << 33) - 1


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(col: str) -> Column:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def shuffle_partitions(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def number_sorted(df: DataFrame, out: str, name: str, start: int = 1) -> DataFrame:
    """Number the rows of ``df``, sorted within its partitions, with the integers from ``start``.

    The per-partition positions are written once; the partition sizes (one row
    a partition, which bounds the broadcast) give each partition its offset.
    """
    t = materialize(df.withColumn("_m", F.monotonically_increasing_id()), name)
    sizes = t.groupBy(F.shiftright("_m", 33).alias("_p")).agg((F.max(F.col("_m").bitwiseAND(F.lit(_LOW33))) + 1).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    return (
        t.withColumn("_p", F.shiftright("_m", 33))
        .join(F.broadcast(offsets), "_p")
        .withColumn(out, F.col("_o") + F.col("_m").bitwiseAND(F.lit(_LOW33)) + start)
        .drop("_m", "_p", "_o")
    )


#: Bits of one bucket of a bit filter, and the most buckets: 4 KB each, so a filter has at most 16 MB.
_BUCKET_BITS, _MOST_BUCKETS = 32768, 4096


def bit_filter(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(bucket, bits) with a bit set for each 64-bit hash in ``keys``, and the number of buckets.

    About 16 bits a key, and at most 16 MB, which bounds its broadcast; with more
    keys the filter passes more rows that aren't among them, never fewer.
    """
    n = keys.count()
    buckets = 1
    while buckets < _MOST_BUCKETS and buckets * _BUCKET_BITS < 16 * n:
        buckets *= 2
    place = F.pmod(F.col(key), F.lit(buckets * _BUCKET_BITS)) + 1
    bits = keys.select(place.alias("_at")).groupBy(F.bitmap_bucket_number("_at").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_bits"))
    return materialize(bits, "bit-filter"), buckets


def with_bit(rows: DataFrame, key: str, filtered: tuple[DataFrame, int], out: str = "_maybe") -> DataFrame:
    """``rows`` with a boolean: false if the 64-bit hash in ``key`` is surely not among the filter's keys."""
    bits, buckets = filtered
    at = F.pmod(F.col(key), F.lit(buckets * _BUCKET_BITS)) + 1
    spot = F.bitmap_bit_position("_at")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(spot / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce((byte / F.pow(F.lit(2), spot % 8)).cast("int") % 2 == 1, F.lit(False))
    joined = rows.withColumn("_at", at).withColumn("_bucket", F.bitmap_bucket_number("_at")).join(F.broadcast(bits), "_bucket", "left")
    return joined.select(*[joined[c] for c in rows.columns], hit.alias(out))


def drop_rows(docs: DataFrame, lost: DataFrame, id_col: str, mark_of) -> DataFrame:
    """``docs`` without ``lost``: columns _lid, _lmark and _some, a distinct (id, mark) each, ids null-safe.

    mark_of  adds ``_mark`` to rows with ``_row`` (the whole row) and ``_id``
    _some    true if one of the rows with this id and mark stays, whichever

    Rows whose id is surely not among the lost ones pass without a shuffle (bit filter
    of at most 16 MB); only the others get a mark and meet ``lost``, so that what is
    shuffled follows the rows that go, not the table.
    """
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id")).withColumn("_h", F.xxhash64(F.coalesce(F.col("_id").cast("string"), F.lit(" "))))
    filtered = bit_filter(lost.select(F.xxhash64(F.coalesce(F.col("_lid").cast("string"), F.lit(" "))).alias("_h")), "_h")
    told = with_bit(rows, "_h", filtered)
    passed = told.where("not _maybe").select("_row.*")
    marked = mark_of(told.where("_maybe").select("_row", "_id"))
    on = F.col("_id").eqNullSafe(F.col("_lid")) & F.col("_mark").eqNullSafe(F.col("_lmark"))
    kept = passed.unionByName(marked.join(lost, on, "left_anti").select("_row.*"))
    twins = lost.where("_some")
    if twins.isEmpty():
        return kept
    again = marked.join(twins, on, "left_semi").groupBy("_id", "_mark").agg(F.first("_row").alias("_row"))
    return kept.unionByName(again.select("_row.*"))


def perhaps_in(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose 64-bit hash in ``key`` may be among ``keys``: all that are, few others, without a shuffle."""
    return with_bit(rows, key, bit_filter(keys, key)).where("_maybe").drop("_maybe")
