"""SimHash near-duplicates by segment popcounts and a grid range-join.

A 64-bit fingerprint becomes 32 counts of set bits, one per 2-bit segment. A
flipped bit changes one count by one, so the Manhattan distance of two count
vectors never exceeds the Hamming distance of the fingerprints. For at most k
differing bits the segments are split into k // 2 + 1 groups: in one of them
the vectors are at most 1 apart. Each vector is therefore a grid cell per
group, and two cells meet if they are equal or if one is the other with one
count raised by one; that is an equi-join of the cells and their raised
neighbours. The join's condition then takes the Manhattan bound over all
segments and the exact bit distance, so that only links leave it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_rows, materialize
from .components import components

_FIVES = 0x5555555555555555


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the signed 64-bit SimHash of the word shingles, XXH64 with seed 42.

    A-Z are lower-cased; words are runs of anything but ASCII white space. Repeats
    count; fewer words than a shingle are one shingle; no words (null text too) give 0.
    The words of a text are hashed a block at a time, so a long text adds no more memory than itself.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    return _with_fingerprint(rows, "_text", shingle)


def _with_fingerprint(rows: DataFrame, text: str, shingle: int) -> DataFrame:
    """``rows`` with ``fp`` of the column ``text``; the other columns pass by the task as they are."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        def fingerprint(text):
            words = (text or "").encode().lower().split()
            if not words:
                return 0
            if len(words) <= shingle:
                h = xxh64_intdigest(b" ".join(words), 42)
                return h - (1 << 64) if h >> 63 else h
            line = b" ".join(words)
            size = np.fromiter(map(len, words), np.int64, len(words))
            end = np.cumsum(size + 1) - 1
            first = (end - size)[: len(words) - shingle + 1].tolist()
            last = end[shingle - 1:].tolist()
            ones, n = np.zeros(64, np.int64), len(first)
            for at in range(0, n, 1 << 16):
                h = np.array([xxh64_intdigest(line[a:b], 42) for a, b in zip(first[at:at + (1 << 16)], last[at:at + (1 << 16)])], np.uint64)
                ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])

        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            fp = pa.array([fingerprint(x) for at in range(0, len(texts), 64) for x in texts.slice(at, 64).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], fp], [*batch.schema.names[:-1], "fp"])

    rows = rows.withColumn("_text", F.col(text).cast("string"))
    kept = [f for f in rows.schema.fields if f.name != "_text"]
    schema = T.StructType([*kept, T.StructField("fp", T.LongType())])
    return rows.mapInArrow(run, schema)


def _long(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def segment_counts(fp: str) -> Column:
    """32 two-bit fields, each the number of set bits in that segment."""
    even = F.col(fp).bitwiseAND(_long(_FIVES))
    odd = F.shiftrightunsigned(F.col(fp), 1).bitwiseAND(_long(_FIVES))
    return even.bitwiseXOR(odd).bitwiseOR(F.shiftleft(even.bitwiseAND(odd), 1))


def manhattan(a: Column, b: Column) -> Column:
    """Of two count vectors with fields 0 to 2: equal 0; 0-1 and 1-2 differ in the low bit; 0-2 in the high bit alone."""
    x = a.bitwiseXOR(b)
    low = x.bitwiseAND(_long(_FIVES))
    high = F.shiftrightunsigned(x, 1).bitwiseAND(_long(_FIVES))
    return F.bit_count(low.bitwiseOR(high)) + F.bit_count(high.bitwiseAND(F.bitwise_not(low)))


def links(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """(u, v): the pairs of different fingerprints in ``fps`` (column fp, distinct) at most ``max_bits`` apart."""
    groups = max_bits // 2 + 1
    width = -(-32 // groups)
    counts = fps.select("fp", segment_counts("fp").alias("counts"))

    def cell(g):
        bits = 2 * min(width, 32 - g * width)
        return F.shiftrightunsigned("counts", 2 * g * width).bitwiseAND(_long((1 << bits) - 1))

    def raised(g):
        fields = range(min(width, 32 - g * width))
        now = [F.shiftrightunsigned(cell(g), 2 * j).bitwiseAND(_long(3)) for j in fields]
        up = [F.when(x == 0, cell(g).bitwiseXOR(_long(1 << 2 * j))).when(x == 1, cell(g).bitwiseXOR(_long(3 << 2 * j))) for j, x in zip(fields, now)]
        return F.filter(F.array(*up), lambda x: x.isNotNull())

    own = counts.select("fp", "counts", F.explode(F.array(*[F.struct(F.lit(g).alias("g"), cell(g).alias("cell")) for g in range(groups)])).alias("c"))
    def raised_cells(g):
        return F.transform(raised(g), lambda x: F.struct(F.lit(g).alias("g"), x.alias("cell")))

    up = counts.select("fp", "counts", F.explode(F.flatten(F.array(*[raised_cells(g) for g in range(groups)]))).alias("c"))
    probe = own.withColumn("up", F.lit(False)).unionByName(up.withColumn("up", F.lit(True)))
    a = probe.select(F.col("fp").alias("u"), F.col("counts").alias("cu"), "up", "c.g", "c.cell")
    b = own.select(F.col("fp").alias("v"), F.col("counts").alias("cv"), "c.g", "c.cell")
    near = (manhattan(F.col("cu"), F.col("cv")) <= max_bits) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits)
    met = a.alias("a").join(b.alias("b"), (F.col("a.g") == F.col("b.g")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("up") | (F.col("u") < F.col("v"))) & near)
    return met.select("u", "v")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over fingerprints at most
    ``max_bits`` bits apart. Equal fingerprints are one class, so copies are
    never expanded into pairs. Null ids take part; a group whose ids are all
    null has a null component_id. An empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    found = grouped(prints, max_bits)
    return prints.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def grouped(prints: DataFrame, max_bits: int) -> DataFrame:
    """(fp, root, component_id, first) of each fingerprint in ``prints`` (doc_id, fp): its group, the group's least id,
    and the (id, fingerprint) of the document that stands first in it, null ids last."""
    least = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("fp").alias("fp"))
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.min(least).alias("first")), "classes")
    stars = materialize(components(links(classes.select("fp"), max_bits), "simhash"), "stars")
    root = F.coalesce("component", "fp").alias("root")
    rooted = materialize(classes.join(stars, F.col("fp") == F.col("node"), "left").select("fp", "low", "first", root), "rooted")
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.min("first").alias("first"))
    return materialize(rooted.select("fp", "root").join(lows, "root").select("fp", "root", "component_id", "first"), "found")


def keep_first(docs: DataFrame, shingle: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns: of each group of near fingerprints the one that stands first.

    First is the smallest id, null ids last, then the smallest fingerprint; of rows that
    agree in both one stays. Rows are found again by id and fingerprint, which is
    computed anew only for rows whose id may be among those that go.
    """
    prints = materialize(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    found = grouped(prints, max_bits)
    counted = prints.groupBy("doc_id", "fp").agg(F.count("*").alias("n")).join(found, "fp")
    first = F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("fp") == F.col("first.fp"))
    lost = counted.select(F.col("doc_id").alias("_lid"), F.col("fp").alias("_lmark"), first.alias("_some"), "n").where("not _some or n > 1").drop("n")

    def mark_of(rows: DataFrame) -> DataFrame:
        return _with_fingerprint(rows, f"_row.`{text_col}`", shingle).withColumnRenamed("fp", "_mark")

    return drop_rows(docs, materialize(lost, "near"), id_col, mark_of)
