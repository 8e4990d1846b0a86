"""Exact duplicates by deterministic block naming (sort and name blocks, then pairs of names).

A document's normalised bytes are cut into blocks of one fixed size. The
distinct blocks are sorted and numbered; the numbers are their names. Adjacent
pairs of names are named the same way, level by level, until each document has
one name. Documents of equal block count share a name if and only if their
blocks are all equal, so (block count, name) is an identity without collisions.

Only the distinct blocks are shuffled with their bytes, once. Occurrences are
joined to the names by two 64-bit hashes of the block; the hashes are proved
unique among the distinct blocks, and dealt anew with another salt otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, drop_rows, materialize, number_sorted


def normalise(text: str = "text"):
    """White-space runs become one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " ")


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """One row per block of ``bytes``; an empty text has one empty block."""
    rows = rows.withColumn("n", F.greatest(F.lit(1), F.ceil(F.length("bytes") / size)).cast("long"))
    rows = rows.withColumn("idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return rows.withColumn("block", F.expr(f"substring(bytes, cast(idx * {size} + 1 as int), {size})"))


def _handles(salt: int):
    return F.xxhash64(F.lit(2 * salt), "block").alias("h1"), F.xxhash64(F.lit(2 * salt + 1), "block").alias("h2")


def _name_blocks(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
    """(h1, h2, name) of each distinct block, and the salt whose handles are unique."""
    salt = 0
    while True:
        distinct = _blocks(rows.select("bytes"), size).select("block").distinct()
        named = distinct.sortWithinPartitions("block").select(*_handles(salt))
        names = number_sorted(named, "name", "blocks")
        if names.groupBy("h1", "h2").count().where("count > 1").isEmpty():
            return names, salt
        salt += 1


def identities(rows: DataFrame, block_bytes: int = 2048) -> tuple[DataFrame, DataFrame]:
    """Documents and their names.

    ``rows`` has ``bytes`` and any columns to keep. Returns (heads, names): heads
    has a row id ``rid`` and the kept columns, names has rid, n (blocks) and name.
    """
    keep = [c for c in rows.columns if c != "bytes"]
    names, salt = _name_blocks(rows, block_bytes)
    cut = _blocks(rows.withColumn("rid", F.monotonically_increasing_id()), block_bytes)
    first = [F.when(F.col("idx") == 0, F.col(c)).alias(c) for c in keep]
    sha = F.when(F.col("idx") == 0, F.sha2("bytes", 256)).alias("text_sha256")
    cut = materialize(cut.select("rid", "idx", "n", *_handles(salt), *first, sha), "occurrences")
    heads = cut.where("idx = 0").select("rid", *keep, "text_sha256")

    level = materialize(cut.select("rid", "idx", "n", "h1", "h2").join(names, ["h1", "h2"]).select("rid", "idx", "n", "name"), "level")
    done, width = [level.where("n = 1").select("rid", "n", "name")], 1
    level = level.where("n > 1")
    while not level.isEmpty():
        width *= 2
        left = F.max(F.when(F.col("idx") % 2 == 0, F.col("name"))).alias("a")
        right = F.coalesce(F.max(F.when(F.col("idx") % 2 == 1, F.col("name"))), F.lit(0)).alias("b")
        pairs = materialize(level.groupBy("rid", "n", F.floor(F.col("idx") / 2).alias("idx")).agg(left, right), "pairs")
        named = number_sorted(pairs.select("a", "b").distinct().sortWithinPartitions("a", "b"), "name", "names")
        level = materialize(pairs.join(named, ["a", "b"]).select("rid", "idx", "n", "name"), "level")
        done.append(level.where(f"n <= {width}").select("rid", "n", "name"))
        level = level.where(f"n > {width}")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return heads, out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 2048) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty and empty texts are equal to each other. Of equal
    texts the row with the smallest id stays; null ids come last, and of rows
    with the same id and text exactly one stays. Other columns are ignored. An
    empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), normalise(text_col).cast("binary").alias("bytes"))
    heads, names = identities(rows, block_bytes)
    members = materialize(heads.join(names, "rid"), "members")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid")
    groups = materialize(members.groupBy("n", "name").agg(F.min(order).alias("k"), F.count("*").alias("group_size")), "groups")
    return members.join(groups, ["n", "name"]).select(
        "doc_id", F.col("k.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("k.rid")).alias("kept"), "text_sha256"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that exact deduplication keeps.

    Dropped rows are found again by id and text digest, without a shuffle of the
    rows that stay. Of rows that repeat both, one stays; Spark ranks only those.
    """
    decided = materialize(exact_dedup(docs, id_col, text_col), "exact")
    lost = materialize(
        decided.groupBy(F.col("doc_id").alias("_lid"), F.col("text_sha256").alias("_lmark"))
        .agg(F.max("kept").alias("_some"), F.min("kept").alias("_all"))
        .where("not _all").select("_lid", "_lmark", "_some"),
        "lost",
    )
    return drop_rows(docs, lost, id_col, lambda rows: rows.withColumn("_mark", F.sha2(normalise(f"_row.`{text_col}`").cast("binary"), 256)))
