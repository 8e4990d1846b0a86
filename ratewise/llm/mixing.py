"""Mixing sources to target token weights.

Each document gets a hash-random key. A source's documents are ordered by key,
in ranges of the key space that hold a bounded number of rows whatever the
source's size; running sums inside a range plus the ranges' prefix sums give
each document its place among the source's words, and the source's budget cuts
there. A budget above the source's size takes it whole as often as it fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, materialize, number_sorted, shuffle_partitions

#: Least rows of a key range; above it, ranges grow with rows / (4 x shuffle partitions).
RANGE_ROWS = 512


def words(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def _key(id_col: str, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))


def budgets(sources: DataFrame, weights, share: float, most: float) -> DataFrame:
    """Targets of sources (source, source_size, n): shares by weight, at most ``most`` times a size.

    Sources above their limit stop there; what they leave is shared again among
    the others by weight until none is above. Each round sends three sums to
    the driver. Integers are exact in these sums, so reruns agree to the bit.
    """
    ranked = number_sorted(
        sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()),
        "rank", "sources", start=0,
    )
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    t = materialize(ranked.withColumn("w", w).withColumn("cap", F.lit(float(most)) * F.col("source_size")), "weighted")
    total = t.agg(F.sum("source_size")).first()[0] or 0
    level, capped = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("w") * F.lit(level) > F.col("cap")
        n, kept, free = t.agg(
            F.sum(F.when(full, 1).otherwise(0)), F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("w")))
        ).first()
        if n is None or n == capped or not free:
            break
        capped, level = n, (share * total - kept) / free
    target = F.col("cap") if level is None else F.least(F.col("cap"), F.col("w") * F.lit(level))
    return t.withColumn("target", target.cast("double"))


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """The input rows with ``_size``, ``_source_size``, ``_target``, ``_taken`` and ``_epochs``.

    Sources by code point, null last, have the weights in turn. ``_taken`` counts
    the words taken with repeats and adds up to the whole part of the target in
    each source; the document on the cut gives only its share. ``_epochs`` counts
    the passes that use the document at all. Null and empty texts have no words
    and are never taken; equal keys are ordered by id and size, and rows that
    agree in those are interchangeable. Null ids are one more id.
    """
    spark = docs.sparkSession
    sized = docs.withColumn("_size", words(text_col))
    sources = sized.groupBy(F.col(source_col).alias("source")).agg(F.sum("_size").alias("source_size"), F.count("*").alias("n"))
    found = budgets(materialize(sources, "source-sizes"), weights, share, most)
    rows = found.agg(F.sum("n")).first()[0] or 0
    wide = max(RANGE_ROWS, -(-rows // (4 * shuffle_partitions(spark))))
    found = materialize(found.select(
        F.col("source").alias("_src"), F.col("rank").alias("_rank"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"),
        F.ceil(F.col("n") / wide).alias("_ranges")), "budgets")
    place = F.conv(F.substring(F.col("_key"), 1, 8), 16, 10).cast("long")
    dealt = (
        sized.withColumn("_key", _key(id_col, seed))
        .join(found, F.col(source_col).eqNullSafe(F.col("_src")))
        .withColumn("_range", F.floor(place * F.col("_ranges") / F.lit(float(1 << 32))))
    )
    totals = dealt.groupBy("_rank", "_range").agg(F.sum("_size").alias("_sum"))
    ahead = Window.partitionBy("_rank").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(totals.select("_rank", "_range", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_start")), "ranges")
    inside = Window.partitionBy("_rank", "_range").orderBy("_key", id_col, "_size").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("_end", F.sum("_size").over(inside)).join(starts, ["_rank", "_range"])
    begin = F.col("_start") + F.col("_end") - F.col("_size")
    budget = F.floor("_target")
    whole = F.when(F.col("_source_size") > 0, F.floor(budget / F.col("_source_size"))).otherwise(0)
    rest = F.greatest(F.lit(0), F.least(F.col("_size"), budget - F.col("_whole") * F.col("_source_size") - F.col("_begin")))
    return (
        placed.withColumn("_whole", whole).withColumn("_begin", begin).withColumn("_rest", rest)
        .withColumn("_taken", (F.col("_whole") * F.col("_size") + F.col("_rest")).cast("long"))
        .withColumn("_epochs", F.when(F.col("_size") > 0, F.col("_whole") + (F.col("_rest") > 0).cast("long")).otherwise(0).cast("int"))
        .select(*[placed[c] for c in docs.columns], "_size", "_source_size", "_target", "_taken", "_epochs")
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", **params) -> DataFrame:
    """The mix itself: each document once for every pass that uses it, columns as given.

    Documents stay whole; the one on a source's cut is emitted for that pass too.
    Further columns, whatever their names, travel along untouched. Only ids and sizes
    are shuffled: a source's last row of the partial pass is its cut, and every row
    sees by its own key on which side it lies. Of rows that agree with the cut in
    key, id and size as many are taken as ``mix`` takes, by the hash of the whole row.
    """
    given = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(source_col).alias("_source"))
    m = mix(given, id_col="_id", text_col="_text", source_col="_source", seed=seed, **params)
    whole = F.when(F.col("_source_size") > 0, F.floor(F.floor("_target") / F.col("_source_size"))).otherwise(0)
    at = F.struct(_key("_id", seed).alias("k"), F.col("_id").alias("i"), F.col("_size").alias("s"))
    m = materialize(m.where("_size > 0").select("_source", at.alias("_at"), (F.col("_epochs") - whole).alias("_more"), whole.alias("_whole")), "mix")
    cuts = m.groupBy("_source").agg(F.max("_whole").alias("_whole"), F.max(F.when(F.col("_more") > 0, F.col("_at"))).alias("_cut"))
    cuts = materialize(cuts.withColumnRenamed("_source", "_src"), "cuts")
    same_source = F.col("_source").eqNullSafe(F.col("_src"))
    ties = m.drop("_whole").join(cuts, same_source).where(F.col("_at") == F.col("_cut"))
    ties = ties.groupBy("_src").agg(F.count("*").alias("_tied"), F.sum("_more").alias("_in")).where("_tied > _in").withColumnRenamed("_src", "_tie")
    cuts = materialize(cuts.join(ties, F.col("_src").eqNullSafe(F.col("_tie")), "left").drop("_tie"), "cuts")  # a row a source

    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), words(text_col).alias("_size"), F.col(source_col).alias("_source"))
    rows = rows.where("_size > 0").withColumn("_at", at).join(cuts, same_source)
    tied = F.col("_tied").isNotNull() & (F.col("_at") == F.col("_cut"))
    upto = F.coalesce(F.col("_at") <= F.col("_cut"), F.lit(False))
    out = rows.where(~tied).select("_row", (F.col("_whole") + upto.cast("long")).alias("_epochs"))
    if not cuts.where("_tied IS NOT NULL").isEmpty():
        same = rows.where(tied).withColumn("_hash", F.sha2(F.to_json("_row"), 256))
        same = number_sorted(same.repartitionByRange("_source", "_hash").sortWithinPartitions("_source", "_hash"), "_nth", "tied")
        first = same.groupBy(F.col("_src").alias("_f")).agg(F.min("_nth").alias("_first"))
        same = same.join(first, F.col("_src").eqNullSafe(F.col("_f")))
        out = out.unionByName(same.select("_row", (F.col("_whole") + (F.col("_nth") - F.col("_first") < F.col("_in")).cast("long")).alias("_epochs")))
    return out.withColumn("_pass", F.explode(F.sequence(F.lit(1).cast("long"), F.when(F.col("_epochs") > 0, F.col("_epochs"))))).select("_row.*")
