"""Balanced cross-validation folds inside each coverage.

The reference shuffles ``rep(1:K)`` with R's generator. Here the order is
``md5(student_id|seed)`` (then student_id), and fold = (rank - 1) mod K + 1,
so fold sizes inside a coverage differ by at most one, as there.

A plain ``row_number`` over coverage would put a whole coverage (possibly a
third of the table) into one task. The rank is built in two levels instead:
the leading hex digits of the hash form buckets, rows are numbered inside
(coverage, bucket), and an exclusive prefix sum of the bucket counts is added.
The result equals the global ``row_number``. Counts tell how many digits a task
can bear: as long as the largest bucket has more rows than it may, prefixes get
longer, by as many digits as even hashes need at once.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratewise.session import dealt, known_small, materialize

#: Most rows of a coverage that one window partition numbers.
BUCKET_ROWS = 1 << 16


def fold_hash(student_col: str = "student_id", seed: int = 1) -> F.Column:
    return F.md5(F.concat(F.col(student_col).cast("string"), F.lit(f"|{seed}")))


def rank_buckets(df: DataFrame, by: str, most: int, first_digits: int = 3) -> tuple[int, DataFrame]:
    """Digits of the hash ``_h`` and the counts (by, ``_b``, ``_cnt``) of buckets that hold at most ``most`` rows.

    Only rows that share a whole hash (repeats of one student in one ``by``) can
    make a larger one.
    """
    digits, counts = first_digits, None
    while True:
        counts = materialize(df.groupBy(by, F.substring("_h", 1, digits).alias("_b")).agg(F.count(F.lit(1)).alias("_cnt")), "rank-buckets")
        top, alike = counts.agg(F.max("_cnt"), F.max_by("_b", "_cnt")).first() or (0, None)
        if (top or 0) <= most or digits >= 32:
            return digits, counts
        if digits > first_digits:  # even hashes would fit by now: are these rows one hash?
            one = df.filter(F.substring("_h", 1, digits) == alike).groupBy(by, "_h").count().agg(F.max("count")).first()[0]
            if one > most:
                return digits, counts
        digits = min(32, digits + max(1, math.ceil(math.log(top / most, 16))))


def assign_folds(train: DataFrame, k: int = 5, seed: int = 1, by: str = "coverage",
                 bucket_digits: int = 3, most: int = BUCKET_ROWS) -> DataFrame:
    """``train`` with ``fold``; a window partition holds at most ``most`` rows. ``bucket_digits`` is where prefixes begin."""
    hashed = train.withColumn("_h", fold_hash(seed=seed))
    digits, counts = rank_buckets(hashed.select(by, "_h"), by, most, bucket_digits)
    rows = counts.agg(F.sum("_cnt")).first()[0] or 0
    df = dealt(hashed.withColumn("_b", F.substring("_h", 1, digits)), rows, by, "_b")
    w_off = Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(by, "_b", F.coalesce(F.sum("_cnt").over(w_off), F.lit(0)).alias("_off"))
    w_in = Window.partitionBy(by, "_b").orderBy("_h", "student_id")
    ranked = df.withColumn("_r", F.row_number().over(w_in))
    out = ranked.join(offsets, on=[by, "_b"], how="inner")
    rank = F.col("_off") + F.col("_r")
    return out.withColumn("fold", ((rank - 1) % k + 1).cast("int")).drop("_h", "_b", "_r", "_off")


def fold_membership(spark, k: int = 5) -> DataFrame:
    """(model_id, fold): model 0 uses every fold, model m every fold but m.

    K·K rows at most, fixed by configuration, so it is always broadcast.
    """
    rows = [(0, f) for f in range(1, k + 1)] + [
        (m, f) for m in range(1, k + 1) for f in range(1, k + 1) if f != m]
    return known_small(spark.createDataFrame(rows, "model_id int, fold int"), len(rows))
