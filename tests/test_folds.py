from pyspark.sql import Window
from pyspark.sql import functions as F

from ratewise.operators.folds import assign_folds, fold_hash, rank_buckets


def test_two_level_rank_equals_row_number(spark):  # §4.3
    df = spark.range(1, 3001).select(F.col("id").alias("student_id"),
                                     (F.col("id") % 3).cast("string").alias("coverage"))
    got = assign_folds(df, k=5, seed=1, bucket_digits=1)
    w = Window.partitionBy("coverage").orderBy(fold_hash(), "student_id")
    ref = df.withColumn("fold_ref", ((F.row_number().over(w) - 1) % 5 + 1).cast("int"))
    j = got.join(ref, ["student_id", "coverage"])
    assert j.count() == 3000
    assert j.filter(F.col("fold") != F.col("fold_ref")).count() == 0


def test_folds_balanced_within_coverage(spark):
    df = spark.range(1, 1004).select(F.col("id").alias("student_id"),
                                     F.when(F.col("id") < 400, "a").otherwise("b").alias("coverage"))
    counts = assign_folds(df, k=5).groupBy("coverage", "fold").count().collect()
    by = {}
    for r in counts:
        by.setdefault(r.coverage, []).append(r["count"])
    for sizes in by.values():
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_buckets_follow_the_rows(spark):
    """Prefixes lengthen until no bucket is over the bound; ranks stay those of one global row_number."""
    df = spark.range(1, 40_001).select(F.col("id").alias("student_id"), F.when(F.col("id") % 10 == 0, "small").otherwise("hot").alias("coverage"))
    hashed = df.select("coverage", fold_hash().alias("_h"))
    digits, counts = rank_buckets(hashed, "coverage", 60, first_digits=1)
    assert digits > 1 and counts.agg(F.max("_cnt"), F.sum("_cnt")).first()[0] <= 60 and counts.agg(F.sum("_cnt")).first()[0] == 40_000
    w = Window.partitionBy("coverage").orderBy(fold_hash(), "student_id")
    ref = df.withColumn("fold_ref", ((F.row_number().over(w) - 1) % 5 + 1).cast("int"))
    j = assign_folds(df, bucket_digits=1, most=60).join(ref, ["student_id", "coverage"])
    assert j.count() == 40_000 and j.filter(F.col("fold") != F.col("fold_ref")).isEmpty()


def test_one_student_over_the_bound_ends_the_search(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 500, 7).otherwise(F.col("id")).alias("student_id"), F.lit("c").alias("coverage"))
    digits, counts = rank_buckets(df.select("coverage", fold_hash().alias("_h")), "coverage", 100, first_digits=1)
    assert digits < 32 and counts.agg(F.max("_cnt")).first()[0] >= 500


def test_ten_million_rows_of_one_coverage(spark):
    """The largest window has a bounded number of rows whatever the size of the coverage."""
    df = spark.range(10_000_000).select(F.lit("c").alias("coverage"), F.md5(F.concat(F.col("id").cast("string"), F.lit("|1"))).alias("_h"))
    digits, counts = rank_buckets(df, "coverage", 2000)
    assert digits == 4 and counts.agg(F.max("_cnt")).first()[0] <= 2000


def test_a_ranking_task_holds_bounded_rows(spark, monkeypatch):  # F3, F4, F5
    monkeypatch.setattr("ratewise.session.TASK_ROWS", 500)
    df = spark.range(1, 10001).select(F.col("id").alias("student_id"), (F.col("id") % 2).cast("string").alias("coverage"))
    got = assign_folds(df, k=5, seed=1).withColumn("p", F.spark_partition_id())
    assert got.groupBy("p").count().agg(F.max("count")).first()[0] < 1000
    w = Window.partitionBy("coverage").orderBy(fold_hash(), "student_id")
    ref = df.withColumn("ref", ((F.row_number().over(w) - 1) % 5 + 1).cast("int"))
    assert got.join(ref, ["student_id", "coverage"]).filter(F.col("fold") == F.col("ref")).count() == 10000
