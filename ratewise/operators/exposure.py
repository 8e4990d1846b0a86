"""Claims → one exposure row per (student, coverage)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewise.functions.nulls import zero_sum

ATTRS_ALL = ("risk_tier", "gpa", "greek", "off_campus", "distance_to_campus", "sprinklered",
             "gender", "holdout")


def exposure_rollup(claims: DataFrame, mode: str = "count", with_gpa: bool = True) -> DataFrame:
    """Group by (student_id, coverage): attributes of the first record, summed amount.

    'First' follows ``row_id`` and keeps a null first value (the least struct of
    row id and attributes, so all attributes come from the same record). Records
    that share the least row id but not their attributes are settled by the
    attributes themselves, the least first and null before all, so that reruns
    agree. One shuffle on the group key; every aggregate here has a map-side partial form, so a student
    or coverage holding a large share of the rows is combined before the
    exchange.

    mode 'count' adds ``claim_n`` (amounts > 0) and ``avg_paid``.
    """
    attrs = [a for a in ATTRS_ALL if with_gpa or a != "gpa"]
    aggs = [
        F.min(F.struct("row_id", *attrs)).alias("_first"),
        zero_sum("amount").alias("total_paid"),
    ]
    if mode == "count":
        aggs.append(F.count_if(F.col("amount") > 0).alias("claim_n"))
    df = claims.groupBy("student_id", "coverage").agg(*aggs)
    cols = ["student_id", "coverage"] + [F.col(f"_first.{a}").alias(a) for a in attrs] + ["total_paid"]
    if mode == "count":
        cols += [
            F.col("claim_n"),
            F.when(F.col("claim_n") > 0, F.col("total_paid") / F.col("claim_n"))
            .otherwise(F.lit(0.0)).alias("avg_paid"),
        ]
    return df.select(*cols)


def claim_indicator(exposure: DataFrame) -> DataFrame:
    """has_claim = total_paid > 0."""
    return exposure.withColumn("has_claim", F.col("total_paid") > 0)
