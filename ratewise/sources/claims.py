"""Claims input: fixed schema, file reader, amount parsing and the test fixture.

The reference reads a spreadsheet with inferred types. Here the schema is
fixed at load; spreadsheets are exported to CSV or Parquet first.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratewise.functions.nulls import nan_to_null
from ratewise.session import dealt

CLAIMS_SCHEMA = T.StructType([
    T.StructField("row_id", T.LongType(), False),
    T.StructField("student_id", T.LongType(), False),
    T.StructField("coverage", T.StringType(), True),
    T.StructField("risk_tier", T.StringType(), True),
    T.StructField("gpa", T.DoubleType(), True),
    T.StructField("greek", T.StringType(), True),
    T.StructField("off_campus", T.StringType(), True),
    T.StructField("distance_to_campus", T.DoubleType(), True),
    T.StructField("sprinklered", T.StringType(), True),
    T.StructField("gender", T.StringType(), True),
    T.StructField("holdout", T.BooleanType(), True),
    T.StructField("amount", T.DoubleType(), True),
])

# Text accepted as a number (same pattern in the DuckDB oracle). Hex and
# 'Inf' text, which R's as.numeric would read, become null here.
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def parse_amount_col(c) -> F.Column:
    """Text → double; anything that is not a plain decimal number → null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(NUMBER_PATTERN), F.trim(c).try_cast("double"))


def parse_amount(df: DataFrame, col: str = "amount", out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, parse_amount_col(col))


def _holdout_flag(c: F.Column, dtype: T.DataType) -> F.Column:
    """Logical or 0/1 flag; any other value is null (in neither set)."""
    if isinstance(dtype, T.BooleanType):
        return c
    if isinstance(dtype, T.StringType):
        u = F.upper(F.trim(c))
        return (F.when(u.isin("TRUE", "T", "1"), F.lit(True))
                .when(u.isin("FALSE", "F", "0"), F.lit(False)))
    d = c.cast("double")
    return F.when(d == 1, F.lit(True)).when(d == 0, F.lit(False))


#: Columns without which claims can't be priced; the rating factors may be absent and are then null.
REQUIRED = ("student_id", "coverage", "risk_tier", "holdout", "amount")


def _require(df: DataFrame, names) -> None:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"claims lack the columns {', '.join(missing)}; found {', '.join(df.columns)}")


def _never_null(c: F.Column, name: str) -> F.Column:
    return F.when(c.isNull(), F.raise_error(F.lit(f"a claim has no {name}"))).otherwise(c)


#: Text that names one whole number only: no sign, no leading zero.
_PLAIN_NUMBER = r"^(0|-?[1-9][0-9]{0,17})$"


def _student_id(c: F.Column, t: T.DataType, as_number: bool) -> F.Column:
    """Ids as read: whole numbers are bigint, all else is text. ``as_number`` turns text ids into
    numbers and raises, when run, for one that isn't written as a plain whole number."""
    if isinstance(t, T.IntegralType):
        return c.cast("bigint")
    text = c.cast("string")
    if not as_number:
        return text
    odd = F.raise_error(F.concat(F.lit("student_id is no plain whole number: "), text)).cast("bigint")
    return F.when(text.isNull() | text.rlike(_PLAIN_NUMBER), text.cast("bigint")).otherwise(odd)


def conform_claims(df: DataFrame, numeric_ids: bool = False) -> DataFrame:
    """Select the claims columns by name and cast them to ``CLAIMS_SCHEMA``.

    Raises if a required column or ``row_id`` is absent, and when run if a
    ``row_id`` or ``student_id`` is null. Text student ids stay text, so that 007
    and 7 are two students, unless ``numeric_ids`` says that they are whole
    numbers. A ``row_id`` of file places (``with_file_order``) is kept as it is.
    Other columns are ignored.
    """
    _require(df, ("row_id", *REQUIRED))
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = []
    for f in CLAIMS_SCHEMA.fields:
        if f.name not in types:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        c, t = F.col(f.name), types[f.name]
        if f.name == "holdout":
            c = _holdout_flag(c, t)
        elif f.name == "amount":
            c = parse_amount_col(c) if isinstance(t, T.StringType) else c.cast("double")
            c = nan_to_null(c)
        elif f.name == "student_id":
            c = _never_null(_student_id(c, t, numeric_ids), f.name)
        elif f.name == "row_id":
            c = c if isinstance(t, T.StructType) else _never_null(c.try_cast("bigint"), f.name)
        elif isinstance(f.dataType, T.DoubleType):
            c = nan_to_null(c.try_cast("double"))
        else:
            c = c.cast(f.dataType)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def with_file_order(df: DataFrame) -> DataFrame:
    """``row_id`` as the place of each row: (file path, offset of the split, count in the scan).

    Places compare like the rows' order: a split is read by one task from front to
    back, so the count rises inside it whatever the number of the task. Nothing is
    written or shuffled, and a repeated scan gives places of the same order.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                     F.monotonically_increasing_id().alias("at"))
    return df.select("*", place.alias("row_id"))


def load_claims(spark: SparkSession, path: str, fmt: str = "parquet", numeric_ids: bool = False) -> DataFrame:
    """Read claims (CSV with header, or Parquet) into the fixed schema, by column name.

    CSV is read as text under the file's own header, which every file of the
    folder must share; bad numbers become null instead of failing the scan, and
    student ids stay text unless ``numeric_ids`` is set. Without a ``row_id`` column
    the order of the rows in the files is taken.
    """
    if fmt == "csv":
        raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    else:
        raw = spark.read.parquet(path)
    _require(raw, REQUIRED)
    return conform_claims(raw if "row_id" in raw.columns else with_file_order(raw), numeric_ids)


# ---------------------------------------------------------------------------
# Test fixture derived from the driver's TPC-H-like tables (see FIXTURES.md).
# ---------------------------------------------------------------------------

def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def fixture_rows(spark: SparkSession, sf_dir: str) -> int:
    """About how many rows ``fixture_claims`` has: one for each line, as the files' footers count them."""
    return _t(spark, sf_dir, "lineitem").count()


def fixture_claims(spark: SparkSession, sf_dir: str, with_text: bool = False, with_line: bool = False) -> DataFrame:
    """One claim for each line of an order. Orders meet their customers before their lines do, so that the
    lines are shuffled once, and in tasks of bounded rows."""
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    li = _t(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_returnflag", "l_quantity")
    n = fixture_rows(spark, sf_dir)
    oc = o.join(c, o.o_custkey == c.c_custkey)
    j = dealt(li, n, "l_orderkey").join(dealt(oc, n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    ck, ok = F.col("c_custkey"), F.col("o_orderkey")
    cols = [
        ok.alias("row_id"),
        ck.alias("student_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Guest Medical")
        .when(F.col("o_orderpriority") == "2-HIGH", "Liability")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "Personal Property")
        .when(F.col("o_orderpriority") == "5-LOW", "Additional Living Expense").alias("coverage"),
        F.col("c_mktsegment").alias("risk_tier"),
        F.when(ck % 17 == 0, F.lit(None).cast("double"))
        .otherwise(F.lit(1.0) + 3 * (F.col("c_acctbal") + 1000) / 11000).alias("gpa"),
        F.when(ok % 5 == 0, "Y").when(ok % 5 == 4, F.lit(None).cast("string"))
        .otherwise("N").alias("greek"),
        F.when(F.col("c_nationkey") % 2 == 0, "Y").otherwise("N").alias("off_campus"),
        F.when(ck % 13 == 0, F.lit(None).cast("double"))
        .when(ck % 7 == 0, F.lit(0.0))
        .otherwise(F.abs(F.col("c_acctbal")) / 2000).alias("distance_to_campus"),
        F.when(ck % 11 == 0, F.lit(None).cast("string"))
        .when(ck % 3 == 0, "N").otherwise("Y").alias("sprinklered"),
        F.when(ck % 2 == 0, "F").otherwise("M").alias("gender"),
        F.when(ck % 97 == 0, F.lit(None).cast("boolean"))
        .otherwise(ck % 5 == 1).alias("holdout"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1),
               F.col("l_extendedprice") * (1 - F.col("l_discount")) / 20)
        .when(F.col("l_returnflag") == "A", F.lit(0.0)).alias("amount"),
    ]
    if with_text:
        ln = F.col("l_linenumber")
        cols.append(
            F.when(ln == 7, "n/a").when(ln == 6, " 12.5 ").when(ln == 5, "1e2")
            .when(ln == 4, "1d").when(ln == 3, "")
            .when(F.col("l_returnflag") == "N", F.lit(None).cast("string"))
            .otherwise(F.col("l_quantity").cast("string")).alias("amount_text")
        )
    if with_line:
        cols.append(F.col("l_linenumber").alias("line"))
    return j.select(*cols)


FIXTURE_CLAIMS_SQL = """
SELECT
  o.o_orderkey AS row_id,
  c.c_custkey AS student_id,
  CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Guest Medical' WHEN '2-HIGH' THEN 'Liability'
       WHEN '3-MEDIUM' THEN 'Personal Property' WHEN '5-LOW' THEN 'Additional Living Expense' END AS coverage,
  c.c_mktsegment AS risk_tier,
  CASE WHEN c.c_custkey % 17 = 0 THEN NULL ELSE CAST(1 AS DOUBLE) + 3 * (c.c_acctbal + 1000) / 11000 END AS gpa,
  CASE o.o_orderkey % 5 WHEN 0 THEN 'Y' WHEN 4 THEN NULL ELSE 'N' END AS greek,
  CASE WHEN c.c_nationkey % 2 = 0 THEN 'Y' ELSE 'N' END AS off_campus,
  CASE WHEN c.c_custkey % 13 = 0 THEN NULL WHEN c.c_custkey % 7 = 0 THEN CAST(0 AS DOUBLE)
       ELSE abs(c.c_acctbal) / 2000 END AS distance_to_campus,
  CASE WHEN c.c_custkey % 11 = 0 THEN NULL WHEN c.c_custkey % 3 = 0 THEN 'N' ELSE 'Y' END AS sprinklered,
  CASE WHEN c.c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
  CASE WHEN c.c_custkey % 97 = 0 THEN NULL ELSE c.c_custkey % 5 = 1 END AS holdout,
  CASE WHEN l.l_returnflag = 'R' AND l.l_linenumber = 1 THEN l.l_extendedprice * (1 - l.l_discount) / 20
       WHEN l.l_returnflag = 'A' THEN CAST(0 AS DOUBLE) END AS amount,
  CASE WHEN l.l_linenumber = 7 THEN 'n/a' WHEN l.l_linenumber = 6 THEN ' 12.5 ' WHEN l.l_linenumber = 5 THEN '1e2'
       WHEN l.l_linenumber = 4 THEN '1d' WHEN l.l_linenumber = 3 THEN '' WHEN l.l_returnflag = 'N' THEN NULL
       ELSE CAST(l.l_quantity AS VARCHAR) END AS amount_text,
  l.l_linenumber AS line
FROM customer c
JOIN orders o ON c.c_custkey = o.o_custkey
JOIN lineitem l ON l.l_orderkey = o.o_orderkey
"""
