import os
import tempfile

import pytest

from pyspark.sql import functions as F

from ratewise.operators.exposure import exposure_rollup
from ratewise.sources import CLAIMS_SCHEMA, fixture_claims, load_claims, parse_amount_col, write_premiums
from tests.conftest import SF001


def test_parse_amount_text(spark):  # T27
    vals = ["12", " 12.5 ", "1e2", "1d", "", "n/a", None, "-3", ".5", "0x1A", "Inf"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, t string")
    got = [r.x for r in df.select("i", parse_amount_col("t").alias("x")).orderBy("i").collect()]
    assert got == [12.0, 12.5, 100.0, None, None, None, None, -3.0, 0.5, None, None]


def test_load_claims_csv_fixed_schema(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    path = os.path.join(d, "claims.csv")
    with open(path, "w") as f:
        f.write("row_id,student_id,coverage,risk_tier,gpa,greek,off_campus,distance_to_campus,"
                "sprinklered,gender,holdout,amount\n")
        f.write("1,7,Liability,A,3.1,Y,N,0.5,Y,F,0,100.5\n")
        f.write("2,7,Liability,A,NaN,,N,,Y,F,1,n/a\n")
        f.write("3,8,,B,2.0,N,Y,4,N,M,2,\n")
    df = load_claims(spark, path, "csv")
    assert df.schema == CLAIMS_SCHEMA or [f.name for f in df.schema] == [f.name for f in CLAIMS_SCHEMA]
    got = {r.row_id: r for r in df.collect()}
    assert got[1].holdout is False and got[1].amount == 100.5
    assert got[2].holdout is True and got[2].amount is None and got[2].gpa is None
    assert got[3].holdout is None and got[3].coverage is None


def test_load_claims_parquet_numeric_holdout(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    src = spark.createDataFrame([(1, 5, "A", "x", 0, 10.0), (2, 5, "A", "x", 1, float("nan"))],
                                "row_id long, student_id long, coverage string, risk_tier string, holdout int, amount double")
    src.write.parquet(os.path.join(d, "p"))
    got = {r.row_id: r for r in load_claims(spark, os.path.join(d, "p")).collect()}
    assert got[1].holdout is False and got[2].holdout is True
    assert got[2].amount is None  # NaN → null at load


def test_fixture_matches_documented_shape(spark):
    c = fixture_claims(spark, SF001)
    assert c.count() == spark.read.parquet(f"{SF001}/lineitem.parquet").count()
    assert c.filter(F.col("coverage").isNull()).count() > 0


def test_write_premiums_round_trip(spark):  # O02
    d = tempfile.mkdtemp(dir="/tmp")
    totals = spark.createDataFrame([(2, "B", 3.0, 4.0), (1, "A", 1.0, 2.0), (1, "B", 5.0, 6.0)],
                                   "student_id long, risk_tier string, total_renew double, total_new double")
    out = os.path.join(d, "totals")
    write_premiums(totals, out)
    back = spark.read.option("header", True).csv(out)
    assert back.columns == ["student_id", "risk_tier", "total_renew", "total_new"]
    assert [(r.student_id, r.risk_tier) for r in back.collect()] == [("1", "A"), ("1", "B"), ("2", "B")]


HEAD = "risk_tier,note,student_id,amount,coverage,holdout"


def _csv(text):
    path = os.path.join(tempfile.mkdtemp(dir="/tmp"), "claims.csv")
    with open(path, "w") as f:
        f.write(text)
    return path


def test_columns_by_name_text_ids_and_file_order(spark):
    df = load_claims(spark, _csv(HEAD + "\nA,x,S1,5,Liability,0\nB,y,S2,7,Liability,1\nA,z,S1,9,Liability,0\n"), "csv")
    got = [(r.student_id, r.risk_tier, r.amount, r.holdout) for r in df.orderBy("row_id").collect()]
    assert got == [("S1", "A", 5.0, False), ("S2", "B", 7.0, True), ("S1", "A", 9.0, False)]


def test_text_ids_are_as_read(spark):
    """007, 7 and +7 are three students; what other rows hold changes nothing."""
    text = "row_id," + HEAD + "\n1,A,x,007,5,Liability,0\n2,A,x,7,10,Liability,0\n3,A,x,+7,20,Liability,0\n"
    for more in ("", "4,A,x,S1,1,Liability,0\n"):
        df = load_claims(spark, _csv(text + more), "csv")
        assert dict(df.dtypes)["student_id"] == "string"
        paid = {r.student_id: r.total_paid for r in exposure_rollup(df).collect()}
        assert {k: paid[k] for k in ("007", "7", "+7")} == {"007": 5.0, "7": 10.0, "+7": 20.0}
    ids = load_claims(spark, _csv("row_id," + HEAD + "\n1,A,x,8,5,Liability,0\n"), "csv", numeric_ids=True)
    assert dict(ids.dtypes)["student_id"] == "bigint" and ids.first().student_id == 8
    with pytest.raises(Exception, match="no plain whole number: 007"):
        load_claims(spark, _csv(text), "csv", numeric_ids=True).collect()


def test_file_order_over_many_splits(spark):
    """Order keys follow path, offset and position; nothing is written for them."""
    d = tempfile.mkdtemp(dir="/tmp")
    for k in range(3):
        with open(os.path.join(d, f"part-{k}.csv"), "w") as f:
            f.write(HEAD + "\n" + "".join(f"A,x,s,{1000 * k + i},Liability,0\n" for i in range(400)))
    saved = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        df = load_claims(spark, d, "csv")
        assert df.rdd.getNumPartitions() > 3
        got = [r.amount for r in df.orderBy("row_id").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", saved)
    assert got == [float(1000 * k + i) for k in range(3) for i in range(400)]


@pytest.mark.parametrize("gone", ["student_id", "coverage", "risk_tier", "amount", "holdout"])
def test_missing_required_column_raises(spark, gone):
    cols = [c for c in HEAD.split(",") if c != gone]
    with pytest.raises(ValueError, match=gone):
        load_claims(spark, _csv(",".join(cols) + "\n" + ",".join("1" for _ in cols) + "\n"), "csv")


def test_null_id_raises(spark):
    df = load_claims(spark, _csv("row_id," + HEAD + "\n1,A,x,,5,Liability,0\n"), "csv")
    with pytest.raises(Exception, match="no student_id"):
        df.collect()


TOTALS = "student_id long, risk_tier string, total_renew double, total_new double"


def test_null_totals_are_not_written(spark):
    """The check runs in the pass that computes the totals; an earlier file stays as it was."""
    path = os.path.join(tempfile.mkdtemp(dir="/tmp"), "t")
    write_premiums(spark.createDataFrame([(1, "A", 1.0, 2.0)], TOTALS), path)
    with pytest.raises(ValueError, match="null total_renew"):
        write_premiums(spark.createDataFrame([(2, "B", None, 4.0)], TOTALS), path)
    assert [r.student_id for r in spark.read.option("header", True).csv(path).collect()] == ["1"]


def test_null_row_premiums_stop_the_job(spark):
    """A row that can't be priced would be left out of its student's sum: the file isn't replaced."""
    from ratewise.config import M2
    from ratewise.plans.pipeline import price
    from tests.test_pipeline import build

    path = os.path.join(tempfile.mkdtemp(dir="/tmp"), "t")
    claims = build(spark)
    price(claims, M2).write(path)
    before = sorted(map(tuple, spark.read.csv(path).collect()))
    assert len(before) > 150
    # a tier without claimants in Liability has no severity there, so its rows have no premium
    lone = claims.withColumn("risk_tier", F.when((F.col("coverage") == "Liability") & (F.col("student_id") == 45), "Lone").otherwise(F.col("risk_tier")))
    with pytest.raises(ValueError, match="null final_prem_renew"):
        price(lone, M2).write(path)
    assert sorted(map(tuple, spark.read.csv(path).collect())) == before


def _tables(spark, d, customers=300, per=4, lines=5):
    """customer, orders and lineitem with a null key and an order without a customer."""
    i = F.col("id")
    spark.range(customers).select(
        i.alias("c_custkey"), (i % 25).cast("int").alias("c_nationkey"), (i * 31 % 9000 - 900).cast("double").alias("c_acctbal"),
        F.concat(F.lit("seg"), (i % 5).cast("string")).alias("c_mktsegment")).write.parquet(f"{d}/customer.parquet")
    n = customers * per
    prio = F.element_at(F.array(*[F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")]), (i % 5 + 1).cast("int"))
    spark.range(n + 1).select(i.alias("o_orderkey"), F.when(i < n, (i / per).cast("long")).otherwise(F.lit(-1)).alias("o_custkey"),
                              prio.alias("o_orderpriority")).write.parquet(f"{d}/orders.parquet")
    spark.range((n + 1) * lines).select(
        F.when(i > 0, (i / lines).cast("long")).alias("l_orderkey"), (i % lines + 1).cast("int").alias("l_linenumber"), (i % 977 + 1).cast("double").alias("l_extendedprice"),
        F.lit(0.1).alias("l_discount"), F.when(i % 3 == 0, "R").when(i % 3 == 1, "A").otherwise("N").alias("l_returnflag"),
        (i % 50).cast("double").alias("l_quantity")).write.parquet(f"{d}/lineitem.parquet")
    return customers * per * lines - 1


def test_a_claims_task_holds_bounded_rows(spark, tmp_path, monkeypatch):  # F1
    d = str(tmp_path)
    n = _tables(spark, d)
    plain = sorted(map(repr, fixture_claims(spark, d, with_line=True).collect()))
    monkeypatch.setattr("ratewise.session.TASK_ROWS", 250)
    got = fixture_claims(spark, d, with_line=True)
    assert sorted(map(repr, got.collect())) == plain and len(plain) == n
    assert got.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0] < 750


def test_loaded_order_tasks_hold_bounded_rows(spark, tmp_path, monkeypatch):  # F2
    from ratewise.plans.queries import QUERIES

    d = str(tmp_path)
    n = _tables(spark, d)
    plain = sorted(map(repr, QUERIES["load_claims_order"](spark, d).collect()))
    monkeypatch.setattr("ratewise.session.TASK_ROWS", 250)
    got = QUERIES["load_claims_order"](spark, d)
    assert sorted(map(repr, got.collect())) == plain and len(plain) == n
    assert got.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0] < 750
    scan = got.inputFiles()
    assert len(scan) >= n // 250  # written by as many tasks as the rows need, not by seven
