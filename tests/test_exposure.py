from ratewise.operators.exposure import claim_indicator, exposure_rollup
from ratewise.operators.levels import align_levels, factor_levels, split_holdout

SCHEMA = ("row_id long, student_id long, coverage string, risk_tier string, gpa double, greek string, "
          "off_campus string, distance_to_campus double, sprinklered string, gender string, "
          "holdout boolean, amount double")


def claims(spark, rows):
    full = []
    for r in rows:
        d = dict(row_id=1, student_id=1, coverage="Liability", risk_tier="A", gpa=3.0, greek="N",
                 off_campus="N", distance_to_campus=1.0, sprinklered="Y", gender="F", holdout=False,
                 amount=None)
        d.update(r)
        full.append(tuple(d.values()))
    return spark.createDataFrame(full, SCHEMA)


def test_first_value_null_is_kept(spark):  # T6
    df = claims(spark, [dict(row_id=2, greek="Y"), dict(row_id=1, greek=None)])
    r = exposure_rollup(df).collect()[0]
    assert r.greek is None


def test_first_follows_row_id_not_input_order(spark):
    df = claims(spark, [dict(row_id=5, risk_tier="B"), dict(row_id=3, risk_tier="C")]).repartition(3)
    assert exposure_rollup(df).collect()[0].risk_tier == "C"


def test_all_amounts_null(spark):  # T5
    df = claims(spark, [dict(row_id=1), dict(row_id=2)])
    r = exposure_rollup(df, mode="count").collect()[0]
    assert (r.total_paid, r.claim_n, r.avg_paid) == (0.0, 0, 0.0)


def test_recovery_row(spark):  # T16
    df = claims(spark, [dict(row_id=1, amount=100.0), dict(row_id=2, amount=-150.0)])
    r = claim_indicator(exposure_rollup(df, mode="count")).collect()[0]
    assert (r.total_paid, r.claim_n, r.avg_paid, r.has_claim) == (-50.0, 1, -50.0, False)


def test_split_null_holdout_in_neither(spark):  # T9
    df = claims(spark, [dict(student_id=1, holdout=False), dict(student_id=2, holdout=True),
                        dict(student_id=3, holdout=None)])
    tr, te = split_holdout(exposure_rollup(df))
    assert [r.student_id for r in tr.collect()] == [1]
    assert [r.student_id for r in te.collect()] == [2]


def test_align_levels_unseen_to_null(spark):  # T10
    train = spark.createDataFrame([("A", "x"), ("B", "y")], "risk_tier string, coverage string")
    test = spark.createDataFrame([("A", "x"), ("Z", "q")], "risk_tier string, coverage string")
    lv = factor_levels(train, ["risk_tier", "coverage"])
    got = sorted([tuple(r) for r in align_levels(test, lv, ["risk_tier", "coverage"]).collect()],
                 key=str)
    assert got == [("A", "x"), (None, None)]


def test_equal_row_ids_give_the_least_attributes_whatever_the_order(spark):
    rows = [dict(row_id=1, risk_tier="B", greek="N", amount=1.0), dict(row_id=1, risk_tier="A", greek="Y", amount=2.0), dict(row_id=1, risk_tier="A", greek=None, amount=4.0)]
    for order in (rows, rows[::-1]):
        r = exposure_rollup(claims(spark, order).repartition(3)).collect()[0]
        assert (r.risk_tier, r.greek, r.total_paid) == ("A", None, 7.0)
