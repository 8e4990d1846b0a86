import pytest

import __spark_entry__ as E
from ratewise.operators.rating import check_quality, quality_gate


def test_contract_keys():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 60
    for name in ("price_m1", "price_m2", "price_m3", "compare_variants"):
        assert name in q and name in s


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["student_id", "risk_tier", "total_renew", "total_new"]
    assert df.count() > 0


def test_quality_gate_raises(spark):
    totals = spark.createDataFrame([(1, "A", None, 1.0)],
                                   "student_id long, risk_tier string, total_renew double, total_new double")
    priced = spark.createDataFrame([(1.0, 1.0)], "final_prem_renew double, final_prem_new double")
    with pytest.raises(ValueError):
        check_quality(quality_gate(totals, priced))
