"""Multi-factor runs (no SQL oracle) against the independent pandas twin."""

import numpy as np
import pytest

from ratewise.config import M1, M2, M3
from ratewise.plans.pipeline import price
from ratewise.sources import fixture_claims
from tests import twin

CASES = [("/root/testdata/sf0.01", M2), ("/root/testdata/sf0.01", M1), ("/root/testdata/sf0.01", M3),
         ("/root/testdata/sf0.001", M2), ("/root/testdata/sf0.001", M1)]


@pytest.mark.parametrize("sf,v", CASES, ids=[f"{s[-6:]}-{v.name}" for s, v in CASES])
def test_totals_match_twin(spark, sf, v):
    claims = fixture_claims(spark, sf)
    ours = price(claims, v)
    got = ours.student_totals.toPandas().set_index(["student_id", "risk_tier"]).sort_index()
    ref = twin.price(claims.toPandas(), v)
    exp = ref["totals"].set_index(["student_id", "risk_tier"]).sort_index()
    assert list(got.index) == list(exp.index)
    for c in ("total_renew", "total_new"):
        rel = np.abs(got[c].to_numpy() / exp[c].to_numpy() - 1)
        assert np.nanmax(rel) < 1e-6, (c, np.nanmax(rel))
    h = ours.holdout_check.toPandas().set_index("coverage").sort_index()
    hr = ref["holdout"].set_index("coverage").sort_index()
    np.testing.assert_allclose(h.ratio.to_numpy(dtype=float), hr.ratio.to_numpy(dtype=float), rtol=1e-6)
