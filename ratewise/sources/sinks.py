"""Output: the per-student premium file."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ratewise.session import materialize


def write_premiums(totals: DataFrame, path: str, fmt: str = "csv", checks=()) -> None:
    """Sorted by (student, tier) with a header, as the reference's CSV.

    The totals are computed once, into the shared scratch folder, while their null
    totals are counted; ``checks`` are further observations of the same plan, whose
    counts must be 0. Only then is the file at ``path`` replaced, from what was
    computed: a failed check raises and leaves an earlier file as it was. The sort
    is a range-partitioned distributed sort; the files come out in key order part
    by part, no single task holds the table.
    """
    seen = Observation(f"totals {uuid.uuid4().hex[:8]}")
    nulls = [F.count_if(F.col(c).isNull()).alias(f"null {c}") for c in ("total_renew", "total_new")]
    staged = materialize(totals.observe(seen, *nulls), "premiums")
    bad = {name: n for check in (seen, *checks) for name, n in check.get.items() if n}
    if bad:
        raise ValueError(f"premiums not written: {bad}")
    w = staged.orderBy("student_id", "risk_tier").write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)
