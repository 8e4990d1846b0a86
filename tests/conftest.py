import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from ratewise.session import get_spark

    s = get_spark("local[4]", shuffle_partitions=8)
    yield s


def rows(df, *cols, order=None):
    d = df.select(*cols) if cols else df
    if order:
        d = d.orderBy(*order)
    return [tuple(r) for r in d.collect()]
