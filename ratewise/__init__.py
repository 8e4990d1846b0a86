"""ratewise: a Spark-native insurance pricing engine.

Claims → exposures → cross-validated frequency/severity GLMs per coverage →
calibration, caps and blending → credibility-smoothed tier premiums →
per-row relativities → premiums per policyholder. DataFrames throughout;
the only Python in tasks is the per-model Newton solve on design cells.
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers whole, so a worker needs no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
