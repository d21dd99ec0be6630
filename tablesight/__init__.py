"""tablesight: table profiling, cleaning and business measures as Spark DataFrames.

Every operator takes and returns ``pyspark.sql.DataFrame`` objects and keeps its
work inside Spark (Catalyst plans, shuffles, windows).  Small decisions that
choose *which columns* to touch (type inference, constant-column detection) are
taken on the driver from one-row aggregates; row data never passes through the
driver.
"""

import sys

from pyspark import cloudpickle

from tablesight.session import get_session, checkpoint_dir

# Functions that run inside tasks travel with the task, so workers need no copy
# of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["get_session", "checkpoint_dir"]
__version__ = "0.1.0"
