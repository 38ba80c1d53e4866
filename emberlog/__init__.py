"""Security-log analytics on Spark.

Every operator takes DataFrames and returns a DataFrame; nothing runs until
an action asks for rows, apart from the few operators whose docstring says
that they probe or checkpoint.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

from emberlog.session import build_session, drop_scratch, scratch_dir

# Functions sent to executors travel with their code, so that the package need
# not be installed there.
register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "drop_scratch", "scratch_dir"]
