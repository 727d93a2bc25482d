"""tablewash: table cleaning, profiling and exploratory analysis on Spark.

Every operator takes a DataFrame and returns a DataFrame (or a few scalars);
the work runs as Spark jobs and only small results reach the driver.
"""

from .operators import *  # noqa: F401,F403
from .operators import __all__ as _ops
from .sources import *  # noqa: F401,F403
from .sources import __all__ as _srcs
from .plans import CleaningPlan, EdaReport, eda_report
from .streaming import clean_stream, read_csv_stream, run_to_parquet

__all__ = list(_ops) + list(_srcs) + ["CleaningPlan", "EdaReport", "eda_report",
                                      "clean_stream", "read_csv_stream", "run_to_parquet"]
