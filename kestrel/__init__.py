"""kestrel — Spark-native statistics for large tables.

Every operator takes DataFrames and returns DataFrames; the heavy work is
expressed with the DataFrame API so Catalyst plans it.  Small result tables
(test statistics, p x p Gram matrices) are finished on the driver only when
their size is bounded by the number of columns or groups, never by rows.
"""

from kestrel.session import get_spark, scratch_dir

__all__ = ["get_spark", "scratch_dir"]
