"""murmur: Spark-native mining of short-message corpora.

Every operator takes and returns DataFrames (or Columns) so the work is
planned by Catalyst and executed by Spark, from local mode to a cluster.
"""

__version__ = "0.1.0"
