"""sentable: tabular data as "column is value" sentences, on Spark.

Prepare, serialise, fit per-column value distributions, sample, impute and
parse tables back from text, all as DataFrame expressions, joins, windows and
aggregations.  Randomness is derived from md5 of (seed, tag, key) so results
do not depend on partitioning and can be reproduced by another SQL engine.
"""

__version__ = "0.1.0"
