"""featsearch: wrapper feature-subset search on Spark DataFrames.

Rows stay partitioned; the (small, config-bounded) population of candidate
subsets is shipped to the tasks, so one pass over the rows scores every
candidate at once.
"""

__version__ = "0.1.0"
