"""postlens: post / topic / user-behaviour analytics as Spark DataFrame jobs.

Every public operator is a function ``DataFrame -> DataFrame`` (or a small
set of DataFrames); nothing is collected to the driver except scalars such
as percentile cut-offs and bounded model parameters (k centroids, k x n
topic words).
"""

__version__ = "0.1.0"
