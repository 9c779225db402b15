"""postlens: analytics over archives of short time-stamped posts, on Spark.

Every operator is a ``DataFrame -> DataFrame`` function built from Spark's own
DataFrame / SQL primitives.  See README.md for the catalogue.
"""

__version__ = "0.1.0"
