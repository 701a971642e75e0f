"""tallyframe: profile, clean and query wide tables on Spark.

Every public operator takes a DataFrame and returns a DataFrame (or a small
fitted object that does). Nothing holds the table as state.
"""

__version__ = "0.1.0"
