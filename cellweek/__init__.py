"""cellweek: grid-cell and weekly analytics of point incidents on Spark.

Every operator takes DataFrames and returns DataFrames; no module creates a session.
"""

__version__ = "0.1.0"
