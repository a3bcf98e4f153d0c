"""freshet: refresh analytics copies of production tables with Spark.

Masking, snapshot choice, schema carry-over, migration audit, fleet state and
the keyed streams around them, all as DataFrame code on stock Spark.
"""

__version__ = "0.1.0"
