"""Fleet deployment analytics on PySpark.

Every operator is a plain function ``DataFrame -> DataFrame`` keyed by message
(and client / environment where relevant), built from Spark's own functions.
"""

__version__ = "0.1.0"
