"""veilspark: message-privacy analytics on Spark.

Every operator is a ``Column -> Column`` or ``DataFrame -> DataFrame`` function
that Catalyst can plan. The only Python worker step is the optional batch
scorer hook in :mod:`veilspark.operators.cascade`.
"""

__all__ = ["session", "schemas"]
