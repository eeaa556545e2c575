"""pitwise: point-in-time scenario features and forecast evaluation on Spark.

Every operator is a function ``DataFrame -> DataFrame`` built from
built-in Spark SQL expressions; there are no row-at-a-time UDFs.
"""

from pitwise.session import get_session, materialize

__all__ = ["get_session", "materialize"]
