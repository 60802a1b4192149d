"""lectern: bibliographic ETL, analytics and corpus preparation on Spark DataFrames."""

__version__ = "0.1.0"

from lectern.session import register_views, table  # noqa: E402, F401
