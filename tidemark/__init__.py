"""Order-flow analytics on Spark: every operator is a function from DataFrame to DataFrame."""

from tidemark.session import get_session

__all__ = ["get_session"]
