"""Tagged-stream pipelines on Spark DataFrames."""

from .frame import TagFrame

__all__ = ["TagFrame"]
