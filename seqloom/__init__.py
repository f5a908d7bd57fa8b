"""Spark-native analytics and alignment over families of sequences."""

from seqloom.config import AlignerConfig
from seqloom.session import build_session, materialize

__all__ = ["AlignerConfig", "build_session", "materialize"]
