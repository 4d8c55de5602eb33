"""vellum: a Spark-native engine for long-document evaluation and rollout analytics."""

from vellum.session import build_session

__all__ = ["build_session"]
