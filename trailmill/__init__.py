"""Spark-native preparation of location records."""

from trailmill.options import Lookup, PrepOptions
from trailmill.plans.preparation import Preparation, prepare

__all__ = ["Lookup", "PrepOptions", "Preparation", "prepare"]
