"""Retail segmentation and recommendations as Spark DataFrame functions."""

from shelfwise.config import Settings
from shelfwise.plans.segmentation import Segmentation, run, segment

__all__ = ["Segmentation", "Settings", "run", "segment"]
