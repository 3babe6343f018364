"""Forecasting and auditing many time series at once, on Spark."""

from .series import SeriesSpec
from .session import build_session, cut_lineage

__all__ = ["SeriesSpec", "build_session", "cut_lineage"]
