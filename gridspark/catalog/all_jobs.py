"""Importing this module registers every job."""

from __future__ import annotations

import importlib

from gridspark.catalog.registry import JOBS

for _name in ("price_jobs", "time_jobs", "quality_jobs", "forecast_jobs", "text_jobs"):
    importlib.import_module(f"gridspark.catalog.{_name}")

__all__ = ["JOBS"]
