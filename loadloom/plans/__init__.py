"""Named queries: operators bound to concrete tables, with their SQL twins."""

import importlib

MODULES = ("rollup_queries", "scalar_queries", "quality_queries", "weather_queries", "feature_queries", "cluster_queries",
           "forecast_queries", "report_queries")


def load_all() -> None:
    for m in MODULES:
        importlib.import_module(f"loadloom.plans.{m}")
