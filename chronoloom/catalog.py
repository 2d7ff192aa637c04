"""The registered queries and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoloom.queries import envelope, exponential, features, horizon, models, online, preparation, trees, tuning, vectors  # noqa: F401  they register themselves
from chronoloom.queries.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly series by event type: gridded, interpolated, lags and calendar, recursive forecast of the last day."""
    return QUERIES["panel_usmr"](spark, sf_dir)
