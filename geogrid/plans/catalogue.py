"""All registered queries of the grid library, and the SQL that checks each."""

from . import q_features, q_metrics, q_models, q_raster, q_reports, q_space, q_time  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
