"""All registered queries and their twins."""

from roadframes.plans import (  # noqa: F401
    data_queries,
    feedback_queries,
    frame_queries,
    model_queries,
    source_queries,
    stream_queries,
)
from roadframes.plans.registry import QUERIES, TWINS

__all__ = ["QUERIES", "TWINS"]
