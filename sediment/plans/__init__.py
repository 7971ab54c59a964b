"""Named queries over the driver's tables, each beside its SQL."""

from . import charts_policy, conversations, relational, retrieval, streams, text  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
