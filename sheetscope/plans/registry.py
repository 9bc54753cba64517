"""All registered queries."""

from sheetscope.plans import (  # noqa: F401
    q_candidates, q_derive, q_insights, q_profile, q_relations, q_specs, q_tables,
)
from sheetscope.plans.base import ORACLES, QUERIES  # noqa: F401
