"""Every query of the library and its SQL, from the modules that register them."""

from gradeflow.plans import case_queries, merge_queries, request_queries, review_queries, scoring_queries, snapshot_queries, view_queries  # noqa: F401
from gradeflow.plans.queries import QUERIES, SQL  # noqa: F401
