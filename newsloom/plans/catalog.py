"""All registered queries; importing the query modules fills the registry."""

from newsloom.plans import corpus_queries, event_queries, feed_queries, grouping_queries, job_queries, stream_queries, text_queries  # noqa: F401
from newsloom.plans.registry import ORACLES, PLANS  # noqa: F401
