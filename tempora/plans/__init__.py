from tempora.plans import cycle, impact_and_decisions, merges, retrieval, sources_and_text, state_and_portfolio, time_and_identity  # noqa: F401
from tempora.plans.registry import QUERIES, SQL  # noqa: F401
