"""Plan summaries and the strict surface."""

from tidemill.plans.explain import explain_analyze, operators, profile, summary
from tidemill.plans.strict import UnsupportedQuery, check, run

__all__ = ["UnsupportedQuery", "check", "explain_analyze", "operators", "profile", "run", "summary"]
