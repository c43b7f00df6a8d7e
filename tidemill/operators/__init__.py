"""Relational operators that Spark SQL has no syntax for, as compositions of its own."""

from tidemill.operators.keyed import distinct_on, top_per_group, with_ties
from tidemill.operators.quantified import quantified
from tidemill.operators.ranges import asof_join, range_join
from tidemill.operators.scalar import single_row_join

__all__ = ["asof_join", "distinct_on", "quantified", "range_join", "single_row_join", "top_per_group", "with_ties"]
