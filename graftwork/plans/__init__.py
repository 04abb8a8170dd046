"""Every operator on the star tables, each with equivalent SQL."""

from graftwork.plans import graphs, names, ordering, records, sources  # noqa: F401
from graftwork.plans.registry import ORACLES, QUERIES  # noqa: F401
