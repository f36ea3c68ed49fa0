"""All registered queries."""

from tidemark.registry import REGISTRY  # noqa: F401
from tidemark.plans import (activity, drift, estimates, facts, filings, market, prices, scalars, sinks, sources,  # noqa: F401
                            streams, timeline)
