"""All queries of the package but those of optional subpackages."""

from __future__ import annotations

from . import analytics, modelling, reporting

QUERIES = analytics.QUERIES | modelling.QUERIES | reporting.QUERIES
ORACLES = analytics.ORACLES | modelling.ORACLES | reporting.ORACLES
