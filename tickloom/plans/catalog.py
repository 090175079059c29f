"""All registered queries and their SQL twins."""

from __future__ import annotations

from tickloom.plans import bars_catalog, model_catalog, trade_catalog, stream_catalog

MODULES = (bars_catalog, model_catalog, trade_catalog, stream_catalog)
QUERIES, ORACLES = {}, {}
for _module in MODULES:
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
