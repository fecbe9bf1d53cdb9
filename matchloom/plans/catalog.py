"""Every query outside the training-data operators, with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from . import q_canonical, q_credit, q_features, q_networks, q_normalize, q_relational, q_scoring, q_sequence, q_situations, q_tracking

_MODULES = (q_sequence, q_relational, q_features, q_credit, q_normalize, q_scoring, q_canonical, q_tracking, q_networks, q_situations)
QUERIES: dict = {}
ORACLES: dict = {}
for _m in _MODULES:
    QUERIES.update(_m.QUERIES)
    ORACLES.update(_m.ORACLES)
