"""The query catalogue: every operator applied to the test tables, with its DuckDB counterpart."""

from __future__ import annotations

from cloneloom.plans import q_associations, q_cleaning, q_models, q_relational, q_repertoire, q_selection, q_sequences, q_statistics  # noqa: F401  they register their queries
from cloneloom.plans.registry import ORACLES, QUERIES  # noqa: F401
