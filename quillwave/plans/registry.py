"""All registered queries of the library and their SQL."""

from __future__ import annotations

from quillwave.plans.model_queries import MODEL_ORACLES, MODEL_QUERIES
from quillwave.plans.oracles import ORACLES
from quillwave.plans.queries import QUERIES
from quillwave.plans.step_queries import STEP_ORACLES, STEP_QUERIES

ALL_QUERIES = QUERIES | MODEL_QUERIES | STEP_QUERIES
ALL_ORACLES = ORACLES | MODEL_ORACLES | STEP_ORACLES
