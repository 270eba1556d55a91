"""Registry of the screening engine's queries and their SQL."""

from __future__ import annotations

from .functions import queries as _descriptors  # noqa: F401
from .operators import gate_queries as _gates  # noqa: F401
from .operators import rank_queries as _rank  # noqa: F401
from .operators import lab_queries as _lab  # noqa: F401
from .operators import run_queries as _runs  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
