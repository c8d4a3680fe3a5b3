"""The corpus pipeline: five stages over ``documents``."""
from __future__ import annotations

from leverkit.llm.pipeline import ORACLE_SQL, STAGES, run  # noqa: F401
