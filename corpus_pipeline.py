"""The corpus pipeline: quality rules, near-duplicate join, secret scans, source mixing, best-fit packing.

The stages themselves, and what they do with odd rows, are in ``rangegrid/llm/pipeline.py``; this front goes with that folder.
"""

from __future__ import annotations

from rangegrid.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
