"""The corpus pipeline: its stages, run() over the tables of a folder, and its SQL (none). See pagewright.llm.pipeline."""

from pagewright.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
