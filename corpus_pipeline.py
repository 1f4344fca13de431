"""The corpus pipeline: documents in, packed training pieces out. Its stages are in strataloom.llm.pipeline."""

from strataloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
