"""From raw documents to token ids: the stages of the subpackage's corpus module."""

from __future__ import annotations

from quillguard.llm.corpus import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
