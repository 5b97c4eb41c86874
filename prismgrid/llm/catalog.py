"""The queries of this subpackage and of the corpus pipeline, with their SQL."""

from __future__ import annotations

import corpus_pipeline
from prismgrid.llm import decontaminate, licences, lm, mixing, neardup, quality, repeats, secrets, tokens, topk

_MODULES = (mixing, topk, quality, decontaminate, secrets, licences, tokens, lm, repeats, neardup)


def queries() -> dict:
    out = {name: f for m in _MODULES for name, f in vars(m).items() if name.startswith("op") and name[2].isdigit()}
    return out | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    out = {name: sql for m in _MODULES for name, sql in getattr(m, "SQL", {}).items()}
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
