"""All queries of the engine, (spark, sf_dir) -> DataFrame, and their SQL oracles."""

from __future__ import annotations

from weftline.plans import q_answers, q_changes, q_graph, q_more, q_rank, q_stores, q_text

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _m in (q_text, q_graph, q_rank, q_answers, q_changes, q_more, q_stores):
    QUERIES |= _m.Q.queries
    ORACLE_SQL |= _m.Q.sql
