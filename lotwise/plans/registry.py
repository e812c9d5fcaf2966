"""The queries of the core library; the flagship first."""

from . import analytics_queries, description_queries, evidence_queries, layout_queries, linkage_queries, lot_evidence_queries, notice_queries, place_queries, reading_queries, record_queries, resolution_queries, search_queries, stream_queries, text_queries

_MODULES = (search_queries, analytics_queries, text_queries, linkage_queries, notice_queries, resolution_queries, place_queries, reading_queries, record_queries, layout_queries, evidence_queries, lot_evidence_queries, description_queries, stream_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.Q.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items() if sql}
