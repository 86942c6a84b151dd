"""plumbline: run-table audit, feature and evaluation operators for Spark DataFrames."""

from plumbline.session import build_session, cut_lineage, drop_tables

__all__ = ["build_session", "cut_lineage", "drop_tables"]
