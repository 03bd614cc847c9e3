"""lakeprep: dataset preparation as Spark DataFrame operators and jobs."""

from .session import build_session, cut_lineage, scratch_path, scratch_root

__all__ = ["build_session", "cut_lineage", "scratch_path", "scratch_root"]
