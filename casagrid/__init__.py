"""Property-market analytics as Spark DataFrame jobs."""

from casagrid.session import build_session, ensure_checkpoint_dir

__all__ = ["build_session", "ensure_checkpoint_dir"]
