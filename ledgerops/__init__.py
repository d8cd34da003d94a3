"""ledgerops: reconcile, clean, aggregate and analyze ledger tables on Spark.

Every operator takes and returns DataFrames (or Columns) and is planned by
Catalyst; nothing runs until the caller asks for rows or writes output.
"""

from . import functions, operators, sources, streaming
from .operators import ReconConfig, Roles, reconcile, reconcile_sources
from .session import build_session, checkpoint_dir

__all__ = ["ReconConfig", "Roles", "build_session", "checkpoint_dir", "functions", "operators", "reconcile",
           "reconcile_sources", "sources", "streaming"]
