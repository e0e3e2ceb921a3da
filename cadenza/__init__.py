"""cadenza: lesson and rental analytics as Spark DataFrame jobs.

Layout:
  sources/    table loading, domain schemas, adapters from the test tables
  functions/  scalar column helpers with PostgreSQL-compatible semantics
  operators/  reports, denormalisation, ingest rules, integrity audits
  plans/      the registered query keys and their oracle SQL
  streaming/  foreachBatch wrapper that applies the ingest rules to a stream
"""

from cadenza.session import build_session, ensure_checkpoint_dir

__all__ = ["build_session", "ensure_checkpoint_dir"]
