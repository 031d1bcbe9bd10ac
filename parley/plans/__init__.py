"""Query catalog, oracle SQL and plan-level helpers (size-checked broadcast,
plan inspection)."""
