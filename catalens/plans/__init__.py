"""Statements: the lexical guard, the guarded read path and the analyse-only check."""
