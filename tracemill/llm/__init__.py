"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it.  Every operator takes DataFrames
and column names and returns DataFrames; the thin ``opN_*`` queries that fix
production parameters live in :mod:`tracemill.llm.queries`.
"""
