"""All queries of the engine outside the llm folder, with their DuckDB SQL."""

from quillspark.plans import accounting, documents, documents_text, steps

_MODULES = (documents, accounting, documents_text, steps)

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in _MODULES for k, s in m.ORACLE_SQL.items()}
