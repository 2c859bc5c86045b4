"""Where queries and their SQL are registered by name."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, model: str = ""):
    """Registers a function (spark, sf_dir) -> DataFrame by its name; sql: what follows the relations of ``model``, a WITH list."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (f"WITH RECURSIVE {model} " if model else "") + sql
        return f

    return register
