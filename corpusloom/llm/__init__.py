"""Operators of a training-data pipeline; nothing else in the library imports them.

``register`` adds their queries; the driver contract calls it only if this subpackage can be imported.
"""


def register() -> tuple[dict, dict]:
    """Queries and SQL of the subpackage."""
    from . import queries

    return queries.QUERIES, queries.ORACLES
