"""Registered queries over the given tables."""


def registered() -> tuple[dict, dict]:
    """(queries, SQL) by name."""
    from gridloom.plans import grids, registry, scores, series, streams

    assert grids and scores and series and streams
    return registry.QUERIES, registry.SQL
