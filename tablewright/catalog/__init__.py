"""The registered queries, by area."""

from __future__ import annotations

from .base import Query


def all_queries() -> list[Query]:
    from . import loading, modelling, preparation, quality, reporting

    out = [
        *quality.QUERIES,
        *preparation.QUERIES,
        *reporting.QUERIES,
        *modelling.QUERIES,
        *loading.QUERIES,
    ]
    names = [q.name for q in out]
    assert len(names) == len(set(names)), "query names must be unique"
    return out
