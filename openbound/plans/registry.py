"""Merges the query catalogs and their oracles into the driver's two maps."""

from __future__ import annotations

from . import catalog, catalog_models, catalog_train, oracle, oracle_models, oracle_train

FLAGSHIP = catalog.FLAGSHIP

_CATALOGS = [catalog, catalog_train, catalog_models]
_ORACLES = [oracle.ORACLES, oracle_train.ORACLES, oracle_models.ORACLES]


def all_queries() -> dict:
    out: dict = {}
    for mod in _CATALOGS:
        out.update(mod.QUERIES)
    return dict(sorted(out.items()))


def all_oracles() -> dict:
    out: dict = {}
    for o in _ORACLES:
        out.update(o)
    q = all_queries()
    return {k: v for k, v in sorted(out.items()) if k in q}
