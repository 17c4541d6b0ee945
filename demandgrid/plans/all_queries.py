"""Every registered query."""

from __future__ import annotations

from functools import cache

from demandgrid.plans import (
    compare_catalog,
    features_catalog,
    keys_catalog,
    metrics_catalog,
    models_catalog,
    prepare_catalog,
    sources_catalog,
)
from demandgrid.plans.catalog import Catalog


@cache
def catalog() -> Catalog:
    built = Catalog()
    for family in (
        sources_catalog,
        prepare_catalog,
        features_catalog,
        keys_catalog,
        models_catalog,
        metrics_catalog,
        compare_catalog,
    ):
        family.register(built)
    return built
