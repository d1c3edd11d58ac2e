"""The catalogue audit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ringloom.operators.catalog import (
    Catalogue,
    catalogue_totals,
    entities_without_textures,
    shared_textures,
)


@dataclass(frozen=True)
class Audit:
    totals: DataFrame  # one row
    missing: DataFrame  # (entity_id), sorted
    shared: DataFrame  # (texture, entity_id, n_entities), sorted by both


def audit_catalogue(catalogue: Catalogue) -> Audit:
    return Audit(
        catalogue_totals(catalogue),
        entities_without_textures(catalogue.entities, catalogue.textures).orderBy("entity_id"),
        shared_textures(catalogue.textures).orderBy("texture", "entity_id"),
    )
