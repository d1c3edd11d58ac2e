"""Deriving a catalogue: cuboids in, edited and deduplicated regions out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ringloom.operators import derive
from ringloom.operators.lineage import cut_lineage


@dataclass(frozen=True)
class Edits:
    """Rule tables, each optional; see the operator that takes it for its columns."""

    replicate: DataFrame | None = None
    mirror: DataFrame | None = None
    rows: DataFrame | None = None
    rows_if_empty: DataFrame | None = None
    orientation: DataFrame | None = None
    parents: DataFrame | None = None
    parent_regions: DataFrame | None = None
    mirror_after: DataFrame | None = None  # copies that share rectangles with their original


def derive_regions(cuboids: DataFrame, entities: DataFrame, edits: Edits, base: DataFrame | None = None) -> DataFrame:
    """Regions of all entities: unfold, seed, copy, mirror, add, tag, inherit, then keep each
    rectangle once.

    ``entities(entity_id, tex_w, template)``; ``base`` holds the regions of the templates some
    entities start from. Every edit reads its input more than once, so each result is
    checkpointed: without that the work would double with every edit.
    """
    regions = derive.faces_of_cuboids(cuboids, keep_part=base is not None)
    if base is not None:
        regions = derive.seed_from_base(cut_lineage(regions), base, entities).drop("part")
    steps = (
        (edits.replicate, lambda df, rules: derive.replicate_parts(df, rules)),
        (edits.mirror, lambda df, rules: derive.mirror_parts(df, rules, entities)),
        (edits.rows, lambda df, rows: derive.add_rows(df, rows)),
        (edits.rows_if_empty, lambda df, rows: derive.add_rows(df, rows, only_if_empty=True)),
        (edits.orientation, lambda df, rules: derive.tag_orientation(df, rules)),
        (edits.parents, lambda df, parents: derive.inherit_regions(df, parents, edits.parent_regions)),
        (True, lambda df, _: derive.first_per_rectangle(df)),
        (edits.mirror_after, lambda df, rules: derive.mirror_parts(df, rules, entities)),
    )
    for given, edit in steps:
        if given is not None:
            regions = edit(cut_lineage(regions), given)
    return regions
