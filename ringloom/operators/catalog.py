"""Region catalogue: entities with ordered regions and ordered textures.

Three flat tables instead of nested structs, so an entity with very many regions is many
rows, not one wide row:

* ``entities(entity_id, tex_w, tex_h, claim)``: ``claim`` orders entities by file; on a
  shared texture the greatest claim wins
* ``regions(entity_id, ord, name, x, y, width, height, flip, rotate)``
* ``textures(entity_id, ord, texture)``
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringloom.operators import sizing
from ringloom.operators.affix import length_stats

REGION_COLUMNS = ["name", "x", "y", "width", "height", "flip", "rotate"]


@dataclass(frozen=True)
class Profile:
    """Measured sizes of a catalogue. Everything derived from it (owners, summaries per
    texture or entity) has at most as many rows, so one pass bounds all its joins."""

    entities: sizing.Size
    regions: sizing.Size
    textures: sizing.Size
    texture_lengths: tuple[int | None, int]  # least and number of distinct path lengths
    max_broadcast_bytes: int | None = None

    def fits(self, *parts: str, extra: int = 0, copies: int = 1) -> bool:
        """Whether each part, with up to ``extra`` bytes added to a row, may be broadcast to
        ``copies`` joins of one stage."""
        return all(getattr(self, p).widened(extra).fits(self.max_broadcast_bytes, copies=copies) for p in parts)


@dataclass(frozen=True)
class Catalogue:
    entities: DataFrame
    regions: DataFrame
    textures: DataFrame
    max_broadcast_bytes: int | None = None

    @cached_property
    def profile(self) -> Profile:
        rows = (
            sizing.size_row(self.entities).withColumn("k", F.lit("entities"))
            .unionByName(sizing.size_row(self.regions).withColumn("k", F.lit("regions")))
            .unionByName(
                sizing.size_row(self.textures, *length_stats("texture")).withColumn("k", F.lit("textures")),
                allowMissingColumns=True,
            )
            .collect()  # three rows
        )
        found = {r["k"]: r for r in rows}
        sizes = {k: sizing.Size(r["n"], r["b"], r["w"]) for k, r in found.items()}
        lengths = found["textures"]["shortest"], found["textures"]["lengths"]
        return Profile(**sizes, texture_lengths=lengths, max_broadcast_bytes=self.max_broadcast_bytes)

    @cached_property
    def face_rows(self) -> int:
        """At most this many (texture, region) pairs."""

        def per_entity(df: DataFrame, name: str) -> DataFrame:
            return df.groupBy("entity_id").agg(F.count(F.lit(1)).alias(name))

        pairs = per_entity(self.textures, "t").join(per_entity(self.regions, "r"), "entity_id")
        return pairs.agg(F.sum(F.col("t") * F.col("r"))).first()[0] or 0


def hinted(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def texture_owners(catalogue: Catalogue) -> DataFrame:
    """``(texture, entity_id)``: one owner per texture, the last entity that claims it."""
    claims = catalogue.textures.select("entity_id", "texture").join(
        hinted(catalogue.entities.select("entity_id", "claim"), catalogue.profile.fits("entities")), "entity_id"
    )
    return claims.groupBy("texture").agg(
        F.max_by("entity_id", F.struct("claim", "entity_id")).alias("entity_id")
    )


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First row per ``keys``; null keys compare equal.

    An aggregate with map-side combine, so a group holding a large share of the rows is
    reduced before the shuffle instead of being sorted in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_first"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_first.`{c}`").alias(c) for c in df.columns])


def append_after(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of ``second`` ordered behind those of ``first`` within each entity.

    Ordinals are shifted by the entity's last ordinal, never renumbered, so no entity has to
    be sorted in one task. They stay unique and ordered but may have gaps.
    """
    last = first.groupBy("entity_id").agg((F.max("ord") + 1).cast("bigint").alias("_shift"))
    shifted = second.join(last, "entity_id", "left").withColumn(
        "ord", F.col("ord") + F.coalesce("_shift", F.lit(0))
    )
    columns = first.columns
    return first.withColumn("ord", F.col("ord").cast("bigint")).unionByName(shifted.select(*columns))


def distinct_in_order(first: DataFrame, second: DataFrame) -> DataFrame:
    """Order-preserving distinct merge of two ``(entity_id, ord, texture)`` lists."""
    return keep_first(append_after(first, second), ["entity_id", "texture"], "ord")


@dataclass(frozen=True)
class MergeRule:
    """Two half entities that become one."""

    merged: str
    first: str
    second: str
    first_prefix: str
    second_prefix: str


# The one pair of halves that catalogues of this format ship.
DEFAULT_MERGES = (MergeRule("bed", "bed_head", "bed_foot", "head_", "foot_"),)


def merge_halves(catalogue: Catalogue, rules: DataFrame) -> Catalogue:
    """Replace both halves of each rule by the merged entity; a rule with one half is idle.

    ``rules(merged, first, second, first_prefix, second_prefix)``. Regions are renamed with
    their half's prefix, first half first; textures are the ordered distinct union; the size
    is the first half's. The merged entity claims its textures after all files.
    """
    ids = catalogue.entities.select("entity_id")
    active = rules.join(ids.withColumnRenamed("entity_id", "first"), "first", "left_semi").join(
        ids.withColumnRenamed("entity_id", "second"), "second", "left_semi"
    )
    halves = active.select(
        "merged",
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("half"), F.col("first").alias("entity_id"), F.col("first_prefix").alias("prefix")),
                F.struct(F.lit(1).alias("half"), F.col("second").alias("entity_id"), F.col("second_prefix").alias("prefix")),
            )
        ),
    )
    small = sizing.measure(rules).fits()  # three rows per rule at most
    # An entity that already has the merged name is replaced too.
    replaced = halves.select("entity_id").unionByName(active.select(F.col("merged").alias("entity_id")))
    consumed = hinted(replaced.distinct(), small)
    halves = hinted(halves, small)

    entities = catalogue.entities.join(consumed, "entity_id", "left_anti").unionByName(
        catalogue.entities.join(halves.filter("half = 0"), "entity_id").select(
            F.col("merged").alias("entity_id"),
            "tex_w",
            "tex_h",
            F.struct(
                F.lit(1).alias("stage"), F.col("claim.folded").alias("folded"), F.col("claim.file").alias("file")
            ).alias("claim"),
        )
    )

    def half_of(table: DataFrame, half: int) -> DataFrame:
        joined = table.join(halves.filter(F.col("half") == half), "entity_id")
        if "name" in table.columns:
            joined = joined.withColumn("name", F.concat("prefix", "name"))
        return joined.drop("entity_id").withColumnRenamed("merged", "entity_id").select(*table.columns)

    merged_regions = append_after(half_of(catalogue.regions, 0), half_of(catalogue.regions, 1))
    parts = half_of(catalogue.textures, 0), half_of(catalogue.textures, 1)
    return replace(
        catalogue,
        entities=entities,
        regions=catalogue.regions.join(consumed, "entity_id", "left_anti").unionByName(merged_regions),
        textures=catalogue.textures.join(consumed, "entity_id", "left_anti").unionByName(
            distinct_in_order(*parts)
        ),
    )


def shared_textures(textures: DataFrame) -> DataFrame:
    """``(texture, entity_id, n_entities)`` for textures listed more than once.

    Long form: a texture shared by very many entities is many rows, not one list.
    """
    counts = textures.groupBy("texture").agg(F.count(F.lit(1)).alias("n_entities")).filter("n_entities > 1")
    return textures.select("texture", "entity_id").join(counts, "texture").select(
        "texture", "entity_id", "n_entities"
    )


def entities_without_textures(entities: DataFrame, textures: DataFrame) -> DataFrame:
    return entities.select("entity_id").join(textures.select("entity_id"), "entity_id", "left_anti")


def catalogue_totals(catalogue: Catalogue) -> DataFrame:
    """One row: entities, entities without textures, shared textures."""
    def scalar(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("measure"), "n")

    shared = catalogue.textures.groupBy("texture").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    stacked = (
        scalar(catalogue.entities, "entities")
        .unionByName(scalar(entities_without_textures(catalogue.entities, catalogue.textures), "missing"))
        .unionByName(scalar(shared, "shared"))
    )
    return stacked.agg(
        *[
            F.max(F.when(F.col("measure") == m, F.col("n"))).alias(out)
            for m, out in (
                ("entities", "total_entities"),
                ("missing", "missing_textures"),
                ("shared", "shared_textures"),
            )
        ]
    )
