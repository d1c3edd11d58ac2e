"""Region catalogues, override rules and block models as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringloom.operators import sizing
from ringloom.operators.catalog import Catalogue
from ringloom.operators.overrides import RULE_FIELDS
from ringloom.sources.files import decoded_path, folder_exists, plain_root

ENTITY_SCHEMA = (
    "map<string, struct<texture_size: array<int>, textures: array<string>, "
    "regions: array<struct<name: string, x: int, y: int, width: int, height: int, "
    "flip: string, rotate: string>>>>"
)
RULE_SCHEMA = (
    "map<string, struct<scale: int, alpha: double, `overlay-scale`: double, "
    "`keep-aspect`: boolean, `fast-overlay-size`: int>>"
)
MODEL_SCHEMA = (
    "struct<parent: string, textures: map<string, string>, "
    "elements: array<struct<faces: map<string, struct<uv: array<double>>>>>>"
)


def parse_catalogue(documents: DataFrame) -> Catalogue:
    """Catalogue from ``documents(file, value)``, one JSON object of entities per row.

    Malformed JSON is an error. A missing size is 64. An entity listed in several files
    takes its size, regions and textures from the last one by case-folded file name; what the
    others say of it is dropped.
    """
    claim = F.struct(
        F.lit(0).alias("stage"), F.lower("file").alias("folded"), F.col("file").alias("file")
    ).alias("claim")
    parsed = documents.select(
        claim, F.explode(F.from_json("value", ENTITY_SCHEMA, {"mode": "FAILFAST"})).alias("entity_id", "info")
    )
    size = F.col("info.texture_size")

    def side(i: int):
        return F.coalesce(F.get(size, F.lit(i)), F.lit(64))

    entities = (
        parsed.groupBy("entity_id")
        .agg(F.max_by(F.struct(side(0).alias("tex_w"), side(1).alias("tex_h"), "claim"), "claim").alias("e"))
        .select("entity_id", "e.*")
    )
    latest = sizing.broadcast_if_small(entities.select("entity_id", "claim"))
    kept = parsed.join(latest, ["entity_id", "claim"], "left_semi")
    regions = kept.select("entity_id", F.posexplode("info.regions").alias("ord", "region")).select(
        "entity_id",
        F.col("ord").cast("bigint").alias("ord"),
        F.coalesce("region.name", F.lit("")).alias("name"),
        *[F.coalesce(f"region.{c}", F.lit(0)).alias(c) for c in ("x", "y", "width", "height")],
        *[F.nullif(F.col(f"region.{c}"), F.lit("")).alias(c) for c in ("flip", "rotate")],
    )
    textures = kept.select("entity_id", F.posexplode("info.textures").alias("ord", "texture")).select(
        "entity_id", F.col("ord").cast("bigint").alias("ord"), "texture"
    )
    return Catalogue(entities, regions, textures)


def read_catalogue(spark: SparkSession, folder: str) -> Catalogue:
    """Every ``*.json`` directly in ``folder`` and every entity that :func:`write_catalogue` wrote
    there, in parallel, one task reading whole files."""
    text = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True, pathGlobFilter="*.{json,txt}")
    below = F.substring(decoded_path(F.input_file_name()), F.lit(len(plain_root(folder)) + 2), F.lit(1 << 30))
    written = F.regexp_extract("below", r"^entity_id=([^/]+)/[^/]+\.txt$", 1)
    named = F.when(written != "", F.concat(F.url_decode(F.replace(written, F.lit("+"), F.lit("%2B"))), F.lit(".json"))).when(
        F.col("below").rlike(r"^[^/]+\.json$"), F.col("below")
    )
    return parse_catalogue(text.select("value", below.alias("below")).select(named.alias("file"), "value").filter("file IS NOT NULL"))


def entity_documents(catalogue: Catalogue) -> DataFrame:
    """``(entity_id, value)``: one JSON document per entity; empty flip and rotate omitted.

    A document lists its own regions, so its size is the entity's by definition.
    """
    fields = ["name", "x", "y", "width", "height", "flip", "rotate"]
    regions = catalogue.regions.groupBy("entity_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", *fields))).alias("r")
    )
    textures = catalogue.textures.groupBy("entity_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", "texture"))).alias("t")
    )

    def plain(r):
        return F.struct(
            *[F.nullif(r[f], F.lit("")).alias(f) if f in ("flip", "rotate") else r[f].alias(f) for f in fields]
        )

    body = F.struct(
        F.array("tex_w", "tex_h").alias("texture_size"),
        F.coalesce(F.transform("t", lambda t: t["texture"]), F.array().cast("array<string>")).alias("textures"),
        F.coalesce(F.transform("r", plain), F.array()).alias("regions"),
    )
    joined = catalogue.entities.join(regions, "entity_id", "left").join(textures, "entity_id", "left")
    return joined.select("entity_id", F.to_json(F.create_map("entity_id", body)).alias("value"))


def write_catalogue(catalogue: Catalogue, folder: str, overwrite: bool = False) -> DataFrame:
    """Write one folder-partitioned JSON file per entity; returns the entities written.

    Entities already present are skipped unless ``overwrite``.
    """
    documents = entity_documents(catalogue)
    spark = documents.sparkSession
    if not overwrite:
        present = existing_entities(spark, folder)
        documents = documents.join(sizing.broadcast_if_small(present), "entity_id", "left_anti")
    spread = documents.repartition("entity_id")
    # Only the partitions, that is the entities, that are written anew are replaced.
    writer = spread.write.option("partitionOverwriteMode", "dynamic").mode("overwrite" if overwrite else "append")
    writer.partitionBy("entity_id").text(folder)
    return documents.select("entity_id")


def existing_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Entity ids already written below ``folder`` by :func:`write_catalogue`."""
    empty = spark.createDataFrame([], "entity_id string")
    if not folder_exists(spark, folder):
        return empty
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    found = F.url_decode(F.regexp_extract("path", "/entity_id=([^/]+)/", 1))
    return listing.select(found.alias("entity_id")).filter("entity_id != ''").distinct()


def read_written_catalogue(spark: SparkSession, folder: str) -> Catalogue:
    """Read back what :func:`write_catalogue` wrote."""
    text = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True, pathGlobFilter="*.txt")
    name = F.concat(F.url_decode(F.regexp_extract(F.input_file_name(), "/entity_id=([^/]+)/", 1)), F.lit(".json"))
    return parse_catalogue(text.select(name.alias("file"), "value"))


def parse_rules(documents: DataFrame, value: str = "value") -> DataFrame:
    """``documents`` exploded to override rules ``(key, ...)``; unknown settings are ignored.

    Null in a field means the rule does not set it.
    """
    rest = [c for c in documents.columns if c != value]
    rows = documents.select(*rest, F.explode(F.from_json(value, RULE_SCHEMA)).alias("key", "set"))
    return rows.select(
        *rest,
        "key",
        *[F.col(f"set.`{name.replace('_', '-')}`").cast(kind).alias(name) for name, kind in RULE_FIELDS.items()],
    )


def read_models(spark: SparkSession, folder: str) -> DataFrame:
    """``(name, parent, textures, elements, has_elements)``, one row per block model file.

    Unreadable files are left out.
    """
    text = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json")
    stem = F.regexp_replace(F.substring_index(decoded_path(F.input_file_name()), "/", -1), r"\.json$", "")
    parsed = text.select(
        stem.alias("name"),
        F.from_json("value", MODEL_SCHEMA).alias("m"),
        F.get_json_object("value", "$.elements").isNotNull().alias("has_elements"),
        F.get_json_object("value", "$").isNotNull().alias("valid"),
    )
    return parsed.filter("valid").select("name", "m.parent", "m.textures", "m.elements", "has_elements")
