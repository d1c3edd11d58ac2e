"""The whole run: folders of sources and targets in, composited rasters and a manifest out."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringloom.functions.geometry import frame_count
from ringloom.operators import sizing
from ringloom.operators.assign import assign_frames
from ringloom.operators.catalog import DEFAULT_MERGES, Catalogue, hinted, merge_halves
from ringloom.operators.lineage import shared_folder
from ringloom.operators.overrides import resolve_parameters
from ringloom.operators.ring import Ring, prepare_ring
from ringloom.plans import compose
from ringloom.plans.assign import build_assignments, require_rows
from ringloom.sources import files, store
from ringloom.sources.catalog_json import parse_rules, read_catalogue
from ringloom.sources.params import RunParameters, write_manifest

LARGE_BYTES = 256 << 20  # of an upscaled image; a row may have 2 GB


@dataclass(frozen=True)
class Inputs:
    """What a run composites, with every raster written once to the staging folder."""

    targets: DataFrame  # (route, target, rel, overlay, ..., w, h, data, has_anim, *parameters)
    sources: DataFrame  # (path, w, h, data)
    faces: DataFrame
    ring: Ring


def staging_folder(spark: SparkSession) -> str:
    """A new folder below the shared one the cluster names."""
    return f"{shared_folder(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"


def load_catalogue(spark: SparkSession, folder: str) -> Catalogue | None:
    """Catalogue of a folder with its half entities merged; none if no folder is given."""
    if not folder:
        return None
    merges = spark.createDataFrame(
        [(m.merged, m.first, m.second, m.first_prefix, m.second_prefix) for m in DEFAULT_MERGES],
        "merged string, first string, second string, first_prefix string, second_prefix string",
    )
    return merge_halves(read_catalogue(spark, folder), merges)


def load_rules(spark: SparkSession, path_config: str) -> DataFrame:
    """Override rules from the run's JSON text."""
    return parse_rules(spark.createDataFrame([(path_config or "{}",)], "value string"))


def undecodable(spark: SparkSession, folder: str) -> DataFrame:
    """Listed images that do not decode."""
    decoded = files.read_image_sizes(spark, folder).select("path")
    return files.list_images(spark, folder).join(decoded, "path", "left_anti")


def account_for(
    folder: str, images: DataFrame, staged: DataFrame, rejects: str | None, done: DataFrame | None = None
) -> None:
    """``images`` (path, rel) of ``folder`` that were not ``staged`` (path), nor ``done`` (rel)
    before: a table at ``rejects``, or an error that names some of them."""
    lost = images.join(staged, "path", "left_anti")
    if done is not None:
        lost = lost.join(done, "rel", "left_anti")
    if rejects:
        lost.write.mode("append").parquet(rejects)
        return
    missing = [r["rel"] for r in lost.limit(5).collect()]
    if missing:
        raise ValueError(f"images in {folder} that do not decode, among them: {', '.join(missing)}")


def stage_inputs(
    spark: SparkSession,
    params: RunParameters,
    staging: str,
    rejects: str | None = None,
    done: DataFrame | None = None,
    listings: tuple[DataFrame, DataFrame] | None = None,
    large_bytes: int = LARGE_BYTES,
) -> Inputs | None:
    """Decode and assign every image once.

    An image that does not decode is an error, or a row (path, rel) of the table ``rejects``.
    Targets whose ``rel`` is ``done`` are left out before any work; None if no other is left.

    ``listings`` are those of the sources' and the targets' folder, if they were made before. Files
    whose names Spark's sources pass over are read too, by way of the staging folder where Spark decodes them.

    Targets are decoded to the staging folder and written there again partitioned by the way they will be drawn (one patch, several frames,
    regions), so that each compositing plan reads only its own pixels.
    """
    overlays, textures = listings or [store.list_tree(spark, d) for d in (params.overlay_dir, params.texture_dir)]
    shown = [
        files.reveal(spark, folder, listing, f"{staging}/revealed/{name}")
        for folder, listing, name in ((params.overlay_dir, overlays, "sources"), (params.texture_dir, textures, "targets"))
    ]
    listed = files.images_of(overlays).select(F.col("path").alias("source"), "rel")
    ring = prepare_ring(listed, params.seed)
    sources = files.read_rasters(spark, params.overlay_dir, shown[0], overlays)
    sources.select("path", "w", "h", "data").write.parquet(f"{staging}/sources")

    catalogue = load_catalogue(spark, params.entity_regions)
    rasters = files.read_rasters(spark, params.texture_dir, shown[1], textures).withColumnRenamed("path", "target")
    if done is not None:
        rasters = rasters.join(sizing.broadcast_if_small(done), "rel", "left_anti")
    # Files are opened once: what was decoded is counted and assigned from the staging folder.
    rasters.write.parquet(f"{staging}/decoded")
    rasters = spark.read.parquet(f"{staging}/decoded")
    if rasters.isEmpty():
        if done is not None:
            return None
        raise ValueError("No texture images found")
    built = build_assignments(
        listed, rasters, catalogue, params.seed, params.entity_face_mode, params.entity_texture_mode, ring,
        keep=("w", "h", "data"), checked=True,
    )
    sidecars = files.read_sidecars(spark, params.texture_dir, shown[1], textures).select(
        F.regexp_replace("path", f"\\{files.SIDECAR}$", "").alias("target"), "has_anim"
    )
    resolved = resolve_parameters(built.targets, load_rules(spark, params.path_config), params.blend_defaults())
    marked = resolved.join(sizing.broadcast_if_small(sidecars), "target", "left").withColumn(
        "has_anim", F.coalesce("has_anim", F.lit(False))
    )
    routed = marked.withColumn("frames", frame_count(F.col("w"), F.col("h"), F.col("has_anim"))).withColumn(
        "route",
        F.when(F.col("is_entity"), F.lit("regions")).when(F.col("frames") > 1, F.lit("frames")).otherwise(F.lit("single")),
    )
    pixels = F.col("w").cast("bigint") * F.col("h") * F.col("scale") * F.col("scale")
    routed = routed.withColumn("large", pixels * 4 > large_bytes)
    routed.write.partitionBy("route").parquet(f"{staging}/targets")
    decoded = {t: spark.read.parquet(f"{staging}/{t}") for t in ("sources", "targets")}
    account_for(params.overlay_dir, files.images_of(overlays), decoded["sources"].select("path"), rejects)
    drawn = decoded["targets"].select(F.col("target").alias("path"))
    account_for(params.texture_dir, files.images_of(textures), drawn, rejects, done)
    faces = built.faces
    if catalogue is not None:
        shape = catalogue.regions.withColumnRenamed("ord", "region_ord").drop("name")
        faces = hinted(faces.join(shape, ["entity_id", "region_ord"]), built.faces_fit())
    return Inputs(
        spark.read.parquet(f"{staging}/targets"), spark.read.parquet(f"{staging}/sources"), faces, ring
    )


def _strips(inputs: Inputs, params: RunParameters, strips: DataFrame) -> DataFrame:
    """Patches of targets with several frames."""
    framed = assign_frames(
        strips.select("target", "rel", "w", "h", "frames", *compose.PARAMETERS), inputs.ring, params.seed, params.per_frame
    )
    return compose.regular_patches(framed)


def _entities(inputs: Inputs, entities: DataFrame) -> DataFrame | None:
    """Patches of entity textures; none without a catalogue."""
    if "x" not in inputs.faces.columns:
        return None
    columns = ("target", "texture", "w", "h", "has_anim", "tex_w", "tex_h", *compose.PARAMETERS)
    return compose.entity_patches(entities.select(*columns), inputs.faces)


def _named(drawn: DataFrame, params: RunParameters, *columns: str) -> DataFrame:
    rel = files.relative_to(F.col("target"), files.plain_root(params.texture_dir))
    return drawn.withColumn("rel", rel).select("target", "rel", *columns)


def composite_inputs(inputs: Inputs, params: RunParameters) -> DataFrame:
    """``(target, rel, w, h, data)`` of every staged target that is not large."""

    def route(name: str) -> DataFrame:
        return inputs.targets.filter((F.col("route") == name) & ~F.col("large"))

    keep = params.keep_aspect
    single = compose.composite_single(
        compose.regular_patches(route("single").withColumn("frame", F.lit(0)), keep=("w", "h", "data")), inputs.sources, keep
    )
    strips, entities = route("frames"), route("regions")
    drawn = single.unionByName(compose.composite_patches(strips, _strips(inputs, params, strips), inputs.sources, keep))
    patches = _entities(inputs, entities)
    if patches is not None:
        drawn = drawn.unionByName(compose.composite_patches(entities, patches, inputs.sources, keep))
    return _named(drawn, params, "w", "h", "data")


def composite_large(inputs: Inputs, params: RunParameters, band_bytes: int = compose.BAND_BYTES) -> DataFrame:
    """``(target, rel, w, h, y, data)``: bands of the targets that are large once upscaled."""
    large = inputs.targets.filter("large")

    def route(name: str) -> DataFrame:
        return large.filter(F.col("route") == name)

    patches = compose.regular_patches(route("single").withColumn("frame", F.lit(0)))
    patches = patches.unionByName(_strips(inputs, params, route("frames")))
    of_entities = _entities(inputs, route("regions"))
    if of_entities is not None:
        patches = patches.unionByName(of_entities)
    bands = compose.composite_bands(large, patches, inputs.sources, params.keep_aspect, band_bytes)
    return _named(bands, params, "w", "h", "y", "data")


def publish(
    spark: SparkSession,
    params: RunParameters,
    overwrite: bool = True,
    png: bool = False,
    staging: str | None = None,
    skip_undecodable: bool = False,
    large_bytes: int = LARGE_BYTES,
    band_bytes: int = compose.BAND_BYTES,
) -> None:
    """Composite all targets into ``output_dir``.

    Rasters go to ``output_dir/rasters`` as Parquet, the manifest to ``output_dir/manifest``. Targets of
    more than ``large_bytes`` once upscaled go to ``output_dir/bands`` instead, as bands of rows.
    Without ``overwrite`` targets already drawn there are not worked on again. A staging folder
    that the run made itself is removed at its end.
    With ``png`` the images are also written as PNG files below ``output_dir/tree``, in whatever store
    that is, and other files are copied beside them. Images that do not decode are an error; with
    ``skip_undecodable`` they are listed in ``output_dir/rejects`` and the rest goes on. Inputs are
    never modified.
    """
    if not params.output_dir:
        raise ValueError("output_dir is required: inputs are never overwritten")
    listings = tuple(store.list_tree(spark, folder) for folder in (params.overlay_dir, params.texture_dir))
    require_rows(files.images_of(listings[0]), "overlay images")
    require_rows(files.images_of(listings[1]), "texture images")
    output = params.output_dir.rstrip("/")
    rejects = f"{output}/rejects" if skip_undecodable else None
    folder, done = staging or staging_folder(spark), None
    there = [f for f in ("rasters", "bands") if files.folder_exists(spark, f"{output}/{f}")]
    if overwrite:
        if "bands" in there:
            files.remove_folder(spark, f"{output}/bands")
    elif "rasters" in there:
        done = reduce(DataFrame.unionByName, [spark.read.parquet(f"{output}/{f}").select("rel") for f in there]).distinct()
    inputs = stage_inputs(spark, params, folder, rejects, done, listings, large_bytes)
    if inputs is not None:
        files.write_rasters(composite_inputs(inputs, params), f"{output}/rasters", overwrite)
        if not inputs.targets.filter("large").isEmpty():
            files.write_rasters(composite_large(inputs, params, band_bytes), f"{output}/bands", overwrite)
    if not staging:
        files.remove_folder(spark, folder)
    if png:
        files.write_pngs(spark.read.parquet(f"{output}/rasters"), f"{output}/tree")
        if files.folder_exists(spark, f"{output}/bands"):
            files.write_banded_pngs(spark.read.parquet(f"{output}/bands"), f"{output}/tree")
        files.copy_other_files(spark, params.texture_dir, f"{output}/tree", listings[1])
    write_manifest(spark, params, f"{output}/manifest")
