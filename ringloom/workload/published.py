"""A whole run over image files: rasters become files, files are published, the tree is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringloom.operators.catalog import Catalogue
from ringloom.operators.lineage import shared_folder
from ringloom.operators.rows import map_rows
from ringloom.plans.publish import publish
from ringloom.sources import files, store
from ringloom.sources.catalog_json import read_models, read_written_catalogue, write_catalogue
from ringloom.sources.params import RunParameters
from ringloom.workload import rasters as r
from ringloom.workload.catalogues import ORACLE as CATALOGUES
from ringloom.workload.catalogues import catalogue_rows
from ringloom.workload.tables import SEED, part_catalogue, placed_sql, position_sql, ring_sql, table

SCALE = 2
_SIDECAR_TEXT = '{"animation": {"frametime": 2}}'

# Names of sources and targets of an image; every third target is gray with alpha, every third a
# strip of four frames. Both engines read these expressions.
_SOURCE = "concat(CASE WHEN vec_id % 4 = 1 THEN '_more/' ELSE '' END, 'v', vec_id, '.png')"
_TARGET = (
    "CASE WHEN vec_id % 3 = 0 THEN concat('block/t', vec_id, '.png') WHEN vec_id % 3 = 1 THEN concat('_gray/t', vec_id, '.png') "
    "ELSE concat('strip/_t', vec_id, '.png') END"
)


def _images(drawn: DataFrame) -> DataFrame:
    """(rel, content) of (rel, gray, w, h, data)."""

    def encode(row: dict) -> dict:
        return {"rel": row["rel"], "content": files.png_bytes(row["data"], row["w"], row["h"], bool(row["gray"]))}

    return map_rows(drawn, encode, "rel string, content binary")


def write_inputs(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Every embedding as a source and as a target; a sidecar for each strip and some notes."""
    plain, strips = r._rasters(spark, sf_dir), r._rasters(spark, sf_dir, 4)
    shape = ("w", "h", "data")
    store.write_files(_images(plain.selectExpr(f"{_SOURCE} AS rel", "0 AS gray", *shape)), f"{folder}/sources")
    targets = plain.where("vec_id % 3 <> 2").unionByName(strips.where("vec_id % 3 = 2"))
    images = _images(targets.selectExpr(f"{_TARGET} AS rel", "CAST(vec_id % 3 = 1 AS INT) AS gray", *shape))
    ids = table(spark, sf_dir, "embeddings", "vec_id")
    sidecars = ids.where("vec_id % 3 = 2").select(
        F.expr(f"concat({_TARGET}, '{files.SIDECAR}')").alias("rel"), F.lit(_SIDECAR_TEXT).cast("binary").alias("content")
    )
    notes = ids.where("vec_id % 5 = 0").selectExpr(
        "concat('notes/t', vec_id, '.txt') AS rel", "CAST(concat('note ', vec_id) AS BINARY) AS content"
    )
    store.write_files(images.unionByName(sidecars).unionByName(notes), f"{folder}/targets")


def publish_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images, some of them gray with alpha or with an underscore in their path, strips with sidecars
    and other files are written, published and read back: checksums of the images drawn, digests of
    the files copied. The folder stays below the shared one until it is removed."""
    folder = f"{shared_folder(spark).rstrip('/')}/round-trip-{uuid.uuid4().hex}"
    write_inputs(spark, sf_dir, folder)
    params = RunParameters(
        overlay_dir=f"{folder}/sources", texture_dir=f"{folder}/targets", output_dir=f"{folder}/out",
        seed=SEED, per_frame=True, alpha=r.ALPHA, scale=SCALE, fast_overlay_size=0,
    )
    publish(spark, params, png=True)
    tree = f"{folder}/out/tree"
    listing = store.list_tree(spark, tree)
    shown = files.reveal(spark, tree, listing, f"{folder}/shown")
    drawn = r.checksums(files.read_rasters(spark, tree, shown, listing).withColumnRenamed("rel", "target").select("target", "w", "h", "data"))
    copied = files.read_other_files(spark, tree, shown, listing).select("rel", F.sha2("content", 256).alias("sha"))
    return drawn.withColumnRenamed("target", "rel").join(copied, "rel", "full").select("rel", "w", "h", "r", "g", "b", "a", "sha")


def _part_of(catalogue: Catalogue, kept: str, **sizes: str) -> Catalogue:
    """The entities that ``kept`` names, with other sizes."""
    entities = catalogue.entities.filter(kept).withColumns({c: F.expr(e).cast("int") for c, e in sizes.items()})
    return Catalogue(entities, catalogue.regions.filter(kept), catalogue.textures.filter(kept))


def catalogue_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue written in three goes and read back: entities that are there already are passed
    over, unless they are to be overwritten."""
    folder = f"{shared_folder(spark).rstrip('/')}/catalogue-{uuid.uuid4().hex}"
    whole = part_catalogue(spark, sf_dir)
    write_catalogue(_part_of(whole, "entity_id < 'Brand#3'", tex_w="tex_w + 100"), folder)
    write_catalogue(whole, folder)
    write_catalogue(_part_of(whole, "entity_id >= 'Brand#5'", tex_h="tex_h + 7"), folder, overwrite=True)
    return catalogue_rows(read_written_catalogue(spark, folder))


def model_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block model file for each brand and type, some with elements, some that are no JSON."""
    folder = f"{shared_folder(spark).rstrip('/')}/models-{uuid.uuid4().hex}"
    kinds = table(spark, sf_dir, "part", "p_brand", "p_type", "p_name", "p_size").groupBy("p_brand", "p_type").agg(
        F.min("p_name").alias("texture"), F.min("p_size").alias("least")
    )
    body = F.concat(
        F.lit('{"parent": "'), "p_brand", F.lit('", "textures": {"side": "'), "texture", F.lit('"}'),
        F.when(F.col("least") % 2 == 0, F.lit(', "elements": []')).otherwise(""), F.when(F.col("least") % 5 == 3, "").otherwise("}"),
    )
    name = F.concat(F.regexp_replace("p_brand", "#", "-"), F.lit("+"), F.regexp_replace("p_type", " ", "_"))
    store.write_files(kinds.select(F.concat(name, F.lit(".json")).alias("rel"), body.cast("binary").alias("content")), folder)
    return read_models(spark, folder).select("name", "parent", F.col("textures")["side"].alias("side"), "has_elements")


QUERIES = {"publish_round_trip": publish_round_trip, "catalogue_files": catalogue_files, "model_files": model_files}

# Oracle ------------------------------------------------------------------------------

_RING = ring_sql("vec_id", _SOURCE, "embeddings")
_TARGETS = f"SELECT vec_id AS img, vec_id % 3 AS kind, {_TARGET} AS rel FROM embeddings"
_FRAMES = f"SELECT *, unnest(range(CASE WHEN kind = 2 THEN 4 ELSE 1 END))::INTEGER AS frame FROM ({_TARGETS})"
_KEY = "rel || CASE WHEN frame = 0 THEN '' ELSE ':' || frame END"
_KEYS = f"SELECT img, kind, frame, {position_sql(repr(f'{SEED}:') + f' || {_KEY}')} AS pos FROM ({_FRAMES})"
_PLACED = placed_sql(_KEYS, "k.img, k.kind, k.frame", _RING, "src")
_BASE = (
    f"SELECT * FROM ({r._upscaled_sql('SELECT * FROM p8 WHERE img % 3 = 0', SCALE)}) UNION ALL "
    f"SELECT * FROM ({r._upscaled_sql('SELECT * REPLACE (r AS g, r AS b) FROM p8 WHERE img % 3 = 1', SCALE)}) UNION ALL "
    f"SELECT * FROM ({r._upscaled_sql(f'SELECT * FROM ({r._P4}) WHERE img % 3 = 2', SCALE)})"
)
# An 8x8 source covers a whole target of 16x16, or one frame of 8x8 as it is.
_OVER = (
    "SELECT img, x, y, r, g, b, a FROM ("
    + r._resize_sql(
        "SELECT s.img, p.w, p.h, p.x, p.y, p.r, p.g, p.b, p.a, 16 AS ow, 16 AS oh FROM placed s JOIN p8 p ON p.img = s.src WHERE s.kind <> 2"
    )
    + ") UNION ALL SELECT s.img, p.x, (p.y + s.frame * 8)::INTEGER AS y, p.r, p.g, p.b, p.a FROM placed s JOIN p8 p ON p.img = s.src WHERE s.kind = 2"
)
ORACLE = {
    "publish_round_trip": (
        r._with_taps([(8, 16)], f", p8 AS MATERIALIZED ({r._P8}), placed AS MATERIALIZED ({_PLACED})")
        + "SELECT t.rel, c.* EXCLUDE (target), NULL::VARCHAR AS sha FROM ("
        + r._checksum_sql(r._blend_sql(_BASE, _OVER, r.ALPHA))
        + f") c JOIN ({_TARGETS}) t ON 't' || t.img = c.target "
        + f"UNION ALL SELECT rel || '{files.SIDECAR}', NULL, NULL, NULL, NULL, NULL, NULL, sha256('{_SIDECAR_TEXT}') FROM ({_TARGETS}) WHERE kind = 2 "
        + "UNION ALL SELECT 'notes/t' || vec_id || '.txt', NULL, NULL, NULL, NULL, NULL, NULL, sha256('note ' || vec_id) FROM embeddings WHERE vec_id % 5 = 0"
    ),
    "catalogue_files": (
        "SELECT kind, entity_id, CASE WHEN kind = 'entity' AND entity_id < 'Brand#3' THEN ord + 100 ELSE ord END AS ord, "
        "CASE WHEN kind = 'entity' AND entity_id >= 'Brand#5' THEN (name::INTEGER + 7)::VARCHAR ELSE name END AS name "
        f"FROM ({CATALOGUES['catalogue_json']})"
    ),
    "model_files": (
        "SELECT replace(p_brand, '#', '-') || '+' || replace(p_type, ' ', '_') AS name, p_brand AS parent, min(p_name) AS side, "
        "min(p_size) % 2 = 0 AS has_elements FROM part GROUP BY p_brand, p_type HAVING min(p_size) % 5 <> 3"
    ),
}
