"""Queries over catalogues: rules, audits, derivation, JSON round trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringloom.functions.geometry import fit_box, region_bounds
from ringloom.operators import derive
from ringloom.operators.catalog import (
    Catalogue,
    distinct_in_order,
    keep_first,
    merge_halves,
    texture_owners,
)
from ringloom.operators.overrides import match_rules, resize_targets, resolve_parameters
from ringloom.plans.audit import audit_catalogue
from ringloom.plans.derivation import Edits, derive_regions
from ringloom.sources.catalog_json import entity_documents, parse_catalogue, parse_rules
from ringloom.sources.harvest import harvest_paths
from ringloom.sources.params import manifest_documents, parse_parameters
from ringloom.workload.tables import _claim, part_catalogue, table

DEFAULTS = {"scale": 4, "alpha": 0.75, "overlay_scale": 1.0, "keep_aspect": False, "fast_overlay_size": 512}
# (key, scale, alpha, overlay_scale, keep_aspect, fast_overlay_size)
RULES = (
    ("https:\\\\m.", 2, None, None, None, 128),
    ("https://", None, 0.5, None, None, None),
    ("https://blog.", 8, 0.25, None, True, 0),
    ("http://www.", None, None, 0.5, None, -1),
    ("http://www.ch", 1, 0.9, None, None, 256),
    ("", 99, 0.0, 9.0, True, 99),
    ("ftp://nowhere", 3, None, None, None, None),
)
_RULE_TYPES = ("string", "int", "double", "double", "boolean", "int")

# At any scale some types are redefined by a brand and others are not.
_REDEFINED = "p_size > 44 AND length(p_type) % 4 <> 0"


def _values(spark: SparkSession, rows: tuple, names: str, kinds: tuple) -> DataFrame:
    """A small literal table as part of the plan."""
    listed = ", ".join("(" + ", ".join(_spark_literal(v) for v in row) + ")" for row in rows)
    raw = spark.sql(f"SELECT * FROM VALUES {listed} AS v({names})")
    return raw.select(*[F.col(n).cast(k).alias(n) for n, k in zip(raw.columns, kinds)])


def _spark_literal(v: object) -> str:
    return "'" + v.replace("\\", "\\\\") + "'" if isinstance(v, str) else _literal(v)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages", "page_id", "url").select("page_id", F.col("url").alias("target"), F.col("url").alias("rel"))


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few prefix rules and one exact rule per page with a query string."""
    exact = table(spark, sf_dir, "pages", "page_id", "url").filter(F.contains("url", F.lit("?page=2"))).select(
        F.col("url").alias("key"),
        (F.col("page_id") % 5 + 1).cast("int").alias("scale"),
        F.lit(None).cast("double").alias("alpha"),
        F.lit(2.0).alias("overlay_scale"),
        F.lit(None).cast("boolean").alias("keep_aspect"),
        F.lit(None).cast("int").alias("fast_overlay_size"),
    )
    return _values(spark, RULES, "key, " + ", ".join(DEFAULTS), _RULE_TYPES).unionByName(exact)


def override_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_rules(_pages(spark, sf_dir), _rules(spark, sf_dir)).select("page_id", "rule_key")


def override_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_parameters(_pages(spark, sf_dir), _rules(spark, sf_dir), DEFAULTS).select("page_id", *DEFAULTS)


def preresize_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resize_targets(resolve_parameters(_pages(spark, sf_dir), _rules(spark, sf_dir), DEFAULTS))


def rules_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule documents, one per event, with a known and an unknown setting each."""
    events = table(spark, sf_dir, "events", "event_id", "event_type", "props").select(
        "event_id",
        F.concat(
            F.lit('{"'), F.col("event_type"), F.lit('": {"scale": '), F.get_json_object("props", "$.k"),
            F.lit(', "keep-aspect": true, "other": '), F.col("props"), F.lit("}}"),
        ).alias("value"),
    )
    return parse_rules(events).select("event_id", "key", "scale", "keep_aspect", "alpha")


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texture_owners(part_catalogue(spark, sf_dir))


def shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_catalogue(part_catalogue(spark, sf_dir)).shared


def _nation_catalogue(spark: SparkSession, sf_dir: str) -> Catalogue:
    """Nations with a texture per rich supplier; poor nations have none."""
    nation = table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    textures = (
        table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey", "s_acctbal")
        .filter("s_acctbal > 8000 AND s_nationkey % 5 <> 0")
        .join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("n_name").alias("entity_id"),
            F.col("s_suppkey").alias("ord"),
            F.concat(F.lit("t"), F.floor(F.col("s_acctbal") / 100).cast("string")).alias("texture"),
        )
    )
    entities = nation.select(F.col("n_name").alias("entity_id")).select("entity_id", _claim())
    return Catalogue(entities, textures.limit(0), textures)


def missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_catalogue(_nation_catalogue(spark, sf_dir)).missing


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_catalogue(_nation_catalogue(spark, sf_dir)).totals


MERGES = (
    ("merged_a", "Brand#1", "Brand#2", "head_", "foot_"),
    ("merged_b", "Brand#3", "Brand#none", "head_", "foot_"),
)


def merge_halves_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = _values(spark, MERGES, "merged, first, second, first_prefix, second_prefix", ("string",) * 5)
    merged = merge_halves(part_catalogue(spark, sf_dir), rules)
    kind = lambda k: F.lit(k).alias("kind")
    return (
        merged.regions.select(kind("region"), "entity_id", "ord", "name")
        .unionByName(merged.textures.select(kind("texture"), "entity_id", "ord", F.col("texture").alias("name")))
        .unionByName(
            merged.entities.select(
                kind("entity"), "entity_id", F.col("tex_w").cast("bigint").alias("ord"), F.col("tex_h").cast("string").alias("name")
            )
        )
    )


def ordered_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand textures: those of large parts first, then all, each once."""
    part = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_size")
    listed = part.select(F.col("p_brand").alias("entity_id"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("texture"), "p_size")
    return distinct_in_order(listed.filter("p_size > 45").drop("p_size"), listed.drop("p_size"))


def _cuboids(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    order = Window.partitionBy("p_brand", "p_type").orderBy("p_partkey")
    return table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type", "p_size").filter(where).select(
        F.col("p_brand").alias("entity_id"),
        F.col("p_partkey").alias("ord"),
        F.col("p_type").alias("part"),
        (F.row_number().over(order) - 1).alias("idx"),
        F.col("p_size").alias("u"),
        (F.col("p_size") * 2).alias("v"),
        (F.col("p_size") % 5).alias("sx"),
        (F.col("p_size") % 7).alias("sy"),
        (F.col("p_size") % 3).alias("sz"),
    )


def _faces(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    return derive.faces_of_cuboids(_cuboids(spark, sf_dir, where))


_OUT = ["entity_id", "ord", "name", "x", "y", "width", "height"]


def cuboid_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _faces(spark, sf_dir).select(*_OUT)


def keep_first_rectangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.first_per_rectangle(_faces(spark, sf_dir)).select(*_OUT)


def keep_first_oriented(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.when(F.col("ord") % 3 == 0, F.lit("h")).when(F.col("ord") % 3 == 1, F.lit("v"))
    tagged = _faces(spark, sf_dir).withColumn("flip", tag)
    return derive.first_per_oriented_rectangle(tagged).select(*_OUT, "flip")


def _orientation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = table(spark, sf_dir, "part", "p_brand").distinct().select(F.col("p_brand").alias("entity_id"))
    none = "CAST(NULL AS STRING)"
    return brands.selectExpr(
        "entity_id",
        "inline(array("
        f"struct(0 AS rank, 'PROMO_0_top' AS name, true AS whole, {none} AS except_name, 'hv' AS flip, {none} AS rotate),"
        f"struct(1 AS rank, 'PROMO_' AS name, false AS whole, 'PROMO_1_top' AS except_name, 'v' AS flip, {none} AS rotate),"
        f"struct(2 AS rank, 'SMALL_0_right' AS name, true AS whole, {none} AS except_name, {none} AS flip, 'cw' AS rotate)))",
    )


def _sheet_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part", "p_brand", "p_size").groupBy(F.col("p_brand").alias("entity_id")).agg(
        (F.max("p_size") + 64).alias("tex_w")
    )


def _mirror_rules(entities: DataFrame) -> DataFrame:
    return entities.selectExpr(
        "entity_id",
        "inline(array(struct('LARGE_0_' AS old, 'LEFT_0_' AS new, true AS mirror, CAST(NULL AS STRING) AS unless),"
        "struct('SMALL_1_' AS old, 'SAME_1_' AS new, false AS mirror, 'PROMO_0_top' AS unless)))",
    )


def _copy_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part", "p_brand").distinct().selectExpr(
        "p_brand AS entity_id",
        "'ECONOMY_' AS match",
        "'ECONOMY_' AS old",
        "inline(transform(sequence(0, 2), i -> struct(i AS copy, concat('cube', i, '_') AS new, i * 32 AS dx, i * 9 AS dy)))",
    )


def tag_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.tag_orientation(_faces(spark, sf_dir), _orientation_rules(spark, sf_dir)).select(*_OUT, "flip", "rotate")


def mirror_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = _sheet_widths(spark, sf_dir)
    return derive.mirror_parts(_faces(spark, sf_dir), _mirror_rules(entities), entities).select(*_OUT)


def replicate_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.replicate_parts(_faces(spark, sf_dir), _copy_rules(spark, sf_dir)).select(*_OUT)


def derive_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edits in a row: copies, mirrors, tags, then each rectangle once."""
    entities = _sheet_widths(spark, sf_dir)
    edits = Edits(
        replicate=_copy_rules(spark, sf_dir),
        mirror=_mirror_rules(entities),
        orientation=_orientation_rules(spark, sf_dir),
    )
    return derive_regions(_cuboids(spark, sf_dir), entities, edits).select(*_OUT, "flip", "rotate")


def add_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations without a rich supplier get one literal region each; the others keep theirs."""
    nations = table(spark, sf_dir, "nation", "n_name", "n_nationkey")
    found = _nation_catalogue(spark, sf_dir).textures.select("entity_id", "ord", F.col("texture").alias("name"))
    rows = nations.select(F.col("n_name").alias("entity_id"), F.col("n_nationkey").cast("bigint").alias("ord"), F.lit("segment_0_top").alias("name"))
    return derive.add_rows(found, rows, only_if_empty=True)


def inherit_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each brand inherits from the next brand number what its own large parts do not define."""
    number = F.substring_index("p_brand", "#", -1).cast("int")
    parents = table(spark, sf_dir, "part", "p_brand").distinct().select(
        F.col("p_brand").alias("entity_id"), F.concat(F.lit("Brand#"), (number % 25 + 1).cast("string")).alias("parent_id")
    )
    return derive.inherit_regions(_faces(spark, sf_dir, _REDEFINED), parents, _faces(spark, sf_dir)).select(*_OUT)


def seed_from_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type", "p_size")
    shape = [F.col("p_partkey").alias("ord"), F.concat("p_type", F.lit("_top")).alias("name"), F.col("p_type").alias("part"), F.col("p_size").alias("x")]
    own = part.filter(_REDEFINED).select(F.col("p_brand").alias("entity_id"), *shape)
    base = keep_first(part.select(*shape), ["part"], "ord").withColumn("template", F.lit("standard"))
    brands = part.select(F.col("p_brand").alias("entity_id"), F.lit("standard").alias("template")).distinct()
    return derive.seed_from_base(own, base, brands)


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as block models: every third key up is the parent; large ones declare elements,
    those of size 1 are their own parent."""
    part = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size", "p_retailprice")
    key = F.col("p_partkey").cast("string")
    parent = F.when(F.col("p_size") == 1, key).when(F.col("p_partkey") == 0, F.lit("block/block")).otherwise(
        F.concat(F.lit("minecraft:block/"), F.floor(F.col("p_partkey") / 3).cast("string"))
    )
    quads = F.expr(
        "array("
        "named_struct('faces', map('up', named_struct('uv', array(p_size / 4D, 0D, p_partkey % 17D, 16D - (p_size % 9) / 2D)), "
        "'north', named_struct('uv', array(p_partkey % 5D, 8D, p_partkey % 3D, 3.5D)))), "
        "named_struct('faces', map('down', named_struct('uv', array(0.25D, 1.5D, p_size / 2D, 2.5D)), "
        "'east', named_struct('uv', array(1D, 2D)))))"
    )
    return part.select(
        F.concat(F.lit("block/"), key).alias("name"),
        parent.alias("parent"),
        (F.col("p_size") > 40).alias("has_elements"),
        quads.alias("elements"),
        F.col("p_brand").alias("entity_id"),
        F.col("p_partkey").alias("template_ord"),
    )


def parent_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.elements_owner(_models(spark, sf_dir).select("name", "parent", "has_elements"))


def model_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = _models(spark, sf_dir)
    owned = derive.elements_owner(models.select("name", "parent", "has_elements"))
    templates = models.select("entity_id", "template_ord", F.col("name").alias("template"))
    found = derive.regions_of_models(templates, models.filter("has_elements"), owned)
    return found.select("entity_id", "name", "x", "y", "width", "height", "flip")


def uv_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value")
    tokens = events.select(
        "event_id",
        "user_id",
        F.when(F.col("event_type") == "click", F.floor("value").cast("int")).alias("u"),
        F.when(F.col("event_type").isin("click", "error"), F.floor(F.col("value") * 10).cast("int")).alias("v"),
    )
    return derive.carry_forward(
        tokens, ["user_id"], "event_id", ["u", "v"], {"u": 0, "v": 0}, F.floor(F.col("event_id") / 1000)
    )


def regex_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct link targets per site, in first-seen order."""
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html").withColumn("site", F.regexp_extract("url", "//([^/]+)/", 1))
    found = harvest_paths(pages, "html", 'href="(/[^"]+)"', "site:", ["site"], "page_id")
    return found.select("site", F.col("at._doc").alias("page_id"), F.col("at._pos").alias("position"), "texture")


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names spelled as constants, quoted literals or plain text."""
    part = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type", "p_size")
    exprs = part.select(
        "p_partkey",
        F.when(F.col("p_size") < 20, F.concat(F.lit("Names."), "p_type"))
        .when(F.col("p_size") < 40, F.concat(F.lit('"'), "p_name", F.lit('"')))
        .otherwise(F.concat(F.lit("  "), "p_name"))
        .alias("expr"),
    )
    text = part.select(F.concat(F.lit('String '), "p_type", F.lit(' = "'), F.lower("p_type"), F.lit('"')).alias("line")).distinct()
    constants = text.select(
        F.concat(F.lit("Names."), F.regexp_extract("line", r'String (\w+) = "([^"]+)"', 1)).alias("constant"),
        F.regexp_extract("line", r'String (\w+) = "([^"]+)"', 2).alias("value"),
    )
    return derive.resolve_part_names(exprs, constants).select("p_partkey", "part")


def _part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file listing: one image per part in its brand's folder or flat, sidecars for some."""
    part = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_size")
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    folder = F.when(F.col("p_size") < 30, F.concat("p_brand", F.lit("/"))).otherwise(F.lit(""))
    image = F.concat(F.lit("root/"), folder, F.when(folder == "", F.concat("p_brand", F.lit("-"))).otherwise(F.lit("")), name, F.lit("."), F.lit("png"))
    sidecar = F.when(F.col("p_size") % 2 == 0, F.concat(image, F.lit(".mcmeta")))
    return part.select(F.explode(F.array_compact(F.array(image, sidecar))).alias("path")).distinct()


def animated_textures(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    models = part.select(
        F.col("p_partkey").cast("string").alias("name"),
        F.concat(F.lit("minecraft:block/"), F.lower("p_type")).alias("parent"),
        F.create_map(
            F.lit("all"), F.concat(F.lit("minecraft:block/"), F.col("p_brand"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_"))),
            F.lit("side"), F.concat(F.lit("block/"), F.col("p_brand"), F.lit("-"), F.replace("p_name", F.lit(" "), F.lit("_"))),
        ).alias("textures"),
    )
    templates = table(spark, sf_dir, "part", "p_type").distinct().filter(F.length("p_type") == 5).select(F.concat(F.lit("block/"), F.lower("p_type")).alias("template"))
    return derive.animated_model_textures(models, templates, _part_files(spark, sf_dir), "root")


def choose_textures(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = table(spark, sf_dir, "part", "p_brand").distinct()
    number = F.substring_index("p_brand", "#", -1).cast("int")
    entities = brands.select(
        F.col("p_brand").alias("entity_id"),
        F.when(number > 20, F.lit("absent")).otherwise(F.col("p_brand")).alias("folder"),
        F.lit(None).cast("string").alias("fallback_folder"),
    )
    excluded = brands.select(F.col("p_brand").alias("entity_id"), F.lit("red_").alias("prefix"))
    included = brands.filter(number < 10).select(
        F.col("p_brand").alias("entity_id"), F.lit("suffix").alias("kind"), F.lit("bolt.png").alias("text"), F.lit(False).alias("wanted")
    )
    return derive.choose_textures(_part_files(spark, sf_dir), entities, excluded, included, "root")


def model_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size", "p_type")
    spelled = F.concat(F.lit("Data.of(root, "), F.col("p_size").cast("string"), F.lit(", "), (F.col("p_size") * 2).cast("string"), F.lit(")"))
    models = part.select(
        F.col("p_partkey").cast("string").alias("name"),
        F.when(F.col("p_size") > 30, spelled).otherwise(F.col("p_type")).alias("text"),
        F.when(F.col("p_size") > 20, spelled).alias("parent_text"),
    )
    known = part.filter("p_size = 50").select(F.col("p_partkey").cast("string").alias("name"), F.lit(128).alias("tex_w"), F.lit(32).alias("tex_h"))
    return derive.model_sizes(models, known, r"Data\.of\([^,\n]+,\s*(\d+),\s*(\d+)\)")


def build_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part", "p_name", "p_size")
    ids = part.select(F.col("p_name").alias("entity_id"), "p_size")
    return derive.build_outcomes(ids.select("entity_id").distinct(), ids.filter("p_size = 50"), ids.filter("p_size >= 48"))


def catalogue_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue written as JSON documents and parsed back."""
    source = part_catalogue(spark, sf_dir)
    documents = entity_documents(source).select(F.concat("entity_id", F.lit(".json")).alias("file"), "value")
    return catalogue_rows(parse_catalogue(documents))


def catalogue_rows(back: Catalogue) -> DataFrame:
    """Regions, textures and sizes of a catalogue as rows of one shape."""
    return (
        back.regions.select(F.lit("region").alias("kind"), "entity_id", "ord", "name")
        .unionByName(back.textures.select(F.lit("texture").alias("kind"), "entity_id", "ord", F.col("texture").alias("name")))
        .unionByName(back.entities.select(F.lit("entity").alias("kind"), "entity_id", F.col("tex_w").cast("bigint").alias("ord"), F.col("tex_h").cast("string").alias("name")))
    )


def _stored_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored run per customer, old and new key names, most keys left out."""
    return table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment").select(
        "c_custkey",
        F.expr(
            "CASE WHEN c_nationkey < 8 THEN concat('{\"input_dir\": \"', c_name, '\", \"seed\": ', c_custkey, '}') "
            "WHEN c_nationkey < 16 THEN concat('{\"overlay_dir\": \"new\", \"input_dir\": \"', c_name, '\", \"source_dir\": \"out\", \"scale\": ', c_nationkey, '}') "
            "ELSE concat('{\"per_frame\": true, \"alpha\": 0.5, \"path_config\": {\"', c_mktsegment, '\":{\"scale\":2}}}') END AS value"
        ),
    )


_PARAMS = ["overlay_dir", "output_dir", "seed", "per_frame", "alpha", "scale", "fast_overlay_size", "path_config"]


def run_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_parameters(_stored_runs(spark, sf_dir)).select("c_custkey", *_PARAMS)


def manifest_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = manifest_documents(parse_parameters(_stored_runs(spark, sf_dir)))
    return parse_parameters(stored.select("c_custkey", "value")).select("c_custkey", *_PARAMS)


def fit_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice")
    box = fit_box(
        F.col("p_size"),
        (F.col("p_partkey") % 37 + 1).cast("int"),
        F.floor(F.col("p_retailprice") / 10).cast("int"),
        F.lit(64),
        F.col("p_size") > 25,
        F.when(F.col("p_size") % 3 == 0, F.lit(0.5)).when(F.col("p_size") % 3 == 1, F.lit(1.0)).otherwise(F.lit(2.0)),
    )
    return part.select("p_partkey", box.alias("b")).select("p_partkey", "b.*")


def region_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part", "p_partkey", "p_size")
    framed = part.select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("frame"))
    s = F.col("p_size")
    box = region_bounds(
        s - 10, s % 7, s % 11, s % 5 + 1, F.lit(48), F.lit(48), F.lit(144), F.lit(64), F.lit(32), s % 4 + 1, F.col("frame")
    )
    return framed.select("p_partkey", "frame", box.alias("b")).filter("b is not null").select("p_partkey", "frame", "b.*")


QUERIES = {
    "override_match": override_match,
    "override_resolve": override_resolve,
    "preresize_sizes": preresize_sizes,
    "rules_json": rules_json,
    "texture_owners": owners,
    "shared_textures": shared,
    "missing_textures": missing,
    "catalogue_totals": totals,
    "merge_halves": merge_halves_query,
    "ordered_merge": ordered_merge,
    "cuboid_faces": cuboid_faces,
    "keep_first_rectangle": keep_first_rectangle,
    "keep_first_oriented": keep_first_oriented,
    "tag_orientation": tag_orientation,
    "mirror_parts": mirror_parts,
    "replicate_parts": replicate_parts,
    "derive_catalogue": derive_catalogue,
    "add_rows": add_rows,
    "inherit_parts": inherit_parts,
    "seed_from_base": seed_from_base,
    "parent_chain": parent_chain,
    "model_regions": model_regions,
    "uv_carry_forward": uv_carry_forward,
    "regex_harvest": regex_harvest,
    "part_names": part_names,
    "animated_textures": animated_textures,
    "choose_textures": choose_textures,
    "model_sizes": model_sizes,
    "build_outcomes": build_outcomes,
    "catalogue_json": catalogue_json,
    "run_parameters": run_parameters,
    "manifest_roundtrip": manifest_roundtrip,
    "fit_boxes": fit_boxes,
    "region_rectangles": region_rectangles,
}

# Oracle ------------------------------------------------------------------------------


def _literal(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return f"'{v}'" if isinstance(v, str) else str(v)


_RULES_SQL = (
    "SELECT replace(key, '\\', '/') AS norm, * FROM (SELECT key, scale::INTEGER AS scale, alpha::DOUBLE AS alpha, "
    "overlay_scale::DOUBLE AS overlay_scale, keep_aspect::BOOLEAN AS keep_aspect, fast_overlay_size::INTEGER AS fast_overlay_size FROM (VALUES "
    + ", ".join("(" + ", ".join(_literal(v) for v in r) + ")" for r in RULES)
    + ") v(key, scale, alpha, overlay_scale, keep_aspect, fast_overlay_size) UNION ALL "
    "SELECT url, (page_id % 5 + 1)::INTEGER, NULL, 2.0, NULL, NULL FROM pages WHERE contains(url, '?page=2'))"
)
_MATCHED = (
    "SELECT * FROM (SELECT p.page_id, p.url, r.*, row_number() OVER (PARTITION BY p.page_id "
    "ORDER BY (p.url = r.norm) DESC NULLS LAST, length(r.norm) DESC NULLS LAST) AS rn FROM pages p "
    f"LEFT JOIN ({_RULES_SQL}) r ON p.url = r.norm OR (starts_with(p.url, r.norm) AND length(r.norm) > 0)) WHERE rn = 1"
)
_RESOLVED = (
    "SELECT page_id, coalesce(scale, 4) AS scale, coalesce(alpha, 0.75::DOUBLE) AS alpha, "
    "coalesce(overlay_scale, 1.0::DOUBLE) AS overlay_scale, coalesce(keep_aspect, false) AS keep_aspect, "
    f"coalesce(fast_overlay_size, 512) AS fast_overlay_size FROM ({_MATCHED})"
)
_NATION_TEXTURES = (
    "SELECT n_name AS entity_id, s_suppkey AS ord, 't' || floor(s_acctbal / 100)::BIGINT AS texture "
    "FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 8000 AND s_nationkey % 5 <> 0"
)
_PART_REGIONS = "SELECT p_brand AS entity_id, min(p_partkey) AS ord, p_type AS name FROM part GROUP BY p_brand, p_type"
_PART_TEXTURES = "SELECT p_brand AS entity_id, min(p_partkey) AS ord, p_name AS name FROM part GROUP BY p_brand, p_name"
_PART_ENTITIES = "SELECT p_brand AS entity_id, max(p_size)::BIGINT AS ord, min(p_size)::VARCHAR AS name FROM part GROUP BY p_brand"


def _first_sql(rows: str, keys: str, columns: str = "*") -> str:
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ord) AS rn FROM ({rows})) WHERE rn = 1"


def _after_sql(first: str, second: str, columns: str) -> str:
    """``second`` behind ``first`` within each entity."""
    rest = ", ".join(f"s.{c}" for c in columns.split(", "))
    return (
        f"SELECT entity_id, ord::BIGINT AS ord, {columns} FROM ({first}) UNION ALL SELECT s.entity_id, "
        f"(s.ord + coalesce(m.top + 1, 0))::BIGINT, {rest} FROM ({second}) s LEFT JOIN "
        f"(SELECT entity_id, max(ord) AS top FROM ({first}) GROUP BY entity_id) m ON m.entity_id = s.entity_id"
    )


def _cuboids_sql(where: str = "true") -> str:
    return (
        "SELECT p_brand AS entity_id, p_partkey AS ord, p_type AS part, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) - 1 AS idx, "
        f"p_size AS u, p_size * 2 AS v, p_size % 5 AS sx, p_size % 7 AS sy, p_size % 3 AS sz FROM part WHERE {where}"
    )


def _faces_sql(where: str = "true") -> str:
    faces = (
        ("top", "u + sz", "v", "sx", "sz"),
        ("bottom", "u + sz + sx", "v", "sx", "sz"),
        ("right", "u", "v + sz", "sz", "sy"),
        ("front", "u + sz", "v + sz", "sx", "sy"),
        ("left", "u + sz + sx", "v + sz", "sz", "sy"),
        ("back", "u + sz + sx + sz", "v + sz", "sx", "sy"),
    )
    parts = " UNION ALL ".join(
        f"SELECT *, {i} AS f, '{n}' AS face, ({x})::INTEGER AS x, ({y})::INTEGER AS y, ({w})::INTEGER AS width, ({h})::INTEGER AS height FROM c"
        for i, (n, x, y, w, h) in enumerate(faces)
    )
    return (
        f"SELECT entity_id, first_ord * 4294967296 + ord * 6 + f AS ord, CASE WHEN n = 1 THEN part || '_' || face ELSE part || '_' || idx || '_' || face END AS name, "
        f"x, y, width, height FROM (WITH c AS (SELECT *, count(*) OVER (PARTITION BY entity_id, part) AS n, min(ord) OVER (PARTITION BY entity_id, part) AS first_ord "
        f"FROM ({_cuboids_sql(where)})) {parts}) WHERE width > 0 AND height > 0"
    )


_NAMED = "name, x, y, width, height"
_BASE = "regexp_replace(name, '(_[0-9]+)?_[^_]*$', '')"
_OWN = _faces_sql(_REDEFINED)
_PARENTS = "SELECT DISTINCT p_brand AS entity_id, 'Brand#' || (split_part(p_brand, '#', 2)::INTEGER % 25 + 1) AS parent_id FROM part"
_INHERITED = (
    f"SELECT k.entity_id, r.ord, r.name, r.x, r.y, r.width, r.height FROM ({_faces_sql()}) r JOIN ({_PARENTS}) k ON k.parent_id = r.entity_id "
    f"WHERE NOT EXISTS (SELECT 1 FROM (SELECT entity_id, {_BASE} AS base FROM ({_OWN})) o WHERE o.entity_id = k.entity_id "
    "AND o.base = regexp_replace(r.name, '(_[0-9]+)?_[^_]*$', ''))"
)
_SHAPE = "p_partkey AS ord, p_type || '_top' AS name, p_type AS part, p_size AS x"
_BASED = (
    f"SELECT b.entity_id, s.ord, s.name, s.part, s.x FROM (SELECT DISTINCT p_brand AS entity_id FROM part) b, "
    f"({_first_sql(f'SELECT {_SHAPE} FROM part', 'part')}) s WHERE NOT EXISTS (SELECT 1 FROM part o WHERE o.p_brand = b.entity_id AND o.p_type = s.part AND o.p_size > 44 AND length(o.p_type) % 4 <> 0)"
)
_MIRROR_WIDTH = "SELECT p_brand AS entity_id, max(p_size) + 64 AS tex_w FROM part GROUP BY 1"
_MIRRORED = (
    f"SELECT f.entity_id, f.ord, k.new || substr(f.name, length(k.old) + 1) AS name, (CASE WHEN k.mirror THEN w.tex_w - f.x - f.width ELSE f.x END)::INTEGER AS x, "
    f"f.y, f.width, f.height FROM faces f JOIN (VALUES ('LARGE_0_', 'LEFT_0_', true, NULL), ('SMALL_1_', 'SAME_1_', false, 'PROMO_0_top')) k(old, new, mirror, unless) "
    f"ON starts_with(f.name, k.old) JOIN ({_MIRROR_WIDTH}) w ON w.entity_id = f.entity_id "
    "WHERE EXISTS (SELECT 1 FROM faces t WHERE t.entity_id = f.entity_id AND t.name = k.old || 'top') "
    "AND NOT EXISTS (SELECT 1 FROM faces t WHERE t.entity_id = f.entity_id AND t.name = k.unless)"
)
_COPIES = (
    "SELECT entity_id, c.copy * span + ord AS ord, replace(name, 'ECONOMY_', 'cube' || c.copy || '_') AS name, (x + c.copy * 32)::INTEGER AS x, "
    "(y + c.copy * 9)::INTEGER AS y, width, height FROM (SELECT *, max(ord) OVER (PARTITION BY entity_id) + 1 AS span FROM faces), range(3) c(copy) WHERE starts_with(name, 'ECONOMY_')"
)


def _tagged_sql(regions: str) -> str:
    return (
        f"SELECT entity_id, ord, {_NAMED}, CASE WHEN name = 'PROMO_0_top' THEN 'hv' WHEN starts_with(name, 'PROMO_') AND name <> 'PROMO_1_top' THEN 'v' END AS flip, "
        f"CASE WHEN name = 'SMALL_0_right' THEN 'cw' END AS rotate FROM ({regions})"
    )


_CHAIN = (
    "WITH RECURSIVE nodes AS (SELECT p_partkey::VARCHAR AS name, CASE WHEN p_size = 1 THEN p_partkey::VARCHAR WHEN p_partkey = 0 THEN NULL "
    "ELSE (p_partkey // 3)::VARCHAR END AS parent, p_size > 40 AS has FROM part), "
    "walk(name, cur) AS (SELECT name, name FROM nodes UNION SELECT w.name, n.parent FROM walk w JOIN nodes n ON n.name = w.cur WHERE NOT n.has AND n.parent IS NOT NULL), "
    "owned AS (SELECT n.name, o.owner FROM nodes n LEFT JOIN (SELECT w.name, w.cur AS owner FROM walk w JOIN nodes n ON n.name = w.cur WHERE n.has) o USING (name)) "
)
_QUADS = (
    "SELECT *, p_size / 4.0::DOUBLE AS x1, 0::DOUBLE AS y1, (p_partkey % 17)::DOUBLE AS x2, 16 - (p_size % 9) / 2.0::DOUBLE AS y2, 0 AS e, 'up' AS face FROM m UNION ALL "
    "SELECT *, (p_partkey % 5)::DOUBLE, 8, (p_partkey % 3)::DOUBLE, 3.5, 0, 'north' FROM m UNION ALL "
    "SELECT *, 0.25, 1.5, p_size / 2.0::DOUBLE, 2.5, 1, 'down' FROM m"
)
_FILES = (
    "SELECT DISTINCT unnest(CASE WHEN p_size % 2 = 0 THEN [f, f || '.mcmeta'] ELSE [f] END) AS path FROM (SELECT p_size, 'root/' || p_brand || "
    "CASE WHEN p_size < 30 THEN '/' ELSE '-' END || replace(p_name, ' ', '_') || '.png' AS f FROM part)"
)
_PARAM_SQL = (
    "SELECT c_custkey, CASE WHEN c_nationkey < 8 THEN c_name WHEN c_nationkey < 16 THEN 'new' ELSE 'dataset/' END AS overlay_dir, "
    "CASE WHEN c_nationkey >= 8 AND c_nationkey < 16 THEN 'out' ELSE '' END AS output_dir, CASE WHEN c_nationkey < 8 THEN c_custkey ELSE 0 END::BIGINT AS seed, "
    "c_nationkey >= 16 AS per_frame, CASE WHEN c_nationkey >= 16 THEN 0.5 ELSE 0.75 END::DOUBLE AS alpha, "
    "CASE WHEN c_nationkey >= 8 AND c_nationkey < 16 THEN c_nationkey ELSE 4 END::INTEGER AS scale, 0::INTEGER AS fast_overlay_size, "
    "CASE WHEN c_nationkey >= 16 THEN '{\"' || c_mktsegment || '\":{\"scale\":2}}' ELSE '' END AS path_config FROM customer"
)
_ROUND = "(CASE WHEN {0} < 0 THEN ceil({0} - 0.5) ELSE floor({0} + 0.5) END)::INTEGER"

ORACLE = {
    "override_match": f"SELECT page_id, key AS rule_key FROM ({_MATCHED})",
    "override_resolve": _RESOLVED,
    "preresize_sizes": (
        f"SELECT CASE WHEN fast_overlay_size > 0 THEN fast_overlay_size ELSE 0 END::INTEGER AS fast_overlay_size, count(*) AS targets FROM ({_RESOLVED}) GROUP BY 1"
    ),
    "rules_json": (
        "SELECT event_id, event_type AS key, json_extract(props, '$.k')::INTEGER AS scale, true AS keep_aspect, NULL::DOUBLE AS alpha FROM events"
    ),
    "texture_owners": "SELECT p_name AS texture, max(p_brand) AS entity_id FROM part GROUP BY p_name",
    "shared_textures": (
        f"SELECT name AS texture, entity_id, n AS n_entities FROM (SELECT *, count(*) OVER (PARTITION BY name) AS n FROM ({_PART_TEXTURES})) WHERE n > 1"
    ),
    "missing_textures": f"SELECT n_name AS entity_id FROM nation WHERE n_name NOT IN (SELECT entity_id FROM ({_NATION_TEXTURES}))",
    "catalogue_totals": (
        f"SELECT (SELECT count(*) FROM nation) AS total_entities, (SELECT count(*) FROM nation WHERE n_name NOT IN (SELECT entity_id FROM ({_NATION_TEXTURES}))) AS missing_textures, "
        f"(SELECT count(*) FROM (SELECT texture FROM ({_NATION_TEXTURES}) GROUP BY texture HAVING count(*) > 1)) AS shared_textures"
    ),
    "merge_halves": (
        f"WITH r AS ({_PART_REGIONS}), t AS ({_PART_TEXTURES}), e AS ({_PART_ENTITIES}) "
        "SELECT 'region' AS kind, * FROM r WHERE entity_id NOT IN ('Brand#1', 'Brand#2') UNION ALL "
        "SELECT 'region', 'merged_a', ord, 'head_' || name FROM r WHERE entity_id = 'Brand#1' UNION ALL "
        "SELECT 'region', 'merged_a', ord + (SELECT max(ord) + 1 FROM r WHERE entity_id = 'Brand#1'), 'foot_' || name FROM r WHERE entity_id = 'Brand#2' UNION ALL "
        "SELECT 'texture', * FROM t WHERE entity_id NOT IN ('Brand#1', 'Brand#2') UNION ALL "
        "SELECT 'texture', 'merged_a', ord, name FROM t WHERE entity_id = 'Brand#1' UNION ALL "
        "SELECT 'texture', 'merged_a', ord + (SELECT max(ord) + 1 FROM t WHERE entity_id = 'Brand#1'), name FROM t "
        "WHERE entity_id = 'Brand#2' AND name NOT IN (SELECT name FROM t WHERE entity_id = 'Brand#1') UNION ALL "
        "SELECT 'entity', * FROM e WHERE entity_id NOT IN ('Brand#1', 'Brand#2') UNION ALL "
        "SELECT 'entity', 'merged_a', ord, name FROM e WHERE entity_id = 'Brand#1'"
    ),
    "ordered_merge": _first_sql(
        _after_sql(
            "SELECT p_brand AS entity_id, p_partkey AS ord, p_name AS texture FROM part WHERE p_size > 45",
            "SELECT p_brand AS entity_id, p_partkey AS ord, p_name AS texture FROM part",
            "texture",
        ),
        "entity_id, texture",
        "entity_id, ord, texture",
    ),
    "cuboid_faces": _faces_sql(),
    "keep_first_rectangle": _first_sql(_faces_sql(), "entity_id, x, y, width, height", f"entity_id, ord, {_NAMED}"),
    "keep_first_oriented": _first_sql(
        f"SELECT *, CASE ord % 3 WHEN 0 THEN 'h' WHEN 1 THEN 'v' END AS flip FROM ({_faces_sql()})",
        "entity_id, x, y, width, height, flip",
        f"entity_id, ord, {_NAMED}, flip",
    ),
    "tag_orientation": _tagged_sql(_faces_sql()),
    "derive_catalogue": (
        f"WITH faces0 AS MATERIALIZED ({_faces_sql()}), faces AS MATERIALIZED ("
        + _after_sql("SELECT * FROM faces0 WHERE NOT starts_with(name, 'ECONOMY_')", _COPIES.replace("FROM faces", "FROM faces0"), _NAMED)
        + f"), mirrored AS MATERIALIZED ({_after_sql('SELECT * FROM faces', _MIRRORED, _NAMED)}) "
        + _first_sql(_tagged_sql("SELECT * FROM mirrored"), "entity_id, x, y, width, height", f"entity_id, ord, {_NAMED}, flip, rotate")
    ),
    "mirror_parts": f"WITH faces AS ({_faces_sql()}) {_after_sql('SELECT * FROM faces', _MIRRORED, _NAMED)}",
    "replicate_parts": (
        f"WITH faces AS ({_faces_sql()}) " + _after_sql("SELECT * FROM faces WHERE NOT starts_with(name, 'ECONOMY_')", _COPIES, _NAMED)
    ),
    "add_rows": (
        f"SELECT entity_id, ord, texture AS name FROM ({_NATION_TEXTURES}) UNION ALL SELECT n_name, n_nationkey::BIGINT, 'segment_0_top' FROM nation "
        f"WHERE n_name NOT IN (SELECT entity_id FROM ({_NATION_TEXTURES}))"
    ),
    "inherit_parts": _after_sql(_INHERITED, _OWN, _NAMED),
    "seed_from_base": _after_sql(
        _BASED, f"SELECT p_brand AS entity_id, {_SHAPE} FROM part WHERE {_REDEFINED}", "name, part, x"
    ),
    "parent_chain": f"{_CHAIN} SELECT name, owner FROM owned",
    "model_regions": (
        f"{_CHAIN}, m AS (SELECT t.p_brand AS entity_id, t.p_partkey AS t, b.p_partkey, b.p_size FROM owned o JOIN part t ON t.p_partkey = o.name::BIGINT "
        "JOIN part b ON b.p_partkey = o.owner::BIGINT), "
        f"q AS ({_QUADS}), r AS (SELECT entity_id, t, e, face, round_even(least(x1, x2), 0)::INTEGER AS x, round_even(least(y1, y2), 0)::INTEGER AS y, "
        "round_even(abs(x2 - x1), 0)::INTEGER AS width, round_even(abs(y2 - y1), 0)::INTEGER AS height, "
        "CASE WHEN x1 > x2 AND y1 > y2 THEN 'hv' WHEN x1 > x2 THEN 'h' WHEN y1 > y2 THEN 'v' END AS flip FROM q WHERE abs(x2 - x1) >= 0.5 AND abs(y2 - y1) >= 0.5) "
        "SELECT entity_id, 't' || t || '_elem' || e || '_' || face AS name, x, y, width, height, flip FROM (SELECT *, row_number() OVER "
        "(PARTITION BY entity_id, x, y, width, height, flip ORDER BY t, e, face) AS rn FROM r) WHERE rn = 1"
    ),
    "uv_carry_forward": (
        "SELECT event_id, user_id, coalesce(last_value(u IGNORE NULLS) OVER w, 0)::INTEGER AS u, coalesce(last_value(v IGNORE NULLS) OVER w, 0)::INTEGER AS v FROM ("
        "SELECT event_id, user_id, CASE WHEN event_type = 'click' THEN floor(value)::INTEGER END AS u, "
        "CASE WHEN event_type IN ('click', 'error') THEN floor(value * 10)::INTEGER END AS v FROM events) "
        "WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    ),
    "regex_harvest": (
        "SELECT site, page_id, position, 'site:' || hit AS texture FROM (SELECT *, row_number() OVER (PARTITION BY site, hit ORDER BY page_id, position) AS rn FROM ("
        "SELECT regexp_extract(url, '//([^/]+)/', 1) AS site, page_id, unnest(hits) AS hit, unnest(range(len(hits)))::INTEGER AS position FROM "
        "(SELECT page_id, url, regexp_extract_all(html, 'href=\"(/[^\"]+)\"', 1) AS hits FROM pages))) WHERE rn = 1"
    ),
    "part_names": (
        "SELECT p_partkey, CASE WHEN p_size < 20 THEN lower(p_type) ELSE p_name END AS part FROM part"
    ),
    "animated_textures": (
        f"WITH files AS ({_FILES}) SELECT DISTINCT texture FROM (SELECT 'root/' || p_brand || s || replace(p_name, ' ', '_') || '.png' AS texture FROM part, (VALUES ('/'), ('-')) v(s) "
        "WHERE length(p_type) = 5) WHERE texture IN (SELECT path FROM files) AND texture || '.mcmeta' IN (SELECT path FROM files)"
    ),
    "choose_textures": (
        f"WITH files AS ({_FILES}), img AS (SELECT path, split_part(path, '/', -1) AS name, substr(path, 6) AS rel FROM files WHERE ends_with(path, '.png')), "
        "brands AS (SELECT DISTINCT p_brand AS b, split_part(p_brand, '#', 2)::INTEGER AS n FROM part), "
        "tiers AS (SELECT b, 0 AS tier, path FROM brands JOIN img ON n <= 20 AND starts_with(rel, b || '/') WHERE NOT starts_with(name, 'red_') AND NOT (n < 10 AND ends_with(name, 'bolt.png')) "
        "UNION ALL SELECT b, 1, path FROM brands JOIN img ON NOT contains(rel, '/') AND starts_with(name, b) WHERE NOT starts_with(name, 'red_')) "
        "SELECT b AS entity_id, path AS texture FROM tiers t WHERE tier = (SELECT min(tier) FROM tiers x WHERE x.b = t.b)"
    ),
    "model_sizes": (
        "SELECT p_partkey::VARCHAR AS name, CASE WHEN p_size = 50 THEN 128 WHEN p_size > 20 THEN p_size ELSE 64 END::INTEGER AS tex_w, "
        "CASE WHEN p_size = 50 THEN 32 WHEN p_size > 20 THEN p_size * 2 ELSE 64 END::INTEGER AS tex_h FROM part"
    ),
    "build_outcomes": (
        "SELECT status, count(*) AS entities FROM (SELECT CASE WHEN bool_or(p_size = 50) THEN 'skipped' WHEN bool_or(p_size >= 48) THEN 'written' ELSE 'warned' END AS status "
        "FROM part GROUP BY p_name) GROUP BY status"
    ),
    "catalogue_json": (
        f"SELECT 'region' AS kind, entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY ord) - 1 AS ord, name FROM ({_PART_REGIONS}) UNION ALL "
        f"SELECT 'texture', entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY ord) - 1, name FROM ({_PART_TEXTURES}) UNION ALL SELECT 'entity', * FROM ({_PART_ENTITIES})"
    ),
    "run_parameters": _PARAM_SQL,
    "manifest_roundtrip": _PARAM_SQL,
    "fit_boxes": (
        "SELECT p_partkey, fw AS fit_w, fh AS fit_h, trunc((tw - fw) / 2.0)::INTEGER AS off_x, trunc((64 - fh) / 2.0)::INTEGER AS off_y FROM ("
        "SELECT *, CASE WHEN fit THEN greatest(1, trunc(ow * s)::INTEGER) ELSE tw END AS fw, CASE WHEN fit THEN greatest(1, trunc(oh * s)::INTEGER) ELSE 64 END AS fh FROM ("
        "SELECT *, least(trunc(tw * k)::INTEGER::DOUBLE / ow, trunc(64 * k)::INTEGER::DOUBLE / oh) AS s, p_size > 25 OR k < 1 AS fit FROM ("
        "SELECT p_partkey, p_size, p_size AS ow, (p_partkey % 37 + 1)::INTEGER AS oh, floor(p_retailprice / 10)::INTEGER AS tw, "
        "CASE p_size % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS k FROM part)))"
    ),
    "region_rectangles": (
        "SELECT p_partkey, frame, xs, ys, xe, ye FROM (SELECT *, least(greatest(xs + ws, 0), 48 * s)::INTEGER AS xe, least(greatest(ys + hs, 0), 144 * s)::INTEGER AS ye FROM ("
        "SELECT *, least(greatest(xr, 0), 48 * s)::INTEGER AS xs, least(greatest(yr + frame * 48 * s, 0), 144 * s)::INTEGER AS ys FROM ("
        f"SELECT p_partkey, frame::INTEGER AS frame, s, {_ROUND.format('((p_size - 10) * 0.75::DOUBLE * s)')} AS xr, {_ROUND.format('((p_size % 7) * 1.5::DOUBLE * s)')} AS yr, "
        f"{_ROUND.format('((p_size % 11) * 0.75::DOUBLE * s)')} AS ws, {_ROUND.format('((p_size % 5 + 1) * 1.5::DOUBLE * s)')} AS hs "
        "FROM (SELECT p_partkey, p_size, p_size % 4 + 1 AS s, unnest(range(3)) AS frame FROM part)))) WHERE ws <> 0 AND hs <> 0 AND xe > xs AND ye > ys"
    ),
}
