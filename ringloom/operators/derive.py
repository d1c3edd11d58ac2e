"""Deriving region catalogues from cuboid, token and block-model tables.

Regions are ``(entity_id, ord, name, x, y, width, height, flip, rotate)``. Edits that
differ per entity (copies, mirrors, extra rows, orientation tags, inheritance) are rows of
small rule tables joined by entity, not code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringloom.functions.geometry import (
    base_part,
    cuboid_faces,
    element_region_name,
    face_region_name,
    quad_rectangle,
)
from ringloom.functions.paths import NAME_PREFIXES, strip_namespace
from ringloom.operators import sizing
from ringloom.operators.catalog import append_after, hinted, keep_first
from ringloom.operators.lineage import cut_lineage

REGION_TABLE = ["entity_id", "ord", "name", "x", "y", "width", "height", "flip", "rotate"]
# Where a model chain ends without elements.
CHAIN_ROOTS = ("block/block", "minecraft:block/block")


def carry_forward(
    tokens: DataFrame,
    group: list[str],
    order: str,
    values: list[str],
    initial: dict[str, object],
    segment: Column,
) -> DataFrame:
    """Fill each null in ``values`` with the group's last non-null one before it.

    ``segment`` is a non-decreasing function of ``order``. Rows are filled inside
    (group, segment); what enters a segment comes from a summary with one row per segment,
    so a group of any size is spread over as many tasks as it has segments.
    """
    cut = tokens.withColumn("_segment", segment)
    summary = cut.groupBy(*group, "_segment").agg(
        *[
            F.max_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(f"_last_{v}")
            for v in values
        ]
    )
    before = Window.partitionBy(*group).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    entering = summary.select(
        *group,
        "_segment",
        *[F.last(f"_last_{v}", ignorenulls=True).over(before).alias(f"_in_{v}") for v in values],
    )
    inside = (
        Window.partitionBy(*group, "_segment")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    filled = cut.select(
        *[c for c in cut.columns if c not in values],
        *[F.last(v, ignorenulls=True).over(inside).alias(v) for v in values],
    )
    joined = filled.join(entering, [*group, "_segment"], "left")
    return joined.select(
        *[
            F.coalesce(F.col(c), F.col(f"_in_{c}"), F.lit(initial[c])).alias(c) if c in values else F.col(c)
            for c in tokens.columns
        ]
    )


def _packed(high: Column, low: Column) -> Column:
    """One ordinal from two; an error, not a wrong order, if they do not fit."""
    fits = high.between(0, (1 << 31) - 1) & low.between(0, (1 << 32) - 1)
    packed = high.cast("bigint") * (1 << 32) + low
    return F.when(fits, packed).otherwise(F.raise_error(F.lit("ordinals too large to be put in order")).cast("bigint"))


def faces_of_cuboids(cuboids: DataFrame, keep_part: bool = False) -> DataFrame:
    """Regions of ``cuboids(entity_id, ord, part, idx, u, v, sx, sy, sz)``.

    Parts keep the order of their first cuboid. A part's cuboid count decides whether its
    names carry an index. Faces with an empty side are dropped. ``keep_part`` keeps the part
    as a column.
    """
    parts = cuboids.groupBy("entity_id", "part").agg(
        F.count(F.lit(1)).alias("in_part"), F.min("ord").alias("first_ord")
    )
    unfolded = cuboids.join(parts, ["entity_id", "part"]).select(
        "entity_id",
        "part",
        "idx",
        "ord",
        "in_part",
        "first_ord",
        F.inline(cuboid_faces(*[F.col(c) for c in ("u", "v", "sx", "sy", "sz")])),
    )
    return unfolded.filter("width > 0 and height > 0").select(
        "entity_id",
        _packed(F.col("first_ord"), F.col("ord").cast("bigint") * 6 + F.col("face_ord")).alias("ord"),
        face_region_name(F.col("part"), F.col("idx"), F.col("in_part"), F.col("face")).alias("name"),
        "x",
        "y",
        "width",
        "height",
        F.lit(None).cast("string").alias("flip"),
        F.lit(None).cast("string").alias("rotate"),
        *(["part"] if keep_part else []),
    )


def first_per_rectangle(regions: DataFrame) -> DataFrame:
    return keep_first(regions, ["entity_id", "x", "y", "width", "height"], "ord")


def first_per_oriented_rectangle(regions: DataFrame) -> DataFrame:
    return keep_first(regions, ["entity_id", "x", "y", "width", "height", "flip"], "ord")


def inherit_regions(own: DataFrame, parents: DataFrame, parent_regions: DataFrame) -> DataFrame:
    """Each entity of ``parents(entity_id, parent_id)`` gets, ahead of its own regions, the
    parent's regions whose base part it does not define itself."""
    defined = own.select("entity_id", base_part(F.col("name")).alias("_part")).distinct()
    links = sizing.broadcast_if_small(parents.select("entity_id", "parent_id"))
    inherited = (
        parent_regions.withColumnRenamed("entity_id", "parent_id")
        .join(links, "parent_id")
        .withColumn("_part", base_part(F.col("name")))
        .join(defined, ["entity_id", "_part"], "left_anti")
        .select(*own.columns)
    )
    return append_after(inherited, own)


def seed_from_base(own: DataFrame, base: DataFrame, entities: DataFrame) -> DataFrame:
    """Every entity of ``entities(entity_id, template)`` starts from the regions of its
    ``base`` template whose part it does not redefine.

    ``own`` has entity_id, ``base`` has template instead; both carry a ``part`` column.
    """
    redefined = own.select("entity_id", "part").distinct()
    template = entities.select("entity_id", "template").join(sizing.broadcast_if_small(base), "template")
    kept = template.join(redefined, ["entity_id", "part"], "left_anti")
    return append_after(kept.select(*own.columns), own)


def replicate_parts(regions: DataFrame, rules: DataFrame) -> DataFrame:
    """Replace regions whose name starts with ``match`` by one offset copy per rule row.

    ``rules(entity_id, match, old, new, dx, dy, copy)``: ``old`` becomes ``new`` in the name.
    """
    small = sizing.broadcast_if_small(rules)
    r, k = regions.alias("r"), small.alias("k")
    on = (F.col("r.entity_id") == F.col("k.entity_id")) & F.startswith(F.col("r.name"), F.col("k.match"))
    # A copy comes behind all ordinals of the one before; too many of them are an overflow error.
    span = regions.groupBy("entity_id").agg((F.max("ord") + 1).cast("bigint").alias("span")).alias("s")
    copies = r.join(k, on).join(span, F.col("r.entity_id") == F.col("s.entity_id")).select(
        "r.entity_id",
        (F.col("k.copy") * F.col("s.span") + F.col("r.ord")).alias("ord"),
        F.replace("r.name", "k.old", "k.new").alias("name"),
        (F.col("r.x") + F.col("k.dx")).alias("x"),
        (F.col("r.y") + F.col("k.dy")).alias("y"),
        "r.width",
        "r.height",
        "r.flip",
        "r.rotate",
    )
    kept = r.join(k, on, "left_anti").select(*REGION_TABLE)
    return append_after(kept, copies)


def mirror_parts(regions: DataFrame, rules: DataFrame, entities: DataFrame) -> DataFrame:
    """Append a renamed copy of each part a rule names.

    ``rules(entity_id, old, new, mirror, unless)``: ``old``/``new`` are name prefixes;
    mirrored copies take ``x' = tex_w - x - width``. The part must own a ``top`` face. A rule
    is idle if the entity already has a region named ``unless`` (null: never idle).
    """
    small = sizing.measure(rules).fits()
    needed = rules.withColumn("_needs", F.concat("old", F.lit("top")))
    # Of all names only those that rules ask for are kept, so what is joined is as small as the rules are.
    asked = needed.select("entity_id", F.explode(F.array("_needs", "unless")).alias("name")).distinct()
    named = regions.select("entity_id", "name").join(hinted(asked, small), ["entity_id", "name"], "left_semi").distinct()
    names = hinted(named, small)
    live = (
        needed.join(names.withColumnRenamed("name", "_needs"), ["entity_id", "_needs"], "left_semi")
        .join(names.withColumnRenamed("name", "unless"), ["entity_id", "unless"], "left_anti")
        .join(entities.select("entity_id", "tex_w"), "entity_id")
    )
    live = hinted(live, small)
    r, k = regions.alias("r"), live.alias("k")
    on = (F.col("r.entity_id") == F.col("k.entity_id")) & F.startswith(F.col("r.name"), F.col("k.old"))
    copies = r.join(k, on).select(
        "r.entity_id",
        "r.ord",
        F.concat(F.col("k.new"), F.substring(F.col("r.name"), F.length("k.old") + 1, F.length("r.name"))).alias("name"),
        F.when(F.col("k.mirror"), F.col("k.tex_w") - F.col("r.x") - F.col("r.width"))
        .otherwise(F.col("r.x"))
        .alias("x"),
        "r.y",
        "r.width",
        "r.height",
        "r.flip",
        "r.rotate",
    )
    return append_after(regions, copies)


def add_rows(regions: DataFrame, rows: DataFrame, only_if_empty: bool = False) -> DataFrame:
    """Append given region rows, optionally only where extraction found none."""
    if only_if_empty:
        rows = rows.join(regions.select("entity_id").distinct(), "entity_id", "left_anti")
    return append_after(regions, rows)


def tag_orientation(regions: DataFrame, rules: DataFrame) -> DataFrame:
    """Set flip and rotate by name rule; the lowest ``rank`` wins, other regions keep theirs.

    ``rules(entity_id, rank, name, whole, except_name, flip, rotate)``: ``whole`` matches the
    full name, otherwise ``name`` is a prefix.
    """
    r, k = regions.alias("r"), sizing.broadcast_if_small(rules).alias("k")
    named = F.when(F.col("k.whole"), F.col("r.name") == F.col("k.name")).otherwise(
        F.startswith(F.col("r.name"), F.col("k.name"))
    )
    on = (
        (F.col("r.entity_id") == F.col("k.entity_id"))
        & named
        & ~F.col("r.name").eqNullSafe(F.col("k.except_name"))
    )
    tags = r.join(k, on).groupBy("r.entity_id", "r.ord").agg(
        F.min_by(F.struct("k.flip", "k.rotate"), "k.rank").alias("_tag")
    )
    return regions.join(tags, ["entity_id", "ord"], "left").select(
        *[
            F.coalesce(F.col(f"_tag.{c}"), F.col(c)).alias(c) if c in ("flip", "rotate") else F.col(c)
            for c in REGION_TABLE
        ]
    )


def resolve_part_names(parts: DataFrame, constants: DataFrame, expr: str = "expr") -> DataFrame:
    """``parts`` plus ``part``: a quoted literal, else a named constant, else the text itself."""
    text = F.trim(F.col(expr))
    quoted = F.regexp_extract(text, '^"(.*)"$', 1)
    named = constants.select(F.col("constant").alias("_c"), F.col("value").alias("_v"))
    joined = parts.withColumn("_c", text).join(sizing.broadcast_if_small(named), "_c", "left")
    return joined.withColumn(
        "part", F.when(text.rlike('^".*"$'), quoted).otherwise(F.coalesce("_v", text))
    ).drop("_c", "_v")


def elements_owner(models: DataFrame) -> DataFrame:
    """``(name, owner)``: the first model up the parent chain that declares elements.

    ``models(name, parent, has_elements)``. Null owner where the chain is broken, ends at a
    root, or is a cycle. Pointers are doubled each round, so a chain of depth d takes
    log2(d) joins; lineage is cut every round. Depths along a chain have no gaps, so a round
    that settles no further model leaves only cycles and ends the search.
    """
    state = cut_lineage(
        models.select(
            strip_namespace(F.col("name")).alias("name"),
            F.when(F.col("has_elements"), F.lit(None))
            .when(F.coalesce("parent", F.lit("")).isin("", *CHAIN_ROOTS), F.lit(None))
            .otherwise(strip_namespace(F.col("parent")))
            .alias("next"),
            F.when(F.col("has_elements"), strip_namespace(F.col("name"))).alias("owner"),
        )
    )
    size = sizing.measure(state)
    moving, before = state.filter("next is not null").count(), None
    while moving and moving != before:
        ahead = state.select(
            F.col("name").alias("_at"), F.col("next").alias("_next"), F.col("owner").alias("_owner")
        )
        ahead = F.broadcast(ahead) if size.fits() else ahead
        # Settled models have no pointer; they get a key of their own so that they neither
        # match nor meet in one task.
        at = F.coalesce("next", F.concat(F.lit("\0"), "name"))
        state = cut_lineage(
            state.withColumn("_at", at)
            .join(ahead, "_at", "left")
            .select("name", F.col("_next").alias("next"), F.coalesce("owner", "_owner").alias("owner"))
        )
        before, moving = moving, state.filter("next is not null").count()
    return state.select("name", "owner")


def regions_of_models(templates: DataFrame, models: DataFrame, owners: DataFrame) -> DataFrame:
    """Regions of block models.

    ``templates(entity_id, template_ord, template)``;
    ``models(name, elements array<struct<faces map<string, struct<uv array<double>>>>>)``;
    ``owners`` from :func:`elements_owner`. Faces go by template, element, then face name;
    quads that are too thin are dropped and each oriented rectangle is kept once. Names of an
    entity with several templates say which.
    """
    several = templates.groupBy("entity_id").agg((F.count(F.lit(1)) > 1).alias("several"))
    counted = templates.join(sizing.broadcast_if_small(several), "entity_id")
    owned = counted.withColumn("name", strip_namespace(F.col("template"))).join(
        owners.filter("owner is not null"), "name"
    )
    bodies = models.select(strip_namespace(F.col("name")).alias("owner"), "elements")
    elements = owned.join(bodies, "owner").select(
        "entity_id", "several", "template_ord", F.posexplode("elements").alias("element", "body")
    )
    faces = elements.select("entity_id", "several", "template_ord", "element", F.explode("body.faces").alias("face", "quad"))
    uv = F.col("quad.uv")
    rect = F.when(F.size(uv) >= 4, quad_rectangle(*[uv[i].cast("double") for i in range(4)]))
    found = faces.withColumn("rect", rect).filter("rect is not null")
    at = F.struct("template_ord", "element", "face")
    named = found.select(
        "entity_id",
        at.alias("ord"),
        element_region_name(F.col("template_ord"), F.col("element"), F.col("face"), F.col("several")).alias("name"),
        "rect.*",
    )
    return first_per_oriented_rectangle(named)


def animated_model_textures(
    models: DataFrame, templates: DataFrame, files: DataFrame, folder: str
) -> DataFrame:
    """Distinct textures of models whose parent is a template, if image and sidecar exist.

    ``models(name, parent, textures map<string,string>)``, ``templates(template)``,
    ``files(path)``.
    """
    listed = templates.select(strip_namespace(F.col("template")).alias("_t"))
    accepted = listed.select(
        F.explode(F.array(*[F.concat(F.lit(p), "_t") for p in NAME_PREFIXES])).alias("parent")
    )
    used = (
        models.join(sizing.broadcast_if_small(accepted.distinct()), "parent", "left_semi")
        .select(F.explode(F.map_values("textures")).alias("_v"))
        .select(F.concat(F.lit(folder.rstrip("/") + "/"), strip_namespace(F.col("_v")), F.lit(".png")).alias("texture"))
        .distinct()
    )
    present = files.select(F.col("path").alias("texture"))
    sidecars = files.filter(F.endswith("path", F.lit(".mcmeta"))).select(
        F.regexp_replace("path", r"\.mcmeta$", "").alias("texture")
    )
    return used.join(present, "texture", "left_semi").join(sidecars, "texture", "left_semi")


def choose_textures(
    files: DataFrame, entities: DataFrame, excluded: DataFrame, included: DataFrame, root: str
) -> DataFrame:
    """``(entity_id, texture)`` found below ``root`` for each entity.

    ``entities(entity_id, folder, fallback_folder)``; ``excluded(entity_id, prefix)`` drops
    files by name prefix; ``included(entity_id, kind, text, wanted)`` keeps only files for
    which the predicate (``prefix``, ``suffix`` or ``equals``) is ``wanted``. Three tiers,
    the first that yields anything wins per entity: the entity's folder, files directly in
    ``root`` starting with the entity id, and ``fallback_folder/entity_id.png``. Callers order
    by ``texture``.
    """
    base = root.rstrip("/") + "/"
    below = (
        files.filter(F.startswith("path", F.lit(base)) & F.lower("path").endswith(".png"))
        .withColumn("_rel", F.substring(F.col("path"), F.lit(len(base) + 1), F.length("path")))
        .withColumn("_name", F.substring_index("path", "/", -1))
    )
    entities = sizing.broadcast_if_small(entities)
    in_folder = below.withColumn("folder", F.substring_index("_rel", "/", 1)).filter(F.contains("_rel", F.lit("/")))
    tier0 = in_folder.join(entities, "folder").select("entity_id", F.lit(0).alias("tier"), "path", "_name")
    # A file name starts with an entity id iff the id equals one of the name's heads.
    heads = below.filter(~F.contains("_rel", F.lit("/"))).select(
        "path",
        "_name",
        F.explode(F.transform(F.sequence(F.lit(1), F.length("_name")), lambda n: F.substring(F.col("_name"), F.lit(1), n))).alias("entity_id"),
    )
    tier1 = heads.join(entities, "entity_id").select("entity_id", F.lit(1).alias("tier"), "path", "_name")
    tier2 = (
        in_folder.withColumn("entity_id", F.regexp_replace("_name", r"(?i)\.png$", ""))
        .join(entities.filter("fallback_folder is not null"), "entity_id")
        .filter(F.col("_rel") == F.concat_ws("/", "fallback_folder", "_name"))
        .select("entity_id", F.lit(2).alias("tier"), "path", "_name")
    )

    def without_excluded(tier: DataFrame) -> DataFrame:
        t, e = tier.alias("t"), sizing.broadcast_if_small(excluded).alias("e")
        on = (F.col("t.entity_id") == F.col("e.entity_id")) & F.startswith(F.col("t._name"), F.col("e.prefix"))
        return t.join(e, on, "left_anti")

    def with_included(tier: DataFrame) -> DataFrame:
        t, i = tier.alias("t"), sizing.broadcast_if_small(included).alias("i")
        holds = (
            F.when(F.col("i.kind") == "prefix", F.startswith(F.col("t._name"), F.col("i.text")))
            .when(F.col("i.kind") == "suffix", F.endswith(F.col("t._name"), F.col("i.text")))
            .otherwise(F.col("t._name") == F.col("i.text"))
        )
        on = (F.col("t.entity_id") == F.col("i.entity_id")) & (holds != F.col("i.wanted"))
        return t.join(i, on, "left_anti")

    tiers = (
        with_included(without_excluded(tier0)).unionByName(without_excluded(tier1)).unionByName(tier2)
    )
    best = tiers.groupBy("entity_id").agg(F.min("tier").alias("tier"))
    return tiers.join(best, ["entity_id", "tier"]).select(
        "entity_id", F.col("path").alias("texture")
    )


def model_sizes(models: DataFrame, known: DataFrame, pattern: str) -> DataFrame:
    """``(name, tex_w, tex_h)`` by tier: a known size, a size spelled in the model's own text,
    in its parent's text, else 64 by 64.

    ``models(name, text, parent_text)``, ``known(name, tex_w, tex_h)``; ``pattern`` has one
    group per side.
    """
    joined = models.join(sizing.broadcast_if_small(known), "name", "left")

    def spelled(column: str, group: int) -> Column:
        return F.regexp_extract(F.coalesce(column, F.lit("")), pattern, group).try_cast("int")

    return joined.select(
        "name",
        F.coalesce("tex_w", spelled("text", 1), spelled("parent_text", 1), F.lit(64)).alias("tex_w"),
        F.coalesce("tex_h", spelled("text", 2), spelled("parent_text", 2), F.lit(64)).alias("tex_h"),
    )


def build_outcomes(requested: DataFrame, existing: DataFrame, derived: DataFrame) -> DataFrame:
    """``(status, entities)``: already written and kept, newly written, or without regions."""
    status = (
        requested.select("entity_id")
        .join(existing.select("entity_id").distinct().withColumn("_old", F.lit(True)), "entity_id", "left")
        .join(derived.select("entity_id").distinct().withColumn("_new", F.lit(True)), "entity_id", "left")
        .select(
            F.when(F.col("_old"), F.lit("skipped"))
            .when(F.col("_new"), F.lit("written"))
            .otherwise(F.lit("warned"))
            .alias("status")
        )
    )
    return status.groupBy("status").agg(F.count(F.lit(1)).alias("entities"))
