"""Queries over the ring: hashing, assignment, frames, entities, consumers, seed search."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringloom.functions.hashing import hash_state, parse_seed, ring_position, string_seed, target_state
from ringloom.functions.paths import relative_to
from ringloom.operators.assign import assign_entities, assign_frames, assign_targets, primary_overlays
from ringloom.operators.classify import classification_totals, classify_targets
from ringloom.operators.catalog import texture_owners
from ringloom.operators.matching import with_hits
from ringloom.operators.ring import prepare_ring
from ringloom.operators.sizing import measure
from ringloom.operators.search import of_kind, priority_top, reverse_lookup, text_filter
from ringloom.plans.assign import build_assignments, preview_list, zip_faces
from ringloom.plans.seed_search import BLOCK_ROW_BYTES, search_seeds
from ringloom.sources.files import sidecar_flags
from ringloom.workload.tables import (
    DOCUMENTS_SQL,
    SEED,
    customer_catalogue,
    documents,
    part_catalogue,
    placed_sql,
    position_sql,
    state_sql,
    suppliers,
    table,
)

SEARCH_SEEDS = range(0, 400)
# The first filter meets about a quarter of the urls, the second all of them.
SEARCH_CONSTRAINTS = [("/FR/1", "0001"), ("", "00000000"), ("spam-farm", "5")]
PATTERNS = ("gear", "bolt", "red", "ring", "small", "widget")


def ring_hash_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer", "c_custkey", "c_name").select(
        "c_custkey",
        hash_state("c_name", target_state(SEED)).alias("accum"),
        ring_position("c_name", target_state(SEED)).alias("final"),
    )


def string_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = (
        table(spark, sf_dir, "nation").select(F.col("n_name").alias("s"))
        .unionByName(table(spark, sf_dir, "region").select(F.col("r_name").alias("s")))
        .unionByName(table(spark, sf_dir, "customer").select(F.col("c_name").alias("s")))
        .unionByName(table(spark, sf_dir, "customer").select((500 - F.col("c_custkey")).cast("string").alias("s")))
    )
    return texts.select("s", string_seed("s").alias("code"), parse_seed("s").alias("seed"))


def ring_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = prepare_ring(suppliers(spark, sf_dir), SEED)
    return assign_targets(documents(spark, sf_dir), ring, SEED).select("doc_id", F.col("overlay").alias("s_name"))


def ring_assign_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ring_assign, with a ring that may not be broadcast."""
    ring = prepare_ring(suppliers(spark, sf_dir), SEED, max_broadcast_bytes=0)
    return assign_targets(documents(spark, sf_dir), ring, SEED).select("doc_id", F.col("overlay").alias("s_name"))


def ring_assign_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load per source when every line item is a target."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber").withColumn(
        "rel", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    )
    placed = assign_targets(lines, prepare_ring(suppliers(spark, sf_dir), SEED), SEED)
    return placed.groupBy(F.col("overlay").alias("s_name")).agg(
        F.count("*").alias("targets"), F.sum("l_orderkey").alias("orderkeys")
    )


def ring_assign_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    strips = table(spark, sf_dir, "conversations", "conv_id", "turn").groupBy("conv_id").agg(
        (F.max("turn") + 1).cast("int").alias("frames")
    )
    targets = strips.withColumn("rel", F.concat(F.lit("conv/"), F.col("conv_id").cast("string")))
    ring = prepare_ring(suppliers(spark, sf_dir), SEED)
    return assign_frames(targets, ring, SEED).select("conv_id", "frame", F.col("overlay").alias("s_name"))


def _entity_assign(face_mode: str, texture_mode: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ring = prepare_ring(suppliers(spark, sf_dir), SEED)
        return assign_entities(part_catalogue(spark, sf_dir), ring, SEED, face_mode, texture_mode)

    return run


def _classified(spark: SparkSession, sf_dir: str, max_broadcast_bytes: int | None = None) -> DataFrame:
    catalogue = replace(customer_catalogue(spark, sf_dir), max_broadcast_bytes=max_broadcast_bytes)
    return classify_targets(documents(spark, sf_dir), texture_owners(catalogue), catalogue.profile)


def classify_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select("doc_id", "texture", "entity_id", "is_entity")


def classify_suffix_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, 0).select("doc_id", "texture", "entity_id", "is_entity")


def classify_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classification_totals(_classified(spark, sf_dir))


def primary_and_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = _entity_assign("different", "separate")(spark, sf_dir)
    return primary_overlays(faces, ["texture", "entity_id"])


def _assignments(spark: SparkSession, sf_dir: str, max_broadcast_bytes: int | None = None):
    sources = suppliers(spark, sf_dir)
    catalogue = replace(customer_catalogue(spark, sf_dir), max_broadcast_bytes=max_broadcast_bytes)
    ring = prepare_ring(sources, SEED, max_broadcast_bytes=max_broadcast_bytes)
    return build_assignments(sources, documents(spark, sf_dir), catalogue, SEED, "different", "separate", ring)


_ASSIGNED = ["rel", "overlay", "is_entity", "entity_id", "texture", "tex_w", "tex_h", "display"]


def full_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assignments(spark, sf_dir).targets.select(*_ASSIGNED)


def full_assignment_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As full_assignment, with nothing small enough to be broadcast."""
    return _assignments(spark, sf_dir, 0).targets.select(*_ASSIGNED)


def text_filter_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = _assignments(spark, sf_dir, 0)
    return text_filter(built.targets, built.faces, "#00000001", built.textures_fit).select("target", "overlay")


def assignment_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assignments(spark, sf_dir).target_faces()


def kind_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_kind(_assignments(spark, sf_dir).targets, "entity").select("target", "overlay")


def text_filter_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = _assignments(spark, sf_dir)
    return text_filter(built.targets, built.faces, "#00000001", built.textures_fit).select("target", "overlay")


def _reverse(query: str, exact: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        built = _assignments(spark, sf_dir)
        return reverse_lookup(built.targets, built.faces, query, exact, built.textures_fit).select("target", "overlay")

    return run


def priority_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand").select(
        "p_partkey", F.concat_ws("/", "p_brand", "p_name").alias("target")
    )
    return priority_top(parts, "p_partkey", 200, PATTERNS)


def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty first entity targets on a matching source, by priority."""
    top = preview_list(_assignments(spark, sf_dir), "entity", "0001", 50, ("src1/", "/en/"))
    return top.select("target", "overlay", "score")


def seed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "url").select(F.col("url").alias("rel"))
    return search_seeds(spark, suppliers(spark, sf_dir), pages, SEARCH_CONSTRAINTS, SEARCH_SEEDS)


def seed_search_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As above, with sources in three blocks or so: the way of catalogues too large for a task."""
    pages = table(spark, sf_dir, "pages", "url").select(F.col("url").alias("rel"))
    sources = suppliers(spark, sf_dir)
    third = BLOCK_ROW_BYTES * max(1, sources.count() // 3)
    return search_seeds(spark, sources, pages, SEARCH_CONSTRAINTS, SEARCH_SEEDS, max_task_bytes=0, block_bytes=third)


def many_text_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's key as a text filter on the urls: how many meet, and the least of them."""
    keys = table(spark, sf_dir, "customer", "c_custkey")
    if not measure(keys).fits():
        raise ValueError("more filters than one list may hold")
    filters = [str(r[0]) for r in keys.orderBy("c_custkey").collect()]
    found = with_hits(table(spark, sf_dir, "pages", "page_id", "url"), "url", filters)
    first = spark.createDataFrame([(n, int(key)) for n, key in enumerate(filters)], "_nth int, least bigint")
    return found.withColumn("_nth", F.get("hits", F.lit(0))).join(F.broadcast(first), "_nth", "left").select(
        "page_id", F.size("hits").cast("bigint").alias("n_hits"), "least"
    )


def relative_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths below their source's folder, or, for every fifth document, below another one."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source")
    path = F.concat_ws("/", F.lit("/data"), "source", F.col("doc_id").cast("string"))
    base = F.when(F.col("doc_id") % 5 == 0, F.lit("/other")).otherwise(F.concat(F.lit("/data/"), "source", F.lit("/")))
    return docs.select("doc_id", relative_to(path, base).alias("rel"))


def sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties as sidecars: some with an animation key, some cut short."""
    events = table(spark, sf_dir, "events", "event_id", "props")
    value = F.replace("props", F.lit('"k": 1'), F.lit('"animation": 1'))
    value = F.when(F.col("event_id") % 7 == 0, F.substring(value, F.lit(1), F.length(value) - 1)).otherwise(value)
    flags = sidecar_flags(events.select(F.col("event_id").cast("string").alias("path"), value.alias("value")))
    return flags.select(F.col("path").cast("bigint").alias("event_id"), "has_anim")


def zipped_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as regions, the larger ones as overlays, paired to the shorter list."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_linestatus", "l_quantity", "l_returnflag")

    def in_order(column: str, large: bool):
        line = F.struct("l_linenumber", F.col(column).alias("v"))
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("l_quantity") > 20, line) if large else line)), lambda x: x["v"])

    nested = lines.groupBy(F.col("l_orderkey").alias("target")).agg(
        in_order("l_linestatus", False).alias("regions"), in_order("l_returnflag", True).alias("overlays")
    )
    return zip_faces(nested)


QUERIES = {
    "ring_hash_keys": ring_hash_keys,
    "string_seed": string_seeds,
    "ring_assign": ring_assign,
    "ring_assign_lineitem": ring_assign_lineitem,
    "ring_assign_frames": ring_assign_frames,
    "entity_assign_same_shared": _entity_assign("same", "shared"),
    "entity_assign_same_separate": _entity_assign("same", "separate"),
    "entity_assign_different_shared": _entity_assign("different", "shared"),
    "entity_assign_different_separate": _entity_assign("different", "separate"),
    "classify_suffix": classify_suffix,
    "classify_totals": classify_totals,
    "primary_and_display": primary_and_display,
    "full_assignment": full_assignment,
    "assignment_faces": assignment_faces,
    "kind_filter": kind_filter,
    "text_filter": text_filter_query,
    "reverse_lookup_exact": _reverse("supplier#000000007", True),
    "reverse_lookup_contains": _reverse("00002", False),
    "priority_topk": priority_topk,
    "preview_list": preview,
    "seed_search": seed_search,
    "seed_search_blocked": seed_search_blocked,
    "many_text_filters": many_text_filters,
    "ring_assign_shuffled": ring_assign_shuffled,
    "classify_suffix_shuffled": classify_suffix_shuffled,
    "full_assignment_shuffled": full_assignment_shuffled,
    "text_filter_shuffled": text_filter_shuffled,
    "relative_paths": relative_paths,
    "sidecar_flags": sidecars,
    "zip_faces": zipped_faces,
}

# Oracle ------------------------------------------------------------------------------

_OWNERS = "SELECT p_name AS texture, max(p_brand) AS entity_id FROM part GROUP BY p_name"
_REGIONS = "SELECT p_brand AS entity_id, p_type AS region, min(p_partkey) AS region_ord FROM part GROUP BY ALL"


def _entity_sql(face_mode: str, texture_mode: str, owners: str = _OWNERS, regions: str = _REGIONS) -> str:
    key = f"'{SEED}:' || entity_id"
    if texture_mode == "separate":
        key += " || ':' || texture"
    if face_mode == "different":
        key += " || ':' || region"
    grid = f"SELECT *, {position_sql(key)} AS pos FROM (SELECT o.texture, o.entity_id, r.region_ord, r.region FROM ({owners}) o JOIN ({regions}) r USING (entity_id))"
    return placed_sql(grid, "k.texture, k.entity_id, k.region_ord, k.region")


_SPELLED = (
    "SELECT c_mktsegment AS entity_id, CASE WHEN c_acctbal < 2000 THEN 'en/' || c_custkey "
    "WHEN c_acctbal < 4000 THEN '/' || c_custkey WHEN c_acctbal < 4100 THEN c_custkey::VARCHAR "
    "ELSE c_name END AS texture FROM customer"
)
_SEGMENT_OWNERS = f"SELECT texture, max(entity_id) AS entity_id FROM ({_SPELLED}) GROUP BY texture"
_SEGMENT_REGIONS = (
    "SELECT c_mktsegment AS entity_id, 'n' || c_nationkey AS region, c_nationkey::BIGINT AS region_ord "
    "FROM customer GROUP BY ALL"
)
_CLASSIFIED = (
    f"SELECT d.doc_id, d.rel, arg_max(o.texture, length(o.texture)) AS texture, "
    f"arg_max(o.entity_id, length(o.texture)) AS entity_id FROM ({DOCUMENTS_SQL}) d "
    f"LEFT JOIN ({_SEGMENT_OWNERS}) o ON ends_with(d.rel, o.texture) GROUP BY ALL"
)
_FACES = _entity_sql("different", "separate", _SEGMENT_OWNERS, _SEGMENT_REGIONS)
_DISPLAY = "CASE WHEN min(overlay) = max(overlay) THEN min(overlay) ELSE '[multiple]' END AS display"
_REGULAR_KEYS = f"SELECT *, {position_sql(repr(f'{SEED}:') + ' || rel')} AS pos FROM ({_CLASSIFIED}) WHERE entity_id IS NULL"
_WITH = (
    f"WITH classified AS MATERIALIZED ({_CLASSIFIED}), faces AS MATERIALIZED ({_FACES}), "
    f"primaries AS (SELECT texture, arg_min(overlay, region_ord) AS overlay, {_DISPLAY} FROM faces GROUP BY texture), "
    "sizes AS (SELECT c_mktsegment AS entity_id, count(*)::INTEGER AS tex_w FROM customer GROUP BY 1), "
    f"regular AS ({placed_sql(_REGULAR_KEYS, 'k.rel')}), "
    "assigned AS (SELECT rel, overlay, false AS is_entity, NULL::VARCHAR AS entity_id, NULL::VARCHAR AS texture, "
    "NULL::INTEGER AS tex_w, NULL::INTEGER AS tex_h, overlay AS display FROM regular UNION ALL "
    "SELECT c.rel, p.overlay, true, c.entity_id, c.texture, s.tex_w, 64, p.display FROM classified c "
    "JOIN primaries p USING (texture) JOIN sizes s ON s.entity_id = c.entity_id WHERE c.entity_id IS NOT NULL), "
    "spread AS (SELECT c.rel AS target, f.entity_id, f.region_ord, f.region, f.overlay FROM classified c "
    "JOIN faces f USING (texture)) "
)


def _hit_sql(own: str, face: str) -> str:
    return (
        f"{_WITH} SELECT rel AS target, overlay FROM assigned WHERE {own} "
        f"OR rel IN (SELECT target FROM spread WHERE {face})"
    )


_FILE = "lower(split_part(overlay, '/', -1))"
_SEARCH_FILTERS = ", ".join(
    f"({i}, '{t.lower()}', '{o.lower()}')" for i, (t, o) in enumerate(SEARCH_CONSTRAINTS)
)
_SEARCH_RING = (
    f"SELECT seed, pos, min(src) AS src FROM (SELECT seed, s_name AS src, "
    f"{position_sql(chr(39) + chr(39) + ' || seed || ' + repr(':overlay:') + ' || s_name')} AS pos "
    f"FROM supplier, range({SEARCH_SEEDS.start}, {SEARCH_SEEDS.stop}) t(seed)) GROUP BY ALL"
)
_SEARCH_KEYS = (
    f"SELECT seed, cid, ov_filter, {position_sql(chr(39) + chr(39) + ' || seed || ' + repr(':') + ' || url')} AS pos "
    f"FROM pages JOIN (VALUES {_SEARCH_FILTERS}) c(cid, tex_filter, ov_filter) ON contains(lower(url), tex_filter), "
    f"range({SEARCH_SEEDS.start}, {SEARCH_SEEDS.stop}) t(seed)"
)

ORACLE = {
    "ring_hash_keys": (
        f"SELECT c_custkey, {state_sql(repr(f'{SEED}:') + ' || c_name')} AS accum, "
        f"{position_sql(repr(f'{SEED}:') + ' || c_name')} AS final FROM customer"
    ),
    "string_seed": (
        "SELECT s, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS code, "
        "coalesce(TRY_CAST(s AS BIGINT), CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) AS seed FROM ("
        f"SELECT s, {state_sql('s')} AS h FROM (SELECT n_name AS s FROM nation UNION ALL SELECT r_name FROM region "
        "UNION ALL SELECT c_name FROM customer UNION ALL SELECT (500 - c_custkey)::VARCHAR FROM customer))"
    ),
    "ring_assign": placed_sql(
        f"SELECT doc_id, {position_sql(repr(f'{SEED}:') + ' || rel')} AS pos FROM ({DOCUMENTS_SQL})",
        "k.doc_id",
        out="s_name",
    ),
    "ring_assign_lineitem": (
        "SELECT s_name, count(*) AS targets, sum(l_orderkey)::BIGINT AS orderkeys FROM ("
        + placed_sql(
            f"SELECT l_orderkey, {position_sql(repr(f'{SEED}:') + ' || l_orderkey || ' + repr('-') + ' || l_linenumber')} AS pos FROM lineitem",
            "k.l_orderkey",
            out="s_name",
        )
        + ") GROUP BY s_name"
    ),
    "ring_assign_frames": placed_sql(
        f"SELECT conv_id, frame, {position_sql(repr(f'{SEED}:conv/') + ' || conv_id || CASE WHEN frame = 0 THEN ' + repr('') + ' ELSE ' + repr(':') + ' || frame END')} AS pos "
        "FROM (SELECT conv_id, unnest(range(max(turn)::INTEGER + 1))::INTEGER AS frame FROM conversations GROUP BY conv_id)",
        "k.conv_id, k.frame",
        out="s_name",
    ),
    **{
        f"entity_assign_{f}_{t}": _entity_sql(f, t)
        for f in ("same", "different")
        for t in ("shared", "separate")
    },
    "classify_suffix": f"SELECT doc_id, texture, entity_id, entity_id IS NOT NULL AS is_entity FROM ({_CLASSIFIED})",
    "classify_totals": (
        "SELECT count(*) AS targets, count(*) FILTER (entity_id IS NOT NULL) AS entity_targets, "
        f"count(*) FILTER (entity_id IS NULL) AS regular_targets FROM ({_CLASSIFIED})"
    ),
    "primary_and_display": (
        f"SELECT texture, entity_id, arg_min(overlay, region_ord) AS overlay, {_DISPLAY} "
        f"FROM ({_entity_sql('different', 'separate')}) GROUP BY ALL"
    ),
    "full_assignment": f"{_WITH} SELECT * FROM assigned",
    "assignment_faces": f"{_WITH} SELECT * FROM spread",
    "kind_filter": f"{_WITH} SELECT rel AS target, overlay FROM assigned WHERE is_entity",
    "text_filter": _hit_sql(
        "contains(lower(rel), '#00000001') OR contains(lower(overlay), '#00000001')",
        "contains(lower(overlay), '#00000001')",
    ),
    "reverse_lookup_exact": _hit_sql(f"{_FILE} = 'supplier#000000007'", f"{_FILE} = 'supplier#000000007'"),
    "reverse_lookup_contains": _hit_sql(f"contains({_FILE}, '00002')", f"contains({_FILE}, '00002')"),
    "priority_topk": (
        "SELECT p_partkey, target, score FROM (SELECT p_partkey, p_brand || '/' || p_name AS target, CASE "
        + " ".join(f"WHEN contains(lower(p_brand || '/' || p_name), '{p}') THEN {i}" for i, p in enumerate(PATTERNS))
        + f" ELSE {len(PATTERNS)} END::INTEGER AS score FROM part) ORDER BY score, p_partkey LIMIT 200"
    ),
    "preview_list": (
        f"{_WITH} SELECT rel AS target, overlay, CASE WHEN contains(lower(rel), 'src1/') THEN 0 WHEN contains(lower(rel), '/en/') THEN 1 ELSE 2 END::INTEGER AS score "
        "FROM assigned WHERE is_entity AND (contains(lower(rel), '0001') OR contains(lower(overlay), '0001') "
        "OR rel IN (SELECT target FROM spread WHERE contains(lower(overlay), '0001'))) ORDER BY score, rel LIMIT 50"
    ),
    "seed_search": (
        f"WITH ring AS MATERIALIZED ({_SEARCH_RING}), keys AS MATERIALIZED ({_SEARCH_KEYS}), "
        "firsts AS (SELECT seed, arg_min(src, pos) AS src FROM ring GROUP BY seed), "
        "placed AS (SELECT k.seed, k.cid, k.ov_filter, coalesce(r.src, f.src) AS src FROM keys k "
        "ASOF LEFT JOIN ring r ON k.seed = r.seed AND k.pos <= r.pos JOIN firsts f ON f.seed = k.seed) "
        "SELECT seed FROM (SELECT seed, cid, bool_or(contains(lower(src), ov_filter)) AS met FROM placed GROUP BY ALL) "
        f"GROUP BY seed HAVING count(*) FILTER (met) = {len(SEARCH_CONSTRAINTS)}"
    ),
}

ORACLE |= {f"{name}_shuffled": ORACLE[name] for name in ("ring_assign", "classify_suffix", "full_assignment", "text_filter")}
ORACLE |= {
    "seed_search_blocked": ORACLE["seed_search"],
    "many_text_filters": (
        "SELECT page_id, count(c_custkey) AS n_hits, min(c_custkey) AS least "
        "FROM pages LEFT JOIN customer ON contains(url, c_custkey::VARCHAR) GROUP BY page_id"
    ),
    "relative_paths": (
        "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '/data/' || source || '/' || doc_id ELSE doc_id::VARCHAR END AS rel FROM documents"
    ),
    "sidecar_flags": "SELECT event_id, event_id % 7 <> 0 AND contains(props, '\"k\": 1') AS has_anim FROM events",
    "zip_faces": (
        "WITH o AS (SELECT l_orderkey AS target, list(l_linestatus ORDER BY l_linenumber, l_linestatus) AS r, "
        "coalesce(list(l_returnflag ORDER BY l_linenumber, l_returnflag) FILTER (l_quantity > 20), []) AS f FROM lineitem GROUP BY 1) "
        "SELECT target, n::INTEGER AS region_ord, r[n + 1] AS region, f[n + 1] AS overlay "
        "FROM (SELECT *, unnest(range(least(len(r), len(f)))) AS n FROM o)"
    ),
}
