"""How the driver tables stand in for sources, targets and catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringloom.operators.catalog import Catalogue

SEED = 42


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier", "s_name").select(F.col("s_name").alias("source"), F.col("s_name").alias("rel"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets; the path is ``source/lang/doc_id``."""
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents", "doc_id", "source", "lang").select(
        "doc_id", path.alias("target"), path.alias("rel")
    )


def part_catalogue(spark: SparkSession, sf_dir: str) -> Catalogue:
    """Brand = entity, name = texture (shared by many brands), type = region."""
    part = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    brand = F.col("p_brand").alias("entity_id")
    entities = part.groupBy(brand).agg(F.max("p_size").alias("tex_w"), F.min("p_size").alias("tex_h")).select(
        "entity_id", "tex_w", "tex_h", _claim()
    )
    regions = part.groupBy(brand, F.col("p_type").alias("name")).agg(F.min("p_partkey").alias("ord"))
    textures = part.groupBy(brand, F.col("p_name").alias("texture")).agg(F.min("p_partkey").alias("ord"))
    return Catalogue(entities, _plain_regions(regions), textures.select("entity_id", "ord", "texture"))


def customer_catalogue(spark: SparkSession, sf_dir: str) -> Catalogue:
    """Market segment = entity; customer keys, spelled four ways by balance, = textures;
    nation keys = regions.

    The short spellings end many document paths, so suffixes of several lengths compete.
    """
    customer = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    segment = F.col("c_mktsegment").alias("entity_id")
    key = F.col("c_custkey").cast("string")
    spelled = (
        F.when(F.col("c_acctbal") < 2000, F.concat(F.lit("en/"), key))
        .when(F.col("c_acctbal") < 4000, F.concat(F.lit("/"), key))
        .when(F.col("c_acctbal") < 4100, key)
        .otherwise(F.col("c_name"))
    )
    textures = customer.select(segment, F.col("c_custkey").alias("ord"), spelled.alias("texture"))
    entities = customer.groupBy(segment).agg(F.count("*").cast("int").alias("tex_w")).select(
        "entity_id", "tex_w", F.lit(64).alias("tex_h"), _claim()
    )
    regions = customer.groupBy(segment, F.col("c_nationkey").cast("bigint").alias("ord")).agg(
        F.concat(F.lit("n"), F.first("c_nationkey").cast("string")).alias("name")
    )
    return Catalogue(entities, _plain_regions(regions), textures)


def _claim():
    return F.struct(
        F.lit(0).alias("stage"), F.lower("entity_id").alias("folded"), F.col("entity_id").alias("file")
    ).alias("claim")


def _plain_regions(regions: DataFrame) -> DataFrame:
    return regions.select(
        "entity_id",
        "ord",
        "name",
        *[F.lit(0).alias(c) for c in ("x", "y", "width", "height")],
        *[F.lit(None).cast("string").alias(c) for c in ("flip", "rotate")],
    )


# SQL twins used by the oracle. -------------------------------------------------------

DOCUMENTS_SQL = "SELECT doc_id, source || '/' || lang || '/' || doc_id AS rel FROM documents"


def state_sql(text: str, init: str = "0") -> str:
    """The polynomial state of a SQL string expression."""
    return (
        f"list_reduce(list_transform(string_split({text}, ''), lambda c: unicode(c)::BIGINT), "
        "lambda h, c: CASE WHEN c < 65536 THEN (h * 31 + c) & 4294967295 "
        "ELSE ((h * 31 + 55296 + ((c - 65536) >> 10)) * 31 + 56320 + ((c - 65536) & 1023)) & 4294967295 END, "
        f"({init})::BIGINT)"
    )


def final_sql(state: str) -> str:
    return (
        f"list_transform(list_transform([{state}], "
        "lambda v: (xor(v, v >> 16) * 73244475) & 4294967295), lambda v: xor(v, v >> 16))[1]"
    )


def position_sql(text: str) -> str:
    return final_sql(state_sql(text))


def ring_sql(source: str = "s_name", rel: str = "s_name", table_name: str = "supplier", seed: int = SEED) -> str:
    key = f"'{seed}:overlay:' || {rel}"
    return f"SELECT pos, min(src) AS src FROM (SELECT {position_sql(key)} AS pos, {source} AS src FROM {table_name}) GROUP BY pos"


def placed_sql(keys: str, columns: str, ring: str | None = None, out: str = "overlay") -> str:
    """ASOF lookup with wrap-around of ``keys(..., pos)``."""
    return (
        f"SELECT {columns}, coalesce(r.src, (SELECT arg_min(src, pos) FROM ({ring or ring_sql()}))) AS {out} "
        f"FROM ({keys}) k ASOF LEFT JOIN ({ring or ring_sql()}) r ON k.pos <= r.pos"
    )
