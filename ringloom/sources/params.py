"""Run parameters: legacy keys, defaults, and the manifest that reproduces a run."""

from __future__ import annotations

import secrets
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringloom.functions.hashing import seed_from_text

# Parameter names, types, superseded names and defaults of a stored run.
STORED = (
    ("overlay_dir", "string", "input_dir", "dataset/"),
    ("texture_dir", "string", "target_dir", "target/"),
    ("output_dir", "string", "source_dir", ""),
    ("seed", "bigint", None, 0),
    ("per_frame", "boolean", None, False),
    ("entity_regions", "string", None, ""),
    ("entity_face_mode", "string", None, "same"),
    ("entity_texture_mode", "string", None, "shared"),
    ("alpha", "double", None, 0.75),
    ("scale", "int", None, 4),
    ("keep_aspect", "boolean", None, False),
    ("overlay_scale", "double", None, 1.0),
    ("fast_overlay_size", "int", None, 0),
)


@dataclass(frozen=True)
class RunParameters:
    """A new run's parameters; a stored run that omits the pre-resize size means none."""

    overlay_dir: str = ""
    texture_dir: str = ""
    output_dir: str = ""
    seed: int = 0
    per_frame: bool = False
    entity_regions: str = ""
    entity_face_mode: str = "same"
    entity_texture_mode: str = "shared"
    alpha: float = 0.75
    scale: int = 4
    keep_aspect: bool = False
    overlay_scale: float = 1.0
    fast_overlay_size: int = 512
    path_config: str = field(default="")

    def with_seed(self, text: str) -> RunParameters:
        return replace(self, seed=seed_from_text(text))

    def with_random_seed(self) -> RunParameters:
        """Drawn once, here, and recorded in the manifest; never inside a plan."""
        return replace(self, seed=secrets.randbelow(2**32 - 1))

    def blend_defaults(self) -> dict[str, object]:
        return {
            "scale": self.scale,
            "alpha": self.alpha,
            "overlay_scale": self.overlay_scale,
            "keep_aspect": self.keep_aspect,
            "fast_overlay_size": self.fast_overlay_size,
        }


def parse_parameters(documents: DataFrame, value: str = "value") -> DataFrame:
    """Stored parameters from JSON text: the key, else its superseded name, else the default."""
    rest = [c for c in documents.columns if c != value]
    names = [n for n, _, old, _ in STORED for n in (n, old) if n]
    kinds = {n: kind for n, kind, _, _ in STORED} | {old: kind for _, kind, old, _ in STORED if old}
    schema = ", ".join(f"{n}: {'double' if n == 'seed' else kinds[n]}" for n in names)
    parsed = documents.select(*rest, value, F.from_json(value, f"struct<{schema}>").alias("p"))

    def resolved(name: str, kind: str, old: str | None, default: object) -> Column:
        options = [F.col(f"p.{name}")] + ([F.col(f"p.{old}")] if old else [])
        return F.coalesce(*[c.cast(kind) for c in options], F.lit(default).cast(kind)).alias(name)

    return parsed.select(
        *rest,
        *[resolved(*row) for row in STORED],
        F.coalesce(F.get_json_object(value, "$.path_config"), F.lit("")).alias("path_config"),
    )


def read_parameters(spark: SparkSession, path: str) -> RunParameters:
    """One stored run; malformed JSON is an error."""
    text = spark.read.text(path, wholetext=True)
    valid = F.get_json_object("value", "$").isNotNull()
    row = parse_parameters(text.filter(valid)).first()
    if row is None:
        raise ValueError(f"Invalid JSON in: {path}")
    return RunParameters(**row.asDict())


def manifest_documents(runs: DataFrame) -> DataFrame:
    """``runs`` plus ``value``, the stored form; an empty ``path_config`` is omitted.

    ``path_config`` is itself JSON text and is embedded as an object.
    """
    names = [n for n, *_ in STORED]
    body = F.to_json(F.struct(*names))
    config = F.col("path_config")
    embedded = F.concat(F.regexp_replace(body, r"\}$", ',"path_config":'), config, F.lit("}"))
    return runs.withColumn("value", F.when(F.coalesce(config, F.lit("")) == "", body).otherwise(embedded))


def write_manifest(spark: SparkSession, params: RunParameters, folder: str) -> None:
    """One document beside the output; the seed is always recorded."""
    kinds = ", ".join([f"{n} {kind}" for n, kind, _, _ in STORED] + ["path_config string"])
    values = asdict(params)
    row = spark.createDataFrame([tuple(values[n] for n in [*(s[0] for s in STORED), "path_config"])], kinds)
    manifest_documents(row).select("value").coalesce(1).write.mode("overwrite").text(folder)
