"""Model folders and checkpoints: which one is meant, what it holds, and how its keys are named elsewhere.

Models are few; a loader for each model type plugs in by ``register``. Null keys and paths stay null or are left out where said;
repeated keys and paths are kept each; empty tables give no rows, and an empty model has no tied head. Further columns are not
read.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.functions.names import file_name, rewrite, trailing_number

#: How keys of pre-trained speech models are named in the other library; the first pattern that matches counts.
KEY_RULES: list[tuple[str, str | None | tuple[tuple[str, str], ...]]] = [
    (r"^(final_proj\.weight|final_proj\.bias|label_embs_concat)$", None),
    (r"^post_extract_proj\.", "feature_projection.projection."),
    (r"^layer_norm\.", "feature_projection.layer_norm."),
    (r"^mask_emb$", "masked_spec_embed"),
    (r"^feature_extractor\.conv_layers\.([0-6])\.0\.", "feature_extractor.conv_layers.$1.conv."),
    (r"^feature_extractor\.conv_layers\.0\.2\.", "feature_extractor.conv_layers.0.layer_norm."),
    (
        r"^encoder\.pos_conv\.0\.",
        (
            ("encoder.pos_conv.0.", "encoder.pos_conv_embed.conv."),
            ("weight_g", "parametrizations.weight.original0"),
            ("weight_v", "parametrizations.weight.original1"),
        ),
    ),
    (
        r"^encoder\.layers\.",
        (
            (".self_attn.", ".attention."),
            (".self_attn_layer_norm.", ".layer_norm."),
            (".fc1.", ".feed_forward.intermediate_dense."),
            (".fc2.", ".feed_forward.output_dense."),
        ),
    ),
]

_LOADERS: dict[str, Callable[..., Any]] = {}


def converted_keys(df: DataFrame, key: str = "key") -> DataFrame:
    """(key, new_key) of the keys that are kept."""
    return df.select(key, rewrite(F.col(key), KEY_RULES).alias("new_key")).where("new_key IS NOT NULL")


def with_tied_head(keys: DataFrame, key: str = "key") -> DataFrame:
    """(key, source): every key from itself; a model whose head is missing takes the embedding as its head."""
    own = keys.select(F.col(key).alias("key"), F.col(key).alias("source"))
    head, embedding = "lm_head.weight", "transformer.wte.weight"
    has = own.agg(F.coalesce(F.max((F.col("key") == head).cast("int")), F.lit(0)).alias("h"), F.coalesce(F.max((F.col("key") == embedding).cast("int")), F.lit(0)).alias("e"))
    return own.union(has.where("h = 0 AND e = 1").select(F.lit(head), F.lit(embedding)))


def model_tensors(tensors: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(key, name, dtype, shape, part, n_bytes, data): the tensors under the keys that a model needs, the tied head from its embedding.

    Data is read once and meets one row that says whether there is a head, found among ``names`` (a column ``name``, as from a
    scan of headers alone) or the tensors themselves.
    """
    head, embedding = "lm_head.weight", "transformer.wte.weight"
    has = (tensors if names is None else names).agg(F.coalesce(F.max((F.col("name") == head).cast("int")), F.lit(0)).alias("_head"))
    own = F.array("name")
    keys = F.when((F.col("name") == embedding) & (F.col("_head") == 0), F.concat(own, F.array(F.lit(head)))).otherwise(own)
    return tensors.drop("file").crossJoin(F.broadcast(has)).withColumn("key", F.explode(keys)).select("key", "name", "dtype", "shape", "part", "n_bytes", "data")


def latest_checkpoint(paths: DataFrame, run: str = "run", path: str = "path") -> DataFrame:
    """(run, path): of each run, the checkpoint of the highest number; null where no path ends in one."""
    return paths.groupBy(run).agg(F.max_by(path, trailing_number(F.col(path))).alias(path))


def retained(paths: DataFrame, run: str = "run", path: str = "path", keep: int = 3) -> DataFrame:
    """Checkpoints with ``kept``: the ``keep`` of highest number of each run. Paths that are no checkpoints are left out."""
    step = trailing_number(F.col(path))
    place = F.row_number().over(Window.partitionBy(run).orderBy(F.desc("step"), path))
    return paths.withColumn("step", step).where("step IS NOT NULL").withColumn("kept", place <= keep)


def latest_model(folders: DataFrame, prefix: Column, path: str = "path", changed: str = "modificationTime") -> DataFrame:
    """The folder changed last of those whose name starts with the prefix; no row without one, ties to the larger name."""
    known = folders.where(F.startswith(file_name(F.col(path)), prefix))
    return known.agg(F.max_by(path, F.struct(changed, path)).alias(path)).where(F.col(path).isNotNull())


def model_folders(spark: SparkSession, root: str) -> DataFrame:
    """(path, modificationTime) of the folders directly in ``root``; none where it doesn't exist. Models are few."""
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s for s in fs.listStatus(where) if s.isDirectory()] if fs.exists(where) else []
    rows = [(s.getPath().toString(), s.getModificationTime()) for s in found]
    return spark.createDataFrame(rows, "path string, ms bigint").select("path", F.timestamp_millis("ms").alias("modificationTime"))


def model_type(spark: SparkSession, folder: str) -> str:
    """What config.json says the model is; gpt2 where it doesn't say."""
    told = spark.read.schema("model_type string").option("multiLine", True).json(f"{folder}/config.json").first()
    return (told and told.model_type) or "gpt2"


def register(kind: str, load: Callable[..., Any]) -> None:
    """``load(folder, **options)`` makes the scorer of a model type; it runs once in each Python worker."""
    _LOADERS[kind] = load


def loader(spark: SparkSession, folder: str, **options) -> Callable[[], Any]:
    """A function without arguments for ``bigrams.score_with``, by the folder's model type."""
    kind = model_type(spark, folder)
    kind = kind if kind == "lstm" else "gpt2"
    if kind not in _LOADERS:
        raise ValueError(f"no loader is registered for {kind}; there are {sorted(_LOADERS)}")
    load = _LOADERS[kind]
    return lambda: load(folder, **options)
