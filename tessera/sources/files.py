"""File sources and sinks: JSON lines, one JSON object, loose JSON arrays, YAML, shards."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codes import shard
from ..operators.relational import require_unique


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, or in local mode a temporary one where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
    return f"{base.rstrip('/')}/files-{uuid.uuid4().hex[:12]}"


def scan_json_lines(spark: SparkSession, path: str, schema: T.StructType | str, key: str) -> DataFrame:
    """JSON lines, compressed or not; blank lines are skipped and a key that occurs twice is an error."""
    return require_unique(spark.read.schema(schema).json(path).where(F.col(key).isNotNull()), key)


def scan_json_object(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """One JSON object by key -> rows (key, fields); fields: name -> type, at the top of each value."""
    whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    rows = whole.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).alias("e"))
    return rows.select(F.col("e.key").alias("key"), *[F.variant_get("e.value", f"$.{n}", t).alias(n) for n, t in fields.items()])


def scan_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array with one object a line, trailing commas and brackets left out."""
    line = F.regexp_replace(F.trim("value"), r"^\[|,$|\]$", "")
    return spark.read.text(path).select(F.from_json(F.trim(line), schema).alias("v"), F.trim(line).alias("l")).where("l <> ''").select("v.*")


def scan_yaml(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A list of mappings in YAML, a file small enough to be written by hand."""
    import yaml

    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    names = T._parse_datatype_string(schema).names
    return spark.createDataFrame([tuple(x.get(n) for n in names) for x in yaml.safe_load(text) or []], schema)


def write_shards(df: DataFrame, path: str, key: str, shards: int = 64) -> None:
    """Parquet by the MD5 of a key, one folder per shard."""
    df.withColumn("shard", shard(F.col(key).cast("string"), shards)).repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)


def unclassified(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (path) that no entry of a manifest (prefix, public) lets out."""
    allowed = manifest.where("public").select("prefix")
    return files.join(F.broadcast(allowed), F.col("path").startswith(F.col("prefix")), "left_anti")
