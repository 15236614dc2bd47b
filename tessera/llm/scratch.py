"""Written tables in the shared folder that cut lineage, and the freeing of what they replace."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOTS: dict[str, tuple[SparkSession, str]] = {}


def folder(spark: SparkSession) -> str:
    """A folder of this session below spark.checkpoint.dir; that setting is made only where it is unset."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
            spark.sparkContext.setCheckpointDir(base)
        _ROOTS[app] = spark, f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex[:12]}"
    return _ROOTS[app][1]


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _end() -> None:
    for spark, path in _ROOTS.values():
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended before
            pass


def bound_batches(spark: SparkSession, most: str = "4m") -> None:
    """Let a batch of rows sent to Python hold a few MB of text, where the session has not set a size itself."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, most)


class Scratch:
    """Tables of one operator call; drop() deletes those that later tables no longer need."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths = spark, f"{folder(spark)}/{uuid.uuid4().hex[:12]}", {}
        bound_batches(spark)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{len(self.paths)}"
        self.free()
        df.write.mode("overwrite").parquet(path)
        self.paths[name] = path
        schema = df.schema
        del df
        self.free()
        return self.spark.read.schema(schema).parquet(path)

    def size(self, name: str) -> int:
        """Bytes of a written table."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.paths[name])
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.paths:
                _delete(self.spark, self.paths.pop(name))

    def free(self) -> None:
        """Let Spark's cleaner remove the shuffle files of plans that are no longer held."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def keep_names(df: DataFrame, taken: list[str]) -> list[str]:
    """Columns of df but for those an operator writes: its own result replaces a column of that name."""
    low = {x.lower() for x in taken}
    return [c for c in df.columns if c.lower() not in low]


def quoted(columns: list[str]) -> list[str]:
    """Names for select(): a dot in a name is no field."""
    return [f"`{c}`" for c in columns]


def inner(name: str, columns: list[str]) -> str:
    """A name for a column of an operator's own that no input column has, whatever its case."""
    low = {c.lower() for c in columns}
    out = f"__{name}"
    while out.lower() in low:
        out = f"_{out}"
    return out


def hash_sample(rows: DataFrame, n: int) -> DataFrame:
    """About n to 2 n distinct rows by least hash, all if there are fewer; no task or driver holds more than these."""
    total = rows.count()
    hashed = rows.withColumn("__hash", F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]))
    if total > 2 * n:
        hashed = hashed.where(F.col("__hash") < -(1 << 63) + int((1 << 64) * (2 * n / total)))
    return hashed.distinct().orderBy("__hash", *[F.col(f"`{c}`") for c in rows.columns]).limit(2 * n).drop("__hash")
