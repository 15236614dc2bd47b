"""Tables replaced as a whole: a new version is written aside, then one rename makes it the current one.

A folder holds versions/<name>/<table> and a file _current that names one of them.  The file is replaced by an atomic rename that overwrites (FileContext), so readers see the old
version or the new one and never a part; a writer that fails leaves only files that nothing names, and removes them.  The newest KEEP versions stay as backups.
One writer at a time: two that start from one version are told apart by the version expected.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

KEEP = 3


class Conflict(Exception):
    """Another version has become current."""


class Versions:
    def __init__(self, spark: SparkSession, path: str, keep: int = KEEP):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        self.hadoop, self.conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def current(self) -> str | None:
        """Name of the version that readers see."""
        at = self._path("_current")
        if not self.fs.exists(at):
            return None
        stream = self.fs.open(at)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
        finally:
            stream.close()

    def names(self) -> list[str]:
        """All whole versions, oldest first."""
        at = self._path("versions")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, table: str = "table", version: str | None = None) -> DataFrame | None:
        name = version or self.current()
        return self.spark.read.parquet(f"{self.path}/versions/{name}/{table}") if name else None

    def write(self, tables: dict[str, DataFrame] | DataFrame, expected: str | None | bool = False) -> str:
        """Write all tables as one version and make it current; expected: the version that this one follows, if that is to be checked."""
        if isinstance(tables, DataFrame):
            tables = {"table": tables}
        before = self.current()
        number = int(before.split("-")[1]) + 1 if before else 1
        name = f"v-{number:08d}-{uuid.uuid4().hex[:8]}"
        aside = f"_aside-{name}"
        try:
            for table, df in tables.items():
                df.write.parquet(f"{self.path}/{aside}/{table}")
            if expected is not False and self.current() != expected:
                raise Conflict(f"{self.current()} is current, not {expected}")
            self.fs.mkdirs(self._path("versions"))
            if not self.fs.rename(self._path(aside), self._path(f"versions/{name}")):
                raise OSError(f"{name} could not be put in place")
        finally:
            if self.fs.exists(self._path(aside)):
                self.fs.delete(self._path(aside), True)
        self._point(name)
        for old in [n for n in self.names() if n != name][: -self.keep or None]:
            self.fs.delete(self._path(f"versions/{old}"), True)
        return name

    def restore(self, version: str) -> None:
        """Make an earlier version current again."""
        if version not in self.names():
            raise ValueError(f"no version {version}")
        self._point(version)

    def _point(self, name: str) -> None:
        new = self._path(f"_next-{uuid.uuid4().hex[:8]}")
        stream = self.fs.create(new, True)
        stream.write(bytearray(name.encode()))
        stream.close()
        how = getattr(self.hadoop, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(how, 1)
        options[0] = how.OVERWRITE
        at = self.fs.makeQualified(self._path("_current"))
        self.hadoop.FileContext.getFileContext(at.toUri(), self.conf).rename(self.fs.makeQualified(new), at, options)
