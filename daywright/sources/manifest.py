"""Output folders that a run can be resumed in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ENTRY = "name string, fingerprint string, schema string, rows long"


class Manifest:
    """Tables below ``folder``, each with an entry (input fingerprint, schema, rows) once it is whole.

    A table is written beside its place and put there by one rename; the entry follows. What a run left
    without an entry, or with another fingerprint, is written anew.
    """

    def __init__(self, spark: SparkSession, folder: str, fingerprint: str):
        self.spark, self.folder, self.fingerprint = spark, folder.rstrip("/"), fingerprint

    def entry(self, name: str):
        try:
            rows = self.spark.read.schema(_ENTRY).json(f"{self.folder}/manifest/{name}").collect()
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return None
        return rows[0] if rows else None

    def keep(self, name: str, made: Callable[[], DataFrame]) -> DataFrame:
        """The table of that name: read if it is finished for the same input, else made, written and read."""
        path = f"{self.folder}/{name}"
        done = self.entry(name)
        if done is not None and done.fingerprint == self.fingerprint:
            finished = self._read(path)
            if finished is not None and finished.schema.json() == done.schema and finished.count() == done.rows:
                return finished
        self._remove(f"{self.folder}/manifest/{name}")
        made().write.mode("overwrite").parquet(f"{path}.new")
        self._remove(path)
        if not self._system(path).rename(self._path(f"{path}.new"), self._path(path)):
            raise OSError(f"cannot rename {path}.new to {path}")
        table = self._read(path)
        entry = self.spark.createDataFrame([(name, self.fingerprint, table.schema.json(), table.count())], _ENTRY)
        entry.coalesce(1).write.mode("overwrite").json(f"{self.folder}/manifest/{name}")
        return table

    def entries(self) -> DataFrame:
        return self.spark.read.schema(_ENTRY).json(f"{self.folder}/manifest/*").where(F.col("name").isNotNull())

    def _read(self, path: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(path)
        except AnalysisException:  # the folder is gone or holds no table
            return None

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _system(self, path: str):
        return self._path(path).getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _remove(self, path: str) -> None:
        self._system(path).delete(self._path(path), True)
