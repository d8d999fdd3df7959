"""A table that grows file by file: one part for each input file, found through a small index.

A part is a folder of tables below a name of its own. It takes its place by one small file, written
last, so a run that stops half-way leaves the store as it was. Putting a name again replaces its
part. One short row for each file reaches the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from skyledger.sources.tables import drop_table, write_table

INDEX = T.StructType([T.StructField(c, T.StringType()) for c in ("name", "part")])


@dataclass(frozen=True)
class PartStore:
    """Parts below ``folder``, which all executors share."""

    spark: SparkSession
    folder: str

    def parts(self) -> dict[str, str]:
        """The folder of each file's part."""
        path = f"{self.folder}/index"
        if not self._exists(path):
            return {}
        entries = self.spark.read.schema(INDEX).parquet(f"{path}/*").collect()
        return {r["name"]: r["part"] for r in entries}

    def put(self, name: str, tables: Mapping[str, DataFrame]) -> None:
        """Writes the tables of one file's part, and then the entry that points to it."""
        old = self.parts().get(name)
        part = f"{self.folder}/parts/{uuid.uuid4().hex}"
        for table, df in tables.items():
            write_table(df, f"{part}/{table}")
        entry = self.spark.createDataFrame([(name, part)], INDEX)
        entry.coalesce(1).write.mode("overwrite").parquet(self._entry(name))
        if old:
            drop_table(self.spark, old)

    def forget(self, name: str) -> None:
        """Takes a file's part out."""
        old = self.parts().get(name)
        if old:
            drop_table(self.spark, self._entry(name))
            drop_table(self.spark, old)

    def read(self, table: str, parts: Sequence[str] | None = None) -> DataFrame:
        """A table of all parts, laid under each other."""
        held = [p for p in parts or self.parts().values() if self._exists(f"{p}/{table}")]
        if not held:
            raise ValueError(f"no file of {table} has been added to {self.folder}")
        first = self.spark.read.parquet(f"{held[0]}/{table}")
        return self.spark.read.schema(first.schema).parquet(*[f"{p}/{table}" for p in held])

    def _entry(self, name: str) -> str:
        return f"{self.folder}/index/{name.encode().hex()}"

    def _exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        files = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return files.exists(where) and len(files.listStatus(where)) > 0
