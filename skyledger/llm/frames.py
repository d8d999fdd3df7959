"""Small helpers around ``mapInArrow``."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from skyledger.llm.words import CHUNK, chunks

Compute = Callable[[pa.RecordBatch, list[bytes]], dict[str, list]]


_shipped: set[str] = set()


def shipped(spark: SparkSession) -> SparkSession:
    """Sends this package to the workers of a session started without it on their path."""
    root = Path(__file__).resolve().parents[2]
    there = [Path.cwd(), *map(Path, os.environ.get("PYTHONPATH", "").split(os.pathsep))]
    name = spark.sparkContext.applicationId
    if root not in there and name not in _shipped:
        path = Path(tempfile.mkdtemp(prefix="skyledger-"), "skyledger.zip")
        with zipfile.ZipFile(path, "w") as out:
            for file in sorted((root / "skyledger").rglob("*.py")):
                out.write(file, file.relative_to(root))
        spark.sparkContext.addPyFile(str(path))  # Spark serves it to the executors
        _shipped.add(name)
    return spark


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def set_aside(df: DataFrame, keep: Sequence[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with all columns but ``keep`` under names that no result has, and the way back:
    the columns that came in, under their names and in their order, results left out."""
    names = df.columns
    private = [c if c in keep else f"~{i}" for i, c in enumerate(names)]

    def restored(out: DataFrame) -> DataFrame:
        return out.select(*[F.col(f"`{p}`").alias(c) for p, c in zip(private, names)])

    return df.toDF(*private), restored


def add_columns(
    df: DataFrame,
    text: str,
    ddl: str,
    compute: Compute,
    limit: int = CHUNK,
    packed: bool = False,
) -> DataFrame:
    """``df`` with the columns of ``ddl`` worked out from whole texts, some MB at a time.

    With ``packed`` the column ``text`` holds zstd frames, and texts are unpacked on the way.

    Input columns named like a new one, in any case, are replaced; the text is read before that.
    Names that begin with two underscores are kept for the operators' own use.
    """
    new = struct(ddl)
    arrow = to_arrow_schema(new)
    names = df.columns
    replaced = {n.lower() for n in new.names}
    kept = [i for i, n in enumerate(names) if n.lower() not in replaced]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = (b.rename_columns(names) for b in batches)
        for batch, texts in chunks(named, text, limit, packed):
            got = compute(batch, texts)
            arrays = [batch.column(i) for i in kept]
            arrays += [pa.array(got[f.name], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(arrays, names=out.names)

    # Positions stand in for names on the way: names may hold dots.
    fields = [T.StructField(f"c{i}", df.schema.fields[i].dataType) for i in kept]
    fields += [T.StructField(f"n{i}", f.dataType) for i, f in enumerate(new.fields)]
    out = T.StructType(fields)
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.mapInArrow(run, out).toDF(*[names[i] for i in kept], *new.names)


def map_texts(
    df: DataFrame, text: str, ddl: str, compute: Compute, limit: int = CHUNK
) -> DataFrame:
    """Any number of rows of ``ddl`` for each some MB of texts."""
    out = struct(ddl)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, text, limit):
            got = compute(batch, texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(got[f.name], f.type) for f in arrow], names=arrow.names
            )

    return df.mapInArrow(run, out)
