"""What the corpus operators share: Arrow batches in, one struct column out; stashed tables.

Rows travel as Arrow batches of bounded bytes, so a worker's memory does not depend on
the length of a partition. Intermediate tables go to the folder that the cluster shares.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Arrow batches of the operators: rows and bytes at most.
BATCH_ROWS = 1_000
BATCH_BYTES = "8m"


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: a batch of very long texts must fit a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a folder of its own; a cluster has to name one,
    as its executors share no local folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="strata-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stash_dir(spark: SparkSession) -> str:
    """This application's folder of stashed tables, which goes when its driver ends."""
    path = f"{shared_dir(spark)}/strata-{spark.sparkContext.applicationId}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(folder):
        system.mkdirs(folder)
        system.deleteOnExit(folder)
    return path


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts lineage: lost executors cost a read of the table, not its computation.
    """
    spark = df.sparkSession
    path = f"{stash_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def named(column: str) -> Column:
    """A column by its name, whatever signs the name has."""
    return F.col("`" + column.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many ``_`` behind it as make it differ from all columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_struct(
    df: DataFrame,
    text_col: str,
    out: str,
    kind: T.StructType,
    make: Callable[[], Callable[[list[bytes]], dict[str, Any]]],
) -> DataFrame:
    """Append the struct column ``out``, computed from whole texts as UTF-8 bytes.

    ``make()`` runs once per task and returns the function of a batch: texts in, a list
    per field out. A null text comes as ``b""``. A column already named ``out`` is
    replaced; all others pass through unchanged, whatever their names.
    """
    bound_batches(df.sparkSession)
    kept = df.select(*[named(c) for c in df.columns if c.lower() != out.lower()])
    at = kept.columns.index(text_col)
    fields = [(f.name, to_arrow_type(f.dataType)) for f in kind.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            got = work([t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()])
            made = pa.StructArray.from_arrays(
                [pa.array(got[name], arrow) for name, arrow in fields],
                fields=[pa.field(name, arrow) for name, arrow in fields],
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, "made"])

    return map_arrow(kept, run, [*kept.schema.fields, T.StructField(out, kind)])


def map_arrow(df: DataFrame, run: Callable, fields: list[T.StructField]) -> DataFrame:
    """``df.mapInArrow(run)`` with rows of ``fields``, where any names are allowed.

    On the way columns are called by their places; ``run`` may give any names to its own.
    """

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield batch.rename_columns([f"c{k}" for k in range(batch.num_columns)])

    schema = T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(fields)])
    by_place = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    return by_place.mapInArrow(placed, schema).toDF(*[f.name for f in fields])


def joined_digest(parts: Column, sep: str) -> Column:
    """Lower-case SHA-256 hex of an array of strings, joined."""
    return F.sha2(F.array_join(parts, sep), 256)
