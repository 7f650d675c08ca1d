"""Rows of datasets: an append-only Parquet log per spec, and the landed slice of a build.

A build's new versions are one folder ``build_id=<id>``; they are visible once the commit
that ends the build lists it, so a build that dies leaves nothing to see. Nothing is
rewritten, and a read of a range of builds opens its folders only.

Every ``SNAPSHOT_EVERY`` builds the open versions of a store are written once more, as a
snapshot. A merge and a read of what is current start from the newest snapshot and the
builds after it, so their cost doesn't grow with the length of history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import spark_type
from ..operators import history
from ..operators.transfer import INIT, Shape, open_versions
from .metalog import MetaLog, full_row


SNAPSHOT_EVERY = 16


def typed(attrs: list[dict], names: tuple[str, ...]) -> list[T.StructField]:
    by_name = {a["attr_code"]: T.StructField(a["attr_code"], spark_type(a["type_code"])) for a in attrs}
    return [by_name[n] for n in names]


def shape_of(attrs: list[dict], chunk: str | None = None) -> Shape:
    return Shape(tuple(a["attr_code"] for a in attrs if a["is_primary"]), tuple(a["attr_code"] for a in attrs if not a["is_primary"]), chunk)


class SpecStorage:
    """Storage of one spec since its creation (``storage`` is the version that created it)."""

    def __init__(self, spark: SparkSession, files, meta: MetaLog, dataset: str, num: int, storage: int, attrs: list[dict], chunk: str | None = None):
        self.spark, self.files, self.meta = spark, files, meta
        self.dataset, self.num, self.storage, self.attrs = dataset, num, storage, attrs
        self.shape = shape_of(attrs, chunk)
        schema, name = dataset.split(".")
        self.folder = f"data/{schema}/{name}_{num}/v{storage}"
        self.landing = f"iface/{schema}/{name}_{num}/v{storage}"

    @property
    def landed_schema(self) -> T.StructType:
        flag = T.StructField("is_active", T.BooleanType())
        return T.StructType([*typed(self.attrs, self.shape.key), flag, *typed(self.attrs, self.shape.rest)])

    @property
    def log_schema(self) -> T.StructType:
        own = [T.StructField("build_id", T.LongType()), T.StructField("is_active", T.BooleanType())]
        return T.StructType([*typed(self.attrs, self.shape.key), *own, *typed(self.attrs, self.shape.rest)])

    # The landed slice.

    def truncate(self) -> None:
        self.files.drop(self.landing)

    def land(self, df: DataFrame) -> None:
        """Write a slice; columns by name, cast to their declared types, missing ones null."""
        given = {c.lower(): c for c in df.columns}
        columns = [(F.col(f"`{given[f.name]}`") if f.name in given else F.lit(True if f.name == "is_active" else None)).cast(f.dataType).alias(f.name) for f in self.landed_schema]
        df.select(*columns).write.mode("append").parquet(self.files.path(self.landing))

    def landed(self) -> DataFrame:
        if not self.files.names(self.landing):
            return self.spark.createDataFrame([], self.landed_schema)
        return self.spark.read.schema(self.landed_schema).parquet(self.files.path(self.landing))

    # The log.

    def builds(self) -> list[dict]:
        return self.meta.all("manifest", dataset_code=self.dataset, build_spec_num=self.num, storage=self.storage)

    def append(self, versions: DataFrame, build_id: int) -> DataFrame:
        """Write a build's versions, not yet visible, and read them back."""
        path = self.files.path(f"{self.folder}/build_id={build_id}")
        versions.drop("build_id").write.mode("overwrite").parquet(path)
        own = T.StructType([f for f in versions.schema if f.name != "build_id"])
        return self.spark.read.schema(own).parquet(path)

    def log(self, after: int = 0) -> DataFrame:
        """Visible versions of builds after ``after``. Flags of the transfer, which the files also hold, are not read."""
        paths = [self.files.path(f"{self.folder}/build_id={b['build_id']}") for b in self.builds() if b["build_id"] > after]
        if not paths:
            return self.spark.createDataFrame([], self.log_schema)
        found = self.spark.read.schema(self.log_schema).option("basePath", self.files.path(self.folder)).parquet(*paths)
        return found.select(*self.log_schema.names)

    def recent_log(self) -> DataFrame:
        """Versions among which the newest of each key is its open one: the snapshot and what came after it."""
        last = self._snapshot()
        if last is None:
            return self.log()
        shot = self.spark.read.schema(self.log_schema).parquet(self.files.path(f"{self.folder}/open/{last}"))
        return shot.unionByName(self.log(last))

    def _snapshot(self) -> int | None:
        return max((r["build_id"] for r in self.meta.all("snapshot", dataset_code=self.dataset, build_spec_num=self.num, storage=self.storage)), default=None)

    def snapshot_due(self) -> bool:
        last = self._snapshot() or 0
        return sum(b["build_id"] > last for b in self.builds()) >= SNAPSHOT_EVERY

    def write_snapshot(self) -> dict:
        """Write the open versions; the row that makes the snapshot visible."""
        newest = max(b["build_id"] for b in self.builds())
        shown = open_versions(self.recent_log(), self.shape)
        shown.write.mode("overwrite").parquet(self.files.path(f"{self.folder}/open/{newest}"))
        return full_row("snapshot", dataset_code=self.dataset, build_spec_num=self.num, storage=self.storage, build_id=newest)

    def is_empty(self) -> bool:
        """No version at all; the first build with rows ends this, so few folders are looked at."""
        return self.log().isEmpty()

    def _resends(self) -> list[int]:
        return [b["build_id"] for b in self.builds() if b["transfer"] == INIT]

    def history(self, dataset_type: str) -> DataFrame:
        if dataset_type == "mart":
            return history.mart_history(self.log(), self.shape, self._resends())
        return history.store_history(self.log(), self.shape)

    def current(self, dataset_type: str) -> DataFrame:
        if dataset_type == "mart":
            return self.history(dataset_type).filter("end_build_id IS NULL")
        return history.store_current(self.recent_log(), self.shape)

    def as_of(self, dataset_type: str, build_id: int) -> DataFrame:
        if dataset_type == "mart":
            return history.as_of(self.history(dataset_type), build_id)
        return history.store_as_of(self.log(), self.shape, build_id)

    def delta(self, dataset_type: str, from_build_id: int, to_build_id: int, current: bool = True) -> DataFrame:
        if dataset_type == "mart":
            shown = history.mart_history(self.log(from_build_id), self.shape, self._resends())
            return history.delta(shown, from_build_id, to_build_id, current)
        return history.store_delta(self.log(from_build_id), self.shape, from_build_id, to_build_id, current)

    def drop(self) -> None:
        self.files.drop(self.folder)
        self.files.drop(self.landing)
