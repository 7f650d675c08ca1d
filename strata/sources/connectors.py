"""Classes of connections, and handles that a body reads them with.

A handle is a context: ``with crm() as c: c.read("select ...")`` gives a DataFrame over
JDBC. Reads can be split over executors by a numeric column and its bounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..errors import CONNECTION_FAILURE, INVALID_PARAMETER_VALUE, StrataError
from ..plans.commands import Assign

#: The implicit connection to the installation itself; never declared.
WAREHOUSE = "warehouse"
PROBE_SECONDS = 30


@dataclass(frozen=True)
class Field:
    name: str
    kind: str = "string"
    secret: bool = False


@dataclass(frozen=True)
class ConnectionClass:
    fields: tuple[Field, ...]
    url: str
    driver: str
    probe: str


_COMMON = (Field("host_name"), Field("port_num", "number"))
_LOGIN = (Field("user_name"), Field("password", secret=True))
CLASSES: dict[str, ConnectionClass] = {
    "oracle": ConnectionClass((*_COMMON, Field("service_name"), *_LOGIN), "jdbc:oracle:thin:@//{host_name}:{port_num}/{service_name}", "oracle.jdbc.OracleDriver", "select 1 from dual"),
    "postgres": ConnectionClass((*_COMMON, Field("database_name"), *_LOGIN), "jdbc:postgresql://{host_name}:{port_num}/{database_name}", "org.postgresql.Driver", "select 1"),
}


def secret_fields(class_code: str) -> set[str]:
    return {f.name for f in CLASSES[class_code].fields if f.secret}


def checked_params(class_code: str, given: tuple[Assign, ...]) -> dict[str, str | int]:
    """Values of all fields of the class; the first fault is reported at its place."""
    fields = {f.name: f for f in CLASSES[class_code].fields}
    out: dict[str, str | int] = {}

    def fault(message: str, pos: int | None = None, hint: str | None = None) -> StrataError:
        return StrataError(message, pos=pos, hint=hint, sqlstate=INVALID_PARAMETER_VALUE)

    for a in given:
        name = a.name.text
        if name not in fields:
            raise fault(f"class {class_code} has no field {name!r}", a.name.pos, "fields: " + ", ".join(fields))
        if name in out:
            raise fault(f"field {name!r} is set twice", a.name.pos)
        if a.value.kind != fields[name].kind:
            raise fault(f"field {name!r} takes a {fields[name].kind}", a.value.pos)
        out[name] = int(a.value.text) if a.value.kind == "number" else a.value.text
    for name in fields:
        if name not in out:
            raise fault(f"class {class_code} needs a field {name!r}")
    return out


class JdbcHandle:
    def __init__(self, spark: SparkSession, class_code: str, params: dict):
        self.spark, self.kind, self.params = spark, CLASSES[class_code], params
        self.options = {
            "url": self.kind.url.format(**params),
            "driver": self.kind.driver,
            "user": params["user_name"],
            "password": params["password"],
            "fetchsize": "10000",
        }

    def read(self, query: str, partition_column: str | None = None, lower: int | None = None, upper: int | None = None, partitions: int = 1) -> DataFrame:
        """Rows of a query; with a column and its bounds, read in parallel."""
        reader = self.spark.read.format("jdbc").options(**self.options)
        if partition_column is None:
            return reader.option("query", query).load()
        bounds = {"partitionColumn": partition_column, "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(partitions)}
        return reader.option("dbtable", f"({query}) q").options(**bounds).load()

    def write(self, df: DataFrame, table: str, mode: str = "append") -> None:
        df.write.format("jdbc").options(**self.options, dbtable=table).mode(mode).save()

    def probe(self) -> None:
        options = self.options | {"query": self.kind.probe, "queryTimeout": str(PROBE_SECONDS)}
        try:
            self.spark.read.format("jdbc").options(**options).load().collect()
        except Exception as e:
            first = str(e).strip().splitlines()[0][:300] if str(e).strip() else type(e).__name__
            raise StrataError(f"the connection does not answer: {first}", sqlstate=CONNECTION_FAILURE) from e


def factory(make: Callable[[], object]) -> Callable:
    """A context manager that hands out what ``make`` returns."""

    @contextmanager
    def connect() -> Iterator[object]:
        handle = make()
        try:
            yield handle
        finally:
            if hasattr(handle, "close"):
                handle.close()

    return connect


class WarehouseHandle:
    """What a body may do with the installation: query it, and land a slice for its build."""

    def __init__(self, spark: SparkSession, reads: dict[str, Callable[..., DataFrame]], land: Callable[[DataFrame], None] | None):
        self.spark, self._land = spark, land
        # The engine's own reads: sql, table, current, as_of, delta.
        self.__dict__ |= reads

    def write_interface(self, df: DataFrame) -> None:
        if self._land is None:
            raise StrataError("only the body of a build lands a slice", sqlstate=INVALID_PARAMETER_VALUE)
        self._land(df)
