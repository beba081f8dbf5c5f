"""Tables whose versions are committed at once: readers see a whole version or the one before it.

A table is a folder with `data/`, which holds Parquet written by Spark, and `commits/`, one small JSON file a
version. Rows are dealt to buckets by a hash of their key; a version names, for each bucket, the folder that
holds it. A change reads and writes the buckets of its keys alone, and nothing of it is seen until its commit
file is there. What a failed or killed change has written is named by no version, and `vacuum` deletes it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructField, StructType

BUCKET = "__bucket"


def _shown(kind: DataType) -> str:
    return kind.simpleString()


def additions(old: DataType, new: DataType, at: str = "") -> list[tuple[str, str]]:
    """Fields of `new` that `old` lacks, by their paths (element and value stand for those of arrays and maps), and their types.

    What `old` has beyond `new` stays and is no difference. A field whose type differs otherwise is refused: types never change.
    """
    here = lambda name: f"{at}.{name}" if at else name
    if isinstance(old, StructType) and isinstance(new, StructType):
        out = []
        for f in new:
            out += additions(old[f.name].dataType, f.dataType, here(f.name)) if f.name in old.fieldNames() else [(here(f.name), _shown(f.dataType))]
        return out
    if isinstance(old, ArrayType) and isinstance(new, ArrayType):
        return additions(old.elementType, new.elementType, here("element"))
    if isinstance(old, MapType) and isinstance(new, MapType):
        return additions(old.keyType, new.keyType, here("key")) + additions(old.valueType, new.valueType, here("value"))
    if _shown(old) != _shown(new):
        raise TypeError(f"{at or 'the schema'} is {_shown(old)} and can't become {_shown(new)}")
    return []


def grown(old: DataType, new: DataType) -> DataType:
    """`old` with all additions of `new` behind its own fields, at every depth; what is added may be null."""
    if isinstance(old, StructType) and isinstance(new, StructType):
        kept = [StructField(f.name, grown(f.dataType, new[f.name].dataType) if f.name in new.fieldNames() else f.dataType, f.nullable) for f in old]
        return StructType(kept + [StructField(f.name, f.dataType, True) for f in new if f.name not in old.fieldNames()])
    if isinstance(old, ArrayType) and isinstance(new, ArrayType):
        return ArrayType(grown(old.elementType, new.elementType), old.containsNull)
    if isinstance(old, MapType) and isinstance(new, MapType):
        return MapType(grown(old.keyType, new.keyType), grown(old.valueType, new.valueType), old.valueContainsNull)
    return old


def shaped(value: Column, have: DataType, want: DataType) -> Column:
    """A value with the fields that it lacks as nulls, in the order of the wanted type, at every depth."""
    if isinstance(want, StructType) and isinstance(have, StructType):
        fields = [(shaped(value[f.name], have[f.name].dataType, f.dataType) if f.name in have.fieldNames() else F.lit(None).cast(f.dataType)).alias(f.name) for f in want]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(want, ArrayType) and isinstance(have, ArrayType):
        return F.transform(value, lambda x: shaped(x, have.elementType, want.elementType))
    if isinstance(want, MapType) and isinstance(have, MapType):
        return F.transform_values(value, lambda k, v: shaped(v, have.valueType, want.valueType))
    return value.cast(want)


class Conflict(RuntimeError):
    """Another writer committed first; the change has to be made again on its version."""


@dataclass
class Version:
    """What a commit file says. folders: bucket to the data folder that holds it; batches: the last batch of each stream."""

    number: int
    schema: str
    key: str
    buckets: int
    folders: dict[str, str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)
    operation: str = "create"


class Storage:
    """What a table needs of the store that Spark's paths name: small files, written once."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.files = self.path(root).getFileSystem(self.conf)
        self.gateway = spark.sparkContext._gateway

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        where = self.path(folder)
        return sorted(s.getPath().getName() for s in self.files.listStatus(where)) if self.files.exists(where) else []

    def read(self, name: str) -> str:
        stream = self.files.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Put a file there whole unless there is one: written aside, then renamed without replacing."""
        aside = self.path(f"{name.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}.tmp")
        stream = self.files.create(aside, False)
        try:
            stream.write(text.encode())
        finally:
            stream.close()
        keep = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        keep[0] = getattr(self.jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.files.getUri(), self.conf).rename(aside, self.path(name), keep)
        except Exception as e:
            self.files.delete(aside, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def delete(self, name: str) -> None:
        self.files.delete(self.path(name), True)


class CommittedTable:
    """A table of rows with a key, read and changed by whole versions.

    The store must rename without replacing in one step, as HDFS does; on a local file system two writers at
    the very same moment could both succeed. Readers never lock: a DataFrame stays on the version it was made from,
    as long as `vacuum` keeps that.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.storage = Storage(spark, root)

    @classmethod
    def create(cls, spark: SparkSession, root: str, schema: StructType | str, key: str, buckets: int = 64) -> CommittedTable:
        """A new table without rows; Conflict where there is one."""
        made = cls(spark, root)
        parsed = spark.createDataFrame([], schema).schema
        if key not in parsed.fieldNames():
            raise ValueError(f"no column {key}")
        if BUCKET in parsed.fieldNames():
            raise ValueError(f"{BUCKET} is a name of the table's own")
        made._commit(Version(1, parsed.json(), key, buckets))
        return made

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.storage.names(f"{self.root}/commits") if n.endswith(".json") and n[:-5].isdigit()]

    def version(self, number: int | None = None) -> Version:
        number = number or max(self.versions(), default=0)
        if not number:
            raise FileNotFoundError(f"no table at {self.root}")
        return Version(**json.loads(self.storage.read(f"{self.root}/commits/{number:010d}.json")))

    def _commit(self, version: Version) -> Version:
        if not self.storage.publish(f"{self.root}/commits/{version.number:010d}.json", json.dumps(version.__dict__)):
            raise Conflict(f"version {version.number} of {self.root} is there already")
        return version

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version, the last one unless it is named."""
        return self._rows(self.version(number))

    def _rows(self, version: Version, buckets: list[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(version.schema))
        paths = [f"{self.root}/data/{f}/{BUCKET}={b}" for b, f in version.folders.items() if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def rows_near(self, keys: DataFrame, number: int | None = None) -> DataFrame:
        """All rows of the buckets that hold any of some keys; the buckets' numbers come to the driver."""
        version = self.version(number)
        buckets = [r[0] for r in keys.select(self._bucket(version, version.key)).distinct().collect()]
        return self._rows(version, buckets)

    def _bucket(self, version: Version, key: str):
        return F.pmod(F.xxhash64(key), F.lit(version.buckets)).cast("string")

    def _write(self, version: Version, rows: DataFrame, touched: list[str] | None, operation: str, batch: tuple[str, int] | None) -> Version:
        """Write rows of the touched buckets (all: None) to a folder of their own, then commit.

        Rows are dealt by bucket; adaptive planning splits large buckets and joins small ones.
        """
        folder = uuid.uuid4().hex
        where = f"{self.root}/data/{folder}"
        schema = StructType.fromJson(json.loads(version.schema))
        have = {f.name: f.dataType for f in rows.schema}
        if lost := additions(schema, rows.schema):
            raise ValueError(f"the table has no {lost[0][0]}: let it evolve first")
        columns = [(shaped(F.col(f"`{f.name}`"), have[f.name], f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema]
        rows.select(*columns).withColumn(BUCKET, self._bucket(version, version.key)).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(where)
        written = [n.split("=", 1)[1] for n in self.storage.names(where) if n.startswith(f"{BUCKET}=")]
        if touched is not None and not set(written) <= set(touched):
            raise ValueError("a change made rows of keys that it did not name")
        kept = {} if touched is None else {b: f for b, f in version.folders.items() if b not in touched}
        batches = version.batches | ({batch[0]: batch[1]} if batch else {})
        return self._commit(Version(version.number + 1, version.schema, version.key, version.buckets, kept | dict.fromkeys(written, folder), batches, operation))

    def _done(self, version: Version, batch: tuple[str, int] | None) -> bool:
        return batch is not None and version.batches.get(batch[0], -1) >= batch[1]

    def overwrite(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> Version:
        """These rows and no others."""
        version = self.version()
        return version if self._done(version, batch) else self._write(version, rows, None, "overwrite", batch)

    def change(self, keys: DataFrame, make: Callable[[DataFrame], DataFrame], operation: str = "change", batch: tuple[str, int] | None = None) -> Version:
        """Replace the buckets that hold the keys by what `make` makes of their rows.

        keys has the table's key column; the buckets they fall into, as many as the table has at most, come to
        the driver. `make` gets all rows of those buckets and returns all that shall be there. `batch`, a stream's name and
        the number of its batch, is kept in the commit: a batch that was committed before changes nothing.
        """
        version = self.version()
        if self._done(version, batch):
            return version
        touched = [r[0] for r in keys.where(F.col(version.key).isNotNull()).select(self._bucket(version, version.key)).distinct().collect()]
        if not touched:
            return self._commit(Version(**(version.__dict__ | {"number": version.number + 1, "operation": operation, "batches": version.batches | {batch[0]: batch[1]}}))) if batch else version
        return self._write(version, make(self._rows(version, touched)), touched, operation, batch)

    def evolve(self, wanted: StructType | str) -> list[tuple[str, str]]:
        """Let the schema grow by what `wanted` has beyond it, at any depth, and return that; no data are rewritten.

        Files of former versions lack the new fields and are read with nulls there. Fields are only added: what `wanted`
        leaves out stays, and another type is refused. The committed schema is compared again: nothing may be left to add.
        """
        version = self.version()
        old = StructType.fromJson(json.loads(version.schema))
        new = self.spark.createDataFrame([], wanted).schema
        added = additions(old, new)
        if added:
            self._commit(Version(**(version.__dict__ | {"number": version.number + 1, "schema": grown(old, new).json(), "operation": "evolve"})))
        if left := additions(self.read().schema, new):
            raise RuntimeError(f"{left[0][0]} was not added")
        return added

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete commits but the last `keep` and all data that none of those name; not while a change is being written."""
        numbers = self.versions()
        last = [self.version(n) for n in numbers[-keep:]]
        for n in numbers[:-keep]:
            self.storage.delete(f"{self.root}/commits/{n:010d}.json")
        named = {f for v in last for f in v.folders.values()}
        gone = [f for f in self.storage.names(f"{self.root}/data") if f not in named]
        for f in gone:
            self.storage.delete(f"{self.root}/data/{f}")
        # of folders that are still named, buckets that newer versions hold elsewhere
        for f in named:
            used = {b for v in last for b, g in v.folders.items() if g == f}
            for n in self.storage.names(f"{self.root}/data/{f}"):
                if n.startswith(f"{BUCKET}=") and n.split("=", 1)[1] not in used:
                    self.storage.delete(f"{self.root}/data/{f}/{n}")
        return gone
