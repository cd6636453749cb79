"""Stored tables that are changed by snapshots: new files first, then one manifest that names the files of every table.

A table's rows lie in hashed buckets of its key, so one key's rows are found in one bucket and replaced by rewriting that
bucket alone. Files are never changed. Each state of the folder is a manifest, `manifests/<version>.json`, with the
directories of every bucket of every table; a change becomes visible when its manifest is renamed into place, which fails
if another change took that version first. Readers go on with the version they began with. A change that fails deletes what
it wrote; what a lost driver leaves behind is named by no manifest, and `vacuum` deletes it.

    store = Store(spark, path)
    with store.change() as c:
        c.create("pages", "doc_id long, page_no int, text string", key="doc_id")
        c.replace("pages", rows)
    store.read("pages"), store.read_key("pages", 7), store.read("pages", version=1)
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

BUCKETS = 64
#: Directories of one bucket before compact() joins them.
MOST_PIECES = 8
#: Which batch a row came with; readers don't see it.
BATCH = "_batch"


class Conflict(RuntimeError):
    """Another change was committed since this one began."""


class Store:
    """The tables in a folder that Spark can write to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # files, by the file system that the path names

    def _at(self, path: str):
        """(Hadoop's file system, its path) of a path."""
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def _put(self, path: str, text: str) -> None:
        """Writes a file whole: under another name, then renamed. FileExistsError if there is one."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        fs, draft = self._at(f"{path}.{uuid.uuid4()}.draft")
        out = fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        _, target = self._at(path)
        kinds = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(draft), fs.makeQualified(target), kinds)
        except Exception as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                raise FileExistsError(path) from e
            raise

    # states

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self._names(f"{self.path}/manifests") if n.endswith(".json") and n[:-5].isdigit()]

    @property
    def version(self) -> int:
        """The newest version; 0 before the first change."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """{table: {schema, key, buckets, files: {bucket: [directories]}}} of a version."""
        n = self.version if version is None else version
        if n == 0:
            return {}
        if n not in self.versions():
            raise FileNotFoundError(f"{self.path} has no version {n}")
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{n:012}.json", wholetext=True).first()[0])

    def tables(self, version: int | None = None) -> list[str]:
        return sorted(self.manifest(version))

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as it is now, or as it was. FileNotFoundError if there is no such table."""
        return self._rows(name, self._table(name, version)).drop(BATCH)

    def read_key(self, name: str, value: object, version: int | None = None) -> DataFrame:
        """The rows of one key: only its bucket is read."""
        table = self._table(name, version)
        kind = _schema(table)[table["key"]].dataType
        bucket = self.spark.range(1).select(_bucket(F.lit(value).cast(kind), table["buckets"])).first()[0]
        return self._rows(name, table, [str(bucket)]).where(F.col(table["key"]).eqNullSafe(F.lit(value).cast(kind))).drop(BATCH)

    def read_keys(self, name: str, keys: DataFrame, version: int | None = None) -> DataFrame:
        """The buckets of these keys (one column): all rows of the keys, and others that share their buckets."""
        table = self._table(name, version)
        key = F.col(keys.columns[0]).cast(_schema(table)[table["key"]].dataType)
        buckets = [str(r[0]) for r in keys.select(_bucket(key, table["buckets"])).distinct().collect()]  # as many as buckets at most
        return self._rows(name, table, buckets).drop(BATCH)

    def _table(self, name: str, version: int | None = None) -> dict:
        tables = self.manifest(version)
        if name not in tables:
            raise FileNotFoundError(f"{self.path} has no table {name}")
        return tables[name]

    def _rows(self, name: str, table: dict, buckets: list[str] | None = None) -> DataFrame:
        """Rows of a table's buckets, with the column BATCH."""
        schema = _schema(table)
        kept = table["files"] if buckets is None else {b: table["files"].get(b, ()) for b in buckets}
        paths = [f"{self.path}/data/{name}/{d}/bucket={b}" for b, dirs in kept.items() for d in dirs]
        schema = StructType([*schema.fields, StructField(BATCH, StringType())])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def change(self) -> Change:
        """A change of this folder, for a with statement: all of it is committed at the end, or nothing."""
        return Change(self)

    def vacuum(self, keep: int = 2, older_than: float = 86_400) -> int:
        """Deletes all but the newest versions, and directories older than so many seconds that no kept version names; how many of these."""
        for n in self.versions()[:-keep]:
            self._delete(f"{self.path}/manifests/{n:012}.json")
        used = {(t, d) for n in self.versions() for t, table in self.manifest(n).items() for dirs in table["files"].values() for d in dirs}
        gone, before = 0, (time.time() - older_than) * 1000
        for name in self._names(f"{self.path}/data"):
            for d in self._names(f"{self.path}/data/{name}"):
                fs, p = self._at(f"{self.path}/data/{name}/{d}")
                if (name, d) not in used and fs.getFileStatus(p).getModificationTime() <= before:
                    fs.delete(p, True)
                    gone += 1
        return gone


class Change:
    """What will be the next version. Each method writes files; commit() alone makes them count."""

    def __init__(self, store: Store):
        self.store, self.base = store, store.version
        self.tables = store.manifest(self.base)
        self.written: list[str] = []
        self.changed = False

    def __enter__(self) -> Change:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind is None:
            self.commit()
        else:
            self.undo()

    def create(self, name: str, schema: str | StructType, key: str, buckets: int = BUCKETS) -> None:
        """A new, empty table; one that is there with the same columns and key stays as it is."""
        fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        if BATCH in fields.names or "bucket" in fields.names or key not in fields.names:
            raise ValueError(f"{name}: the columns {BATCH} and bucket are taken, the key has to be a column")
        new = {"schema": json.loads(fields.json()), "key": key, "buckets": buckets, "files": {}}
        old = self.tables.get(name)
        if old is None:
            self.tables[name], self.changed = new, True
        elif _schema(old).simpleString() != fields.simpleString() or old["key"] != key:
            raise ValueError(f"{name} is there with other columns or another key")

    def replace(self, name: str, rows: DataFrame) -> DataFrame:
        """The rows of the keys in it take the place of all that these keys had; other keys stay. No key counts as a key, too.

        Returns the rows, as they are written.
        """
        table = self._table(name)
        new = self._write(name, rows)
        fresh = self.store._rows(name, table | {"files": {b: [d] for b, d in new.items()}})
        self._without(name, table, list(new), fresh.select(table["key"]).distinct())
        self._add(table, new)
        return fresh.drop(BATCH)

    def add(self, name: str, rows: DataFrame) -> None:
        """Rows come in as they are, worked out once; if they are sent again, they are there twice."""
        table = self._table(name)
        self._add(table, self._write(name, rows))

    def delete(self, name: str, keys: DataFrame) -> None:
        """The rows of these keys (a column of the key's name) go."""
        table = self._table(name)
        key = table["key"]
        keys = keys.select(F.col(key).cast(_schema(table)[key].dataType).alias(key)).distinct()
        buckets = [str(r[0]) for r in keys.select(_bucket(F.col(key), table["buckets"])).distinct().collect()]  # as many as buckets at most
        self._without(name, table, buckets, keys)

    def append(self, name: str, rows: DataFrame, batch: str, row: list[str]) -> None:
        """Rows come in, each once: those whose batch and row columns are there already, or that come twice, add nothing.

        So a batch may be sent again, in whole or in part, after a failure. Only the buckets of its keys are looked through.
        """
        table = self._table(name)
        rows = self._cast(table, rows)
        buckets = [str(r[0]) for r in rows.select(_bucket(F.col(table["key"]), table["buckets"])).distinct().collect()]  # as many as buckets at most
        known = self.store._rows(name, table, buckets).where(F.col(BATCH) == batch).select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(row)))
        same = [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(row)]
        self._add(table, self._write(name, rows.dropDuplicates(row).join(known, same, "left_anti"), batch))

    def compact(self, name: str, most: int = MOST_PIECES) -> None:
        """Buckets of more than so many directories are written anew as one."""
        table = self._table(name)
        many = [b for b, dirs in table["files"].items() if len(dirs) > most]
        if many:
            written = self._write(name, self.store._rows(name, table, many), keep_batch=True)
            table["files"] |= {b: [written[b]] if b in written else [] for b in many}
            self.changed = True

    def commit(self) -> int:
        """The new version; the old one if nothing has changed. Conflict if another change came first, and this one is undone."""
        if not self.changed:
            self.undo()
            return self.base
        try:
            self._switch(self.base + 1)
        except FileExistsError as e:
            self.undo()
            raise Conflict(f"{self.store.path} has a version {self.base + 1} already") from e
        except BaseException:
            self.undo()
            raise
        return self.base + 1

    def undo(self) -> None:
        for path in self.written:
            self.store._delete(path)
        self.written = []

    def _switch(self, version: int) -> None:
        self.store._put(f"{self.store.path}/manifests/{version:012}.json", json.dumps(self.tables))

    def _table(self, name: str) -> dict:
        if name not in self.tables:
            raise FileNotFoundError(f"{self.store.path} has no table {name}")
        return self.tables[name]

    def _cast(self, table: dict, rows: DataFrame) -> DataFrame:
        return rows.select(*(rows[f.name].cast(f.dataType).alias(f.name) for f in _schema(table)))

    def _write(self, name: str, rows: DataFrame, batch: str | None = None, keep_batch: bool = False) -> dict[str, str]:
        """Writes rows by bucket into a new directory; {bucket: directory}. A large bucket is written by several tasks."""
        table = self._table(name)
        d = str(uuid.uuid4())
        path = f"{self.store.path}/data/{name}/{d}"
        self.written.append(path)
        own = rows if keep_batch else self._cast(table, rows).withColumn(BATCH, F.lit(batch).cast("string"))
        own = own.withColumn("bucket", _bucket(F.col(table["key"]), table["buckets"])).hint("rebalance", F.col("bucket"))
        own.write.partitionBy("bucket").parquet(path)
        return {n.removeprefix("bucket="): d for n in self.store._names(path) if n.startswith("bucket=")}

    def _add(self, table: dict, written: dict[str, str]) -> None:
        for b, d in written.items():
            table["files"].setdefault(b, []).append(d)
            self.changed = True

    def _without(self, name: str, table: dict, buckets: list[str], keys: DataFrame) -> None:
        """Writes these buckets anew without the rows of keys."""
        held = [b for b in buckets if table["files"].get(b)]
        if not held:
            return
        key = table["key"]
        keys = keys.withColumnRenamed(key, "_key")
        kept = self.store._rows(name, table, held).join(keys, F.col(key).eqNullSafe(F.col("_key")), "left_anti")
        written = self._write(name, kept, keep_batch=True)
        table["files"] |= {b: [written[b]] if b in written else [] for b in held}
        self.changed = True


def _schema(table: dict) -> StructType:
    return StructType.fromJson(table["schema"])


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
