"""Datasets: named directories of immutable snapshots with a manifest per version.

Records are dealt to a fixed number of buckets by a hash of their key. A mutation writes anew the buckets that it touches,
the parts of the indexes over them and its change rows, and only then the next manifest, which names them all. A manifest
comes into being at once and fails if another writer was first, so that writers of one dataset never overwrite each other
and no reader sees half a commit. All paths go through Hadoop's file system; it must have an atomic rename that doesn't
overwrite (HDFS has, and on local disks a hard link does the same), which object stores lack.
"""

from __future__ import annotations

import json
import time
import uuid
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field, replace
from functools import reduce
from typing import Any
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellstream.functions.expr import TYPES, Always, CellDefinition, Predicate, checked, define, over, physical, same_record
from cellstream.operators.stream import RecordStream, mutated, without
from cellstream.operators.update import Update
from cellstream.plans.access import StreamPlan, plan_of

ADDITION, MUTATION, DELETION = "ADDITION", "MUTATION", "DELETION"
BUCKET = "__bucket"
#: How often a write of one record starts anew when another writer was first.
RETRIES = 5


class ConcurrentChange(RuntimeError):
    """Another writer committed first; read again and retry."""


class TransactionTimeout(RuntimeError):
    """A transaction was open for longer than it may be."""


class Files:
    """The few file operations of the catalog, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def bytes(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Write a new whole file at once; False if there is one already."""
        fs, p = self._at(path)
        aside = self.jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        try:
            if fs.getUri().getScheme() == "file":
                at = self.jvm.java.io.File(p.toUri().getPath()).toPath()
                self.jvm.java.nio.file.Files.createLink(at, self.jvm.java.io.File(aside.toUri().getPath()).toPath())
            else:
                none = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
                renames = self.jvm.java.lang.reflect.Array.newInstance(none.getClass(), 1)
                renames[0] = none
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.conf).rename(aside, p, renames)
        except Exception:
            if not fs.exists(p):
                raise
            return False
        finally:
            fs.delete(aside, False)
        return True


@dataclass
class Configuration:
    """How a dataset is made. durability: EVENTUAL, EVERY_MUTATION or TIMED (after `durability_millis` at most).

    Every commit here is durable when it returns, which meets each of them; the choice is kept with the dataset.
    """

    buckets: int = 16
    indexes: tuple[CellDefinition, ...] = ()
    durability: str = "EVERY_MUTATION"
    durability_millis: int | None = None
    disk: str | None = None
    offheap: str | None = None

    def __post_init__(self):
        if self.durability not in ("EVENTUAL", "EVERY_MUTATION", "TIMED") or (self.durability == "TIMED") != (self.durability_millis is not None):
            raise ValueError("durability is EVENTUAL, EVERY_MUTATION, or TIMED with its milliseconds")
        if self.buckets < 1:
            raise ValueError("a dataset has one bucket at least")

    @classmethod
    def from_json(cls, text: str) -> Configuration:
        """From an object of these fields, with indexes as a list of {"name", "type"}."""
        told = json.loads(text)
        cells = tuple(define(i["name"], i["type"].lower()) for i in told.pop("indexes", ()))
        return cls(**told, indexes=cells)

    @classmethod
    def from_xml(cls, text: str) -> Configuration:
        """From `<dataset buckets= durability= durability-millis= disk= offheap=><index name= type=/>...</dataset>`."""
        root = ElementTree.fromstring(text)
        told = {k.replace("-", "_"): v for k, v in root.attrib.items()}
        told |= {k: int(told[k]) for k in ("buckets", "durability_millis") if k in told}
        return cls(**told, indexes=tuple(define(i.attrib["name"], i.attrib["type"].lower()) for i in root.findall("index")))

    def told(self) -> dict:
        out = asdict(self)
        out.pop("indexes")
        out.pop("buckets")
        return out


@dataclass
class Index:
    """A sorted copy of the records that have a cell. status: POTENTIAL, INITIALIZING, LIVE, BROKEN or DEAD."""

    cell: str
    status: str
    parts: dict[str, str] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)

    @property
    def records(self) -> int:
        return sum(self.counts.values())


@dataclass
class Dataset:
    spark: SparkSession
    path: str
    files: Files
    outcomes: Counter = field(default_factory=Counter)
    accesses: Counter = field(default_factory=Counter)
    shapes: Counter = field(default_factory=Counter)
    retries: int = RETRIES

    def trying(self) -> Dataset:
        """The same dataset, whose writes of one record fail with `ConcurrentChange` at once instead of trying anew."""
        return replace(self, retries=1)

    # ---- manifest
    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names(f"{self.path}/log") if n.endswith(".json") and n[0] != ".")

    def manifest(self, version: int | None = None) -> dict:
        version = self.versions()[-1] if version is None else version
        return json.loads(self.files.read(f"{self.path}/log/{version:08d}.json"))

    @property
    def key(self) -> str:
        return self.manifest()["key"]

    def _read(self, schema: T.StructType, parts: Iterable[str]) -> DataFrame:
        paths = [f"{self.path}/{p}" for p in parts]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def frame(self, version: int | None = None, told: dict | None = None, buckets: list[int] | None = None) -> DataFrame:
        told = told or self.manifest(version)
        parts = told["parts"]
        return self._read(T.StructType.fromJson(told["schema"]), [p for b, p in sorted(parts.items()) if buckets is None or int(b) in buckets])

    @staticmethod
    def _bucket(told: dict) -> Column:
        return F.pmod(F.xxhash64(F.col(f"`{told['key']}`")), F.lit(told["buckets"])).cast("int")

    def _bucket_of(self, told: dict, key: Any) -> int:
        kind = TYPES[told["kind"]]
        one = self.spark.createDataFrame([(checked(key, told["kind"]),)], T.StructType([T.StructField(told["key"], kind)]))
        return one.select(self._bucket(told)).first()[0]

    def _write(self, rows: DataFrame, told: dict, kind: str) -> dict[str, str]:
        """Write rows by bucket; the folder of each bucket that has some."""
        name = f"{kind}-{uuid.uuid4().hex}"
        rows.write.partitionBy(BUCKET).parquet(f"{self.path}/{name}")
        return {n.split("=")[1]: f"{name}/{n}" for n in self.files.names(f"{self.path}/{name}") if n.startswith(f"{BUCKET}=")}

    def _indexed(self, told: dict, cell: str, buckets: list[int], index: Index) -> Index:
        """`index` with its parts over these buckets written anew."""
        kept = {b: p for b, p in index.parts.items() if int(b) not in buckets}
        counts = {b: n for b, n in index.counts.items() if int(b) not in buckets}
        rows = self.frame(told=told, buckets=buckets)
        if cell not in rows.columns:
            return Index(cell, "LIVE", kept, counts)
        held = rows.where(F.col(f"`{cell}`").isNotNull()).withColumn(BUCKET, self._bucket(told))
        try:
            made = self._write(held.repartition(BUCKET).sortWithinPartitions(BUCKET, f"`{cell}`"), told, "index")
            schema = T.StructType.fromJson(told["schema"])
            found = {b: self._read(schema, [p]).count() for b, p in made.items()}
        except Exception:
            return Index(cell, "BROKEN")
        return Index(cell, "LIVE", kept | made, counts | found)

    def commit(self, rows: DataFrame, buckets: list[int], changes: DataFrame | None, base: dict) -> int:
        """Make `rows` the content of `buckets`, or fail if version `base` isn't the last one any more.

        changes: (key, type) of the records that changed.
        """
        told = base | {"version": base["version"] + 1, "schema": json.loads(rows.schema.json()), "changes": None}
        made = self._write(rows.withColumn(BUCKET, self._bucket(base)), base, "data")
        told["parts"] = {b: p for b, p in base["parts"].items() if int(b) not in buckets} | made
        indexes = {c: self._indexed(told, c, buckets, Index(c, **i)) for c, i in base["indexes"].items()}
        told["indexes"] = {c: {"status": i.status, "parts": i.parts, "counts": i.counts} for c, i in indexes.items()}
        if changes is not None:
            told["changes"] = f"changes-{uuid.uuid4().hex}"
            changes.select(F.col(f"`{base['key']}`").cast("string").alias("key"), "type").write.parquet(f"{self.path}/{told['changes']}")
        return self._set(told, base)

    def _set(self, told: dict, base: dict) -> int:
        if not self.files.create(f"{self.path}/log/{told['version']:08d}.json", json.dumps(told)):
            for folder in self._folders(told) - self._folders(base):
                self.files.delete(f"{self.path}/{folder}")
            raise ConcurrentChange(self.path)
        return told["version"]

    @staticmethod
    def _folders(told: dict) -> set[str]:
        every = [*told["parts"].values(), *(p for i in told["indexes"].values() for p in i["parts"].values()), told.get("changes") or ""]
        return {p.split("/")[0] for p in every if p}

    def retain(self, last: int) -> None:
        """Drop all versions but the last ones, and the folders that none of these names."""
        versions = self.versions()
        kept = set().union(*(self._folders(self.manifest(v)) for v in versions[-last:]))
        for v in versions[:-last]:
            gone = self._folders(self.manifest(v)) - kept
            self.files.delete(f"{self.path}/log/{v:08d}.json")
            for folder in gone:
                self.files.delete(f"{self.path}/{folder}")

    # ---- reads
    def records(self) -> RecordStream:
        return RecordStream(self.frame(), self.key, self._access)

    def _access(self, p: Predicate) -> tuple[DataFrame, StreamPlan]:
        told = self.manifest()
        live = {i.cell: i for i in self._listed(told) if i.status == "LIVE"}
        plan = plan_of(p, {c: i.records for c, i in live.items()})
        self.shapes[f"{plan.kind} {plan.cell or ''} {plan.filter}".strip()] += 1
        if plan.kind == "SKIP":
            return self.frame(told=told).where(F.lit(False)), plan
        if plan.cell:  # a sorted copy, whose row groups the pushed filter prunes
            self.accesses[plan.cell] += 1
            return self._read(T.StructType.fromJson(told["schema"]), live[plan.cell].parts.values()), plan
        return self.frame(told=told), plan

    def stream_shapes(self, most: int = 10) -> list[tuple[str, int]]:
        """The most frequent access paths of this process's streams, and how often each was asked for."""
        return self.shapes.most_common(most)

    def _one(self, key: Any, told: dict) -> DataFrame:
        """The record under a key, from its bucket alone."""
        return self.frame(told=told, buckets=[self._bucket_of(told, key)]).where(F.col(f"`{told['key']}`") == F.lit(key))

    def get(self, key: Any) -> Row | None:
        row = self._one(key, self.manifest()).first()
        self.outcomes["get.found" if row else "get.missing"] += 1
        return row

    def on(self, key: Any, condition: Predicate | None = None) -> Accessor:
        return Accessor(self, key, condition or Always())

    # ---- writes
    def _cells(self, key: Any, cells: tuple[tuple[CellDefinition, Any], ...], told: dict) -> DataFrame:
        if len({c.name for c, _ in cells}) < len(cells):
            raise ValueError("a cell name stands twice")
        schema = T.StructType.fromJson(told["schema"])
        kinds = {f.name: f.dataType.simpleString() for f in schema}
        fields = [schema[told["key"]], *(T.StructField(physical(c.name, c.kind, kinds), TYPES[c.kind]) for c, _ in cells)]
        return self.spark.createDataFrame([(checked(key, told["kind"]), *(checked(v, c.kind) for c, v in cells))], T.StructType(fields))

    def _retried(self, write: Callable[[dict], Any]) -> Any:
        """`write(manifest)`, anew on the newest version when another writer was first."""
        for attempt in range(self.retries):
            try:
                return write(self.manifest())
            except ConcurrentChange:
                if attempt == self.retries - 1:
                    raise

    def add(self, key: Any, *cells: tuple[CellDefinition, Any]) -> bool:
        def write(base: dict) -> bool:
            bucket = self._bucket_of(base, key)
            old, new = self.frame(told=base, buckets=[bucket]), self._cells(key, cells, base)
            there = not old.where(F.col(f"`{base['key']}`") == F.lit(key)).isEmpty()
            self.outcomes["add.existed" if there else "add.success"] += 1
            if not there:
                self.commit(old.unionByName(new, allowMissingColumns=True), [bucket], new.withColumn("type", F.lit(ADDITION)), base)
            return not there

        return self._retried(write)

    def add_all(self, rows: DataFrame) -> int:
        """Insert rows whose key isn't there yet: an anti join, and how many they were. Repeated new keys count once."""
        base = self.manifest()
        key = base["key"]
        old = self.frame(told=base)
        fresh = rows.dropDuplicates([key]).join(old.select(key), key, "left_anti").cache()
        try:
            by_bucket = {r[BUCKET]: r["n"] for r in fresh.groupBy(self._bucket(base).alias(BUCKET)).agg(F.count(F.lit(1)).alias("n")).collect()}
            n = sum(by_bucket.values())
            self.outcomes["add.success" if n else "add.existed"] += 1
            if n:
                held = self.frame(told=base, buckets=list(by_bucket))
                self.commit(held.unionByName(fresh, allowMissingColumns=True), list(by_bucket), fresh.withColumn("type", F.lit(ADDITION)), base)
            return n
        finally:
            fresh.unpersist()

    def upsert(self, key: Any, *cells: tuple[CellDefinition, Any]) -> None:
        def write(base: dict) -> None:
            bucket = self._bucket_of(base, key)
            old, new = self.frame(told=base, buckets=[bucket]), self._cells(key, cells, base)
            own = F.col(f"`{base['key']}`") == F.lit(key)
            there = not old.where(own).isEmpty()
            changes = new.withColumn("type", F.lit(MUTATION if there else ADDITION))
            self.commit(old.where(~own).unionByName(new, allowMissingColumns=True), [bucket], changes, base)

        self._retried(write)

    def _touch(self, p: Predicate, kind: str, new: Callable[[DataFrame], DataFrame]) -> int:
        base = self.manifest()
        old = self.frame(told=base)
        with over(old):
            hit = old.where(p.top())
        by_bucket = {r[BUCKET]: r["n"] for r in hit.groupBy(self._bucket(base).alias(BUCKET)).agg(F.count(F.lit(1)).alias("n")).collect()}
        if by_bucket:
            self.commit(new(self.frame(told=base, buckets=list(by_bucket))), list(by_bucket), hit.withColumn("type", F.lit(kind)), base)
        return sum(by_bucket.values())

    def mutate(self, p: Predicate, update: Update) -> int:
        """Update the records under `p`; how many they were. Buckets without any stay as they are."""
        n = self._touch(p, MUTATION, lambda old: mutated(old, self.key, p, update))
        self.outcomes["update.success" if n else "update.missing"] += 1
        return n

    def delete(self, p: Predicate) -> int:
        n = self._touch(p, DELETION, lambda old: without(old, p))
        self.outcomes["delete.success" if n else "delete.missing"] += 1
        return n

    # ---- indexes: sorted copies of the records that have the cell, by bucket
    def create_index(self, cell: CellDefinition, kind: str = "BTREE") -> Index:
        if kind != "BTREE" or cell.kind == "bytes":
            raise ValueError("only sorted indexes of comparable cells are supported")

        def write(base: dict) -> Index:
            name = physical(cell.name, cell.kind, {f["name"]: T.StructField.fromJson(f).dataType.simpleString() for f in base["schema"]["fields"]})
            made = self._indexed(base, name, [int(b) for b in base["parts"]], Index(name, "INITIALIZING"))
            self._set_indexes(base, base["indexes"] | {name: {"status": made.status, "parts": made.parts, "counts": made.counts}})
            return made

        return self._retried(write)

    def _set_indexes(self, base: dict, indexes: dict) -> None:
        self._set(base | {"version": base["version"] + 1, "indexes": indexes, "changes": None}, base)

    def destroy_index(self, cell: CellDefinition) -> None:
        """Its folders go with the versions that name them."""

        def write(base: dict) -> None:
            if cell.name not in base["indexes"]:
                raise KeyError(cell.name)
            self._set_indexes(base, {c: i for c, i in base["indexes"].items() if c != cell.name})

        self._retried(write)

    @staticmethod
    def _listed(told: dict) -> list[Index]:
        return [Index(c, **i) for c, i in told["indexes"].items()]

    def indexes(self) -> list[Index]:
        return self._listed(self.manifest())

    def live_indexes(self) -> list[Index]:
        return [i for i in self.indexes() if i.status == "LIVE"]

    def index_status(self, cell: CellDefinition) -> str:
        """POTENTIAL where there is none of that cell."""
        return next((i.status for i in self.indexes() if i.cell == cell.name), "POTENTIAL")

    def index(self, cell: CellDefinition) -> IndexView:
        told = self.manifest()
        found = next(i for i in self._listed(told) if i.cell == cell.name)
        return IndexView(self, found, self._read(T.StructType.fromJson(told["schema"]), found.parts.values()))


@dataclass
class IndexView:
    """What an index holds: its statistics, and records by neighbouring values."""

    dataset: Dataset
    index: Index
    frame: DataFrame

    def statistics(self) -> dict[str, int]:
        """Records, bytes, and how many streams of this process read it."""
        size = sum(self.dataset.files.bytes(f"{self.dataset.path}/{p}") for p in self.index.parts.values())
        return {"records": self.index.records, "bytes": size, "accesses": self.dataset.accesses[self.index.cell]}

    def _end(self, rows: DataFrame, last: bool) -> Row | None:
        c = F.col(f"`{self.index.cell}`")
        return rows.orderBy(c.desc() if last else c.asc(), self.dataset.key).first()

    def first(self) -> Row | None:
        return self._end(self.frame, False)

    def last(self) -> Row | None:
        return self._end(self.frame, True)

    def get(self, value: Any) -> list[Row]:
        return self.frame.where(F.col(f"`{self.index.cell}`") == F.lit(value)).orderBy(self.dataset.key).collect()

    def higher(self, value: Any) -> Row | None:
        return self._end(self.frame.where(F.col(f"`{self.index.cell}`") > F.lit(value)), False)

    def lower(self, value: Any) -> Row | None:
        return self._end(self.frame.where(F.col(f"`{self.index.cell}`") < F.lit(value)), True)


@dataclass
class Accessor:
    """One record by key, perhaps under a condition. Each operation works on one snapshot and touches one bucket."""

    dataset: Dataset
    key: Any
    condition: Predicate

    def _where(self, told: dict) -> Predicate:
        own = define(told["key"], told["kind"]).value().is_(self.key)
        return own if isinstance(self.condition, Always) else own & self.condition

    def iff(self, p: Predicate) -> Accessor:
        return Accessor(self.dataset, self.key, p if isinstance(self.condition, Always) else self.condition & p)

    def _rows(self, told: dict) -> DataFrame:
        rows = self.dataset._one(self.key, told)
        with over(rows):
            return rows.where(self._where(told).top())

    def read(self, *columns) -> Row | None:
        return self._rows(self.dataset.manifest()).select(*(columns or ("*",))).first()

    def add(self, *cells: tuple[CellDefinition, Any]) -> Row | None:
        """Add it; or the record that is there already."""
        return None if self.dataset.add(self.key, *cells) else self.dataset.get(self.key)

    def upsert(self, *cells: tuple[CellDefinition, Any]) -> None:
        self.dataset.upsert(self.key, *cells)

    def _write(self, kind: str, new: Callable[[DataFrame, dict], DataFrame]) -> tuple[Row, Row | None] | None:
        def write(base: dict) -> tuple[Row, Row | None] | None:
            before = self._rows(base).first()
            self.dataset.outcomes[f"{'update' if kind == MUTATION else 'delete'}.{'success' if before else 'missing'}"] += 1
            if before is None:
                return None
            bucket = self.dataset._bucket_of(base, self.key)
            rows = new(self.dataset.frame(told=base, buckets=[bucket]), base)
            after = rows.where(F.col(f"`{base['key']}`") == F.lit(self.key)).first()
            self.dataset.commit(rows, [bucket], self._rows(base).withColumn("type", F.lit(kind)), base)
            return before, after

        return self.dataset._retried(write)

    def update(self, update: Update) -> tuple[Row, Row] | None:
        return self._write(MUTATION, lambda rows, told: mutated(rows, told["key"], self._where(told), update))

    def delete(self) -> Row | None:
        done = self._write(DELETION, lambda rows, told: without(rows, self._where(told)))
        return done and done[0]

    def update_if_same(self, record: Row, update: Update) -> tuple[Row, Row] | None:
        """Compare and set: only if the record is still as it was read."""
        return self.iff(same_record(record)).update(update)


class DatasetManager:
    """Datasets under one directory. mode: AUTO (create what is missing), CREATE (must be new) or VALIDATE (must be there)."""

    def __init__(self, spark: SparkSession, root: str, mode: str = "AUTO"):
        self.spark, self.root, self.files = spark, root, Files(spark)
        there = self.files.exists(root)
        if mode == "CREATE" and there or mode == "VALIDATE" and not there:
            raise ValueError(f"{root} {'is' if there else 'is not'} there")

    def new(self, name: str, key: CellDefinition, rows: DataFrame | None = None, configuration: Configuration | None = None) -> bool:
        """False if there is one already. A bucket should fit one task: about 128 MB."""
        if name in self.list():
            return False
        if key.kind == "bytes":
            raise ValueError("bytes can't be a key")
        own = configuration or Configuration()
        df = rows if rows is not None else self.spark.createDataFrame([], T.StructType([T.StructField(key.name, TYPES[key.kind], False)]))
        told = {"version": 1, "key": key.name, "kind": key.kind, "buckets": own.buckets, "schema": json.loads(df.schema.json()), "indexes": {}, "changes": None, "options": own.told()}
        dataset = Dataset(self.spark, f"{self.root}/{name}", self.files)
        held = df.withColumn(BUCKET, dataset._bucket(told))
        told["parts"] = dataset._write(held.repartition(own.buckets, BUCKET), told, "data") if rows is not None else {}
        made = self.files.create(f"{self.root}/{name}/log/00000001.json", json.dumps(told))
        if made:
            for cell in own.indexes:
                dataset.create_index(cell)
        return made

    def get(self, name: str, kind: str | None = None) -> Dataset:
        if name not in self.list():
            raise KeyError(name)
        dataset = Dataset(self.spark, f"{self.root}/{name}", self.files)
        if kind and dataset.manifest()["kind"] != kind:
            raise TypeError(f"the key of {name} is no {kind}")
        return dataset

    def list(self) -> list[str]:
        return [n for n in self.files.names(self.root) if any(x.endswith(".json") and x[0] != "." for x in self.files.names(f"{self.root}/{n}/log"))]

    def destroy(self, name: str) -> bool:
        there = name in self.list()
        self.files.delete(f"{self.root}/{name}")
        return there


class Transaction:
    """Reads what was committed before it began and its own writes; commits all its datasets or fails before the first.

    It fails too if it is open for longer than `timeout` seconds.
    """

    def __init__(self, timeout: float = 15.0, **datasets: Dataset):
        self.until = time.monotonic() + timeout
        self.datasets, self.base = datasets, {n: d.manifest() for n, d in datasets.items()}
        self.frames = {n: d.frame(told=self.base[n]) for n, d in datasets.items()}
        self.changes: dict[str, list[DataFrame]] = {n: [] for n in datasets}

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.commit()
        else:
            self.rollback()

    def read(self, name: str) -> DataFrame:
        return self.frames[name]

    def records(self, name: str) -> RecordStream:
        return RecordStream(self.frames[name], self.base[name]["key"])

    def _changed(self, name: str, rows: DataFrame, kind: str) -> None:
        key = self.base[name]["key"]
        self.changes[name].append(rows.select(F.col(f"`{key}`"), F.lit(kind).alias("type"), F.lit(len(self.changes[name])).alias("nth")))

    def _hit(self, name: str, p: Predicate) -> DataFrame:
        with over(self.frames[name]):
            return self.frames[name].where(p.top())

    def add(self, name: str, key: Any, *cells: tuple[CellDefinition, Any]) -> bool:
        base = self.base[name] | {"schema": json.loads(self.frames[name].schema.json())}
        if not self.frames[name].where(F.col(f"`{base['key']}`") == F.lit(key)).isEmpty():
            return False
        new = self.datasets[name]._cells(key, cells, base)
        self._changed(name, new, ADDITION)
        self.frames[name] = self.frames[name].unionByName(new, allowMissingColumns=True)
        return True

    def mutate(self, name: str, p: Predicate, update: Update) -> None:
        self._changed(name, self._hit(name, p), MUTATION)
        self.frames[name] = mutated(self.frames[name], self.base[name]["key"], p, update)

    def delete(self, name: str, p: Predicate) -> None:
        self._changed(name, self._hit(name, p), DELETION)
        self.frames[name] = without(self.frames[name], p)

    def commit(self) -> None:
        if time.monotonic() > self.until:
            self.rollback()
            raise TransactionTimeout
        written = sorted(n for n, c in self.changes.items() if c)
        for n in written:
            if self.datasets[n].manifest()["version"] != self.base[n]["version"]:
                raise ConcurrentChange(n)
        for n in written:
            dataset, base = self.datasets[n], self.base[n]
            changes = reduce(DataFrame.union, self.changes[n])
            # one change a record: its last one, or an addition that was changed on
            last = changes.groupBy(f"`{base['key']}`").agg(F.max_by("type", "nth").alias("last"), F.min_by("type", "nth").alias("first"))
            last = last.where(~((F.col("first") == ADDITION) & (F.col("last") == DELETION)))
            kind = F.when((F.col("first") == ADDITION) & (F.col("last") == MUTATION), ADDITION).when((F.col("first") == DELETION) & (F.col("last") == ADDITION), MUTATION).otherwise(F.col("last"))
            bucket = dataset._bucket(base)
            touched = [r[0] for r in changes.select(bucket).distinct().collect()]  # as many as buckets at most
            if touched:
                dataset.commit(self.frames[n].where(bucket.isin(touched)), touched, last.withColumn("type", kind), base)
        self.rollback()

    def rollback(self) -> None:
        """Forget all writes."""
        self.changes = {n: [] for n in self.datasets}
        self.frames = {n: d.frame(told=self.base[n]) for n, d in self.datasets.items()}
