"""Written tables: intermediates of iterative operators, and a store of versioned tables with a manifest."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.plans.spec import CorruptedTable, MissingTable, VersionError

FORMAT_VERSION = 1


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; a local session without the setting gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="orrery-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _file_system(spark, path)
    return fs.exists(hadoop_path)


def materialise(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/orrery-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, hadoop_path = _file_system(spark, path)
    fs.deleteOnExit(hadoop_path)
    return spark.read.schema(df.schema).parquet(path)


class Store:
    """Versioned tables under a root: `<layer>/<name>/part=<n>`, immutable once written, and manifests.

    A version is a list of parts: writing makes a version of one new part, appending a version of the current parts and a
    new one, so nothing is rewritten. Each state of the store is a manifest of its own, `manifest/<number>.json`, which is
    created by renaming a file onto a name that must not exist: of two writers one wins and the other tries again on top
    of what it finds, and readers always see whole manifests. A session pins the state it starts with.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def read_text(self, path: str) -> str | None:
        fs, hadoop_path = _file_system(self.spark, path)
        if not fs.exists(hadoop_path):
            return None
        stream = fs.open(hadoop_path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, path: str, text: str, replace: bool = True) -> bool:
        """Write aside and rename into place in one step; without `replace`, False if the path exists."""
        _, target = _file_system(self.spark, path)
        fs, aside = _file_system(self.spark, f"{path}.{uuid.uuid4().hex}")
        fs.mkdirs(target.getParent())
        stream = fs.create(aside)
        stream.write(bytearray(text.encode()))
        stream.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self.spark._jsc.hadoopConfiguration())
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE if replace else rename.NONE
        try:
            context.rename(aside, target, options)
        except Py4JJavaError as error:
            fs.delete(aside, False)
            if not replace and error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise
        return True

    def _state(self) -> int:
        """Number of the latest manifest, 0 without any."""
        fs, folder = _file_system(self.spark, f"{self.root}/manifest")
        if not fs.exists(folder):
            return 0
        return max((int(m[1]) for f in fs.listStatus(folder) if (m := re.fullmatch(r"(\d+)\.json", f.getPath().getName()))), default=0)

    def manifest(self) -> dict:
        """format, and for each table `layer/name` its versions as lists of parts, the last of which is current."""
        return self._manifest(self._state())

    def _manifest(self, state: int) -> dict:
        text = self.read_text(f"{self.root}/manifest/{state}.json") if state else None
        if text is None:
            return {"format": FORMAT_VERSION, "tables": {}}
        try:
            found = json.loads(text)
        except ValueError as error:
            raise CorruptedTable("the manifest is not JSON") from error
        if found.get("format") != FORMAT_VERSION:
            raise VersionError(f"format {found.get('format')} is not supported")
        return found

    def _commit(self, table: str, part: str, keep: bool, expected: int | None = None) -> int:
        """Make a version of the part, after the current parts if `keep`; a CorruptedTable if the table has moved on from `expected`."""
        while True:
            state = self._state()
            manifest = self._manifest(state)
            versions = manifest["tables"].setdefault(table, [])
            if expected is not None and len(versions) != expected:
                raise CorruptedTable(f"{table} was changed meanwhile")
            versions.append([*(versions[-1] if keep and versions else []), part])
            if self.write_text(f"{self.root}/manifest/{state + 1}.json", json.dumps(manifest, sort_keys=True), replace=False):
                return len(versions)

    def _write_part(self, table: str, df: DataFrame, partition_by: list[str] | None, sort_by: list | None) -> str:
        part = f"part={uuid.uuid4().hex}"
        if sort_by:
            df = df.sortWithinPartitions(*sort_by)
        writer = df.write
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.root}/{table}/{part}")
        return part

    def write(self, layer: str, name: str, df: DataFrame, partition_by: list[str] | None = None, sort_by: list | None = None, expected: int | None = None) -> int:
        """Write a new version and make it current; with `expected`, only if that is the number of versions so far."""
        table = f"{layer}/{name}"
        return self._commit(table, self._write_part(table, df, partition_by, sort_by), False, expected)

    def append(self, layer: str, name: str, rows: DataFrame, partition_by: list[str] | None = None) -> int:
        """A new version with the rows after the current ones, which are not touched."""
        table = f"{layer}/{name}"
        return self._commit(table, self._write_part(table, rows, partition_by, None), True)

    def versions(self, layer: str, name: str) -> int:
        return len(self.manifest()["tables"].get(f"{layer}/{name}", []))

    def read(self, layer: str, name: str, version: int | None = None, manifest: dict | None = None) -> DataFrame:
        found = (manifest or self.manifest())["tables"].get(f"{layer}/{name}", [])
        if not 1 <= (version or len(found)) <= len(found):
            raise MissingTable(f"{layer}/{name}, version {version}")
        parts = [f"{self.root}/{layer}/{name}/{p}" for p in found[(version or len(found)) - 1]]
        for part in parts:
            if not exists(self.spark, part):
                raise MissingTable(part)
        # Parts are read one by one, so each finds its own partition columns.
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(self.spark.read.parquet, parts))

    def upsert(self, layer: str, name: str, rows: DataFrame, key: str) -> int:
        """A new version with the rows in place of those with their keys; plainly appended where no key is known yet."""
        old = self.read(layer, name)
        if not old.join(rows.select(key).distinct(), key, "left_semi").take(1):
            return self.append(layer, name, rows)
        return self.write(layer, name, upserted(old, rows, key))

    def append_geometry(self, name: str, rows: DataFrame, key: str) -> int:
        """Upsert entities of a population and rank all of them anew."""
        from orrery.operators.quantiles import with_global_rank

        merged = upserted(self.read("geometry", name), rows, key).withColumn("__norm", F.round("norm", 9))
        ranked = with_global_rank(merged, "__norm", "__below", "__rows")
        return self.write("geometry", name, ranked.withColumn("delta_rank_pct", F.col("__below") / F.col("__rows") * 100).drop("__norm", "__below", "__rows"))

    def append_temporal(self, name: str, slices: DataFrame, agent: str | None = None) -> int:
        """Append slices, as those of an agent or of all; `agent_id` is null for the latter."""
        return self.append("temporal", name, slices.withColumn("agent_id", F.lit(agent).cast("string")))

    def purge_temporal(self, name: str, agent: str | None = None) -> int:
        """A new version without an agent's slices, or without those of any agent."""
        kept = F.col("agent_id").isNull() if agent is None else ~F.col("agent_id").eqNullSafe(F.lit(agent))
        return self.write("temporal", name, self.read("temporal", name).where(kept))

    def compact_temporal(self, name: str, key: str, order: str = "slice", rows_a_file: int = 1_000_000) -> int:
        """A new version of the same slices in few files, each with whole entities in order of time."""
        own = self.read("temporal", name)
        files = max(1, -(-own.count() // rows_a_file))
        return self.write("temporal", name, own.repartitionByRange(files, key), sort_by=[key, order])

    def delete(self, layer: str, name: str, keys: DataFrame, key: str) -> int:
        return self.write(layer, name, self.read(layer, name).join(keys.select(F.col(keys.columns[0]).alias(key)).distinct(), key, "left_anti"))

    def compact(self, layer: str, name: str, files: int = 1) -> int:
        """A new version of the current rows in so many files."""
        return self.write(layer, name, self.read(layer, name).coalesce(files))

    def batches(self, layer: str, name: str, columns: list[str] | None = None, rows: int = 10_000):
        """The current rows as Arrow batches of at most `rows`, one partition at a time, for readers outside Spark."""
        import pyarrow as pa

        own = self.read(layer, name)
        own = own.select(*columns) if columns else own
        names = own.columns
        waiting: list = []
        for row in own.toLocalIterator():
            waiting.append(row)
            if len(waiting) == rows:
                yield pa.RecordBatch.from_pylist([r.asDict() for r in waiting]).select(names)
                waiting = []
        if waiting:
            yield pa.RecordBatch.from_pylist([r.asDict() for r in waiting]).select(names)

    def write_json(self, name: str, value: dict) -> None:
        self.write_text(f"{self.root}/meta/{name}.json", json.dumps(value, sort_keys=True))

    def read_json(self, name: str) -> dict:
        text = self.read_text(f"{self.root}/meta/{name}.json")
        if text is None:
            raise MissingTable(name)
        return json.loads(text)

    def session(self) -> Session:
        return Session(self, self.manifest())


class Session:
    """A snapshot: tables are read at the versions that were current when it began."""

    def __init__(self, store: Store, manifest: dict):
        self.store, self.manifest = store, manifest

    def read(self, layer: str, name: str) -> DataFrame:
        return self.store.read(layer, name, manifest=self.manifest)

    def __enter__(self) -> Session:
        return self

    def __exit__(self, *_) -> None:
        self.manifest = {"tables": {}}


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows whose key is not among the new ones, and the new rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)
