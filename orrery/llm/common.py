"""Plumbing shared by the training-data operators: tables, written intermediates, worker-side state."""

from __future__ import annotations

import re
import sys
import tempfile
import types
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blanks of the word rule: U+0020 and U+0009 to U+000D.
BLANK_CLASS = "[\\x20\\x09-\\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workspace(spark: SparkSession) -> str:
    """A new folder for written intermediates below spark.checkpoint.dir, which driver and executors share.

    Where the setting is unset, only a session in local mode gets a folder of its own; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="orrery-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/orrery-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write df once as a table in the shared folder and read it back.

    It cuts the lineage like checkpoint(), but runs the plan once and stores columns compressed. A lost executor
    costs its running tasks only. The folder goes when the session's file system closes.
    """
    spark = df.sparkSession
    path = workspace(spark)
    df.write.parquet(path)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.read.schema(df.schema).parquet(path)


def planned_partitions(df: DataFrame, size: int) -> int:
    """Partitions of about `size` bytes by the optimiser's estimate, which for a scan comes from its files' sizes; no job runs.

    One a core at least, and spark.sql.shuffle.partitions where the optimiser knows nothing of the size.
    """
    spark = df.sparkSession
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = estimate < 1 << 60
    return max(spark.sparkContext.defaultParallelism, -(-estimate // size) if known else int(spark.conf.get("spark.sql.shuffle.partitions")))


def worker_state(key: str, build: Callable[[], object], version: str = ""):
    """What `build` makes, once per Python worker process; workers are reused between tasks. The last version stays.

    What other operators have left there goes first; keys of one operator begin alike, the shortest being all others' beginning.
    """
    store = sys.modules.setdefault("_orrery_worker_state", types.ModuleType("_orrery_worker_state")).__dict__
    if store.get(key, (None,))[0] != version:
        for other in [k for k in store if not (k.startswith("__") or k.startswith(key) or key.startswith(k))]:
            del store[other]
        store[key] = (version, build())
    return store[key][1]


def forget_worker_state() -> None:
    """Drop what operators have left in this Python worker; for operators that remember nothing themselves."""
    sys.modules.pop("_orrery_worker_state", None)


class RecentCache(dict):
    """A dict that computes what is missing and keeps the two latest generations of `half` entries at most."""

    def __init__(self, compute: Callable, half: int):
        super().__init__()
        self.compute, self.half, self.old = compute, half, {}

    def __missing__(self, key):
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self[key] = value
        return value


def utf8(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    return column.cast(pa.large_binary()).to_pylist()


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def shipped_file(spark: SparkSession, path: str):
    """A vocabulary file, read by the driver and broadcast; such files have a fixed size of a few MB."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def free_name(name: str, taken: list[str]) -> str:
    """The name, with more underscores if a column has it (in any case, as Spark compares names)."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` with `value` bound as a lambda variable, so a lambda inside it reads the value and never recomputes it."""
    return F.transform(F.array(value), body)[0]


def word_array(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text; null gives none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{BLANK_CLASS}+"), "")


def text_parts(batches, column: int = 1, most: int = 8 << 20):
    """The batches' rows in slices of about `most` bytes of text, so memory does not follow the batch size."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = max(1, int(batch.num_rows * most // max(most, batch.column(column).nbytes)))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
