"""Source readers: files by extension, joins, transforms and user scripts, in that order."""

from __future__ import annotations

import hashlib
import importlib.util
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.plans.spec import MissingTable
from orrery.sources.store import exists, shared_folder

# The types that transforms cast to.
CASTS = {"string": "string", "int32": "int", "int64": "bigint", "float32": "float", "float64": "double", "bool": "boolean"}


@dataclass(frozen=True)
class SourceSpec:
    """A source: a file with options, joins to other files, transforms per column, or a script."""

    path: str | None = None
    script: str | None = None
    delimiter: str | None = None
    encoding: str | None = None
    joins: tuple[dict, ...] = ()
    transforms: dict[str, dict] = field(default_factory=dict)


def resolve(path: str, base: str | None) -> str:
    return path if base is None or "://" in path or os.path.isabs(path) else f"{base.rstrip('/')}/{path}"


def read_file(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str | None = None) -> DataFrame:
    """Parquet, CSV (also .csv.gz and .tsv), ORC, JSON or Arrow files, by extension; Parquet for any other."""
    name = path.lower()
    if name.endswith((".csv", ".csv.gz", ".tsv", ".tsv.gz")):
        separator = delimiter or ("\t" if ".tsv" in name else ",")
        options = {"header": True, "sep": separator, "inferSchema": True} | ({"encoding": encoding} if encoding else {})
        return spark.read.options(**options).csv(path)
    if name.endswith((".arrow", ".ipc", ".feather")):
        return read_arrow(spark, path)
    if name.endswith(".orc"):
        return spark.read.orc(path)
    if name.endswith((".json", ".jsonl")):
        return spark.read.json(path)
    return spark.read.parquet(path)


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """An Arrow IPC file: executors read its bytes through Spark and decode record batches."""
    import pyarrow as pa

    files = spark.read.format("binaryFile").load(path).select("content")

    def open_table(content: bytes):
        buffer = pa.py_buffer(content)
        try:
            return pa.ipc.open_file(buffer).read_all()
        except pa.ArrowInvalid:
            return pa.ipc.open_stream(buffer).read_all()

    # The schema comes from the first file's head; its rows are decoded on executors.
    first = files.first()
    if first is None:
        raise MissingTable(path)
    from pyspark.sql.pandas.types import from_arrow_schema

    schema = from_arrow_schema(open_table(bytes(first["content"])).schema)

    def decode(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                yield from open_table(content).to_batches()

    return files.mapInArrow(decode, schema)


def transform(df: DataFrame, transforms: dict[str, dict]) -> DataFrame:
    """Per column: fill_null first, then cast, which truncates and gives null for what has no value. Columns that the
    table lacks are skipped."""
    for name, spec in transforms.items():
        if name not in df.columns:
            continue
        column = F.col(name)
        if "fill_null" in spec:
            column = F.coalesce(column, F.lit(spec["fill_null"]))
        if "cast" in spec:
            if spec["cast"] not in CASTS:
                raise ValueError(f"unknown type: {spec['cast']}")
            column = column.try_cast(CASTS[spec["cast"]])
        df = df.withColumn(name, column)
    return df


def join_source(df: DataFrame, other: DataFrame, on: str, how: str = "left", columns: list[str] | None = None) -> DataFrame:
    """Equi-join on one common column, left or inner, with a projection of the right side."""
    if how not in ("left", "inner"):
        raise ValueError("joins are left or inner")
    return df.join(other.select(on, *[c for c in columns if c != on]) if columns else other, on, how)


def load_source(spark: SparkSession, spec: SourceSpec, base: str | None = None) -> DataFrame:
    """Script or file, then joins, then transforms."""
    if spec.script:
        df = run_script(spark, resolve(spec.script, base))
    elif spec.path:
        df = read_file(spark, resolve(spec.path, base), spec.delimiter, spec.encoding)
    else:
        raise ValueError("a source needs a path or a script")
    for j in spec.joins:
        df = join_source(df, read_file(spark, resolve(j["path"], base), j.get("delimiter"), j.get("encoding")), j["on"], j.get("how", "left"), j.get("columns"))
    return transform(df, spec.transforms)


def run_script(spark: SparkSession, path: str, cache: bool = True) -> DataFrame:
    """The DataFrame that prepare(spark) of a user's script returns.

    With `cache`, it is written to the shared folder once for each state of the script's file (path, time of change and
    size), and read from there by later loads of this or another session.
    """
    if not cache:
        return _prepared(spark, path)
    state = os.stat(path)
    name = hashlib.sha256(f"{os.path.abspath(path)}:{state.st_mtime_ns}:{state.st_size}".encode()).hexdigest()
    folder = f"{shared_folder(spark)}/orrery-scripts/{name}"
    if not exists(spark, f"{folder}/_SUCCESS"):
        _prepared(spark, path).write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


def _prepared(spark: SparkSession, path: str) -> DataFrame:
    loader = importlib.util.spec_from_file_location("orrery_source_script", path)
    module = importlib.util.module_from_spec(loader)
    loader.loader.exec_module(module)
    if not hasattr(module, "prepare"):
        raise ValueError(f"{path} has no prepare(spark)")
    return module.prepare(spark)


def as_line(df: DataFrame, key: str, columns: dict[str, str] | None = None) -> DataFrame:
    """An entity table: renamed columns, the key as string primary_key, and the system columns if missing."""
    if columns:
        df = df.select(*(F.col(old).alias(new) for new, old in columns.items()))
    df = df.withColumnRenamed(key, "primary_key").withColumn("primary_key", F.col("primary_key").cast("string"))
    defaults = {"version": F.lit(1), "status": F.lit("active"), "created_at": F.lit(None).cast("timestamp"), "changed_at": F.lit(None).cast("timestamp")}
    return df.withColumns({n: c for n, c in defaults.items() if n not in df.columns})


def with_edges(df: DataFrame, relations: dict[str, str]) -> DataFrame:
    """`entity_keys` (one per relation, '' where dead) and `edges` (line, key, status) of rows with relation columns."""
    from orrery.functions.expressions import alive

    keys = [F.when(F.coalesce(alive(F.col(c)), F.lit(False)), F.col(c).cast("string")).otherwise("") for c in relations.values()]
    with_keys = df.withColumn("entity_keys", F.array(*keys))
    return with_keys.withColumn("edges", edges_of(F.col("entity_keys"), list(relations)))


def edges_of(entity_keys, lines: list[str]):
    """Edge structs from positional keys."""
    names = F.array(*map(F.lit, lines))
    return F.zip_with(entity_keys, names, lambda key, line: F.struct(line.alias("line_id"), key.alias("point_key"), F.when(key != "", "alive").otherwise("dead").alias("status")))


def alive_edges(edges):
    """The alive ones of an array of edges."""
    return F.filter(edges, lambda e: e["status"] == "alive")


def jump(edges, line: str, index: int = 0):
    """Key of the n-th alive edge to a line; null if there are fewer."""
    return F.get(F.filter(edges, lambda e: (e["status"] == "alive") & (e["line_id"] == line)), index)["point_key"]


def referring(df: DataFrame, key: str, slot: int | None = None) -> DataFrame:
    """Rows whose entity_keys hold the key, or hold it at one slot."""
    return df.where(F.array_contains("entity_keys", key) if slot is None else F.get("entity_keys", slot) == key)
