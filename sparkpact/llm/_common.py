"""Shared plumbing of the training-data operators: inputs, scratch tables, Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import shutil
import tempfile
import uuid
from contextlib import contextmanager, suppress
from functools import wraps
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_LOCAL_FALLBACK: dict[str, str] = {}
_MADE: list = []
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
MAX_BATCH_BYTES = 8 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def importable(spark: SparkSession) -> None:
    """Let Python workers of a local run import this package from where the driver has it, and bound Arrow batches by
    bytes: by rows alone, a batch of very long texts could be of any size."""
    known = spark.conf.get(_BATCH_BYTES).rstrip("b")
    if not known.isdigit() or int(known) > MAX_BATCH_BYTES:
        spark.conf.set(_BATCH_BYTES, str(MAX_BATCH_BYTES))
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); a temporary one only in a local run where it is unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not re.match(r"local(\[[^,]*(,\d+)?\])?$", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FALLBACK:
        folder = tempfile.mkdtemp(prefix="sparkpact-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _LOCAL_FALLBACK[app] = f"file://{folder}"
    return _LOCAL_FALLBACK[app]


class Scratch:
    """Written tables in the shared folder: they cut lineage and survive the loss of executors."""

    def __init__(self, spark: SparkSession, owner: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{owner}-{uuid.uuid4().hex}"
        _MADE.append(self)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write and reread a table. The shuffle files of the write go with its end: only the table is read again."""
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(self.path(name))
        finally:
            self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        """Remove a table that no pending plan reads; without a name, the whole folder."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.base)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch_scope():
    """Folders of tables that are made within go at its end: what was built on them must be written by then."""
    before = len(_MADE)
    try:
        yield
    finally:
        while len(_MADE) > before:
            _MADE.pop().drop()


def free_name(columns: list[str], stem: str) -> str:
    """A column name that is not among ``columns``, whatever their case."""
    taken = {c.lower() for c in columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def released(run):
    """A function of Arrow batches whose task gives memory that it no longer uses back to the system at its end: Python
    workers live on, and an executor's memory holds all of them."""

    @wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # glibc only
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def give_back(spark: SparkSession) -> None:
    """Have the driver's JVM collect its garbage, so that a heap that grew over many short stages shrinks again, and
    broadcasts and shuffles that nothing reads go."""
    spark.sparkContext._jvm.System.gc()


def text_runs(batch: pa.RecordBatch, column: str, limit: int = 4 << 20):
    """Yield (start, texts) slices of a batch holding about ``limit`` bytes of text each (one row at least)."""
    texts = batch.column(batch.schema.get_field_index(column)).to_pylist()
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= limit:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


class Seen:
    """Rows that a task has met lately, so that one that a third of all rows repeat is sent once a task."""

    def __init__(self, limit: int = 20_000):
        self.limit, self.keys = limit, set()

    def new(self, key) -> bool:
        if key in self.keys:
            return False
        if len(self.keys) >= self.limit:
            self.keys.clear()
        self.keys.add(key)
        return True


def by_group(df: DataFrame, keys: list[str], fn, out: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    """Rows of ``fn(columns)`` for each group of ``keys``: columns is a dict of lists, fn gives a list of tuples.

    One sorted stream a task in place of one Arrow table a group, which is what many small groups need. A group is
    held in memory whole, so callers bound it. ``out``: (name, Arrow type, SQL type) of the result.
    """
    names = [*keys, *(c for c in df.columns if c not in keys)]

    def rows_of(found):
        columns = list(zip(*found))
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind, _) in zip(columns, out)], [n for n, _, _ in out])

    def run(batches):
        current, held, found = None, None, []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            tags = list(zip(*columns[: len(keys)]))
            begin = 0
            while begin < len(tags):
                end = begin + 1
                while end < len(tags) and tags[end] == tags[begin]:
                    end += 1
                part = [c[begin:end] for c in columns]
                if tags[begin] == current:
                    for a, b in zip(held, part):
                        a.extend(b)
                else:
                    if held is not None:
                        found += fn(dict(zip(names, held)))
                    current, held = tags[begin], part
                begin = end
            if len(found) > 10_000:
                yield rows_of(found)
                found = []
        if held is not None:
            found += fn(dict(zip(names, held)))
        if found:
            yield rows_of(found)

    ordered = df.select(*names).repartition(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(released(run), ", ".join(f"{n} {sql}" for n, _, sql in out))
