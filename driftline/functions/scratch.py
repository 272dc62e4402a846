"""Written tables in the folder that all executors share, and joins whose broadcast side has a proven size."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a join side that may be broadcast; a larger side is shuffled.
BROADCAST_ROWS = 20_000
#: A key with fewer rows than this is never treated as hot.
LEAST_HOT = 500

_scopes: list[list[tuple[SparkSession, str]]] = [[]]
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one where that is unset, but only in a local session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="driftline-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def fresh_path(spark: SparkSession, name: str, outlives: bool = False) -> str:
    """A new path in the shared folder; it is removed when the innermost scope ends (or, if it ``outlives`` that, the
    one around it), at the latest with the program."""
    path = f"{shared_dir(spark)}/driftline-{name}-{uuid.uuid4().hex}"
    _scopes[max(-2, -len(_scopes)) if outlives else -1].append((spark, path))
    return path


def materialize(df: DataFrame, name: str, outlives: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there and lost executors cost nothing."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name, outlives)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(table: DataFrame) -> None:
    """Remove a table that ``materialize`` returned and that nothing reads any more."""
    if (path := _paths.pop(table, None)) is not None:
        _remove(table.sparkSession, path)
        for scope in _scopes:
            scope[:] = [x for x in scope if x[1] != path]


@contextmanager
def scratch() -> Iterator[None]:
    """Tables written inside the block are removed at its end, so its results have to be written or collected there."""
    _scopes.append([])
    try:
        yield
    finally:
        for spark, path in _scopes.pop():
            _remove(spark, path)


@atexit.register
def _sweep() -> None:
    for scope in _scopes:
        for spark, path in scope:
            try:
                _remove(spark, path)
            except Exception:  # the JVM may be gone already
                return


def checked(side: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``side`` with a broadcast hint if it has at most ``limit`` rows, else unchanged (a shuffled join)."""
    return F.broadcast(side) if len(side.limit(limit + 1).select(F.lit(1)).collect()) <= limit else side


def join_hot(rows: DataFrame, per_key: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` joined with ``per_key``, which has one row a key and in ``count`` the key's number of rows.

    ``total`` is the sum of the counts. Fewer than BROADCAST_ROWS keys can hold more than total / BROADCAST_ROWS rows
    each; these are broadcast, so a hot key's rows stay where they are, and only the other keys are shuffled.
    """
    limit = max(LEAST_HOT, total // BROADCAST_ROWS)
    if total <= limit:
        return rows.join(per_key, key)
    hot = F.broadcast(per_key.filter(F.col(count) > limit))
    cold = rows.join(F.broadcast(per_key.filter(F.col(count) > limit).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(cold.join(per_key.filter(F.col(count) <= limit), key))
