"""Written intermediate tables.

Results that several later steps need are written once, as parquet, to the shared
folder the cluster names in ``spark.checkpoint.dir``. A written table cuts lineage,
keeps column pruning and survives lost executors.
"""

from __future__ import annotations

import contextlib
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")

_local_root: dict[str, str] = {}
_tables: dict[tuple, str] = {}
_frames: dict[tuple, object] = {}


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_root:
        _local_root[app] = tempfile.mkdtemp(prefix="weir-")
    return _local_root[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Queries leave no shuffle files behind when they end, rather than when the driver next collects garbage: for
#: steps that write more to shuffles than to the table that is kept.
RELEASED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: The same, with fewer rows in the batches that go to Python: for rows that hold whole texts, or become many.
RELEASED_WIDE = {**RELEASED, "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Queries inside run with these settings of the session; then they are as before."""
    before = {key: spark.conf.get(key) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def once(spark: SparkSession, key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
    """A table built at most once per application; later calls scan what was written."""
    full = (spark.sparkContext.applicationId, *key)
    if full not in _tables:
        path = new_path(spark, "-".join(str(k).strip("/").replace("/", "_") for k in key))
        build().write.parquet(path)
        _tables[full] = path
    return spark.read.parquet(_tables[full])


def stamp(spark: SparkSession, path: str) -> str:
    """A mark of what a table holds now: the names, sizes and times of its files. Part of the key of
    :func:`once`, so that a table that was rewritten is read again."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = fs.listStatus(at)
    marks = sorted(f"{f.getPath().getName()} {f.getLen()} {f.getModificationTime()}" for f in files)
    return hashlib.blake2b("\n".join(marks).encode(), digest_size=8).hexdigest()


def drop_written(spark: SparkSession) -> None:
    """Delete all tables this application has written below the shared folder, and forget them."""
    forget(spark)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/{spark.sparkContext.applicationId}")
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def forget(spark: SparkSession, keep: tuple[str, ...] = ()) -> None:
    """Drop the memory of tables written by :func:`once` and of :func:`remembered` objects (the files stay),
    but for those whose key begins with a name in ``keep``."""
    app = spark.sparkContext.applicationId
    for known in (_tables, _frames):
        for key in [k for k in known if k[0] == app and k[1] not in keep]:
            del known[key]


def remembered(spark: SparkSession, key: tuple, build: Callable[[], T]) -> T:
    """The same object (a DataFrame, a fitted model, a path) for the same key within an
    application, so that what it was built from is written or fitted once."""
    full = (spark.sparkContext.applicationId, *key)
    if full not in _frames:
        _frames[full] = build()
    return _frames[full]
