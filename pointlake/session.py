"""Session helpers shared by every subpackage: where shared scratch data goes and how plans are cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what the session names in ``spark.checkpoint.dir``. A local session (one machine) that names
    none gets a temporary folder, which is then set as the checkpoint folder as well; on a cluster a
    missing setting is an error, since executors would write to their own disks.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    sc = spark.sparkContext
    folder = sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="pointlake-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


#: Lists that note each new scratch folder, the innermost last.
_NOTES: list[list[str]] = []


@contextmanager
def scratch_noted() -> Iterator[list[str]]:
    """Gives the list of the scratch folders that are made inside, in their order."""
    made: list[str] = []
    _NOTES.append(made)
    try:
        yield made
    finally:
        _NOTES.pop()
        if _NOTES:
            _NOTES[-1].extend(made)


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new folder under the shared folder, deleted when the driver's virtual machine ends."""
    uri = f"{shared_dir(spark)}/pointlake/{tag}-{uuid.uuid4().hex}"
    path, store = _hadoop(spark, uri)
    store.mkdirs(path)
    store.deleteOnExit(path)
    if _NOTES:
        _NOTES[-1].append(uri)
    return uri


def delete_scratch(spark: SparkSession, uris: Iterable[str]) -> None:
    """Deletes scratch folders that nothing will read again."""
    for uri in uris:
        path, store = _hadoop(spark, uri)
        store.delete(path, True)


def _hadoop(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back.

    Lineage ends at files that outlive any executor; a task that fails is retried and only
    committed files are read. Columns keep their names and types.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.mode("append").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle(spark: SparkSession, make: Callable[[], DataFrame], tag: str) -> tuple[DataFrame, str]:
    """``materialise`` of what ``make`` gives, and its folder; the scratch folders that making it took are deleted."""
    with scratch_noted() as made:
        df = materialise(make(), tag)
        delete_scratch(spark, made[:-1])
        made[:-1] = []
    return df, made[0]


@contextmanager
def _set(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def shuffles_deleted(spark: SparkSession):
    """Inside, the shuffle files of a query are deleted when it ends, not when the driver next collects garbage."""
    return _set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def dealt_once(spark: SparkSession):
    """Inside, rows that are dealt by some of the columns of a join meet without being dealt again by all of them."""
    return _set(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false")


#: Rows that a table may have for Spark to send it whole to the driver and all executors, by its own estimate.
WHOLE_ROWS = 20_000


def apart(df: DataFrame) -> DataFrame:
    """A written table as it is if it is small, else marked so that it meets others by shuffle alone.

    Spark judges a file by its compressed size and an exploded row as one, so tables of millions of rows pass for small
    ones, and building them for a broadcast exhausts the driver.
    """
    return df.hint("merge") if df.count() > WHOLE_ROWS else df


def write_text(spark: SparkSession, uri: str, text: str) -> None:
    write_bytes(spark, uri, text.encode())


def write_bytes(spark: SparkSession, uri: str, body: bytes) -> None:
    """Replaces a small file in any store that the engine knows."""
    path, store = _hadoop(spark, uri)
    out = store.create(path, True)
    try:
        out.write(bytearray(body))
    finally:
        out.close()


def read_text(spark: SparkSession, uri: str) -> str:
    """A small file from any store that the engine knows."""
    return spark.read.text(uri, wholetext=True).first()[0]


def exists(spark: SparkSession, uri: str) -> bool:
    path, store = _hadoop(spark, uri)
    return store.exists(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
